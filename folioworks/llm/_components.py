"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import discard, written

#: A node of more edges than this is hot: its edges are joined with its minimum in so many parts
HOT, SALTS = 1 << 20, 64


def components(edges: DataFrame, hot: int = HOT) -> DataFrame:
    """(node, label) for each node of ``edges`` (a, b): label is the least node that it is linked with.

    Each round keeps at most as many edges as there were.  Minima are summed before the
    shuffle, and the edges of a node of more than ``hot`` are salted before they meet its
    minimum, so that no star's centre is a hot group.  A round's edges are a written table.  The
    rounds end when one changes nothing.
    """
    now = written(_canonical(edges), "edges")
    mark = _mark(now)
    while True:
        before, now = now, written(_small(_large(now, hot), hot), "edges")
        discard(before)
        new = _mark(now)
        if new == mark:
            break
        mark = new
    stars = now.select(F.col("a").alias("label"), F.col("b").alias("node"))
    return stars.unionByName(stars.select("label", F.col("label").alias("node")).distinct()).select("node", "label")


def _canonical(e: DataFrame) -> DataFrame:
    return e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1000003)).head())


def _met(rows: DataFrame, minima: DataFrame, hot: int) -> DataFrame:
    """``rows`` (u, v) with the minimum m of u, from ``minima`` (u, m, n rows); hot nodes in SALTS parts."""
    many: Column = F.col("n") > hot
    # one row for each hot node: at most the number of edges / hot
    crowded = F.broadcast(minima.where(many).select("u", F.lit(True).alias("many")))
    salted = rows.join(crowded, "u", "left").select("u", "v", F.when(F.col("many"), F.pmod(F.xxhash64("v"), F.lit(SALTS))).otherwise(0).cast("int").alias("salt"))
    parts = F.when(many, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(minima.select("u", "m", F.explode(parts).alias("salt")), ["u", "salt"]).select("u", "v", "m")


def _large(e: DataFrame, hot: int) -> DataFrame:
    """Each node's larger neighbours are linked with the least of its neighbours and itself."""
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    minima = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    return _canonical(_met(both.where("v > u"), minima, hot).select(F.col("m").alias("a"), F.col("v").alias("b")))


def _small(e: DataFrame, hot: int) -> DataFrame:
    """Each node and its smaller neighbours are linked with the least of them."""
    rows = e.select(F.col("b").alias("u"), F.col("a").alias("v"))
    minima = rows.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    met = _met(rows, minima, hot)
    return _canonical(met.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(met.select(F.col("m").alias("a"), F.col("u").alias("b"))))
