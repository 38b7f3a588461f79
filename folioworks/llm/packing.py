"""Best-fit packing of documents into sequences of a fixed number of tokens.

Bulk-synchronous best fit.  Equal sizes form runs (size, how many, number of the first),
so that the state of a round has a bounded number of rows however many documents there
are.  Runs of pieces and of gaps are range-partitioned by size (ranges of about as many
pieces each) and sorted.  In each superstep every range is one task: a sweep from the
largest run of pieces down finds each its successor, the smallest gap that holds it, by bisection; where
several pieces want the same gaps, their rank within the run decides; the gaps
shrink and go to the range of their new size, and pieces that found none go on to
the next range.  Beyond the largest range they open new sequences.  The
range of the largest pieces enters first, the next once all of them are placed, as in
best-fit decreasing, until no piece is left.  Pieces then learn their places by (length, rank within the length).

Null and empty texts are one token, the closing one.  Repeated rows are packed each.
Documents longer than a sequence, however long, are cut into whole sequences and a rest.  Pieces of one length
are interchangeable; their rank (by id, piece and checksum) says which goes where.  An empty
table gives an empty table.  Other columns of the input are not looked at.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _text
from ._spark import narrow, width, written
from .tokens import word_tokens

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenized_pieces(docs: DataFrame, vocabulary: str, capacity: int, closing: int = 0, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of each whole text's tokens and the closing one, cut only where a document is longer than ``capacity``."""

    def run(batches):
        for batch in batches:
            for b in _text.blocks(batch, "text", 4 << 20):
                data, at = _text.raw(_text.text_column(b.column(1)))
                starts, ends, w_at = _text.words(data, at)
                ids, each = word_tokens(_text.strings(data, starts, ends).dictionary_encode(), vocabulary)
                n = _text.sums(each, w_at)
                flat = np.full(int(n.sum()) + len(n), closing, "<u4")
                heads = np.cumsum(n + 1) - n - 1
                flat[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
                n += 1
                pieces = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), pieces)
                piece = _text.spread(pieces)
                start = piece * capacity
                length = np.minimum(capacity, n[doc] - start)
                a = heads[doc] + start
                crc = [zlib.crc32(flat[i:j]) for i, j in zip(a.tolist(), (a + length).tolist())]
                columns = [b.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), start, length, pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.r_[a, len(flat)], pa.int32()), pa.array(flat.astype(np.int32))))
                yield pa.RecordBatch.from_arrays([narrow(c) for c in columns], names=names)

    schema = PIECES + (", ids array<int>" if with_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def best_fit(pieces: list[tuple[int, int, int]], gaps: list[tuple[int, int, int]], fresh: tuple[int, int] | None = None):
    """One sweep over runs: pieces (size, rank of the first, how many), gaps (size, first sequence, how many).

    ``fresh``: (capacity, number of the first) of sequences to open for pieces that fit nowhere.
    Returns placings (length, first rank, how many, first sequence, pieces a sequence, gap), the gaps that are left and the pieces that are.
    """
    by_size: dict[int, list[tuple[int, int]]] = {}
    for g, s, n in gaps:
        by_size.setdefault(g, []).append((s, n))
    sizes = sorted(by_size)
    placed, left = [], []

    def put(g: int, s: int, n: int) -> None:
        if g not in by_size:
            by_size[g] = []
            bisect.insort(sizes, g)
        by_size[g].append((s, n))

    for size, rank, n in sorted(pieces, reverse=True):
        while n:
            i = bisect.bisect_left(sizes, size)
            if i < len(sizes):
                g = sizes[i]
                s, have = by_size[g].pop()
                if not by_size[g]:
                    del by_size[g]
                    sizes.pop(i)
            elif fresh:
                g, s = fresh
                have = -(-n // (g // size))
                fresh = (g, s + have)
            else:
                left.append((size, rank, n))
                break
            a_gap = g // size
            full = min(have, n // a_gap)
            if full:
                placed.append((size, rank, full * a_gap, s, a_gap, g))
                if g - a_gap * size:
                    put(g - a_gap * size, s, full)
                rank, n, s, have = rank + full * a_gap, n - full * a_gap, s + full, have - full
            if n and have:  # fewer than one gap takes
                placed.append((size, rank, n, s, n, g))
                put(g - n * size, s, 1)
                s, have, n = s + 1, have - 1, 0
            if have:
                put(g, s, have)
    return placed, [(g, s, n) for g, x in by_size.items() for s, n in x], left


STATE = "kind int, size long, first long, many long, at int, step int, a_gap long, gap long, sequence long"


def _bounds(runs: list[tuple[int, int]], ranges: int) -> list[int]:
    """Sizes that cut the runs (size, many) into ranges of about as many pieces each."""
    total, seen, out = sum(m for _, m in runs), 0, []
    for size, many in sorted(runs):
        seen += many
        if len(out) < ranges - 1 and seen * ranges >= total * (len(out) + 1):
            out.append(size + 1)
    return out


def supersteps(lengths: DataFrame, capacity: int, ranges: int = 3) -> DataFrame:
    """From runs (size, many) the placings (size, first, many, sequence, a_gap, gap); ``first`` is the rank in the size."""
    zero = F.lit(0).cast("long")
    waiting = written(lengths.select(F.lit(1).alias("kind"), "size", zero.alias("first"), "many"), "runs")
    # at most ``capacity`` rows, whatever the number of documents
    bounds = _bounds([(r.size, r.many) for r in waiting.select("size", "many").collect()], ranges)
    top = len(bounds)
    of = lambda size: bisect.bisect_right(bounds, int(size))
    names = [x.split()[0] for x in STATE.split(", ")]

    def sweep(batches):
        """One range in order of size: its pieces find their successors among its gaps, as long as gaps that shrink stay in the range."""
        import pandas as pd

        parts = [b.to_pandas() for b in batches]
        frame = pd.concat(parts) if parts else pd.DataFrame(columns=names)
        if not len(frame):
            return
        at, step = int(frame["at"].iloc[0]), int(frame["step"].iloc[0])
        runs = list(zip(frame["kind"], frame["size"], frame["first"], frame["many"]))
        pieces = [(s, f, m) for k, s, f, m in runs if k == 1]
        gaps = [(s, f, m) for k, s, f, m in runs if k == 0]
        placed, gaps, left = best_fit(pieces, gaps, (capacity, step << 40) if at > top else None)
        rows = [(2, s, f, m, 0, 0, k, g, q) for s, f, m, q, k, g in placed]
        rows += [(0, g, s, m, of(g), 0, 0, 0, 0) for g, s, m in gaps]
        rows += [(1, s, f, m, at + 1, 0, 0, 0, 0) for s, f, m in left]
        yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=names).astype({c: "int32" if c in ("kind", "at", "step") else "int64" for c in names}), schema=kinds, preserve_index=False)

    kinds = pa.schema([(c, pa.int32() if c in ("kind", "at", "step") else pa.int64()) for c in names])
    at = F.lit(0)
    for b in bounds:
        at = at + (F.col("size") >= b).cast("int")
    waiting = waiting.select("kind", "size", "first", "many", at.cast("int").alias("at"), F.lit(0).alias("step"), zero.alias("a_gap"), zero.alias("gap"), zero.alias("sequence"))
    state, done, step = waiting.limit(0), [waiting.limit(0)], 0
    for entering in range(top, -1, -1):
        state, left = state.unionByName(waiting.where(F.col("at") == entering)), True
        while left:
            step += 1
            now = state.withColumn("step", F.lit(step))
            # a range is a partition, sorted by size; the last one is for pieces that no gap of any range holds
            out = written(now.repartitionById(top + 2, F.col("at")).sortWithinPartitions("size", "kind", "first").mapInArrow(sweep, STATE), "superstep")
            done.append(out.where("kind = 2"))
            state = out.where("kind <> 2")
            left = bool(state.where("kind = 1").head(1))
    placings = done[0]
    for d in done[1:]:
        placings = placings.unionByName(d)
    return placings.select("size", "first", "many", "sequence", "a_gap", "gap")


def ranked(pieces: DataFrame, order: list[str], salts: int) -> DataFrame:
    """``rank`` from 0 within each length; a hot length is spread over ``salts`` windows."""
    w = Window.partitionBy("length", "__salt")
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("__n"))  # at most capacity x salts rows
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    own = salted.withColumn("__own", F.row_number().over(w.orderBy(*order)) - 1)
    return own.join(bases, ["length", "__salt"]).withColumn("rank", F.col("__base") + F.col("__own")).drop("__salt", "__own", "__base")


def pack(pieces: DataFrame, capacity: int, order: list[str], salts: int | None = None) -> DataFrame:
    """``pieces`` (with ``length`` from 1 to ``capacity``) with their sequence_id and offset in it.

    The rows need a deterministic lineage or a written table: they are read for the
    runs and again for their places.
    """
    spark = pieces.sparkSession
    runs = pieces.groupBy(F.col("length").cast("long").alias("size")).agg(F.count(F.lit(1)).alias("many"))
    # at most a few rows for each length: a length's run is cut only where a run of gaps ends
    table = supersteps(runs, capacity).orderBy("size", "first").toPandas()
    size, first = table["size"].to_numpy(), table["first"].to_numpy()
    step = (int(first.max()) if len(first) else 0) + (int(table["many"].max()) if len(first) else 0) + 1
    if step * (capacity + 1) >= 1 << 62:
        raise ValueError("too many pieces of one length for 64-bit ranks")
    key = size * step + first
    per, gap, seq = table["a_gap"].to_numpy(), table["gap"].to_numpy(), table["sequence"].to_numpy()
    shared = spark.sparkContext.broadcast((key, first, per, gap, seq))
    rank = ranked(pieces, order, salts or max(16, width(spark)))
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    at = [columns.index("length")]

    def place(batches):
        key, first, per, gap, seq = shared.value
        for b in batches:
            n = b.column(at[0]).to_numpy()
            r = b.column(b.num_columns - 1).to_numpy()
            i = np.searchsorted(key, n * step + r, "right") - 1
            k = r - first[i]
            columns_out = [b.column(j) for j in range(b.num_columns - 1)]
            columns_out += [pa.array(seq[i] + k // per[i]), pa.array(capacity - gap[i] + k % per[i] * n)]
            yield pa.RecordBatch.from_arrays(columns_out, names=names)

    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([pieces.schema[c] for c in columns] + [StructField("sequence_id", LongType()), StructField("offset", LongType())])
    names = schema.names
    return rank.select(*columns, "rank").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, capacity: int = 2048, vocabulary: str = "word_bpe_49k.json", closing: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All pieces of ``docs`` with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = written(tokenized_pieces(docs, vocabulary, capacity, closing, doc_id, text), "pieces")
    return pack(pieces, capacity, ["doc_id", "piece", "ids_crc32"])


def sequences(packed: DataFrame, docs: DataFrame, capacity: int = 2048, vocabulary: str = "word_bpe_49k.json", closing: int = 0) -> DataFrame:
    """The packed sequences themselves: sequence_id, and its ids in order (at most ``capacity``)."""
    ids = tokenized_pieces(docs, vocabulary, capacity, closing, with_ids=True).select("doc_id", "piece", "ids_crc32", "ids").dropDuplicates(["doc_id", "piece", "ids_crc32"])
    on = packed["doc_id"].eqNullSafe(ids["doc_id"]) & (packed["piece"] == ids["piece"]) & (packed["ids_crc32"] == ids["ids_crc32"])
    rows = packed.join(ids, on).select("sequence_id", "offset", "ids")
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return rows.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
