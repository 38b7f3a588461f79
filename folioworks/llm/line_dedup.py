"""Line dedup: of a line found in several documents, the last document keeps it.

Hashes of the lines' keys are range-partitioned with document and position as
secondary sort, largest document first, so that a stream over each partition meets a
key's keeper first and drops all that follows.  A hot key just takes several ranges:
rows of the two keys at a range's edges wait for a fact of bounded size (the three
largest documents of the key in each range).  What comes back is no text but, for each
document that loses lines, a compressed bitmap of those it keeps.

Null and empty texts are one empty line.  Rows with the same doc_id and text are the
same document; rows with the same doc_id and other text count as one document for a
key.  A line that a document repeats is one document's.  Very long texts are split as a whole, and a
line of any length is one hash.  A null doc_id counts as the smallest.  An empty table gives an empty table.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import width, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STREAM = "kind int, h1 long, h2 long, doc long, th long, pos int, docs array<long>"


def identified(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, doc (null: the least), text (null: empty) and th, the text's hash."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    least = F.lit(-(2**63)).cast("long")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), least).alias("doc"), body.alias("text"), F.xxhash64(body).alias("th"))


def line_keys(rows: DataFrame, least_chars: int) -> DataFrame:
    lines = rows.select("doc", "th", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    key = F.translate(F.expr("trim(BOTH ' \\t\\n\\u000b\\u000c\\r' FROM line)"), UPPER, LOWER)
    lines = lines.withColumn("key", key).where(F.char_length("key") >= least_chars)
    return lines.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc", "th", "pos")


def stream(least_docs: int):
    """Over rows sorted by (key, document descending, position): rows to drop (0), rows that wait (1), facts of edge keys (2).

    A key's first document keeps its lines.  Those of the next ones are dropped once
    ``least_docs`` documents are seen; until then they are held (a few documents' lines).
    """
    names = [x.split()[0] for x in STREAM.split(", ")]

    def emit(kind: int, rows: tuple) -> pa.RecordBatch:
        n = len(rows[0])
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *map(pa.array, rows), pa.nulls(n, pa.list_(pa.int64()))], names=names)

    def fact(key: tuple, docs: list[int]) -> pa.RecordBatch:
        one = [np.array([x], np.int64) for x in (*key, 0, 0)]
        return pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), *map(pa.array, one), pa.array([0], pa.int32()), pa.array([docs], pa.list_(pa.int64()))], names=names)

    def run(batches):
        first = key = None
        docs: list[int] = []  # the key's largest documents so far
        held: list[tuple] = []
        for b in batches:
            rows = tuple(b.column(i).to_numpy() for i in range(5))
            h1, h2, doc = rows[:3]
            n = len(h1)
            if not n:
                continue
            new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
            new_doc = new | np.r_[True, doc[1:] != doc[:-1]]
            cuts = np.r_[np.flatnonzero(new), n]
            group = np.cumsum(new) - 1
            rank = np.cumsum(new_doc)
            rank = rank - rank[cuts[:-1]][group] + 1
            if key == (h1[0], h2[0]):  # the key goes on from the last batch
                rank[: cuts[1]] += len(docs) - (doc[0] in docs)
            elif key is not None:
                if key == first:
                    yield fact(key, docs)
                docs, held = [], []
            if first is None:
                first = (h1[0], h2[0])
            total = rank[cuts[1:] - 1]
            enough = total[group] >= least_docs
            drop = (rank > 1) & enough
            wait = np.zeros(n, bool)
            if first == (h1[0], h2[0]):
                drop[: cuts[1]], wait[: cuts[1]] = False, True
            elif held and total[0] >= least_docs:
                for x in held:
                    yield emit(0, x)
                held = []
            last = slice(cuts[-2], n)
            same = len(cuts) == 2
            if not same:
                if first == (h1[0], h2[0]):
                    yield fact(first, list(dict.fromkeys(docs + doc[: cuts[1]][new_doc[: cuts[1]]][:least_docs].tolist()))[:least_docs])
                docs, held = [], []
            key = (h1[-1], h2[-1])
            docs = list(dict.fromkeys(docs + doc[last][new_doc[last]][:least_docs].tolist()))[:least_docs]
            if key != first:
                hold = np.zeros(n, bool)
                hold[last] = (rank[last] > 1) & ~enough[last]
                if hold.any():
                    held.append(tuple(x[hold] for x in rows))
            for kind, mask in ((0, drop), (1, wait)):
                if mask.any():
                    yield emit(kind, tuple(x[mask] for x in rows))
        if key is not None:
            for x in held:
                yield emit(1, x)
            yield fact(key, docs)

    return run


def dropped_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, th, positions: the lines that each document loses."""
    rows = written(line_keys(identified(docs, doc_id, text), least_chars), "lines")
    order = [F.asc("h1"), F.asc("h2"), F.desc("doc"), F.asc("th"), F.asc("pos")]
    spark = docs.sparkSession
    by_range = rows.repartitionByRange(width(spark), *order).sortWithinPartitions(*order)
    told = written(by_range.mapInArrow(stream(least_docs), STREAM), "streamed")
    # two keys at most of each range: bounded by the number of partitions
    facts = told.where("kind = 2").groupBy("h1", "h2").agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("docs"))), asc=False), 1, least_docs).alias("top"))
    facts = facts.where(F.size("top") >= least_docs).select("h1", "h2", F.col("top")[0].alias("keeper"))
    waiting = told.where("kind = 1").join(F.broadcast(facts), ["h1", "h2"]).where(F.col("doc") != F.col("keeper"))
    gone = told.where("kind = 0").select("doc", "th", "pos").unionByName(waiting.select("doc", "th", "pos"))
    return gone.groupBy("doc", "th").agg(F.collect_set("pos").alias("positions"))  # at most the lines of one document


def bitmap(positions: np.ndarray) -> bytes:
    """A bit for each line, set where it is kept, up to the last one dropped; all later lines are kept."""
    keep = np.ones(int(positions.max()) + 1, np.uint8)
    keep[positions] = 0
    return zlib.compress(np.packbits(keep).tobytes() + bytes([len(keep) % 8]), 6)


def unpack(data: bytes | None, n_lines: int) -> np.ndarray:
    keep = np.ones(n_lines, bool)
    if data:
        packed = zlib.decompress(data)
        bits = np.unpackbits(np.frombuffer(packed[:-1], np.uint8))
        bits = bits[: len(bits) - (8 - packed[-1]) % 8]
        keep[: len(bits)] = bits.astype(bool)
    return keep


def keep_bitmaps(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, th, keep: the bitmap of each document that loses lines."""

    def run(batches):
        for b in batches:
            maps = [bitmap(x.values.to_numpy()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(maps, pa.binary())], names=["doc", "th", "keep"])

    return dropped_lines(docs, least_chars, least_docs, doc_id, text).select("doc", "th", "positions").mapInArrow(run, "doc long, th long, keep binary")


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` and, where a document loses lines, its bitmap in the column ``__keep``."""
    least = F.lit(-(2**63)).cast("long")
    keyed = docs.withColumn("__doc", F.coalesce(F.col(doc_id).cast("long"), least)).withColumn("__th", F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    right = bitmaps.select(F.col("doc").alias("__doc"), F.col("th").alias("__th"), F.col("keep").alias("__keep")).hint("shuffle_hash")
    return keyed.join(right, ["__doc", "__th"], "left").drop("__doc", "__th")


def kept_lines(text: str | None, keep: bytes | None) -> tuple[int, int, str]:
    """Lines before, lines dropped, and the other lines joined."""
    lines = (text or "").split("\n")
    if not keep:
        return len(lines), 0, text or ""
    mask = unpack(keep, len(lines))
    return len(lines), int((~mask).sum()), "\n".join([x for x, k in zip(lines, mask) if k])


def line_dedup(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with their text rewritten, and n_lines (before), n_dropped.  Columns of these names are replaced."""
    given = docs.drop("n_lines", "n_dropped")
    marked = with_bitmaps(given, keep_bitmaps(docs, least_chars, least_docs, doc_id, text), doc_id, text)
    from pyspark.sql.types import StructType

    schema = StructType(list(given.schema.fields)).add("n_lines", "long").add("n_dropped", "long")
    at = given.columns.index(text)

    def run(batches):
        for b in batches:
            done = [kept_lines(t, k) for t, k in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist())]
            columns = [b.column(i) for i in range(b.num_columns - 1)]
            columns[at] = pa.array([x[2] for x in done], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.int64())], names=schema.names)

    return marked.select(*given.columns, "__keep").mapInArrow(run, schema)


def line_dedup_digest(docs: DataFrame, least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """doc_id, n_lines, n_dropped and the digest of what is kept."""
    done = line_dedup(docs.select("doc_id", "text"), least_chars, least_docs)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
