"""Exact repeats of windows of W symbols (words or bytes), found through content-chosen anchors.

Of the grams of k symbols in a window, the one with the least hash is its anchor:
equal windows have equal anchors.  Neighbouring windows with the same anchor are a
stretch, kept as one row (anchor's hash, stretch's hash, document, start, number of
windows): about 2 / (W - k + 2) rows a symbol instead of one.

Rows are range-partitioned and sorted by (anchor, stretch, document, start), so a hot
anchor takes several ranges.  A stream over each range then tells
  kind 1: an equal stretch comes earlier: all its windows are repeats;
  kind 2: the first of its stretch, but its anchor occurs in others: its windows are
          to be compared one by one;
  kind 0: no other stretch has its anchor.
The first and last rows of a range count as kind 2 when in doubt, which costs a
comparison and changes no result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._spark import width, written
from .line_dedup import identified

ENTRIES = "fp long, sh long, doc long, th int, start int, n int"
FLAGGED = ENTRIES + ", kind int"
NAMES = [x.split()[0] for x in ENTRIES.split(", ")]


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, doc (null: the least), th (32 bits of the text's hash, to tell rows of one doc_id apart), text."""
    return identified(docs, doc_id, text).select("doc_id", "doc", F.shiftright("th", 32).cast("int").alias("th"), "text")


def symbols(data: np.ndarray, at: np.ndarray, by_word: bool) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of a block, and where each text's begin."""
    if not by_word:
        return _text.BYTE_KEY[data], at
    starts, ends, w_at = _text.words(data, at)
    return _text.Rolling(_text.BYTE_KEY[data]).of(starts, ends), w_at


def second(data: np.ndarray, at: np.ndarray, by_word: bool) -> np.ndarray:
    """The symbols of a block under other random keys: hashes over them are independent of those over ``symbols``."""
    if not by_word:
        return _text.BYTE_KEY_2[data]
    starts, ends, _ = _text.words(data, at)
    return _text.Rolling(_text.BYTE_KEY_2[data]).of(starts, ends)


def stretches(x: np.ndarray, at: np.ndarray, window: int, gram: int):
    """(rolling hashes, gram hashes, anchor hash, first window, number of windows, text) of each stretch."""
    rolling = _text.Rolling(x)
    g = rolling.windows(gram)
    w = window - gram + 1
    m = _text.sliding_min(g, w)
    none = np.zeros(0, np.int64)
    if not len(m):
        return rolling, g, np.zeros(0, np.uint64), none, none, none
    long = np.flatnonzero(np.diff(at) >= window)
    edge = np.zeros(len(m) + 1, np.int8)
    edge[at[:-1][long]] = 1
    edge[at[1:][long] - window + 1] -= 1
    valid = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
    new = np.zeros(len(m), bool)
    new[1:] = (m[1:] != m[:-1]) | (g[: len(m) - 1] == m[:-1])
    new[at[:-1][long]] = True
    new &= valid
    start = np.flatnonzero(new)
    doc = np.searchsorted(at, start, "right") - 1
    end = np.minimum(np.r_[start[1:], len(m)], at[1:][doc] - window + 1)
    return rolling, g, m[start], start, end - start, doc


def range_of(fp: np.ndarray, sh: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of the sorted bounds (fp, sh) are at most each row's."""
    low, high = np.searchsorted(bounds[:, 0], fp, "left"), np.searchsorted(bounds[:, 0], fp, "right")
    out = low.copy()
    for a in np.unique(low[high > low]).tolist():  # rows whose anchor is that of a bound
        rows = (low == a) & (high > a)
        z = int(high[rows][0])
        out[rows] = a + np.searchsorted(bounds[a:z, 1], sh[rows], "right")
    return out


def entries(rows: DataFrame, window: int, gram: int, by_word: bool, bounds: np.ndarray | None = None) -> DataFrame:
    """ENTRIES of the rows from ``keyed``, and with ``bounds`` the range of each; one Arrow pass."""

    def run(batches):
        for batch in batches:
            for b in _text.blocks(batch, "text", 1 << 20):
                data, at = _text.raw(b.column(2))
                x, s_at = symbols(data, at, by_word)
                _, _, fp, start, n, doc = stretches(x, s_at, window, gram)
                sh = _text.Rolling(second(data, at, by_word)).of(start, start + n + window - 1)
                index = pa.array(doc)
                columns = [pa.array(fp.view(np.int64)), pa.array(sh.view(np.int64)), b.column(0).take(index), b.column(1).take(index), pa.array(start - s_at[doc], pa.int32()), pa.array(n, pa.int32())]
                if bounds is not None:
                    columns.append(pa.array(range_of(columns[0].to_numpy(), columns[1].to_numpy(), bounds), pa.int32()))
                yield pa.RecordBatch.from_arrays(columns, names=NAMES if bounds is None else [*NAMES, "range"])

    return rows.select("doc", "th", "text").mapInArrow(run, ENTRIES if bounds is None else ENTRIES + ", range int")


def bounds_of(rows: DataFrame, window: int, gram: int, by_word: bool, sampled: int = 2000) -> np.ndarray | None:
    """Bounds of ranges of about equal shares of the entries, from those of some ``sampled`` rows (more for many ranges); None if that are too few to tell."""
    ranges = width(rows.sparkSession)
    n, sampled = rows.select("doc").count(), max(sampled, 2 * ranges)
    if n <= sampled:  # Spark's own sampling costs no more
        return None
    some = entries(rows.sample(min(1.0, 1.2 * sampled / n), 1), window, gram, by_word)
    keys = some.select("fp", "sh").limit(400_000).toPandas().sort_values(["fp", "sh"]).to_numpy(np.int64)
    if len(keys) < 20 * ranges:
        return None
    return np.unique(keys[[len(keys) * k // ranges for k in range(1, ranges)]].reshape(-1, 2), axis=0)


ORDER = ["fp", "sh", "doc", "th", "start", "n"]


def kinds(batches, names: list[str] = [*NAMES, "kind"]):
    """Batches sorted by (fp, sh, place), each with its rows' kind as the last column; columns after the first six pass through."""

    def with_kind(b, kind):
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(kind, pa.int32())], names=names)

    before = held = None  # the row before; the last row, whose kind waits for the next batch
    for b in batches:
        if not b.num_rows:
            continue
        fp, sh = b.column(0).to_numpy(), b.column(1).to_numpy()
        same_row = np.ones(len(fp), bool)
        own = np.stack([b.column(i).to_numpy().astype(np.int64) for i in (2, 3, 4)])
        same_fp, same_sh = np.zeros(len(fp), bool), np.zeros(len(fp), bool)
        same_fp[1:] = fp[1:] == fp[:-1]
        same_sh[1:] = same_fp[1:] & (sh[1:] == sh[:-1])
        same_row[0] = False
        same_row[1:] = same_sh[1:] & (own[:, 1:] == own[:, :-1]).all(axis=0)
        if before is None:
            same_fp[0] = True  # the range before may end with it
        else:
            same_fp[0] = fp[0] == before[0]
            same_sh[0] = same_fp[0] and sh[0] == before[1]
            same_row[0] = same_sh[0] and (own[:, 0] == before[2]).all()
        # a repeated row of the table is the same place, not an earlier one: it takes the kind of the row that it repeats
        kind = np.where(same_sh, 1, np.where(same_fp, 2, 0)).astype(np.int32)
        # the first of its stretch is in doubt if its anchor has another stretch; a group at the batch's edge may have one
        group = np.cumsum(~same_fp) - (not same_fp[0])
        n_sh = np.bincount(group, ~same_sh)
        n_sh[[0, -1]] = 2
        kind[:-1] = np.where((kind[:-1] == 0) & same_fp[1:] & (n_sh[group[:-1]] > 1), 2, kind[:-1])
        if same_row.any():
            lead = np.maximum.accumulate(np.where(same_row, -1, np.arange(len(fp))))
            kind = np.where(same_row, np.where(lead >= 0, kind[np.maximum(lead, 0)], before[3] if before is not None else 2), kind).astype(np.int32)
        if held is not None:
            if held[1] == 0 and same_fp[0]:
                held[1] = 2
            yield with_kind(held[0], np.array([held[1]], np.int32))
        yield with_kind(b.slice(0, b.num_rows - 1), kind[:-1])
        held = [b.slice(b.num_rows - 1), int(kind[-1])]
        before = (fp[-1], sh[-1], own[:, -1], int(kind[-1]))
    if held is not None:
        yield with_kind(held[0], np.array([max(held[1], 2) if held[1] != 1 else 1], np.int32))


def flagged(rows: DataFrame, window: int, gram: int, by_word: bool, **settings) -> DataFrame:
    """The entries of the rows, range-sorted, with their kind.

    Ranges come from some rows' entries, so that those of all rows are made once; where
    that tells too little, Spark samples all entries, which makes them twice.
    """
    n, bounds = width(rows.sparkSession), bounds_of(rows, window, gram, by_word, **settings)
    found = entries(rows, window, gram, by_word, bounds)
    ranged = found.repartitionByRange(n, *ORDER) if bounds is None else found.repartitionById(n, "range").drop("range")
    return ranged.sortWithinPartitions(*ORDER).mapInArrow(kinds, FLAGGED)


def to_compare(rows: DataFrame, doubtful: DataFrame) -> DataFrame:
    """doc, th, text, and the stretches (fp, start, n) to compare, for each row of a document that has any."""
    lists = doubtful.distinct().groupBy("doc", "th").agg(F.collect_list(F.struct("fp", "start", "n")).alias("runs"))  # of one document
    # the columns and keys of with_spans, so that both read one shuffle of the texts
    return rows.join(lists.hint("shuffle_hash"), ["doc", "th"]).select("doc", "th", "text", "runs", "doc_id")


def parts(column: pa.Array) -> tuple[np.ndarray, ...]:
    """(row, fp, start, n) of the lists of stretches."""
    flat = column.flatten()
    counts = np.diff(column.offsets.to_numpy())
    row = np.repeat(np.arange(len(column)), counts)
    return row, flat.field(0).to_numpy(), flat.field(1).to_numpy().astype(np.int64), flat.field(2).to_numpy().astype(np.int64)


def first_places(windows: DataFrame) -> DataFrame:
    """Of windows (fp, wh, doc, th, pos), those that an equal one precedes: doc, th, start, n.

    Sorted by (fp, wh, place) over ranges; whether the first of a range is a repeat, the
    last rows of the ranges tell (kinds 3 and 4: two rows a range).
    """
    names = ["kind", "fp", "wh", "doc", "th", "start"]

    def run(batches):
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            x = [b.column(i).to_numpy() for i in range(5)]
            same = np.zeros(len(x[0]), bool)
            same[1:] = (x[0][1:] == x[0][:-1]) & (x[1][1:] == x[1][:-1])
            again = np.zeros(len(x[0]), bool)
            again[1:] = same[1:] & (x[2][1:] == x[2][:-1]) & (x[3][1:] == x[3][:-1]) & (x[4][1:] == x[4][:-1])
            if last is None:
                yield rows(3, [c[:1] for c in x])
            else:
                same[0] = x[0][0] == last[0] and x[1][0] == last[1]
                again[0] = same[0] and all(c[0] == v for c, v in zip(x[2:], last[2:]))
            found = same & ~again  # a repeated row is the same place: told once
            if found.any():
                yield rows(1, [c[found] for c in x])
            last = [c[-1] for c in x]
        if last is not None:
            yield rows(4, [np.array([v]) for v in last])

    def rows(kind, x):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(x[0]), kind, np.int32)), *(pa.array(c, k) for c, k in zip(x, kinds))], names=names)

    order = ["fp", "wh", "doc", "th", "pos"]
    by_range = windows.select(*order).repartitionByRange(width(windows.sparkSession), *order).sortWithinPartitions(*order)
    told = written(by_range.mapInArrow(run, "kind int, fp long, wh long, doc long, th int, start int"), "repeats")
    lasts = told.where("kind = 4").select("fp", "wh", F.struct("doc", "th", "start").alias("last"))
    firsts = told.where("kind = 3").join(F.broadcast(lasts), ["fp", "wh"]).where(F.col("last") < F.struct("doc", "th", "start"))
    found = told.where("kind = 1").select("doc", "th", "start").unionByName(firsts.select("doc", "th", "start").distinct())
    return found.select("doc", "th", "start", F.lit(1).alias("n"))


def covered(n: int, starts: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """Which of n symbols lie in a window of the given stretches."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + counts + window - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """``rows`` from ``keyed`` with the lists of their repeats (start, n), null where there are none."""
    lists = spans.groupBy("doc", "th").agg(F.collect_list(F.struct("start", "n")).alias("spans"))  # of one document
    return rows.join(lists.hint("shuffle_hash"), ["doc", "th"], "left").select("doc_id", "text", "spans")


def apply_spans(rows: DataFrame, schema: str, one) -> DataFrame:
    """``one(text, starts, counts) -> values`` of the columns after doc_id, for each row of ``with_spans``."""
    from pyspark.sql.types import StructType

    kinds = [{"long": pa.int64(), "string": pa.string(), "array<struct<start:long,end:long>>": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))}[f.dataType.simpleString().replace("bigint", "long")] for f in StructType.fromDDL(schema).fields[1:]]
    names = StructType.fromDDL(schema).names
    none = np.zeros(0, np.int64)

    def run(batches):
        for b in batches:
            lists = b.column(2)
            out = []
            at = lists.offsets.to_numpy()
            starts, counts = lists.values.field(0).to_numpy().astype(np.int64), lists.values.field(1).to_numpy().astype(np.int64)
            for i, t in enumerate(b.column(1)):
                a, z = (at[i], at[i + 1]) if lists[i].is_valid else (0, 0)
                out.append(one(t.as_py(), starts[a:z], counts[a:z]) if z > a else one(t.as_py(), none, none))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(x), k) for x, k in zip(zip(*out), kinds))] if out else [b.column(0), *(pa.array([], k) for k in kinds)], names=names)

    return rows.mapInArrow(run, schema)
