"""Benchmark decontamination: Wu-Manber multi-pattern search over word sequences.

Test strings are the windows of ``window`` consecutive words of each item (an item of
fewer words is one string).  For all strings of one length, a shift table over blocks
of two words tells how far a position may be skipped; where the shift is 0, the bucket
of that last block holds the strings that may end there, and comparing all their words
confirms an occurrence.  Many stretches of text are scanned side by side, each with
its own cursor, so that a step of all of them is a few array operations.

The strings are compiled in blocks of at most ``block_bytes`` of item text, each
broadcast for one more pass over the documents: what is broadcast doesn't grow with the
benchmark, and no documents are shuffled.

A block of 1 MB of item text has some 170,000 windows, whose compiled form is about 20 MB.

Null and empty texts have no words and are not contaminated.  Very long texts are scanned whole, in lanes side by side.  Items without words
match nothing; repeated items count once by their id, a null id as the string
``null``.  An empty benchmark or table is fine.  Other columns pass through; one that
has a result's name is replaced.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._spark import annotate, text_bytes

RESULTS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hits array<struct<start:int,end:int>>, items array<string>"


def item_words(text: str | None) -> list[bytes]:
    data = _text.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    starts, ends, _ = _text.words(data, np.array([0, len(data)]), _text.ALNUM_BYTES)
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip(starts, ends)]


class Strings:
    """All test strings of one length, with their shift table and buckets."""

    def __init__(self, rows: np.ndarray, n_words: int) -> None:
        self.m = rows.shape[1]
        self.b = min(2, self.m)
        self.n_words = n_words
        last = self.key(rows, self.m - 1)
        self.order = np.argsort(last, kind="stable")
        self.rows = rows[self.order]
        self.bucket_keys, self.bucket_heads = np.unique(last[self.order], return_index=True)
        self.bucket_ends = np.r_[self.bucket_heads[1:], len(rows)]
        best: dict[int, int] = {}
        for end in range(self.b - 1, self.m):
            for k in self.key(rows, end).tolist():
                best[k] = self.m - 1 - end  # later ends shift less
        self.blocks = np.array(sorted(best), np.int64)
        self.shifts = np.array([best[k] for k in sorted(best)], np.int64)
        self.far = self.m - self.b + 1

    def key(self, rows: np.ndarray, end: int) -> np.ndarray:
        k = rows[:, end].astype(np.int64)
        return k if self.b == 1 else rows[:, end - 1].astype(np.int64) * self.n_words + k

    def scan(self, ids: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``ids`` an occurrence begins within [begin, end) of any lane, and of which string."""
        m, found_at, found = self.m, [], []
        cur = begin + m - 1
        live = cur < end
        cur, end = cur[live], end[live]
        while len(cur):
            k = ids[cur]
            known = k >= 0
            if self.b == 2:
                before = ids[cur - 1]
                known &= before >= 0
                k = before * self.n_words + k
            place = np.minimum(np.searchsorted(self.blocks, k), len(self.blocks) - 1)
            shift = np.where(known & (self.blocks[place] == k), self.shifts[place], self.far)
            stop = np.flatnonzero(shift == 0)
            if len(stop):
                bucket = np.searchsorted(self.bucket_keys, k[stop])
                lo, hi = self.bucket_heads[bucket], self.bucket_ends[bucket]
                start = cur[stop] - m + 1
                for j in range(int((hi - lo).max())):
                    has = np.flatnonzero(lo + j < hi)
                    row = lo[has] + j
                    same = (ids[start[has, None] + np.arange(m)] == self.rows[row]).all(axis=1)
                    found_at.append(start[has][same])
                    found.append(self.order[row[same]])
                shift[stop] = 1
            cur = cur + shift
            live = cur < end
            cur, end = cur[live], end[live]
        if not found_at:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found_at), np.concatenate(found)


class Matcher:
    """The compiled strings of a set of items."""

    def __init__(self, items: list[tuple[str, str | None]], window: int) -> None:
        words: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple, set[str]]] = {}
        for item, text in items:
            w = [words.setdefault(x, len(words)) for x in item_words(text)]
            m = min(window, len(w))
            for i in range(len(w) - m + 1 if m else 0):
                by_length.setdefault(m, {}).setdefault(tuple(w[i : i + m]), set()).add(item)
        self.words = pa.array([x.decode() for x in words], pa.large_string())
        self.groups = [(Strings(np.array(list(p), np.int64), len(words)), [sorted(x) for x in p.values()]) for _, p in sorted(by_length.items())]

    def occurrences(self, ids: np.ndarray, offsets: np.ndarray, lane: int = 1024):
        """(starts, length, items of each) for each length of strings."""
        for strings, items in self.groups:
            n = np.diff(offsets)
            lanes = -(-n // lane)
            first = np.repeat(offsets[:-1], lanes) + _text.spread(lanes) * lane
            last = np.minimum(first + lane + strings.m - 1, np.repeat(offsets[1:], lanes))
            at, which = strings.scan(ids, first, last)
            yield at, strings.m, [items[i] for i in which.tolist()]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, per_hit: int = 20, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = 1 << 20) -> DataFrame:
    """``docs`` with the columns of RESULTS; contaminated: any word is hit, and at least one in ``per_hit``."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.col(item_text).cast("string").alias("text"))
    total = items.agg(F.sum(text_bytes())).head()[0] or 0
    n_blocks = max(1, math.ceil(total / block_bytes))
    out = docs
    for k in range(n_blocks):
        part = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == k)
        matcher = spark.sparkContext.broadcast(Matcher([(r.item, r.text) for r in part.toLocalIterator()], window))
        out = annotate(out, RESULTS, _pass(matcher, text, per_hit, k > 0), text, most=8 << 20)
    return out


def _pass(matcher, text: str, per_hit: int, again: bool):
    def compute(block: pa.RecordBatch) -> list:
        m = matcher.value
        data, at = _text.raw(_text.text_column(block.column(block.schema.get_field_index(text))))
        data = _text.LOWER[data]
        starts, ends, w_at = _text.words(data, at, _text.ALNUM_BYTES)
        n_docs, n_words = len(at) - 1, np.diff(w_at)
        if len(m.words):
            ids = pc.index_in(_text.strings(data, starts, ends), m.words)
            ids = pc.fill_null(ids, -1).to_numpy().astype(np.int64)
        else:
            ids = np.full(len(starts), -1, np.int64)
        hit = np.zeros(len(ids), bool)
        found: dict[int, set[str]] = {}
        for begin, length, items in m.occurrences(ids, w_at):
            for j in range(length):
                hit[begin + j] = True
            for d, x in zip((np.searchsorted(w_at, begin, "right") - 1).tolist(), items):
                found.setdefault(d, set()).update(x)
        if again:  # what the passes before found
            for d, (spans, items) in enumerate(zip(block.column(block.schema.get_field_index("hits")).to_pylist(), block.column(block.schema.get_field_index("items")).to_pylist())):
                for s in spans or ():
                    hit[w_at[d] + s["start"] : w_at[d] + s["end"]] = True
                if items:
                    found.setdefault(d, set()).update(items)
        n_hit = _text.sums(hit, w_at)
        edges = np.zeros(len(ids) + 1, bool)  # a run of hits ends with its text
        edges[w_at] = True
        first = hit & ~np.r_[False, hit[:-1]] | hit & edges[:-1]
        last = hit & ~np.r_[hit[1:], False] | hit & edges[1:]
        a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
        doc = np.searchsorted(w_at, a, "right") - 1
        spans = pa.StructArray.from_arrays([pa.array(a - w_at[doc], pa.int32()), pa.array(b - w_at[doc], pa.int32())], names=["start", "end"])
        span_at = np.searchsorted(doc, np.arange(n_docs + 1))
        lists = [sorted(found.get(d, ())) for d in range(n_docs)]
        digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in lists]
        return [
            n_words.astype(np.int64),
            n_hit,
            np.array([len(x) for x in lists], np.int64),
            pa.array(digests, pa.string()),
            (n_hit > 0) & (per_hit * n_hit >= n_words),
            pa.ListArray.from_arrays(pa.array(span_at, pa.int32()), spans),
            pa.array(lists, pa.list_(pa.string())),
        ]

    return compute
