"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets verify them.

Texts are lower-cased (A-Z) words of letters and digits; a document's set is that of
its n-word grams (of all its words, if they are fewer).  Bands and rows are chosen for
a target recall at the threshold.  Equal texts are one class from the start, by a
64-bit and a second hash, and copies are never expanded into pairs.

Band hashes are range-partitioned with the class as secondary sort, so a hot bucket
takes several ranges.  In a bucket each class is linked with the next ``reach``; where
that leaves pairs out, the signatures (128 nibbles) of all its pairs are compared,
block against block.  Pairs whose signatures have little in common are left out.  Within
the components that remain, all pairs are verified on the full sets.  Components of
more than ``block`` classes are cut into blocks that are compared two by two.  Only
counts and links to a representative leave a comparison, no pairs.

Null and empty texts (and those without words) have no grams and link only with
their equals.  Very long texts are taken whole; the sets of one comparison are held at once.  Repeated rows are copies.  An empty table gives an empty table.  Other
columns aren't looked at.  A null doc_id counts as the smallest.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _text
from ._components import components
from ._spark import discard, whole_groups, width, written

SKETCH = "doc long, node long, check long, bands array<long>, nibbles binary"


def bands_for(threshold: float, recall: float, rows: int) -> int:
    """How many bands of ``rows`` hashes find a pair at the threshold with that probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def grams(data: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram hashes of each text (with repeats), after one another, and where each text's begin."""
    data = _text.LOWER[data]
    starts, ends, w_at = _text.words(data, at, _text.ALNUM_BYTES)
    words = _text.Rolling(_text.BYTE_KEY[data]).of(starts, ends)
    n_words = np.diff(w_at)
    size = np.minimum(n, n_words)
    count = np.where(n_words > 0, n_words - size + 1, 0)
    begin = np.repeat(w_at[:-1], count) + _text.spread(count)
    h = _text.Rolling(words).of(begin, begin + np.repeat(size, count))
    return h, np.r_[0, np.cumsum(count)]


class MinHash:
    def __init__(self, n_hashes: int, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 32, n_hashes, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, n_hashes, dtype=np.uint64).astype(np.uint32)

    def signatures(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(texts, hashes): the least value of each hash function; texts without grams get none of use."""
        out = np.zeros((len(at) - 1, len(self.a)), np.uint32)
        some = np.flatnonzero(np.diff(at))
        if len(some):
            x = (h >> np.uint64(32)).astype(np.uint32)
            y = h.astype(np.uint32) | np.uint32(1)
            heads = at[:-1][some]
            for i, (a, b) in enumerate(zip(self.a, self.b)):
                v = x * a + b
                v ^= v >> np.uint32(15)
                v *= y
                out[some, i] = np.minimum.reduceat(v, heads)
        return out


def sketches(docs: DataFrame, n: int, n_bands: int, rows: int, doc_id: str, text: str) -> DataFrame:
    """SKETCH of each document: its class's node (64-bit hash of the text), band hashes, signature nibbles."""
    n_nibbles = 128

    def run(batches):
        minhash = MinHash(max(n_bands * rows, n_nibbles))
        for batch in batches:
            for b in _text.blocks(batch, "text", 1 << 20):
                h, at = grams(*_text.raw(b.column(3)), n)
                s = minhash.signatures(h, at)
                banded = s[:, : n_bands * rows].reshape(len(s), n_bands, rows).astype(np.uint64)
                key = np.tile(np.arange(1, n_bands + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F), (len(s), 1))
                for r in range(rows):
                    key = _text.mix(key * np.uint64(0x9E3779B97F4A7C15) + banded[:, :, r])
                has = np.diff(at) > 0
                counts = np.where(has, n_bands, 0)
                bands = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(key[has].ravel().view(np.int64)))
                low = (s[:, :n_nibbles] >> np.uint32(7)) & np.uint32(15)
                packed = (low[:, ::2] | low[:, 1::2] << np.uint32(4)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), bands, pa.array([x.tobytes() for x in packed], pa.binary())], names=["doc", "node", "check", "bands", "nibbles"])

    return _classed(docs, doc_id, text).mapInArrow(run, SKETCH)


def _classed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    doc = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63)).cast("long"))
    return docs.select(doc.alias("doc"), F.xxhash64(body).alias("node"), F.xxhash64(F.lit(1), body).alias("check"), body.alias("text"))


def streamed(buckets: DataFrame, reach: int) -> DataFrame:
    """From rows (key, node): links of each class with the next ``reach`` of its bucket (kind 0, a, b), the first and last rows of each range (1, key, node), rows of buckets with more classes than those links pair up (2, key, node)."""
    most = reach + 1  # classes of a bucket whose links are all its pairs

    def run(batches):
        tail = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        told = np.zeros(0, bool)  # rows of the tail already given as kind 2
        head = 0  # rows given of the range's start
        for batch in batches:
            key, node = (np.concatenate([t, batch.column(i).to_numpy()]) for i, t in enumerate(tail))
            keep = np.ones(len(key), bool)
            keep[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])  # copies
            key, node = key[keep], node[keep]
            old = min(len(tail[0]), len(key))
            if head < most and len(key) > old:
                first = slice(old, old + most - head)
                head += len(key[first])
                yield edge(1, key[first], node[first])
            for d in range(1, reach + 1):
                same = key[d:] == key[:-d]
                same[: max(0, old - d)] = False  # linked before
                if same.any():
                    yield edge(0, node[:-d][same], node[d:][same])
            many = np.zeros(len(key), bool)
            far = np.flatnonzero(key[most:] == key[:-most])
            for d in range(most + 1):
                many[far + d] = True
            told = np.r_[told[:old], np.zeros(len(key) - old, bool)]
            new = many & ~told
            if new.any():
                yield edge(2, key[new], node[new])
            tail, told = (key[-most:], node[-most:]), (many | told)[-most:]
        if head:
            yield edge(1, *tail)

    def edge(kind, a, b):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b)], names=["kind", "a", "b"])

    by_range = buckets.repartitionByRange(width(buckets.sparkSession), "key", "node").sortWithinPartitions("key", "node")
    return written(by_range.mapInArrow(run, "kind int, a long, b long"), "links")


def _ends(told: DataFrame) -> DataFrame:
    """(key, nodes) at the edges of ranges: at most 2 x (reach + 1) rows for each range."""
    ends = told.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("node")).distinct()
    return ends.groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("nodes")).where(F.size("nodes") > 1)


def _chains(told: DataFrame) -> DataFrame:
    across = _ends(told).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("nodes") - 1), lambda i: F.struct(F.element_at("nodes", i).alias("a"), F.element_at("nodes", i + 1).alias("b")))).alias("e")).select("e.a", "e.b")
    return told.where("kind = 0").select("a", "b").unionByName(across).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def chained(buckets: DataFrame, reach: int) -> DataFrame:
    """Links (a, b) of each class with the next ``reach`` of its bucket, from rows (key, node), whatever their number."""
    return _chains(streamed(buckets, reach))


def agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each row of ``x`` and of ``y`` (nibbles, one a byte): in how many nibbles they agree."""
    out = np.zeros((len(x), len(y)), np.uint8)
    for u, v in zip(np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)):
        out += u[:, None] == v[None, :]
    return out


def crowded(told: DataFrame, nibbles: DataFrame, least: float, block: int = 1024) -> DataFrame:
    """Links (a, b) that join what alike pairs join, from all pairs of the buckets that chains don't pair up.

    A bucket of more than ``block`` classes is cut into blocks that are compared two by two.
    """
    rows = told.where("kind = 2").select(F.col("a").alias("key"), F.col("b").alias("node"))
    # a bucket over an edge has all its rows there, or it is crowded on that side, too
    rows = rows.unionByName(_ends(told).select("key", F.explode("nodes").alias("node"))).distinct()
    sizes = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("nb"))
    placed = rows.join(sizes, "key").withColumn("blk", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o")
    pairs = placed.join(nibbles, "node").select("key", "node", "blk", "nibbles", other).select("key", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), "blk", "node", "nibbles")

    def run(batches):
        for t in whole_groups(batches, ["key", "i", "j"], 1 << 14):
            key, i, j, blk, node = (t.column(c).to_numpy() for c in range(5))
            packed = np.frombuffer(b"".join(t.column(5).to_pylist()), np.uint8).reshape(len(key), -1)
            signs = np.concatenate([packed & 15, packed >> 4], axis=1)
            new = np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
            cuts = np.r_[np.flatnonzero(new), len(key)]
            out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for a, z in zip(cuts[:-1], cuts[1:]):
                n = z - a
                near = np.zeros((n, n), bool)
                if i[a] == j[a]:
                    near = agreement(signs[a:z], signs[a:z]) >= least * signs.shape[1]
                    np.fill_diagonal(near, False)
                else:
                    left, right = (np.flatnonzero(blk[a:z] == k[a]) for k in (i, j))
                    cross = agreement(signs[a:z][left], signs[a:z][right]) >= least * signs.shape[1]
                    near[np.ix_(left, right)] = cross
                    near[np.ix_(right, left)] = cross.T
                some = np.flatnonzero(near.any(axis=1))
                if len(some):
                    root = some[_roots(near[np.ix_(some, some)])]
                    out.append((node[a:z][root[root != some]], node[a:z][some[root != some]]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["a", "b"])

    return pairs.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node").mapInArrow(run, "a long, b long").distinct()


def alike(edges: DataFrame, nibbles: DataFrame, least: float) -> DataFrame:
    """The edges whose signatures agree in that share of their nibbles at least."""
    sides = edges.join(nibbles.select(F.col("node").alias("a"), F.col("nibbles").alias("x")), "a").join(nibbles.select(F.col("node").alias("b"), F.col("nibbles").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(b.num_rows, -1) for i in (2, 3))
            z = x ^ y
            share = (((z & 15) == 0).sum(axis=1) + ((z >> 4) == 0).sum(axis=1)) / (2 * z.shape[1])
            mask = pa.array(share >= least)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["a", "b"])

    return sides.mapInArrow(run, "a long, b long")


def verified(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """(i, j) for all i < j: whether the sets' Jaccard similarity is at least ``threshold``."""
    k = len(sets)
    sizes = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    own = np.repeat(np.arange(k), sizes)
    order = np.argsort(flat, kind="stable")
    flat, own = flat[order], own[order]
    new = np.r_[True, flat[1:] != flat[:-1]]
    group = np.cumsum(new) - 1
    count = np.bincount(group)
    shared = count[group] > 1
    group, own = group[shared], own[shared]
    inter = np.zeros((k, k), np.float32)
    if len(group):
        _, group = np.unique(group, return_inverse=True)
        for a in range(0, int(group[-1]) + 1, 8192):
            lo, hi = np.searchsorted(group, [a, a + 8192])
            m = np.zeros((k, int(group[hi - 1]) - a + 1), np.float32)
            m[own[lo:hi], group[lo:hi] - a] = 1
            inter += m @ m.T
    union = sizes[:, None] + sizes[None, :] - inter
    return (inter >= threshold * union - 1e-6) & (union > 0)


def _roots(links: np.ndarray) -> np.ndarray:
    """For each of a few nodes, the first of its component."""
    root = np.arange(len(links))
    for i in range(len(links)):
        if root[i] == i:
            front = np.flatnonzero(links[i] & (root >= i))
            while len(front):
                root[front] = i
                front = np.flatnonzero(links[front].any(axis=0) & (root > i))
    return root


def compare(members: DataFrame, rows: DataFrame, n: int, threshold: float, block: int) -> DataFrame:
    """From members (node, first, copies, label) of components: (node, links, root, whole) after all pairs are verified."""
    sizes = members.groupBy("label").agg(F.count(F.lit(1)).alias("__n"))
    placed = members.join(sizes, "label").withColumn("__nb", F.ceil(F.col("__n") / F.lit(block)).cast("int"))
    placed = placed.withColumn("__b", F.pmod(F.xxhash64("node"), F.col("__nb")).cast("int"))
    texts = rows.join(placed.hint("shuffle_hash"), (rows["doc"] == placed["first"]) & (rows["node"] == placed["node"])).select(placed["node"], "copies", "label", "__nb", "__b", "text")

    def sets(batches):
        for batch in batches:
            for b in _text.blocks(batch, "text", 1 << 20):
                h, at = grams(*_text.raw(b.column(5)), n)
                each = [np.unique(h[x:y]) for x, y in zip(at[:-1], at[1:])]
                out = [b.column(i) for i in range(5)] + [pa.array([len(x) for x in each], pa.int64()), pa.array([x.tobytes() for x in each], pa.binary())]
                yield pa.RecordBatch.from_arrays(out, names=["node", "copies", "label", "nb", "b", "size", "grams"])

    full = texts.mapInArrow(sets, "node long, copies long, label long, nb int, b int, size long, grams binary").dropDuplicates(["node"])
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o")
    pairs = full.select("*", other).select("node", "copies", "label", "nb", "b", "size", "grams", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))

    def run(batches):
        for t in whole_groups(batches, ["label", "i", "j"], 1 << 20, "size"):
            label, i, j = (t.column(c).to_numpy() for c in (2, 7, 8))
            new = np.r_[True, (label[1:] != label[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
            cuts = np.r_[np.flatnonzero(new), len(label)]
            node, copies, nb, blk = (t.column(c).to_numpy() for c in (0, 1, 3, 4))
            data = t.column(6).combine_chunks() if isinstance(t.column(6), pa.ChunkedArray) else t.column(6)
            out = []
            for a, z in zip(cuts[:-1], cuts[1:]):
                links = verified([np.frombuffer(data[k].as_py(), np.uint64) for k in range(a, z)], threshold)
                np.fill_diagonal(links, False)
                if i[a] != j[a]:
                    links &= blk[a:z, None] != blk[None, a:z]
                out.append((node[a:z], links @ copies[a:z], node[a:z][_roots(links)], np.full(z - a, nb[a] == 1)))
            columns = [np.concatenate(x) for x in zip(*out)]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1].astype(np.int64)), pa.array(columns[2]), pa.array(columns[3])], names=["node", "links", "root", "whole"])

    return pairs.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j", "node").mapInArrow(run, "node long, links long, root long, whole boolean")


def ngram_join(docs: DataFrame, n: int = 3, threshold: float = 0.5, recall: float = 0.96, rows: int = 4, reach: int = 6, block: int = 1500, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document: doc_id, class_id (least doc_id with its text), n_copies (with itself), n_links (other documents, copies among them, of Jaccard similarity ``threshold`` or more), group_id (least doc_id of those linked with it, directly or not), text_hash."""
    sketch = written(sketches(docs, n, bands_for(threshold, recall, rows), rows, doc_id, text), "sketches")
    classes = written(sketch.groupBy("node", "check").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("copies")), "classes")
    buckets = sketch.select(F.explode("bands").alias("key"), "node")
    nibbles = sketch.groupBy("node").agg(F.min("nibbles").alias("nibbles"))
    agree = threshold + (1 - threshold) / 16
    least = agree - 4.5 * math.sqrt(agree * (1 - agree) / 128)
    told = streamed(buckets, reach)
    labels = components(alike(_chains(told), nibbles, least).unionByName(crowded(told, nibbles, least)))
    discard(told)  # the labels are a table of their own
    members = classes.join(labels, "node").select("node", "first", "copies", "label")
    found = written(compare(members, _classed(docs, doc_id, text).select("doc", "node", "text"), n, threshold, block), "verified")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parted = found.where("not whole").select(F.col("root").alias("a"), F.col("node").alias("b"))
    roots = found.where("whole").select("node", F.col("root").alias("label"))
    if parted.head(1):
        roots = roots.unionByName(components(parted))
    named = classes.join(links, "node", "left").join(roots, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("first").alias("group"))
    named = named.join(least, "label").select("node", "check", "first", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "group")
    real = lambda c: F.when(F.col(c) != F.lit(-(2**63)).cast("long"), F.col(c))
    return sketch.select("doc", "node", "check").join(named, ["node", "check"]).select(real("doc").alias("doc_id"), real("first").alias("class_id"), F.col("copies").alias("n_copies"), "n_links", real("group").alias("group_id"), F.col("node").alias("text_hash"))


def one_of_each(docs: DataFrame, joined: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when one document of each group does: the least doc_id (then text hash), and one row of it.

    ``joined``: ``ngram_join``'s result for ``docs``.
    """
    best = joined.groupBy("group_id").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(-(2**63)).cast("long")).alias("doc"), "text_hash")).alias("best"))
    stay = best.select(F.col("best.doc").alias("__doc"), F.col("best.text_hash").alias("__node")).distinct()
    keyed = docs.withColumn("__doc", F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63)).cast("long"))).withColumn("__node", F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    kept = keyed.join(stay.hint("shuffle_hash"), ["__doc", "__node"], "left_semi")
    one = kept.withColumn("__row", F.row_number().over(Window.partitionBy("__doc", "__node").orderBy(F.lit(1))))  # repeated rows of one document
    return one.where("__row = 1").select(docs.columns)
