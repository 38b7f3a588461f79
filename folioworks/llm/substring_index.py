"""Substring dedup with a log-structured fingerprint index.

The index is a log of sorted immutable runs below one folder.  A run holds the window
fingerprints of one batch of documents (a row for each stretch of neighbouring windows
with one anchor, see ``_repeats``), sorted by (anchor's hash, stretch's hash, place) and
cut at ranges of the fingerprint that are fixed when the index is made, one file a range.  A
manifest names the runs; each change writes a new one, so an index can be opened again.

A new batch is the only thing that is shuffled and sorted: to the same ranges, of which
a hot anchor takes several, as their bounds are of anchor and stretch.  Each range is
one task, a merge join of the batch's stream with the runs' files of that range, read a
few thousand rows at a time.  It tells which stretches of the batch history (or the
batch itself) has before, and which are in doubt, since their anchor occurs elsewhere;
the windows of those are verified one by one, hashed again from the texts, of which
historical ones are read only for the documents that the merge names.  When there are
``fanout`` runs, they are compacted first: the same merge, without a batch, into one run,
after which the old ones are deleted.  Batches come in ascending order of doc_id (others
are refused), so results don't depend on how the documents are cut into batches.

A window is ``window`` consecutive words of one document; a word is removed if any
window over it starts earlier, too (smaller doc_id, or the same document and an earlier
start), judged on the input.  Two 64-bit hashes must agree: of the anchor and of its
stretch, which are taken with different random keys, or of the anchor and of the window.

Null and empty texts have no words.  Texts shorter than a window lose nothing; very long
ones are hashed in one pass each.  Rows that repeat a doc_id and its text are the same
document, each with the same result; of rows with one doc_id and several texts, the
text's hash tells which comes first.  A null doc_id counts as the smallest and joins the
first batch.  An empty table gives an empty table.  Other columns aren't looked at.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _repeats, _text
from ._repeats import range_of
from ._spark import delete, filesystem, shared_path, width, written

_WORD = re.compile("[^\x20\x09-\x0d]+")
SPANS = "doc_id long, n_words long, n_removed long, kept_sha256 string"
RUN = _repeats.ENTRIES + ", bucket int, old boolean, kind int"
RUN_NAMES = [x.split()[0] for x in RUN.split(", ")]


def run_file(uri: str, most: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    """A run's rows that count later: the batch's own ones, each stretch at its first place."""
    import pyarrow.compute as pc
    from pyarrow import fs, parquet

    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_file(path) as f:
        for b in parquet.ParquetFile(f, pre_buffer=False).iter_batches(most, columns=[*_repeats.NAMES, "old", "kind"], use_threads=False):
            keep = pc.and_(pc.invert(b.column("old")), pc.not_equal(b.column("kind"), 1))
            yield b.select(_repeats.NAMES).filter(keep)
    pa.default_memory_pool().release_unused()


def chain_files(uris) -> Iterator[pa.RecordBatch]:
    for uri in uris:
        yield from run_file(uri)


def merged(streams: list[Iterator[pa.RecordBatch]]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """One sorted stream (and which stream each row is of) from several that are sorted by (fp, sh); of equal rows, earlier streams' come first."""
    heads: list[pa.RecordBatch | None] = [None] * len(streams)

    def fill(k: int) -> None:
        while heads[k] is None or not heads[k].num_rows:
            heads[k] = next(streams[k], None)
            if heads[k] is None:
                return

    while True:
        for k in range(len(streams)):
            fill(k)
        live = [k for k in range(len(streams)) if heads[k] is not None]
        if not live:
            return
        key = lambda k: tuple(int(heads[k].column(c)[-1].as_py()) for c in (0, 1))
        upto = min(map(key, live))
        parts, own = [], []
        for k in live:
            fp, sh = heads[k].column(0).to_numpy(), heads[k].column(1).to_numpy()
            i, j = np.searchsorted(fp, upto[0], "left"), np.searchsorted(fp, upto[0], "right")
            n = int(i + np.searchsorted(sh[i:j], upto[1], "right"))
            if n:
                parts.append(heads[k].slice(0, n))
                own.append(np.full(n, k))
                heads[k] = heads[k].slice(n)
        table, of = pa.Table.from_batches(parts).combine_chunks(), np.concatenate(own)
        if len(parts) > 1:
            order = np.lexsort((table.column(1).to_numpy(), table.column(0).to_numpy()))
            table, of = table.take(pa.array(order)).combine_chunks(), of[order]
        yield table, of


class FingerprintIndex:
    """The runs of an index, as tables below one folder."""

    def __init__(self, spark: SparkSession, path: str | None = None, window: int = 20, gram: int = 5, fanout: int = 3, ranges: int | None = None) -> None:
        self.spark, self.path = spark, path or shared_path(spark, "index")
        self.window, self.gram, self.fanout, self.ranges = window, gram, fanout, ranges or width(spark)
        self.runs: list[dict] = []  # path, last (its largest doc), files: bucket -> uris in order
        self.bounds: np.ndarray | None = None
        self.made = self.version = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        """The index as its newest manifest has it."""
        fs, at = filesystem(spark, path)
        names = [str(x.getPath().toString()) for x in fs.listStatus(at) if x.getPath().getName().startswith("manifest-")]
        m = json.loads(spark.read.text(max(names), wholetext=True).head()[0])
        out = cls(spark, path, m["window"], m["gram"], m["fanout"], m["ranges"])
        out.runs, out.made, out.version = m["runs"], m["made"], m["version"]
        out.bounds = np.array(m["bounds"], np.int64).reshape(-1, 2)
        return out

    def _commit(self) -> None:
        self.version += 1
        m = {"window": self.window, "gram": self.gram, "fanout": self.fanout, "ranges": self.ranges, "runs": self.runs, "made": self.made, "version": self.version, "bounds": self.bounds.tolist()}
        fs, at = filesystem(self.spark, f"{self.path}/manifest-{self.version:08d}.json")
        out = fs.create(at, True)
        out.write(bytearray(json.dumps(m).encode()))
        out.close()

    def _written(self, rows: DataFrame, last: int) -> dict:
        """Rows of RUN, sorted within ranges, as a new run's table."""
        self.made += 1
        to = f"{self.path}/run-{self.made:06d}"
        rows.write.option("compression", "zstd").parquet(to)
        files: dict[str, list[str]] = {}
        # a row for each file: at most one or a few a range
        for r in self.spark.read.schema(RUN).parquet(to).select("bucket", F.input_file_name().alias("file")).distinct().collect():
            files.setdefault(str(r.bucket), []).append(r.file)
        return {"path": to, "last": last, "files": {k: sorted(v) for k, v in files.items()}}

    def _table(self, run: dict) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(run["path"])

    def _fix_bounds(self, batch: DataFrame, sampled: int = 2000) -> None:
        """Ranges of equal shares of the fingerprints of some ``sampled`` documents; any bounds give the same results."""
        n = batch.select("doc").count()
        some = batch if n <= sampled else batch.sample(min(1.0, 1.2 * sampled / n), 1).limit(2 * sampled)
        keys = _repeats.entries(some, self.window, self.gram, True).select("fp", "sh").sample(1.0 if n <= sampled else 0.5, 1).limit(400_000).toPandas().drop_duplicates().sort_values(["fp", "sh"]).to_numpy(np.int64)
        at = [len(keys) * k // self.ranges for k in range(1, self.ranges)] if len(keys) >= self.ranges else []
        self.bounds = keys[at].reshape(-1, 2)

    def add(self, batch: DataFrame, history: DataFrame | None = None, matched: int = 250_000) -> DataFrame:
        """Repeats (doc, th, start, n windows) in a batch of rows from ``keyed``; the batch joins the index.

        ``history``: the rows of all earlier batches, against whose texts stretches are verified; an index with runs needs them.
        Up to ``matched`` names of historical documents are broadcast to choose their texts, more are shuffled.
        """
        if self.runs and history is None:
            raise ValueError("an index with runs needs the rows of its earlier batches")
        low, high = batch.agg(F.min("doc"), F.max("doc")).head()
        if low is None:
            return batch.sparkSession.createDataFrame([], "doc long, th int, start int, n int")
        if self.runs and low <= max(r["last"] for r in self.runs):
            raise ValueError("batches come in ascending order of doc_id")
        if self.bounds is None:
            self._fix_bounds(batch)
        if len(self.runs) >= self.fanout:
            self.compact()
        run = self._written(self._joined(batch), high)
        self.runs.append(run)
        self._commit()
        seen = self._table(run)
        doubtful = seen.where("kind = 2").select("fp", "doc", "th", "start", "n", "old")
        windows = self._windows(_repeats.to_compare(batch, doubtful.where("not old").drop("old")))
        if len(self.runs) > 1:
            before = doubtful.where("old").drop("old")
            names = before.select("doc", "th").distinct()
            few = names.limit(matched + 1).count() <= matched  # some 20 MB
            texts = history.join(F.broadcast(names) if few else names.hint("shuffle_hash"), ["doc", "th"], "left_semi")
            windows = windows.unionByName(self._windows(_repeats.to_compare(texts, before)))
        found = seen.where("kind = 1 and not old").select("doc", "th", "start", "n").distinct().unionByName(_repeats.first_places(windows))
        return found.where(F.col("doc") >= low)

    def _joined(self, batch: DataFrame) -> DataFrame:
        """The batch's sorted stream merged with all runs: its own rows with their kinds, and those of history that are to be compared with them."""
        bounds, files = self.bounds, [r["files"] for r in self.runs]

        def ranged(batches):
            for b in batches:
                at = range_of(b.column(0).to_numpy(), b.column(1).to_numpy(), bounds)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32())], names=[*_repeats.NAMES, "bucket"])

        def needed(b: pa.RecordBatch) -> pa.RecordBatch:
            if not b.num_rows:
                return b
            fp, old, kind = b.column(0).to_numpy(), b.column(7).to_numpy(zero_copy_only=False), b.column(8).to_numpy()
            group = np.cumsum(np.r_[False, fp[1:] != fp[:-1]])
            met = np.bincount(group, ~old) > 0
            met[[0, -1]] = True  # an anchor at the edge may meet the batch beyond it
            keep = ~old | (kind == 2) & met[group]
            return b if keep.all() else b.filter(pa.array(keep))

        def one(bucket: int, own: Iterator[pa.RecordBatch]):
            chained = [chain_files(f.get(str(bucket), ())) for f in files]

            def rows():
                for table, of in merged([*chained, own]):
                    new = of == len(files)
                    columns = [table.column(c).combine_chunks() for c in range(6)]
                    columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(new), bucket), pa.int32()), pa.array(~new)], names=RUN_NAMES[:-1])

            for b in _repeats.kinds(rows(), RUN_NAMES):
                b = needed(b)
                if b.num_rows:
                    yield b

        def run(batches):
            ahead: list[tuple[int, pa.RecordBatch]] = []
            pieces = by_bucket(batches)

            def own(bucket: int):
                yield ahead.pop()[1]
                for k, b in pieces:
                    if k != bucket:
                        ahead.append((k, b))
                        return
                    yield b

            first = next(pieces, None)
            if first:
                ahead.append(first)
            while ahead:
                yield from one(ahead[0][0], own(ahead[0][0]))

        def by_bucket(batches):
            for b in batches:
                bucket = b.column(6).to_numpy()
                cuts = np.r_[0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)] if len(bucket) else []
                for a, z in zip(cuts[:-1], cuts[1:]):
                    own = b.slice(a, z - a).select(_repeats.NAMES)
                    yield int(bucket[a]), own.filter(pa.array(own.column(5).to_numpy() > 0))

        entries = _repeats.entries(batch, self.window, self.gram, by_word=True).mapInArrow(ranged, _repeats.ENTRIES + ", bucket int")
        if files:  # a range without rows of the batch may hold a part of an anchor that the batch has beyond its bounds
            none = [F.lit(0).cast(k).alias(c) for c, k in (("fp", "long"), ("sh", "long"), ("doc", "long"), ("th", "int"), ("start", "int"), ("n", "int"))]
            entries = entries.unionByName(self.spark.range(self.ranges).select(*none, F.col("id").cast("int").alias("bucket")))
        return entries.repartitionById(self.ranges, F.col("bucket")).sortWithinPartitions("bucket", *_repeats.ORDER).mapInArrow(run, RUN)

    def compact(self) -> None:
        """All runs become one, merged range by range; no row is sorted or shuffled again.  The old ones are deleted."""
        files, old = [r["files"] for r in self.runs], [r["path"] for r in self.runs]

        def run(batches):
            for b in batches:
                for bucket in b.column(0).to_pylist():
                    for table, _ in merged([chain_files(f.get(str(bucket), ())) for f in files]):
                        n = table.num_rows
                        columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in (table.column(i).combine_chunks() for i in range(6))]
                        yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(n, bucket), pa.int32()), pa.array(np.zeros(n, bool)), pa.array(np.zeros(n), pa.int32())], names=RUN_NAMES)

        each = self.spark.range(self.ranges, numPartitions=self.ranges)
        self.runs = [self._written(each.mapInArrow(run, RUN), max(r["last"] for r in self.runs))]
        self._commit()
        for path in old:
            delete(self.spark, path)

    def _windows(self, rows: DataFrame) -> DataFrame:
        window = self.window

        def run(batches):
            for batch in batches:
                for b in _text.blocks(batch, "text", 1 << 20):
                    data, at = _text.raw(b.column(2))
                    x, w_at = _repeats.symbols(data, at, True)
                    h = _text.Rolling(x).windows(window)
                    row, fp, start, n = _repeats.parts(b.column(3))
                    each = np.repeat(np.arange(len(row)), n)
                    pos = start[each] + _text.spread(n)
                    index = pa.array(row[each])
                    yield pa.RecordBatch.from_arrays([pa.array(fp[each]), pa.array(h[w_at[row[each]] + pos].view(np.int64)), b.column(0).take(index), b.column(1).take(index), pa.array(pos, pa.int32())], names=["fp", "wh", "doc", "th", "pos"])

        return rows.mapInArrow(run, "fp long, wh long, doc long, th int, pos int")


def removed_words(text: str, starts: np.ndarray, counts: np.ndarray, window: int) -> tuple[list[str], np.ndarray]:
    words = _WORD.findall(text)
    return words, _repeats.covered(len(words), starts, counts, window) if len(starts) else np.zeros(len(words), bool)


def substring_dedup(docs: DataFrame, window: int = 20, gram: int = 5, batches: int = 4, index: FingerprintIndex | None = None, doc_id: str = "doc_id", text: str = "text", history: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (kept words joined by a space).

    ``batches``: in how many ranges of doc_id the documents join the index, one after another.
    ``history``: all documents that ``index`` has already, of smaller doc_ids; an index with runs needs them.
    """
    spark = docs.sparkSession
    index = index or FingerprintIndex(spark, window=window, gram=gram)
    if history is not None and not index.runs:
        raise ValueError("history without the index that it is in")
    window = index.window
    earlier = None if history is None else _repeats.keyed(history, doc_id, text)
    at = F.col(doc_id).cast("long")
    cuts = docs.select(at.alias("at")).approxQuantile("at", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    cuts = [None, *sorted({int(c) for c in cuts}), None]
    spans = None
    for low, high in zip(cuts[:-1], cuts[1:]):
        batch = docs
        if high is not None:
            batch = batch.where((at <= high) | at.isNull() if low is None else at <= high)
        if low is not None:
            batch = batch.where(at > low)
        before = None if low is None else _repeats.keyed(docs.where(at.isNull() | (at <= low)), doc_id, text)
        if earlier is not None:
            before = earlier if before is None else earlier.unionByName(before)
        found = written(index.add(_repeats.keyed(batch, doc_id, text), before), "spans")
        spans = found if spans is None else spans.unionByName(found)

    def one(body: str, starts: np.ndarray, counts: np.ndarray):
        words, gone = removed_words(body, starts, counts, window)
        kept = [w for w, g in zip(words, gone.tolist()) if not g] if len(starts) else words
        return len(words), len(words) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()

    return _repeats.apply_spans(_repeats.with_spans(_repeats.keyed(docs, doc_id, text), spans), SPANS, one)
