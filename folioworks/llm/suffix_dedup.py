"""Suffix-array dedup: removes each byte that an earlier repeat of ``window`` bytes covers.

Texts are taken as UTF-8 bytes.  Stretches of windows with the same anchor (see
``_repeats``) that are equal as a whole are settled by their hashes.  The others, the
ragged edges of repeats, go to shards by a core of bytes that all their windows hold.
In a shard, windows whose hash is alone are no repeats, and pieces with the very bytes
of an earlier one are; the rest get a suffix array by induced sorting (SA-IS): suffixes are
classified, leftmost-smaller (LMS) substrings sorted by one induction and named by
comparison, their order refined recursively, whatever the number of names, and all
suffixes induced from it.  From the array follow the permuted common prefixes (only
irreducible ones are compared), and runs of suffixes that share a whole window give its
earliest place; all later ones are repeats.

The strings of a core with more than ``shard_rows`` of them are cut into shorter ones by
the longer cores that these hold, and sharded again.  Only a longer core (all but 7 bytes of
a window) with more than ``shard_rows`` strings is settled by the windows' hashes, range-sorted, instead of in
one task; the result is the same.

Null and empty texts are no bytes; texts shorter than a window lose nothing; very long
ones are hashed in one pass each.  Matches never cross documents.  Repeated rows, one
doc_id with several texts and a null doc_id are as in ``substring_index``.  An empty
table gives an empty table.  Other columns aren't looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _repeats, _text
from ._spark import whole_groups, written

SPANS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


# ------------------------------------------------------------------ suffix arrays


def _types(s: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the next one (the last one is)."""
    n = len(s)
    step = np.sign(np.diff(s.astype(np.int64)))
    at = np.where(step != 0, np.arange(n - 1), n - 1)
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    smaller = np.ones(n, bool)
    smaller[:-1] = np.r_[step, 1][nearest] > 0
    return smaller


def _spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i] .. first[i] + count[i] - 1 for each i, after one another."""
    return np.repeat(first, count) + _text.spread(count)


def _until(own: np.ndarray, target: np.ndarray, end: int) -> int:
    """How many of the entries (in scanning order; buckets ``own``, what they induce goes to ``target``, later than ``own``) can be taken at once: none induces into a bucket that is taken, too."""
    least = np.minimum.accumulate(target)
    stop = least[:-1] < own[1:]
    k = int(stop.argmax()) if len(stop) else 0
    if not len(stop) or not stop[k]:
        return max(int(own[-1]), min(end, int(least[-1])))
    return max(int(own[k]), int(least[k]))


def _sweep(s: np.ndarray, sa: np.ndarray, bounds: np.ndarray, free: np.ndarray, stays: np.ndarray, up: bool) -> None:
    """One induction over ``sa``: from each suffix in order (downwards unless ``up``), the one before it in the text, if ``stays`` has it, goes to the next free place of its bucket.

    Buckets are taken one after another, as in the sequential algorithm, or many at
    once where nothing that they induce belongs among them: some square root of the
    number of names steps for long alphabets.
    """
    n_buckets, steps = len(bounds) - 1, np.arange(len(s))
    last = n_buckets - 1

    def place(j: np.ndarray) -> None:
        if not len(j):
            return
        c = s[j]
        order = np.argsort(c, kind="stable")
        j, c = j[order], c[order]
        new = np.ones(len(c), bool)
        np.not_equal(c[1:], c[:-1], out=new[1:])
        heads = np.flatnonzero(new)
        k = np.empty(len(heads), np.int64)
        k[:-1], k[-1] = heads[1:], len(c)
        k -= heads
        used = c[heads]
        if up:
            sa[np.repeat(free[used] - heads, k) + steps[: len(c)]] = j
            free[used] += k
        else:
            sa[np.repeat(free[used] + heads - 1, k) - steps[: len(c)]] = j
            free[used] -= k

    def before(front: np.ndarray) -> np.ndarray:
        j = front[front > 0] - 1
        return j[stays[j]]

    # in what follows, bucket numbers count in scanning order: c upwards, last - c downwards
    real = (lambda c: c) if up else (lambda c: last - c)
    c, step = 0, 16
    while c < n_buckets:
        end = min(n_buckets, c + step)
        lo, hi = (bounds[c], bounds[end]) if up else (bounds[n_buckets - end], bounds[n_buckets - c])
        while end > c + 1 and hi - lo > 1 << 16:
            end = c + max(1, (end - c) // 4)
            lo, hi = (bounds[c], bounds[end]) if up else (bounds[n_buckets - end], bounds[n_buckets - c])
        if end > c + 1:
            front = sa[lo:hi] if up else sa[lo:hi][::-1]
            front = front[front > 0]
            j = front - 1
            ok = stays[j]
            j, own = j[ok], s[front[ok]]
            if not len(j):
                c, step = end, 2 * (end - c)
                continue
            own, target = (own, s[j]) if up else (last - own, last - s[j])
            e = _until(own, target, end)
            if e > c:
                place(j[own < e])
                step = max(16, 2 * (e - c))
                c = e
                continue
        # one bucket, whose own suffixes come in rounds
        r = real(c)
        a, z = bounds[r], bounds[r + 1]
        if up:
            done = a
            while done < free[r]:
                front, done = sa[done : free[r]].copy(), int(free[r])
                if len(j := before(front)):
                    place(j)
            j = before(sa[free[r] : z])
        else:
            done = z
            while done > free[r]:
                front, done = sa[free[r] : done][::-1].copy(), int(free[r])
                if len(j := before(front)):
                    place(j)
            j = before(sa[a : free[r]][::-1])
        if len(j):
            place(j)
        c += 1


def _induce(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """All suffixes in order, from LMS suffixes in theirs: larger types upwards, then smaller types downwards."""
    n = len(s)
    sa = np.full(n, -1, np.int64)
    heads, tails = bounds[:-1].copy(), bounds[1:].copy()
    counts = np.bincount(s[lms], minlength=len(heads))
    # LMS suffixes at the ends of their buckets, in the given order
    sa[_spans(tails - counts, counts)] = lms[np.argsort(s[lms], kind="stable")]
    _sweep(s, sa, bounds, heads, ~smaller, True)
    # LMS suffixes get their right places among the smaller types
    sa[_spans(heads, bounds[1:] - heads)] = -1
    sa[bounds[s[n - 1]]] = n - 1  # the sentinel is alone in the first bucket
    tails[s[n - 1]] = bounds[s[n - 1]]
    _sweep(s, sa, bounds, tails, smaller, False)
    return sa


def _equal(s: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether s[a : a + size] and s[b : b + size] are equal, symbol by symbol."""
    same = s[_spans(a, size)] == s[_spans(b, size)]
    return np.logical_and.reduceat(same, np.cumsum(size) - size) if len(size) else np.zeros(0, bool)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The suffixes of ``s`` in order, by induced sorting; its last symbol must be its only 0."""
    n = len(s)
    if n < 3:
        return np.arange(n)[::-1]
    smaller = _types(s)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    bounds = np.r_[0, np.cumsum(np.bincount(s))]
    sa = _induce(s, smaller, lms, bounds)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    in_order = sa[is_lms[sa]]
    # names: equal LMS substrings (up to and with the next LMS symbol) share one
    number = np.empty(n, np.int64)
    number[lms] = np.arange(len(lms))
    size = (np.r_[lms[1:] + 1, n] - lms)[number[in_order]]
    alike = np.flatnonzero(size[1:] == size[:-1])
    new = np.ones(len(lms), bool)
    new[alike + 1] = ~_equal(s, in_order[alike], in_order[alike + 1], size[alike])
    names = np.empty(len(lms), np.int64)
    names[number[in_order]] = np.cumsum(new) - 1
    order = np.argsort(names) if new.all() else suffix_array(names)
    return _induce(s, smaller, lms[order], bounds)


def permuted_common_prefixes(data: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each suffix of ``data`` (by its place in the text), the bytes that it shares with the one before it in ``sa``.

    Only irreducible ones (the bytes before the two differ) are compared; each later one is
    one less than its neighbour to the left, until the next irreducible one.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n)
    left = np.r_[-1, data[:-1].astype(np.int64)]
    irreducible = (before < 1) | (at == 0) | (left != np.where(before > 0, left[before], -2))
    i = np.flatnonzero(irreducible & (before >= 0))
    common = np.zeros(n, np.int64)
    common[i] = _shared(data, i, before[i])
    head = np.maximum.accumulate(np.where(irreducible, at, 0))
    return common[head] - (at - head)


def _shared(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes the stretches from a[i] and from b[i] have in common."""
    eight = np.lib.stride_tricks.sliding_window_view(np.r_[data, np.zeros(8, np.uint8)], 8)
    out = np.zeros(len(a), np.int64)
    rest, off, n = np.arange(len(a)), 0, len(data)
    while len(rest):
        x, y = a[rest] + off, b[rest] + off
        far = np.maximum(x, y) >= n
        x, y = np.minimum(x, n), np.minimum(y, n)
        z = np.ascontiguousarray(eight[x]).view("<u8")[:, 0] ^ np.ascontiguousarray(eight[y]).view("<u8")[:, 0]
        differ = (z != 0) | far
        low = z[differ] & (~z[differ] + np.uint64(1))
        more = np.where(low > 0, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8, 0)
        done = rest[differ]
        out[done] = np.minimum(off + np.where(far[differ], 0, more), n - np.maximum(a[done], b[done]))
        rest, off = rest[~differ], off + 8
    return out


def later_windows(strings: list[np.ndarray] | np.ndarray, starts: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """Of all windows that begin at starts[i] .. starts[i] + counts[i] - 1 of the joined bytes, in order, those that one before equals.

    ``strings``: the joined bytes, with one 0 symbol after each string (so no window crosses one).
    """
    data = strings
    s = data.astype(np.int64) + 1
    s[data == 0] = 1
    sa = suffix_array(np.r_[s, 0])[1:]
    new = permuted_common_prefixes(data, sa)[sa] < window
    new[0] = True
    each = np.repeat(starts, counts) + _text.spread(counts)
    valid = np.zeros(len(data), bool)
    valid[each] = True
    place = np.where(valid[sa], sa, len(data))  # other suffixes are no window's
    heads = np.flatnonzero(new)
    firsts = np.minimum.reduceat(place, heads)
    later = np.ones(len(data) + 1, bool)
    later[firsts] = False
    return later[each]


def repeats_among(data: np.ndarray, at: np.ndarray, n: np.ndarray, window: int, passes: int = 3) -> np.ndarray:
    """Of the windows of all strings (``n`` each, from ``at``), in order, those that one before equals.

    Equal windows have equal hashes, so one whose hash no other has is no repeat.  Of
    what is left without such windows, a piece with the very bytes of one before it holds
    nothing but repeats; without these pieces more windows are alone, so the others are
    looked at again.  What then is left goes into a suffix array.
    """
    each = np.repeat(at, n) + _text.spread(n)
    again = np.zeros(len(each), bool)
    if not len(each):
        return again
    h = _text.Rolling(_text.BYTE_KEY[data]).windows(window)[each]
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    shared = np.zeros(len(h), bool)
    shared[order[1:][same]] = shared[order[:-1][same]] = True
    # pieces: runs of such windows in one string
    new = np.ones(len(each), bool)
    new[1:] = ~shared[:-1]
    new[np.cumsum(n)[:-1][np.cumsum(n)[:-1] < len(each)]] = True
    first = np.flatnonzero(new & shared)
    if not len(first):
        return again
    count = np.add.reduceat(shared.astype(np.int64), first)
    whole, seen = data.tobytes(), set()
    copy = np.zeros(len(first), bool)
    for i, (a, z) in enumerate(zip(each[first].tolist(), (each[first] + count + window - 1).tolist())):
        piece = whole[a:z]
        copy[i] = piece in seen
        seen.add(piece)
    own, size = first[~copy], count[~copy]
    if copy.any() and passes > 1:
        again[_spans(own, size)] = repeats_among(data, each[own], size, window, passes - 1)
    else:
        heads = np.cumsum(size + window) - size - window  # a 0 ends each piece
        joined = np.zeros(int((size + window).sum()), np.uint8)
        joined[_spans(heads, size + window - 1)] = data[_spans(each[own], size + window - 1)]
        again[_spans(own, size)] = later_windows(joined, heads, size, window)
    again[_spans(first[copy], count[copy])] = True
    return again


# ------------------------------------------------------------------ tables


STRINGS = "core long, doc long, th int, start int, n int, size long, bytes binary, anchor int"


def _strings(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """For each stretch in doubt, the bytes of its windows, by the core that they all hold.

    Windows that reach at least ``half`` bytes before the anchor share the bytes from
    there through the anchor; the others, those from the anchor on.
    """
    w = window - gram + 1
    half = w // 2

    def run(batches):
        done: set[tuple[int, int]] = set()  # repeated rows of the table meet in one task; the few that skew may part, _shards drops
        for batch in batches:
            names = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            fresh = [x not in done and not done.add(x) for x in names]
            if not all(fresh):
                batch = batch.filter(pa.array(fresh))
            for b in _text.blocks(batch, "text", 1 << 20):
                data, at = _text.raw(b.column(2))
                x = _text.BYTE_KEY[data]
                rolling = _text.Rolling(x)
                row, fp, start, n = _repeats.parts(b.column(3))
                a = at[row] + start
                g = rolling.windows(gram)
                anchor = a + (g[a[:, None] + np.arange(w)] == fp.view(np.uint64)[:, None]).argmax(axis=1)
                cut = np.clip(anchor - half + 1, a, a + n)  # the first window that begins less than half before the anchor
                whole = data.tobytes()
                for begin, end, left in ((a, cut, True), (cut, a + n, False)):
                    has = np.flatnonzero(end > begin)
                    s, e, k, r = begin[has], end[has], anchor[has], row[has]
                    core = rolling.of(k - half, k + gram) if left else rolling.of(k, k + window - half + 1) ^ np.uint64(0x5555555555555555)
                    text = [whole[i : j + window - 1] for i, j in zip(s.tolist(), e.tolist())]
                    index = pa.array(r)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(core.view(np.int64)), b.column(0).take(index), b.column(1).take(index), pa.array(s - at[r], pa.int32()), pa.array(e - s, pa.int32()), pa.array(e - s + window - 1), pa.array(text, pa.binary()), pa.array(k - s, pa.int32())],
                        names=[f.split()[0] for f in STRINGS.split(", ")],
                    )

    return rows.mapInArrow(run, STRINGS)


def _split(strings: DataFrame, window: int, width: int = 8) -> DataFrame:
    """The strings cut into ones of at most ``width`` windows, by the longer core that these share.

    Windows are told apart by where they begin, seen from their anchor, which equal
    windows have at the same place: those of one of ``width`` neighbouring places hold the
    same window - width + 1 bytes.
    """
    names = [f.split()[0] for f in STRINGS.split(", ")]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            data, at = _binary(b.column(6))
            n, anchor = (b.column(i).to_numpy().astype(np.int64) for i in (4, 7))
            first, last = -anchor // width, (n - 1 - anchor) // width
            row = np.repeat(np.arange(len(n)), last - first + 1)
            q = first[row] + _text.spread(last - first + 1)
            begin = np.maximum(q * width + anchor[row], 0)
            end = np.minimum((q + 1) * width + anchor[row], n[row])
            zero = at[row] + anchor[row] + q * width
            # a class that the string has in part may reach beyond it: windows in it still hold these bytes
            core = _text.Rolling(_text.BYTE_KEY[data]).of(zero + width - 1, zero + window) ^ _text.mix(q.astype(np.uint64))
            whole = data.tobytes()
            text = [whole[x:y] for x, y in zip((at[row] + begin).tolist(), (at[row] + end + window - 1).tolist())]
            index = pa.array(row)
            own = [pa.array(core.view(np.int64)), b.column(1).take(index), b.column(2).take(index), pa.array(b.column(3).to_numpy()[row] + begin, pa.int32()), pa.array(end - begin, pa.int32()), pa.array(end - begin + window - 1), pa.array(text, pa.binary()), pa.array(anchor[row] - begin, pa.int32())]
            yield pa.RecordBatch.from_arrays(own, names=names)

    return strings.mapInArrow(run, STRINGS)


def _hot(strings: DataFrame, shard_rows: int) -> DataFrame:
    """The cores of more than ``shard_rows`` strings: at most one for each so many strings."""
    return written(strings.groupBy("core").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > shard_rows).select("core"), "hot")


def _shards(strings: DataFrame, window: int, shard_bytes: int) -> DataFrame:
    """Repeats (doc, th, start, n) among the strings of each core, by suffix arrays of whole cores' strings."""

    def run(batches):
        for t in whole_groups(batches, ["core"], shard_bytes, "size"):
            own = np.stack([t.column(i).to_numpy().astype(np.int64) for i in range(4)])
            again = np.r_[False, (own[:, 1:] == own[:, :-1]).all(axis=0)]
            if again.any():  # one place, not two
                t = t.filter(pa.array(~again))
            n, start = t.column(4).to_numpy().astype(np.int64), t.column(3).to_numpy().astype(np.int64)
            doc, th = t.column(1).to_numpy(), t.column(2).to_numpy()
            data, at = _binary(t.column(6))
            later = repeats_among(data, at[:-1], n, window)
            row = np.repeat(np.arange(len(n)), n)[later]
            pos = (start[row] + _text.spread(n)[later]).astype(np.int64)
            new = np.ones(len(pos), bool)
            new[1:] = (row[1:] != row[:-1]) | (pos[1:] != pos[:-1] + 1)
            first = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays([pa.array(doc[row[first]]), pa.array(th[row[first]]), pa.array(pos[first], pa.int32()), pa.array(np.diff(np.r_[first, len(pos)]), pa.int32())], names=["doc", "th", "start", "n"])

    parts = strings.repartition("core").sortWithinPartitions("core", "doc", "th", "start")
    return parts.mapInArrow(run, "doc long, th int, start int, n int")


def _binary(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    _, at, data = a.buffers()
    at = np.frombuffer(at, np.int32, len(a) + 1, a.offset * 4).astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def _windows(strings: DataFrame, window: int) -> DataFrame:
    def run(batches):
        for b in batches:
            data, at = _binary(b.column(6))
            h = _text.Rolling(_text.BYTE_KEY[data]).windows(window)
            n = b.column(4).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            off = _text.spread(n)
            index = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(index), pa.array(h[at[row] + off].view(np.int64)), b.column(1).take(index), b.column(2).take(index), pa.array(b.column(3).to_numpy()[row] + off, pa.int32())], names=["fp", "wh", "doc", "th", "pos"])

    return strings.mapInArrow(run, "fp long, wh long, doc long, th int, pos int")


def repeated_bytes(rows: DataFrame, window: int = 100, gram: int = 24, shard_bytes: int = 1 << 20, shard_rows: int = 10_000) -> DataFrame:
    """doc, th, start, n: the windows of each document (as stretches) that an equal one precedes."""
    seen = written(_repeats.flagged(rows, window, gram, by_word=False).where("kind > 0"), "stretches")
    doubtful = seen.where("kind = 2").select("fp", "doc", "th", "start", "n")
    strings = written(_strings(_repeats.to_compare(rows, doubtful), window, gram), "strings")
    found = seen.where("kind = 1").select("doc", "th", "start", "n").distinct()
    for last in (False, True):
        hot = _hot(strings, shard_rows)
        if not hot.head(1):
            return found.unionByName(_shards(strings, window, shard_bytes))
        found = found.unionByName(_shards(strings.join(F.broadcast(hot), "core", "left_anti"), window, shard_bytes))
        crowd = strings.join(F.broadcast(hot), "core", "left_semi")
        if last:
            return found.unionByName(_repeats.first_places(_windows(crowd, window)))
        strings = written(_split(crowd, window), "strings")


def suffix_dedup(docs: DataFrame, window: int = 100, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (the other bytes)."""
    rows = _repeats.keyed(docs, doc_id, text)

    def one(body: str, starts: np.ndarray, counts: np.ndarray):
        data = body.encode()
        if not len(starts):
            return len(data), 0, 0, hashlib.sha256(data).hexdigest()
        gone = _repeats.covered(len(data), starts, counts, window)
        return len(data), int(gone.sum()), len(_text.runs_of(gone)[0]), hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest()

    return _repeats.apply_spans(_repeats.with_spans(rows, repeated_bytes(rows, window, **settings)), SPANS, one)
