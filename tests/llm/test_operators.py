"""The ten operators on small awkward tables, against plain Python."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(6000))
PASSAGE = " ".join(f"passage{i}" for i in range(40))


def texts():
    r = random.Random(5)
    words = ["alpha", "beta,", "gamma.", "Delta", "épsilon", "zeta", "1234", "ETA!", "θήτα", "iota"]
    out = [(0, None), (1, ""), (2, " \t\n\x0b\x0c\r "), (3, LONG), (4, LONG), (5, "same line that is long enough\nother\n\n"), (6, "SAME LINE that is long enough\t\nsame line that is long enough"), (7, "x\n  same line that is long enough"), (8, "a b c " * 60), (9, "\n\n\n")]
    out += [(10 + i, f"{' '.join(r.choice(words) for _ in range(30))} {PASSAGE} {' '.join(r.choice(words) for _ in range(r.randrange(40)))}") for i in range(12)]
    out += [(30 + i, " ".join(f"{r.choice(words)}{r.randrange(400)}" for _ in range(r.randrange(200)))) for i in range(20)]
    base = [f"near{i}" for i in range(120)]
    for i in range(6):
        copy = list(base)
        for _ in range(3):
            copy[r.randrange(120)] = f"edit{r.randrange(9999)}"
        out.append((60 + i, " ".join(copy)))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, "z", 2.0) for i, t in texts()]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words int, kept string, sequence_id double")


@pytest.fixture(scope="module")
def awkward(docs):
    """Repeated rows, a null id, one id with two texts."""
    more = docs.sparkSession.createDataFrame([(None, PASSAGE, 1, "z", 2.0), (3, LONG, 1, "z", 2.0), (11, "another text of document eleven", 1, "z", 2.0)], docs.schema)
    return docs.unionByName(more)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def test_packing(spark, awkward):
    from tokenizers import Tokenizer

    from folioworks.llm import packing
    from folioworks.llm.tokens import vocabulary_path

    tok = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    got = packing.pack_documents(awkward, capacity=256).toPandas()
    want = collections.Counter()
    for r in awkward.collect():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), 256):
            want[(r.doc_id, k // 256, k, len(ids[k : k + 256]), zlib.crc32(ids[k : k + 256].tobytes()))] += 1
    key = [(None if d != d else int(d), p, s, n, c) for d, p, s, n, c in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert collections.Counter(key) == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 256
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 256) * 1.05 + 1
    whole = packing.sequences(packing.pack_documents(awkward.where("doc_id between 30 and 40"), 256), awkward.where("doc_id between 30 and 40"), 256)
    assert whole.where(F.size("ids") > 256).count() == 0


def test_best_fit_is_exact():
    """A sweep over runs packs as best-fit decreasing does one by one."""
    from folioworks.llm.packing import best_fit

    r = random.Random(3)
    for _ in range(60):
        sizes = [r.randrange(1, 101) for _ in range(r.randrange(1, 60))]
        bins = []
        for s in sorted(sizes, reverse=True):
            fits = [i for i, b in enumerate(bins) if b >= s]
            i = min(fits, key=lambda i: bins[i]) if fits else len(bins)
            if not fits:
                bins.append(100)
            bins[i] -= s
        runs = collections.Counter(sizes)
        placed, gaps, left = best_fit([(s, 0, n) for s, n in runs.items()], [], (100, 0))
        assert not left and sum(p[2] for p in placed) == len(sizes)
        used = {q + k for *_, n, q, a, g in [(p[0], p[1], p[2], p[3], p[4], p[5]) for p in placed] for k in range(-(-n // a))}
        assert len(used) == len(bins)


def jaccard_truth(rows, n=3, t=0.5):
    sets = {}
    for _, x in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
        k = min(n, len(w))
        sets[x or ""] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
    return sets


def test_ngram_join(awkward):
    from folioworks.llm.ngram_join import ngram_join, one_of_each

    out = ngram_join(awkward, block=4)
    got = collections.defaultdict(list)
    for r in out.collect():
        got[r.doc_id].append(r)
    rows = [(r.doc_id, r.text or "") for r in awkward.collect()]
    sets = jaccard_truth(rows)
    for i, x in rows:
        want = sum(1 for _, y in rows if y == x or (sets[x] | sets[y] and len(sets[x] & sets[y]) >= 0.5 * len(sets[x] | sets[y]))) - 1
        assert want in {r.n_links for r in got[i]}, i
    near = {r.group_id for i in range(60, 66) for r in got[i]}
    assert near == {60} and {r.group_id for r in got[3] + got[4]} == {3} and {r.n_copies for r in got[3]} == {3}
    kept = one_of_each(awkward, out)
    ids = [r.doc_id for r in kept.collect()]
    assert 60 in ids and not set(range(61, 66)) & set(ids) and ids.count(3) == 1 and 4 not in ids and kept.columns == awkward.columns


def test_hot_bucket_is_chained(spark):
    """A bucket over many ranges keeps its classes connected, with few links a row."""
    from folioworks.llm._components import components
    from folioworks.llm.ngram_join import chained

    links = chained(spark.range(3000).select(F.lit(7).cast("long").alias("key"), F.col("id").alias("node")), 6)
    assert links.count() < 3000 * 7 and components(links).select("label").distinct().count() == 1


def test_components_with_hot_centres(spark):
    """Stars whose centres are salted, and chains, against union-find."""
    from folioworks.llm._components import components

    r = random.Random(6)
    pairs = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 399)] + [(r.randrange(2000, 2300), r.randrange(2000, 2300)) for _ in range(150)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        u, v = sorted((find(a), find(b)))
        root[v] = u
    want = {x: find(x) for a, b in pairs if a != b for x in (a, b)}
    for hot in (1 << 20, 50):
        got = {x.node: x.label for x in components(spark.createDataFrame(pairs, "a long, b long"), hot).collect()}
        assert got == want


def test_bucket_of_ten_thousand_classes(spark):
    """Near pairs among 10,000 different texts that one bucket holds, wherever they lie in it."""
    from folioworks.llm.ngram_join import crowded, streamed

    r = np.random.default_rng(9)
    signs = r.integers(0, 256, (10_000, 64)).astype(np.uint8)
    pairs = {tuple(sorted((int(a), int(b)))) for a, b in r.permutation(10_000)[:400].reshape(-1, 2)}
    for a, b in pairs:
        signs[b] = np.where(r.random(64) < 0.7, signs[a], signs[b])  # some 0.7 of the signature agrees
    nibbles = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(signs)], "node long, nibbles binary")
    told = streamed(spark.range(10_000).select(F.lit(7).cast("long").alias("key"), F.col("id").alias("node")), 6)
    got = {tuple(sorted(x)) for x in crowded(told, nibbles, 0.33).collect()}
    assert len(pairs & got) >= 0.95 * len(pairs) and len(got - pairs) < 5


def test_near_pairs_of_a_hot_bucket(spark):
    """Near pairs are found among many texts that share a passage and a bucket, whatever their places there."""
    from folioworks.llm.ngram_join import bands_for, crowded, ngram_join, sketches, streamed

    r = np.random.default_rng(5)
    word = lambda n, at: [f"w{at}x{i}" for i in range(n)]
    shared = word(60, "shared")
    rows = []
    for k in range(300):
        own = word(100, k)
        rows.append((k, " ".join(shared + own)))
        if k % 2 == 0:
            rows.append((1000 + k, " ".join(shared + own[:72] + word(28, f"{k}y"))))
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    bands = {x.doc: set(x.bands) for x in sketches(texts, 3, bands_for(0.5, 0.96, 1), 1, "doc_id", "text").collect()}
    met = [k for k in range(0, 300, 2) if bands[k] & bands[1000 + k]]
    got = {x.doc_id: x.group_id for x in ngram_join(texts, rows=1).collect()}
    assert len(met) > 140 and [k for k in met if got[1000 + k] != k] == []
    # one bucket over several ranges and blocks
    signs = r.integers(0, 256, (2000, 64)).astype(np.uint8)
    pairs = {(int(a), int(b)) for a, b in r.permutation(2000)[:80].reshape(-1, 2)}
    for a, b in pairs:
        signs[b] = signs[a]
    nibbles = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(signs)], "node long, nibbles binary")
    told = streamed(spark.range(2000).select(F.lit(7).cast("long").alias("key"), F.col("id").alias("node")), 6)
    for block in (4096, 300):
        assert {tuple(sorted(x)) for x in crowded(told, nibbles, 0.33, block).collect()} == {tuple(sorted(x)) for x in pairs}


def test_line_dedup(awkward):
    from folioworks.llm.line_dedup import LOWER, UPPER, bitmap, line_dedup, line_dedup_digest, unpack

    rows = [(-1 if r.doc_id is None else r.doc_id, r.text or "") for r in awkward.collect()]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(UPPER, LOWER))
    held = collections.defaultdict(set)
    for i, x in rows:
        for line in x.split("\n"):
            held[key(line)].add(i)
    want = collections.Counter()
    for i, x in rows:
        lines = x.split("\n")
        kept = [s for s in lines if not (len(key(s)) >= 20 and len(held[key(s)]) >= 3 and max(held[key(s)]) != i)]
        want[(i, len(lines), len(lines) - len(kept), sha("\n".join(kept)))] += 1
    got = collections.Counter((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup_digest(awkward).collect())
    assert got == want
    assert set(line_dedup(awkward).columns) == {*awkward.columns, "n_lines", "n_dropped"}
    for positions in ([0], [7], [8], [3, 15, 16], list(range(40))):
        keep = unpack(bitmap(np.array(positions)), 50)
        assert np.flatnonzero(~keep).tolist() == positions


def test_line_keys_keep_f_and_lose_form_feeds(spark):
    """Lines that begin or end with f or F keep it in their key; form feeds go."""
    from folioworks.llm.line_dedup import line_dedup

    lines = [("For example these are the same", "for example these are the same", "\ffor example these are the same\f"), ("fall is a line of its own here", "all is a line of its own here", "all is a line of its own here")]
    lines += [("f" + "x" * 18 + "F", "F" + "x" * 18 + "f", "f" + "x" * 18 + "f\f\f")]
    rows = [(i, "\n".join(x[i] for x in lines)) for i in range(3)]
    got = {x.doc_id: x.text for x in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: lines[1][0], 1: lines[1][1], 2: rows[2][1]}


def test_line_dedup_of_a_hot_line(spark):
    """A key over several ranges has one keeper."""
    from folioworks.llm.line_dedup import line_dedup_digest

    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a line that all of them hold\nown "), F.col("id")).alias("text"))
    assert {r.n_dropped: r["count"] for r in line_dedup_digest(d).groupBy("n_dropped").count().collect()} == {1: 3999, 0: 1}


def repeats(rows, size, split, join):
    seen, out = set(), {}
    for i, x in sorted(rows, key=lambda r: r[0]):
        s = split(x)
        gone = [False] * len(s)
        for j in range(len(s) - size + 1):
            k = join(s[j : j + size])
            if k in seen:
                gone[j : j + size] = [True] * size
            seen.add(k)
        out[i] = (s, gone)
    return out


@pytest.mark.parametrize("batches", [1, 3, 6])
def test_substring_dedup(docs, batches):
    from folioworks.llm.substring_index import substring_dedup

    want = {i: (len(s), sum(g), sha(" ".join(w for w, x in zip(s, g) if not x))) for i, (s, g) in repeats([(r.doc_id, r.text) for r in docs.collect()], 20, words, tuple).items()}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(docs, batches=batches).collect()} == want


@pytest.mark.parametrize("batches", [1, 2])
def test_substring_dedup_on_an_index(spark, batches):
    """A second call finds what the first one's documents hold, ragged ends included, and is refused without them."""
    from folioworks.llm.substring_index import FingerprintIndex, substring_dedup

    r = np.random.default_rng(3)
    new = lambda n: [f"w{x}" for x in r.integers(0, 10**9, n)]
    passages = [new(n) for n in (21, 24, 30, 60, 200)]
    rows = [(i, " ".join(new(15) + p + new(17))) for i, p in enumerate(passages * 3)]
    want = {i: sum(g) for i, (s, g) in repeats(rows, 20, words, tuple).items()}
    first, second = (spark.createDataFrame(x, "doc_id long, text string") for x in (rows[:5], rows[5:]))
    index = FingerprintIndex(spark, fanout=2)
    substring_dedup(first, index=index, batches=2).count()
    with pytest.raises(ValueError):
        substring_dedup(second, index=index)
    with pytest.raises(ValueError):  # not after the documents that it has
        substring_dedup(first, index=index, history=first)
    assert len(index.runs) == 2
    index = FingerprintIndex.open(spark, index.path)
    got = {x.doc_id: x.n_removed for x in substring_dedup(second, batches=batches, index=index, history=first).collect()}
    assert got == {i: want[i] for i in range(5, 15)}
    assert len(index.runs) == 2 and FingerprintIndex.open(spark, index.path).runs == index.runs  # two were compacted before the next came


def test_index_ranges_and_merges():
    """Bounds that cut a hot anchor, and streams merged in small pieces, against plain sorting."""
    import pyarrow as pa

    from folioworks.llm._repeats import NAMES
    from folioworks.llm.substring_index import merged, range_of

    r = np.random.default_rng(2)
    bounds = np.array(sorted({(int(a), int(b)) for a, b in zip(r.choice([3, 5, 5, 5, 9], 30), r.integers(0, 50, 30))}), np.int64)
    fp, sh = r.integers(0, 12, 500), r.integers(0, 50, 500)
    assert range_of(fp, sh, bounds).tolist() == [sum((a, b) <= (int(x), int(y)) for a, b in bounds.tolist()) for x, y in zip(fp, sh)]
    assert range_of(fp, sh, np.zeros((0, 2), np.int64)).tolist() == [0] * 500
    for _ in range(40):
        streams, every = [], []
        for k in range(int(r.integers(1, 5))):
            rows = sorted({(int(a), int(b)) for a, b in r.integers(-6, 6, (int(r.integers(0, 60)), 2))})
            if k == 3:
                rows = sorted(rows * 3)
            every += [(*x, k) for x in rows]
            size = int(r.integers(1, 9))
            cut = lambda rows=rows, k=k, size=size: (pa.RecordBatch.from_arrays([pa.array([x[c] if c < 2 else k for x in rows[i : i + size]], pa.int64()) for c in range(6)], names=NAMES) for i in range(0, len(rows), size))
            streams.append(cut())
        got = [(a, b, int(k)) for t, of in merged(streams) for a, b, k in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), of)]
        assert got == sorted(every)


def test_substring_dedup_awkward(awkward):
    from folioworks.llm.substring_index import substring_dedup

    got = collections.defaultdict(set)
    for r in substring_dedup(awkward).collect():
        got[r.doc_id].add(r.n_removed)
    assert got[None] == {0} and got[3] == {repeats([(0, LONG)], 20, words, tuple)[0][1].count(True)} and got[4] == {6000} and len(got[11]) == 2


@pytest.mark.parametrize("shard_rows", [10_000, 5, 2])
def test_suffix_dedup(docs, shard_rows):
    from folioworks.llm.suffix_dedup import suffix_dedup

    want = {}
    for i, (s, g) in repeats([(r.doc_id, r.text) for r in docs.collect()], 100, lambda x: (x or "").encode(), bytes).items():
        flags = bytes(g)
        want[i] = (len(s), sum(g), len(re.findall(b"\1+", flags)), sha(bytes(b for b, x in zip(s, g) if not x)))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(docs, shard_rows=shard_rows).collect()} == want


def test_suffix_dedup_ranges_from_sample(awkward, monkeypatch):
    """Ranges that are told from some entries, and Spark's own: the same result; no sampling of all entries with them."""
    from folioworks.llm import _repeats
    from folioworks.llm.suffix_dedup import suffix_dedup

    want = sorted(map(str, suffix_dedup(awkward).collect()))
    rows = _repeats.keyed(awkward)
    keys = _repeats.entries(rows, 100, 24, False).select("fp", "sh").toPandas().sort_values(["fp", "sh"]).to_numpy(np.int64)
    bounds = np.unique(keys[[len(keys) * k // 4 for k in (1, 2, 3)]], axis=0)
    monkeypatch.setattr(_repeats, "bounds_of", lambda *a: bounds)
    plan = _repeats.flagged(rows, 100, 24, False)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan.lower()
    assert sorted(map(str, suffix_dedup(awkward).collect())) == want
    monkeypatch.undo()
    many = awkward.sparkSession.range(400).selectExpr("id AS doc_id", "repeat(concat(sha2(cast(id % 300 AS string), 256), sha2(cast(id AS string), 256)), 12) AS text")
    assert 1 <= len(_repeats.bounds_of(_repeats.keyed(many), 100, 24, False, sampled=100)) <= 3


def test_suffix_arrays_of_repeats_only(monkeypatch):
    """Of a crowd that shares a core, only what may repeat goes into a suffix array, once each; the result is that of comparing all windows."""
    from folioworks.llm import suffix_dedup

    r = np.random.default_rng(2)
    piece = lambda n: bytes(r.integers(97, 123, n).astype(np.uint8))
    core, sizes, real = piece(62), [], suffix_dedup.later_windows
    monkeypatch.setattr(suffix_dedup, "later_windows", lambda data, *a: sizes.append(len(data)) or real(data, *a))
    crowd = [piece(38) + core + piece(38) for _ in range(1000)]
    crowd += [crowd[0], crowd[7][20:], crowd[7][:-9], crowd[3] + crowd[4]] + [crowd[5]] * 50
    for strings, most in ((crowd, 1500), ([b"ab" * int(k) for k in r.integers(50, 70, 40)], 10**6), (crowd[:1000], 0), ([crowd[9]], 0), ([], 0)):
        sizes.clear()
        size = np.array([len(x) for x in strings], np.int64)
        got = suffix_dedup.repeats_among(np.frombuffer(b"".join(strings), np.uint8), np.cumsum(size) - size, size - 99, 100)
        seen, want = set(), []
        for x in strings:
            for i in range(len(x) - 99):
                want.append(x[i : i + 100] in seen)
                seen.add(x[i : i + 100])
        assert got.tolist() == want and sum(sizes) <= most


def test_suffix_array():
    from folioworks.llm.suffix_dedup import later_windows, permuted_common_prefixes, suffix_array

    r = np.random.default_rng(0)
    for t in range(400):
        s = np.r_[np.tile(r.integers(1, 3, r.integers(1, 4)), 20) if t % 3 == 0 else r.integers(1, r.integers(2, 6), r.integers(1, 60)), 0]
        if t % 5 == 0:
            s = np.unique(np.r_[r.integers(1, 90, r.integers(1, 200)), 0], return_inverse=True)[1]
        sa = sorted(range(len(s)), key=lambda i: s[i:].tolist())
        assert suffix_array(s).tolist() == sa
        data = s[:-1].astype(np.uint8)
        got = permuted_common_prefixes(data, np.array(sa[1:], np.int64)) if len(data) else []
        for a, b in zip(sa[1:], sa[2:]):
            assert got[b] == next((n for n in range(len(data)) if max(a, b) + n >= len(data) or data[a + n] != data[b + n]), len(data))
    for _ in range(100):
        strings = [bytes(r.integers(97, 99, r.integers(6, 20)).astype(np.uint8)) for _ in range(r.integers(1, 8))]
        starts = np.cumsum([0] + [len(x) + 1 for x in strings])[:-1]
        got = later_windows(np.frombuffer(b"".join(x + b"\0" for x in strings), np.uint8), starts, np.array([len(x) - 5 for x in strings]), 6)
        seen, want = set(), []
        for x in strings:
            for i in range(len(x) - 5):
                want.append(x[i : i + 6] in seen)
                seen.add(x[i : i + 6])
        assert got.tolist() == want


def test_suffix_array_of_many_names():
    """Reduced strings of far more than a thousand names are sorted by the same recursion."""
    from folioworks.llm.suffix_dedup import suffix_array

    r = np.random.default_rng(1)
    for s in (r.integers(1, 60, 60_000), r.permutation(np.arange(1, 20_000)), np.tile(r.integers(1, 9000, 9000), 3)):
        s = np.unique(np.r_[s, 0], return_inverse=True)[1].astype(np.int64)
        sa = suffix_array(s)
        assert sorted(sa.tolist()) == list(range(len(s)))
        rank = np.empty(len(s) + 1, np.int64)
        rank[sa], rank[-1] = np.arange(len(s)), -1
        a, b = sa[:-1], sa[1:]  # each suffix is less than the next: by its first symbol, else by the rest's rank
        assert ((s[a] < s[b]) | (s[a] == s[b]) & (rank[a + 1] < rank[b + 1])).all()


def test_chat(spark):
    from folioworks.llm import chat_format as C

    rows = [(1, 0, "user", "a\\l<s>[INST]\n"), (1, 1, "assistant", "[/INST]</s>"), (1, 1, "assistant", "b"), (2, 0, None, None), (None, 5, "as\n<x", "y"), (3, 0, "user", "z" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("spans", F.lit(1))
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, role or "", text or ""))
    full = {r.conv_id: r for r in C.format_conversations(df).collect()}
    for r in C.format_digest(df).collect():
        turns = [(a, b) for _, a, b in sorted(by[r.conv_id])]
        said = "".join(b for a, b in turns if a == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(said), sha(said))
        text = full[r.conv_id].formatted
        assert C.read_back(text) == turns and len(text) == r.formatted_chars
        assert "".join(C.unescape(text[s.start : s.end]) for s in full[r.conv_id].spans) == said
    assert C.format_digest(df.limit(0)).count() == 0


def test_templates():
    from folioworks.llm import chat_format as C

    assert C.fold(C.parse("a{{ 'b' + 'C' | lower }}{% if 1 == 2 %}x{% elif true %}y{% else %}z{% endif %}")) == (C.Text("abcy"),)
    text, spans = C.render("{% for m in messages %}{% if loop.first and not m.x %}^{% endif %}{% generation %}{{ m.t | upper }}{% endgeneration %};{% endfor %}", [{"t": "a"}, {"t": None}])
    assert text == "^A;;" and spans == [(1, 2), (3, 3)]
    for bad in ("{% for m %}{% endfor %}", "{{ m.__class__ }}", "{{ a() }}", "{% if a %}", "{% import os %}", "{{ x | eval }}"):
        with pytest.raises(C.TemplateError):
            C.parse(bad)


def test_urls(spark):
    from folioworks.llm import url_filters as U

    def brute(u):
        if "://" not in (u or ""):
            return "", "", None
        m = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1], re.S)
        host, path = re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]
        best = None
        for rule in U.RULES:
            h, _, p = rule.pattern.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule.pattern) > len(best)):
                best = rule.pattern
        return host, path if (m[2][:1] in ("/", "")) else "", best

    urls = [None, "", "nope", "http://com", "http://com/", "http://example.com/en/", "http://A.EXAMPLE.com/en/x?y", "http://www.example.com/en/#", "x://evil.org/a.example.com/en/", "http://xexample.com/en/", "http://fr.net/es/", "http://net/fr/ü", "http://a?b.com/", "http://.com/", "http:///en/", "http://a.net/fr" + "x" * 3000]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule) for r in U.url_filters(df).collect()}
    assert got == {i: brute(u) for i, u in enumerate(urls)}
    many = [f"h{i}.org/p*q?/" for i in range(60)]  # several words of states
    fits = U.Automaton(many).fits(*__import__("folioworks.llm._text", fromlist=["raw"]).raw(__import__("pyarrow").array([".h7.org/pabcqz/tail", ".x.h59.org/pq//", ".h7.org/p/qz/"], "large_string")))
    assert [np.flatnonzero(f).tolist() for f in fits] == [[7], [], []]


def test_classifier(spark, docs, data):
    from folioworks.llm import quality_classifier as Q

    d, labels = spark.read.parquet(f"{data[:-5]}0.01/documents.parquet"), spark.read.parquet(f"{data[:-5]}0.01/labels.parquet")
    got = Q.quality_scores(d, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.held_out == held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert ((held.score >= 0.3) == held.predicted).all() and (held.predicted == held.quality).mean() > 0.95 and got.score.between(0, 1).all()
    none = Q.quality_scores(docs, labels.limit(0)).toPandas()
    assert len(none) == docs.count() and (none.score == 0.5).all()
    assert Q.pool(np.ones(4), np.array([0.0, 1.0, 0.5, 2.0])).tolist() == [0.0, 0.75, 0.75, 2.0]


def test_quality_rules(awkward):
    from folioworks.llm.quality_rules import quality_rules

    out = quality_rules(awkward)
    for r in out.collect():
        w = words(r.text)
        c = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {j + k for j in range(len(w) - 2) if c[tuple(w[j : j + 3])] > 1 for k in range(3)}
        lines = [x for x in (r.text or "").split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.text or "")), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.kept and r.base_failed)
    assert quality_rules(awkward.limit(0)).count() == 0


def plain_measures(text):
    """The tokeniser's figures of one text, word by word."""
    import math

    from folioworks.llm.tokens import encoder, fallback_ids

    w = words(text)
    byte_n = sum(encoder("byte_bpe_50k.tiktoken")([x])[1][0] for x in w)
    ids = [int(i) for x in w for i in encoder("piece_bpe_32k.model")([x])[0]]
    chars = sum(map(len, w))
    c = collections.Counter(ids)
    return {
        "n_tokens": len(ids), "chars_a_token": chars / max(1, byte_n), "piece_chars_a_token": chars / max(1, len(ids)),
        "fallback_share": sum(bool(fallback_ids("piece_bpe_32k.model")[i]) for i in ids) / max(1, len(ids)), "token_entropy": -sum(n / len(ids) * math.log2(n / len(ids)) for n in c.values()) if ids else 0.0,
    }


def test_fertility_and_bands_by_brute_force(spark):
    """Every measure, learnt band and verdict against a plain version; copies don't narrow a band."""
    import math

    from folioworks.llm.quality_rules import BANDED, BANDS, SCRIPTS, learnt_bands, measures, quality_rules

    r = random.Random(8)
    stems = {"en": "the river stone walks under bright morning light over green hills toward quiet towns".split(), "ru": "река камень утро свет холмы тихий город дорога зима весна".split(), "zh": "河 石 早晨 光 山 安静 城 路 冬 春".split()}
    rows = []
    for i in range(150):
        lang = ("en", "en", "en", "ru", "zh")[i % 5]
        rows.append((i, " ".join(r.choice(stems[lang]) + (r.choice(("", "s", ",", "ing", "stone", "light", "bury", "ward", "less", "ful")) if lang == "en" else "") for _ in range(r.choice((60, 70, 130, 140)))), lang.upper() if i % 7 == 0 else lang))
    rows += [(200 + i, rows[0][1], "en") for i in range(60)]  # copies
    rows += [(300, " ".join(f"{r.choice(stems['en'])}$$$***" for _ in range(90)), "en"), (301, None, None), (302, "", "en"), (303, "é" * 20_000, ""), (304, "αβγ " * 70, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("in_band", F.lit("z"))
    got = {x.doc_id: x for x in quality_rules(df, least_texts=10, spreads=3.0).collect()}
    lang = {i: (x or "").lower()[:2] or "--" for i, _, x in rows}
    groups = collections.defaultdict(set)
    for i, t, _ in rows:
        x, m = got[i], plain_measures(t)
        for k, v in m.items():
            assert abs(getattr(x, k) - v) < 1e-9, (i, k)
        if not x.base_failed:
            figures = (x.n_words, x.word_chars, x.n_tokens, *(math.floor(m[c] * 200) for c in BANDED))
            for octave in (math.floor(math.log2(max(1, x.n_tokens))), -1):
                groups[(x.script, lang[i], octave)].add(figures)
    want = {}
    for key, texts in groups.items():
        if len(texts) >= 10:
            for k, (c, least) in enumerate(BANDED.items()):
                bins = sorted(x[3 + k] for x in texts)
                q = [next(b for b in bins if sum(y <= b for y in bins) * 4 >= len(bins) * j) for j in (1, 2, 3)]
                s = max((q[2] - q[1]) / 134.9, (q[1] - q[0]) / 134.9, least)
                s *= 4.5 if key[2] < 0 else 3
                want[(*key, c)] = ((q[1] + 0.5) / 200 - s, (q[1] + 0.5) / 200 + s)
    bands = learnt_bands(measures(df), least_texts=10, spreads=3.0).collect()
    assert {(b.script, b.language, b.octave, c) for b in bands for c in BANDED} == set(want) and len({b.script for b in bands}) > 2
    for b in bands:
        for c in BANDED:
            low, high = want[(b.script, b.language, b.octave, c)]
            assert abs(b[f"{c}_low"] - low) < 1e-9 and abs(b[f"{c}_high"] - high) < 1e-9
    for i, x in got.items():
        f = BANDS[x.script]
        good = f.chars_a_token[0] <= x.chars_a_token <= f.chars_a_token[1] and f.piece_chars_a_token[0] <= x.piece_chars_a_token <= f.piece_chars_a_token[1] and x.fallback_share <= f.most_fallback and x.token_entropy >= f.least_entropy
        for c in BANDED:
            low, high = want.get((x.script, lang[i], math.floor(math.log2(max(1, x.n_tokens))), c)) or want.get((x.script, lang[i], -1, c)) or (-1e9, 1e9)
            good &= low <= x[c] <= high
        assert x.script in SCRIPTS and x.in_band == good and x.kept == (good and not x.base_failed), i
    assert not got[300].base_failed and not got[300].kept and got[0].kept and got[200].kept
    assert quality_rules(df.limit(0)).count() == 0 and set(quality_rules(df).columns) >= {*df.columns, "kept"}


def test_bands_reject_junk_that_the_base_rule_lets_through(spark, data):
    """Labelled texts, judged by bands learnt without labels: some junk goes, at most one in a hundred good texts does."""
    from folioworks.llm.quality_rules import quality_rules

    d = quality_rules(spark.read.parquet(f"{data[:-5]}0.01/documents.parquet"), keep_text=False)
    got = d.join(spark.read.parquet(f"{data[:-5]}0.01/labels.parquet"), "doc_id").where("not base_failed").toPandas()
    bad, good = got[got.quality == 0], got[got.quality == 1]
    assert (~bad.in_band).mean() > 0.5 and (~good.in_band).mean() <= 0.01
    r = random.Random(4)
    junk = [" ".join(f"ab{chr(r.randrange(0x2600, 0x26FF))}{chr(r.randrange(0x1F600, 0x1F640))}" for _ in range(80)), " ".join(r.choice(("the", "of", "and", "to", "in", "is", "it")) for _ in range(60))]
    got = [(x.base_failed, x.kept, x.fallback_share > 0.2, x.token_entropy < 4.8) for x in quality_rules(spark.createDataFrame(enumerate(junk), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert [x[1] for x in got] == [False, False] and got[0][2] and not got[0][0] and got[1][3]


@pytest.mark.parametrize("block_bytes", [1 << 20, 150])
def test_decontamination(spark, awkward, block_bytes):
    from folioworks.llm.decontaminate import decontaminate

    items = [(1, PASSAGE), (2, PASSAGE.upper()), (3, None), (4, "..."), (5, "same line"), (6, " ".join(f"w{i}x{i}" for i in range(3, 9))), (7, "absent words here"), (None, "gamma"), (1, PASSAGE)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    split = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
    windows = collections.defaultdict(set)
    for i, x in items:
        w = split(x)
        m = min(13, len(w))
        for j in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[j : j + m])].add("null" if i is None else str(i))
    for r in decontaminate(awkward, bench, block_bytes=block_bytes).collect():
        w = split(r.text)
        hit, found = set(), set()
        for m in {len(k) for k in windows}:
            for j in range(len(w) - m + 1):
                if tuple(w[j : j + m]) in windows:
                    hit |= set(range(j, j + m))
                    found |= windows[tuple(w[j : j + m])]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w))
        assert sum(s.end - s.start for s in r.hits) == len(hit)
    assert decontaminate(awkward, bench.limit(0)).where("contaminated").count() == 0


def test_empty_tables(spark, docs):
    from folioworks.llm import decontaminate, line_dedup, ngram_join, packing, quality_classifier, substring_index, suffix_dedup

    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for out in (
        packing.pack_documents(none), ngram_join.ngram_join(none), line_dedup.line_dedup_digest(none), substring_index.substring_dedup(none), quality_classifier.quality_scores(none, labels), suffix_dedup.suffix_dedup(none),
        decontaminate.decontaminate(none, none.withColumnRenamed("doc_id", "item_id")),
    ):
        assert out.count() == 0


def test_suffix_dedup_against_sql(spark, data, duck):
    """The whole query against its SQL, which compares windows as strings."""
    from folioworks.llm.queries import ORACLE_SQL, QUERIES

    got = {r.doc_id: tuple(r) for r in QUERIES["op8_suffix_array_dedup"](spark, data).collect()}
    assert got == {r[0]: r for r in duck.sql(ORACLE_SQL["op8_suffix_array_dedup"]).fetchall()}


def test_classifier_by_plain_numpy(spark):
    """Scores against features, normal equations, ridge and pooling done in one place."""
    import math

    import pyarrow as pa

    from folioworks.llm import quality_classifier as Q

    r = random.Random(12)
    good = lambda: " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(2, 9))) for _ in range(r.randrange(40, 120)))
    junk = lambda: " ".join(r.choice(("buy!!!", "$$$", "NOW", "click|here", "ok", "ok")) for _ in range(r.randrange(10, 90)))
    rows = [(i, good() if i % 3 else junk(), 7.0) for i in range(240)] + [(None, good(), 7.0), (5, rows0 := good(), 7.0), (5, rows0, 7.0), (900, None, 7.0), (901, "", 7.0)]
    labels = [(i, int(i % 3 > 0) if i % 17 else 0, 0) for i in range(0, 240, 2)] + [(None, 1, 0), (5, 1, 0), (6, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double").withColumn("quality", F.lit(0)).withColumn("x", F.lit("z"))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("label's own"))
    got = Q.quality_scores(docs, table).toPandas()
    stats = Q.statistics(pa.array([t for _, t, _ in rows], pa.string()))
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0 for i, *_ in rows]
    known = collections.defaultdict(list)
    for i, y, _ in labels:
        if i is not None and y is not None:
            known[i].append(y)
    train = [(k, y) for k, (i, *_) in enumerate(rows) if not held[k] for y in known.get(i, [])]
    x, y = stats[[k for k, _ in train]], np.array([v for _, v in train], float)
    n, d, m = len(y), x.shape[1], 192
    rng = np.random.default_rng(7)
    w, phase = rng.normal(0, 1 / 4.0, (d, m)), rng.uniform(0, 2 * np.pi, m)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale <= 1e-9] = 1.0

    def features(v):
        z = np.clip((v - mean) / scale, -8, 8)
        return np.array([[math.sqrt(2 / m) * math.cos(float(a @ w[:, j]) + phase[j]) for j in range(m)] + list(a / 8) + [1.0] for a in z])

    f = features(x)
    penalty = np.diag([1e-3 * n / m] * (m + d) + [1e-9])
    solution = np.linalg.solve(f.T @ f + penalty, f.T @ y)
    bins = np.clip((f @ solution + 0.5) / 2 * 1024, 0, 1023).astype(int)
    used = sorted(set(bins))
    blocks = [[(bins == b).sum(), y[bins == b].mean(), [b]] for b in used]
    k = 0
    while k < len(blocks) - 1:  # pool adjacent violators, from the start again after each
        if blocks[k][1] >= blocks[k + 1][1]:
            a, b = blocks[k], blocks.pop(k + 1)
            blocks[k] = [a[0] + b[0], (a[0] * a[1] + b[0] * b[1]) / (a[0] + b[0]), a[2] + b[2]]
            k = 0
        else:
            k += 1
    value = {b: v for _, v, bs in blocks for b in bs}
    knots = [-0.5 + (b + 0.5) * 2 / 1024 for b in used]
    want = np.interp(features(stats) @ solution, knots, [value[b] for b in used])
    key = lambda i, s: (str(None if i is None or i != i else int(i)), round(float(s), 4))
    assert sorted(key(i, s) for i, s in zip(got.doc_id, got.score)) == sorted(key(i, s) for (i, *_), s in zip(rows, want))
    assert sorted(got.held_out) == sorted(held) and ((got.score >= 0.3) == got.predicted).all() and got.columns.tolist() == ["doc_id", "held_out", "score", "predicted"]


def test_urls_of_an_empty_table(spark):
    from folioworks.llm.url_filters import url_filters

    out = url_filters(spark.createDataFrame([], "page_id long, url string, host string"))
    assert out.count() == 0 and out.columns.count("host") == 1


def test_texts_longer_than_a_block(spark):
    """A text of over 2 MB, a copy of it and a short one, through the operators that take texts in blocks."""
    from folioworks.llm import decontaminate, line_dedup, ngram_join, packing, quality_rules, substring_index, suffix_dedup

    r = np.random.default_rng(4)
    w = np.array([f"{a}{b}" for a in "bcdfghjklmnpqrstvwxz" for b in ("a", "e", "io", "un", "ark")])[r.integers(0, 100, 600_000)]
    long = "\n".join(" ".join(w[i : i + 12]) for i in range(0, len(w), 12))
    rows = [(1, long), (2, long), (3, " ".join(w[5000:5100]))]
    assert len(long) > 2 << 20
    df = spark.createDataFrame(rows, "doc_id long, text string")
    q = {x.doc_id: x for x in quality_rules.quality_rules(df).collect()}
    assert q[1].n_words == 600_000 and q[1].word_chars == sum(map(len, w)) and q[2].n_tokens == q[1].n_tokens
    d = {x.doc_id: x for x in decontaminate.decontaminate(df, spark.createDataFrame([(1, " ".join(w[-20:]))], "item_id long, text string")).collect()}
    assert d[1].n_hit == d[2].n_hit == 20 and [tuple(s) for s in d[1].hits] == [(599_980, 600_000)] and d[3].n_hit == 0
    s = {x.doc_id: x for x in substring_index.substring_dedup(df).collect()}
    assert (s[1].n_removed, s[2].n_removed, s[3].n_removed) == (0, 600_000, 100)
    b = {x.doc_id: x for x in suffix_dedup.suffix_dedup(df).collect()}
    assert (b[1].n_removed, b[2].n_removed) == (0, len(long)) and b[3].n_removed < 100 < len(rows[2][1])  # its words stand on several lines in the others
    n = {x.doc_id: x for x in ngram_join.ngram_join(df).collect()}
    assert n[2].class_id == 1 and n[1].n_links == 1 and n[3].n_links == 0
    k = {x.doc_id: x for x in line_dedup.line_dedup_digest(df, least_docs=2).collect()}
    assert k[1].n_lines == 50_000 and k[1].n_dropped == 50_000 and k[2].n_dropped == 0
    p = packing.tokenized_pieces(df, "word_bpe_49k.json", 2048).toPandas().groupby("doc_id")
    assert p.length.sum()[1] == p.length.sum()[2] == p.start.max()[1] + p.length.apply(lambda x: x.iloc[-1])[1]
