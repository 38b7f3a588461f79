"""Quality rules: base counts, then tokeniser fertility within bands per script and language.

Public vocabularies measure how a text is cut into tokens: characters a token (of a
byte-level and of a piece vocabulary), the share of tokens that fall back to single
bytes, and the entropy of the tokens' distribution.  A text whose figures leave a band
is rejected.  Two kinds of bands hold at once:

* fixed ones per script (``BANDS``), wide enough for any prose of that script;
* learnt ones per script, language and octave of the number of tokens: ``spreads``
  robust standard deviations (quartile distances) about the median of all texts of that
  group in the table that pass the base rule.  Texts with the same figures (copies)
  count once, so that a group of copies can't narrow a band.  A group of fewer than
  ``least_texts`` different texts takes the band of its script and language over all
  lengths, half as wide again (short texts vary more); where that group is as small, the
  fixed bands alone hold.

The quartiles are exact on bins of 1 / 200: counts of bins are summed before the
shuffle, and what is broadcast is one row for each script, two-letter language and
octave, whatever the number of documents.

Null and empty texts have no words: all counts are 0 and the base rule (at least
50 words) fails.  Very long texts are measured whole, one at a time.  Of scripts with
equally many letters the first in ``SCRIPTS`` is the text's; a null language, or a table
without that column, is a group of its own.  Repeated rows are judged one by one and
alike.  An empty table gives an empty table.  Other columns pass through; one that has a
result's name is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _text
from ._spark import annotate, written
from .tokens import fallback_ids, word_counts, word_tokens

SCRIPTS = ("latin", "greek", "cyrillic", "arabic", "indic", "cjk", "other")
_LEAD = np.full(256, -1, np.int8)
_LEAD[0x41:0x5B] = _LEAD[0x61:0x7B] = _LEAD[0xC3:0xCA] = 0
_LEAD[0xCE:0xD0] = 1
_LEAD[0xD0:0xD4] = 2
_LEAD[0xD8:0xDC] = 3
_LEAD[0xE0] = 4
_LEAD[0xE3:0xEE] = 5
_LEAD[0xE1:0xE3] = _LEAD[0xEE:0xF5] = 6
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
#: The first byte of each character of a word
_CHAR = (_text.WORD_BYTES & ((np.arange(256) & 0xC0) != 0x80)).astype(np.int64)


@dataclass(frozen=True)
class Band:
    """What a script's texts may measure; outside it, a text is rejected."""

    chars_a_token: tuple[float, float]
    piece_chars_a_token: tuple[float, float]
    most_fallback: float
    least_entropy: float


#: Alphabets of few letters give long tokens; scripts that the vocabularies hardly know fall back to bytes throughout.
BANDS = {
    "latin": Band((1.4, 9.0), (1.4, 8.0), 0.2, 4.8),
    "greek": Band((0.4, 6.0), (0.5, 6.0), 0.9, 2.0),
    "cyrillic": Band((0.4, 7.0), (0.7, 7.0), 0.6, 2.5),
    "arabic": Band((0.4, 6.0), (0.4, 6.0), 1.0, 2.0),
    "indic": Band((0.2, 6.0), (0.2, 6.0), 1.0, 2.0),
    "cjk": Band((0.2, 4.0), (0.2, 4.0), 1.0, 2.0),
    "other": Band((0.2, 9.0), (0.2, 9.0), 1.0, 2.0),
}

MEASURES = """n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean,
script string, n_tokens long, chars_a_token double, piece_chars_a_token double, fallback_share double, token_entropy double"""
#: What has learnt bands, and the least standard deviation of each
BANDED = {"chars_a_token": 0.02, "piece_chars_a_token": 0.02, "token_entropy": 0.05}
_BINS = 200


def repeated_window_words(ids: np.ndarray, offsets: np.ndarray, n_ids: int, k: int = 3) -> np.ndarray:
    """For each text, how many of its words lie in a k-word window that the text has at least twice (exact)."""
    n, n_docs = len(ids), len(offsets) - 1
    if n < k:
        return np.zeros(n_docs, np.int64)
    doc = np.repeat(np.arange(n_docs), np.diff(offsets))
    inside = doc[: n - k + 1] == doc[k - 1 :]
    at = np.flatnonzero(inside)
    key = doc[at].astype(np.uint64)
    bits = max(1, int(n_ids - 1).bit_length())
    if bits * k + int(n_docs).bit_length() <= 64:
        for j in range(k):
            key = (key << np.uint64(bits)) | ids[at + j].astype(np.uint64)
    else:  # too many to pack: number the pairs one after another, still exact
        for j in range(k):
            _, key = np.unique(key * np.uint64(n_ids) + ids[at + j].astype(np.uint64), return_inverse=True)
            key = key.astype(np.uint64)
    in_order = np.sort(key)
    twice = np.unique(in_order[1:][in_order[1:] == in_order[:-1]])
    if not len(twice):
        return np.zeros(n_docs, np.int64)
    place = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    hits = at[twice[place] == key]
    cover = np.zeros(n, bool)
    for j in range(k):
        cover[hits + j] = True
    total = np.r_[0, np.cumsum(cover)]
    return total[offsets[1:]] - total[offsets[:-1]]


def duplicate_lines(data: np.ndarray, at: np.ndarray, word_starts: np.ndarray) -> np.ndarray:
    """For each text, how many of its lines with a word equal an earlier one."""
    breaks = np.flatnonzero(data == 10)
    # a line begins at each text's start and after each \n of it
    doc_of_break = np.searchsorted(at, breaks, "right") - 1
    per_doc = np.bincount(doc_of_break, minlength=len(at) - 1) + 1
    doc = np.repeat(np.arange(len(at) - 1), per_doc)
    heads = np.cumsum(per_doc) - per_doc
    starts = np.empty(len(doc), np.int64)
    ends = np.empty(len(doc), np.int64)
    first = np.zeros(len(doc), bool)
    first[heads] = True
    last = np.zeros(len(doc), bool)
    last[heads + per_doc - 1] = True
    starts[first], starts[~first] = at[:-1], breaks + 1
    ends[last], ends[~last] = at[1:], breaks
    has_word = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    ids = _text.strings(data, starts[has_word], ends[has_word]).dictionary_encode().indices.to_numpy().astype(np.int64)
    doc = doc[has_word]
    distinct = np.unique(doc * (int(ids.max()) + 1 if len(ids) else 1) + ids)
    n = np.bincount(doc, minlength=len(at) - 1)
    return n - np.bincount(distinct // (int(ids.max()) + 1 if len(ids) else 1), minlength=len(at) - 1)


def _entropy(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of the distribution of the ids of each text."""
    n = np.diff(offsets)
    doc = np.repeat(np.arange(len(n)), n)
    key = np.sort(doc.astype(np.int64) << 20 | ids)
    heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[heads, len(key)])
    doc = key[heads] >> 20
    part = counts * np.log2(counts) if len(counts) else np.zeros(0)
    s = np.bincount(doc, part, minlength=len(n)) if len(doc) else np.zeros(len(n))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n > 0, np.log2(np.maximum(n, 1)) - s / np.maximum(n, 1), 0.0)


def measure(column: pa.Array, byte_vocabulary: str, piece_vocabulary: str) -> dict[str, np.ndarray]:
    """All counts of a block of whole texts."""
    data, at = _text.raw(_text.text_column(column))
    starts, ends, w_at = _text.words(data, at)
    n_words = np.diff(w_at)
    bytes_of = _text.byte_counts(data, at)
    word_chars = bytes_of @ _CHAR
    coded = _text.strings(data, starts, ends).dictionary_encode()
    ids = coded.indices.to_numpy().astype(np.int64)
    repeat = repeated_window_words(ids, w_at, len(coded.dictionary))
    piece_ids, piece_n = word_tokens(coded, piece_vocabulary)
    byte_n = word_counts(coded, byte_vocabulary)
    pieces, byte_tokens = _text.sums(piece_n, w_at), _text.sums(byte_n, w_at)
    t_at = np.r_[0, np.cumsum(pieces)]
    fallback = _text.sums(fallback_ids(piece_vocabulary)[piece_ids], t_at)
    by_script = (bytes_of @ (_LEAD[:, None] == np.arange(len(SCRIPTS))).astype(np.int64)).T
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": bytes_of @ _SYMBOL,
        "n_dup_lines": duplicate_lines(data, at, starts),
        "n_repeat_words": repeat,
        "n_tokens": pieces,
        "script": np.where(by_script.sum(axis=0) > 0, by_script.argmax(axis=0), len(SCRIPTS) - 1),
        "chars_a_token": word_chars / np.maximum(byte_tokens, 1),
        "piece_chars_a_token": word_chars / np.maximum(pieces, 1),
        "fallback_share": fallback / np.maximum(pieces, 1),
        "token_entropy": _entropy(piece_ids, t_at),
    }


def measures(df: DataFrame, text: str = "text", byte_vocabulary: str = "byte_bpe_50k.tiktoken", piece_vocabulary: str = "piece_bpe_32k.model", least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """``df`` with the columns of MEASURES; one Arrow pass, no shuffle.

    base_failed: fewer than ``least_words`` words, or more than ``most_repeated``
    percent of them in repeated 3-word windows.
    """

    def compute(block: pa.RecordBatch) -> list:
        m = measure(block.column(block.schema.get_field_index(text)), byte_vocabulary, piece_vocabulary)
        base = (m["n_words"] < least_words) | (100 * m["n_repeat_words"] > most_repeated * m["n_words"])
        longs = [m[k].astype(np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        doubles = [m[k].astype(np.float64) for k in ("chars_a_token", "piece_chars_a_token", "fallback_share", "token_entropy")]
        return [*longs, base, pa.array(SCRIPTS).take(pa.array(m["script"])), m["n_tokens"].astype(np.int64), *doubles]

    return annotate(df, MEASURES, compute, text, most=2 << 20)


def language(df: DataFrame, lang: str = "lang") -> Column:
    """The first two letters, in lower case; what has none is ``--``."""
    if lang not in df.columns:
        return F.lit("--")
    two = F.lower(F.substring(F.col(lang).cast("string"), 1, 2))
    return F.when(two.rlike("^[a-z]{2}$"), two).otherwise(F.lit("--"))


def octave(n: Column) -> Column:
    return F.floor(F.log2(F.greatest(n, F.lit(1)))).cast("int")


def learnt_bands(measured: DataFrame, lang: str = "lang", spreads: float = 4.0, least_texts: int = 100) -> DataFrame:
    """script, language, octave (-1: all lengths) and, for each of BANDED, the least and the greatest value that stays."""
    bins = [F.floor(F.col(c) * _BINS).cast("int").alias(c) for c in BANDED]
    texts = measured.where(~F.col("base_failed")).select(F.col("script"), language(measured, lang).alias("language"), "n_words", "word_chars", "n_tokens", *bins).distinct()
    values = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("bin")) for c in BANDED])
    lengths = F.array(octave(F.col("n_tokens")), F.lit(-1))
    each = texts.select("script", "language", F.explode(lengths).alias("octave"), values.alias("v")).select("script", "language", "octave", F.explode("v").alias("v"))
    keys = ["script", "language", "octave", "measure"]
    counts = each.select("script", "language", "octave", "v.measure", "v.bin").groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    # at most a few thousand bins of one group, whatever the number of texts
    own = Window.partitionBy(*keys)
    placed = counts.withColumns({"upto": F.sum("n").over(own.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(own)})
    quarter = lambda k: F.min(F.when(F.col("upto") * 4 >= F.col("total") * k, F.col("bin"))).alias(f"q{k}")
    q = placed.groupBy(*keys).agg(F.max("total").alias("total"), quarter(1), quarter(2), quarter(3)).where(F.col("total") >= least_texts)
    floor = F.create_map(*[x for c, least in BANDED.items() for x in (F.lit(c), F.lit(least))])
    spread = F.greatest((F.col("q3") - F.col("q2")) / (_BINS * 0.6745), (F.col("q2") - F.col("q1")) / (_BINS * 0.6745), F.element_at(floor, F.col("measure")))
    middle = (F.col("q2") + 0.5) / _BINS
    reach = spread * spreads * F.when(F.col("octave") < 0, 1.5).otherwise(1.0)
    q = q.select(*keys, (middle - reach).alias("low"), (middle + reach).alias("high"))
    ends = [F.min(F.when(F.col("measure") == c, F.col(e))).alias(f"{c}_{e}") for c in BANDED for e in ("low", "high")]
    return q.groupBy("script", "language", "octave").agg(*ends)


def within_bands(measured: DataFrame, bands: DataFrame, lang: str = "lang", fixed: dict[str, Band] = BANDS) -> DataFrame:
    """``measured`` with in_band (false: the method rejects) and kept.  ``bands``: a table of learnt ones."""
    ends = [f"{c}_{e}" for c in BANDED for e in ("low", "high")]
    of = lambda df, name: df.select(F.col("script").alias("__script"), F.col("language").alias("__language"), F.struct(*ends).alias(name), *([F.col("octave").alias("__octave")] if name == "__own" else []))
    # one row for each script (7), language (677 at most) and octave (64 at most)
    own, whole = of(bands.where("octave >= 0"), "__own"), of(bands.where("octave = -1"), "__whole")
    names = measured.drop("in_band", "kept").columns
    keyed = measured.select(*names, F.col("script").alias("__script"), language(measured, lang).alias("__language"), octave(F.col("n_tokens")).alias("__octave"))
    met = keyed.join(F.broadcast(own), ["__script", "__language", "__octave"], "left").join(F.broadcast(whole), ["__script", "__language"], "left")
    good = F.lit(True)
    for c in BANDED:
        value = F.col(c)
        low, high = (F.coalesce(F.col(f"__own.{c}_{e}"), F.col(f"__whole.{c}_{e}")) for e in ("low", "high"))
        good = good & F.coalesce((value >= low) & (value <= high), F.lit(True))
    limit = lambda f: F.element_at(F.create_map(*[x for k, b in fixed.items() for x in (F.lit(k), F.lit(float(f(b))))]), F.col("script"))
    good = good & F.col("chars_a_token").between(limit(lambda b: b.chars_a_token[0]), limit(lambda b: b.chars_a_token[1]))
    good = good & F.col("piece_chars_a_token").between(limit(lambda b: b.piece_chars_a_token[0]), limit(lambda b: b.piece_chars_a_token[1]))
    good = good & (F.col("fallback_share") <= limit(lambda b: b.most_fallback)) & (F.col("token_entropy") >= limit(lambda b: b.least_entropy))
    return met.withColumn("in_band", good).select(*names, "in_band", (~F.col("base_failed") & F.col("in_band")).alias("kept"))


def quality_rules(df: DataFrame, text: str = "text", lang: str = "lang", spreads: float = 4.0, least_texts: int = 100, fixed: dict[str, Band] = BANDS, keep_text: bool = True, **measuring) -> DataFrame:
    """``df`` with the columns of MEASURES, in_band, and kept: neither base_failed nor out of a band.

    The measured rows are a written table (without the texts unless ``keep_text``), read
    for the bands and again for the verdicts; texts are neither shuffled nor cut twice.
    """
    rows = measures(df, text, **measuring)
    rows = written(rows if keep_text else rows.drop(text), "measures")
    bands = written(learnt_bands(rows, lang, spreads, least_texts), "bands")
    return within_bands(rows, bands, lang, fixed)
