"""Text measures and detectors as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import r

#: label -> patterns (Java, with Unicode word classes); matching ignores case unless the pattern says otherwise
INTENT_PATTERNS: dict[str, list[str]] = {
    "prescription": [rf"(?iU)\b{w}\b" for w in ("prescription", "rx", "medication", "dispense", "dose", "pharmacy")] + ["PRESCRIPTION", "(?i)MEDICATIONS?"],
    "diagnosis": [r"(?iU)\bdiagnosis\b", r"(?iU)\bdiagnoses\b", r"(?iU)\bicd[- ]?\d"],
    "chief_complaint": [r"(?iU)\bchief complaint\b", r"(?iU)\bcc\s*:"],
    "discharge_summary": [r"(?iU)\bdischarge summary\b", r"(?iU)\bdischarge diagnosis\b", "DISCHARGE"],
    "lab_report": [rf"(?iU)\b{w}\b" for w in ("lab", "laboratory", "results?", "hemoglobin", "wbc")],
}
CRITICAL = tuple(INTENT_PATTERNS)

DOCUMENT_TYPES = {
    "invoice": ("invoice", "bill to", "invoice number", "due date", "amount due"),
    "receipt": ("receipt", "thank you", "payment received"),
    "catalog": ("catalog", "catalogue", "price", "product"),
    "manual": ("manual", "instructions", "guide", "tutorial"),
}


def text_quality(text: str | Column, include_unassigned: bool = True) -> dict[str, Column]:
    """Shares of characters that don't print and of noise, and the average word length; null under 10 characters."""
    t = F.substring(F.col(text) if isinstance(text, str) else text, 1, 1000)
    n = F.length(t)
    noise = r"[^\x{FFFD}\p{Cf}\p{Co}\p{Cn}]" if include_unassigned else r"[^\x{FFFD}\p{Cf}\p{Co}]"
    bare = r"[^\p{Cc}\p{Cf}\p{Co}\p{Cn}]|[\t\n\x0B\f\r\x1C-\x1F\x85]" if include_unassigned else r"[^\p{Cc}\p{Cf}\p{Co}]|[\t\n\x0B\f\r\x1C-\x1F\x85]"
    words = F.regexp_extract_all(t, F.lit(r"([\p{L}\p{M}\p{N}_]+)"), F.lit(1))
    total = F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w))
    long = n >= 10
    return {
        "non_printable_ratio": F.when(long, r(F.length(F.regexp_replace(t, bare, "")) / n, 4)),
        "unicode_noise_ratio": F.when(long, r(F.length(F.regexp_replace(t, noise, "")) / n, 4)),
        "avg_word_length": F.when(long, F.when(F.size(words) > 0, r(total / F.size(words), 2)).otherwise(0.0)),
    }


def meaningful(text: Column, least: int = 50) -> Column:
    return F.length(F.regexp_replace(text, r"(?U)^\s+|\s+$", "")) >= least


def html_text(html: Column) -> Column:
    """Visible text: scripts, styles and tags go, white space is one space."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]+>", " "), r"\s+", " "))


def intent_scores(text: Column, patterns: dict[str, list[str]] = INTENT_PATTERNS) -> Column:
    """map(label -> score): of each label's best pattern, min(0.5 + 0.1 x hits, 1); labels without a hit are left out."""
    scores = []
    for label, own in patterns.items():
        hits = F.greatest(*[F.regexp_count(text, F.lit(p)) for p in own], F.lit(0))
        scores += [F.lit(label), F.when(hits > 0, r(F.least(F.lit(0.5) + hits * 0.1, F.lit(1.0)), 2))]
    return F.map_filter(F.create_map(*scores), lambda _, v: v.isNotNull())


def critical_score(scores: Column, critical: tuple[str, ...] = CRITICAL) -> Column:
    return F.coalesce(F.greatest(*[F.try_element_at(scores, F.lit(x)) for x in critical]), F.lit(0.0))


def document_type(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit(None).cast("string")
    for kind, words in reversed(DOCUMENT_TYPES.items()):
        any_of = F.lit(False)
        for w in words:
            any_of = any_of | low.contains(w)
        out = F.when(any_of, kind).otherwise(out)
    return out


def currency(text: Column) -> Column:
    up = F.upper(text)
    return (
        F.when(up.contains("GST") | up.contains("VIC") | up.contains("AUD"), "AUD")
        .when(up.contains("USD") | text.contains("US$"), "USD")
        .when(up.contains("EUR") | text.contains("€"), "EUR")
        .when(up.contains("GBP") | text.contains("£"), "GBP")
        .when(up.contains("INR") | text.contains("₹"), "INR")
    )


def money(text: Column) -> Column:
    return F.regexp_extract(text, r"[\$₹€£]?\s*(\d+\.?\d*)", 1).try_cast("double")


def first_int(text: Column) -> Column:
    return F.regexp_extract(text, r"(\d+)", 1).try_cast("int")


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(text)), r"\s+", " ")


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)))


def escape_html(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def spaced_prices(text: Column) -> Column:
    """A space between a letter and a price that runs into it."""
    return F.regexp_replace(text, r"([A-Za-z])(\$\d)", "$1 $2")


#: Words that tell which way a line reads
TURNED_WORDS = ("invoice", "total", "date", "description", "amount", "page", "number")


def turned_back(text: Column) -> Column:
    """Text that reads backwards (as vertical text may come out) the right way round: reversed it has a known word that it hasn't as it is."""
    back = F.reverse(text)
    turned = F.lit(False)
    for w in TURNED_WORDS:
        turned = turned | (F.lower(back).rlike(rf"\b{w}\b") & ~F.lower(text).rlike(rf"\b{w}\b"))
    return F.when(turned, back).otherwise(text)
