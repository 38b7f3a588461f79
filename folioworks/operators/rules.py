"""The decision ladder, the vision gate and the refinement ladder, as Column expressions.

A ladder first finds which rule fires (one CASE); verdict, confidence and code are looked
up by its number, so no predicate is evaluated once for each output column.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.numeric import r, zero
from .signals import OFFICE, ocr_score, score_confidence

DESCRIPTIONS = {
    "TEXT_FILE": "text can be read as it is",
    "OFFICE_WITH_TEXT": "office file with enough text",
    "OFFICE_NO_TEXT": "office file with too little text",
    "IMAGE_FILE": "an image, nothing to extract",
    "PDF_DIGITAL": "its text can be extracted",
    "PDF_SCANNED": "looks scanned",
    "PDF_MIXED": "digital and scanned content",
    "STRUCTURED_DATA": "structured data",
    "HTML_WITH_TEXT": "page with enough text",
    "HTML_MINIMAL": "page with hardly any text",
    "UNKNOWN_BINARY": "binary of unknown type",
    "UNRECOGNIZED_TYPE": "type not recognised",
    "PDF_PAGE_DIGITAL": "the page's text can be extracted",
    "PDF_PAGE_SCANNED": "the page looks scanned",
}


@dataclass(frozen=True)
class Rule:
    """needs None: the initial verdict stays.  fixed: the confidence, else the score's, at least ``floor``.  of: what rules in a row have in common, asked once for all of them; the last of them must always fire."""

    name: str
    when: Column
    needs: bool | None
    code: str
    fixed: float | None = None
    floor: float = 0.0
    of: Column | None = None


def reason(code: Column) -> Column:
    pairs = [x for k, v in DESCRIPTIONS.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), F.concat(F.lit("Unknown reason code: "), code))


def first_rule(rules: list[Rule]) -> Column:
    """The number of the first rule that fires.

    One chain of cases, and one within it for rules that share a condition: the JVM
    doesn't compile a method of more than 8,000 bytes, and interprets it for each row.
    """
    out = None
    for _, run in groupby(enumerate(rules), lambda x: x[0] if x[1].of is None else id(x[1].of)):
        own = list(run)
        inner = None
        for i, x in own:
            inner = F.when(x.when, F.lit(i)) if inner is None else inner.when(x.when, F.lit(i))
        shared = own[0][1].of
        condition, value = (own[0][1].when, F.lit(own[0][0])) if shared is None else (shared, inner)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out


def ladder(df: DataFrame, rules: list[Rule], score: str) -> DataFrame:
    """Adds rule, needs_ocr, confidence, category, reason_code: those of the first rule that fires."""
    df = df.withColumn("__rule", first_rule(rules))

    def pick(value) -> Column:
        return F.element_at(F.array(*[F.lit(value(x)) for x in rules]), F.col("__rule") + 1)

    needs = pick(lambda x: x.needs)
    by_score = F.greatest(score_confidence(F.col(score), needs), pick(lambda x: float(x.floor)))
    out = df.withColumns({"rule": pick(lambda x: x.name), "needs_ocr": needs, "reason_code": pick(lambda x: x.code), "confidence": F.coalesce(pick(lambda x: x.fixed), by_score)})
    return out.withColumn("category", F.when(F.col("needs_ocr"), "unstructured").otherwise("structured")).drop("__rule")


def decide(signals: DataFrame, config: Config = Config()) -> DataFrame:
    """One verdict for each signals row; ``ocr_score`` is added, too."""
    c = config
    columns = signals.columns
    vis = {k: zero(f"vision_{k}") if f"vision_{k}" in columns else F.lit(0.0) for k in ("text_coverage", "image_coverage")}
    own = {
        "mime": F.coalesce(F.col("mime"), F.lit("")), "ext": F.coalesce(F.col("extension"), F.lit("")), "n": zero("text_length"), "ic": zero("image_coverage"), "tc": zero("text_coverage"),
        "etc": F.when(vis["text_coverage"] > 0, vis["text_coverage"]).otherwise(zero("text_coverage")), "eic": F.when(vis["image_coverage"] > 0, vis["image_coverage"]).otherwise(zero("image_coverage")),
    }
    signals = signals.withColumns({f"__{k}": v for k, v in own.items()})
    mime, ext, n, ic, tc, etc, eic = (F.col(f"__{k}") for k in own)
    df = signals.withColumn("ocr_score", ocr_score(eic, c))
    score = F.col("ocr_score")
    pdf = (mime == "application/pdf") | (ext == "pdf")
    office = mime.contains("officedocument") | ext.isin(*OFFICE)
    known = F.col("layout_type").isNotNull() & ~F.col("layout_type").isin("unknown", "")
    mixed = F.coalesce(F.col("is_mixed_content"), F.lit(False))
    noisy = (zero("non_printable_ratio") > 0.05) | (zero("unicode_noise_ratio") > 0.08)
    html = mime.isin("text/html", "application/xhtml+xml") | ext.isin("html", "htm")
    high, mid, low = c.high_confidence, c.medium_confidence, c.low_confidence
    enough = n >= c.min_text_length
    off = F.lit(False)
    digital_bias = (etc >= c.digital_bias_text_coverage_min) & (eic <= c.digital_bias_image_coverage_max) & enough if c.digital_bias_text_coverage_min is not None and c.digital_bias_image_coverage_max is not None else off
    table_bias = (zero("text_density") >= c.table_bias_text_density_min) & (etc >= c.table_bias_text_coverage_min) & enough if c.table_bias_text_density_min is not None and c.table_bias_text_coverage_min is not None else off
    rules = [
        Rule("text", mime.startswith("text/"), False, "TEXT_FILE", high),
        Rule("office_text", office & (n >= c.min_office_text_length), False, "OFFICE_WITH_TEXT", high),
        Rule("office", office, True, "OFFICE_NO_TEXT", mid),
        Rule("image", mime.startswith("image/"), True, "IMAGE_FILE", high),
        Rule("hard_digital", n >= c.hard_digital_text_threshold, False, "PDF_DIGITAL", high, of=pdf),
        Rule("hard_scan", (eic >= c.hard_scan_image_coverage_min) & (n < c.hard_scan_text_max), True, "PDF_SCANNED", high, of=pdf),
        Rule("no_fonts", F.coalesce(F.col("font_count") == 0, off) & (n < c.hard_scan_text_max), True, "PDF_SCANNED", high, of=pdf),
        Rule("noise", noisy & (n > 0) & (score > 0.6), True, "PDF_SCANNED", floor=0.75, of=pdf),
        Rule("digital_bias", digital_bias, False, "PDF_DIGITAL", floor=0.85, of=pdf),
        Rule("hybrid_scan", (eic / 100.0 > 0.75) & (n < 30), True, "PDF_SCANNED", floor=0.90, of=pdf),
        Rule("low_text", (n < 30) & known & ((ic > 50) | (mixed & (ic > tc))), True, "PDF_SCANNED", of=pdf),
        Rule("table_bias", known & mixed & table_bias, False, "PDF_DIGITAL", floor=0.80, of=pdf),
        Rule("mixed_text", known & mixed & enough & (tc > 10), False, "PDF_DIGITAL", of=pdf),
        Rule("mixed", known & mixed, True, "PDF_MIXED", of=pdf),
        Rule("image_only", F.coalesce(F.col("layout_type") == "image_only", off), True, "PDF_SCANNED", floor=0.85, of=pdf),
        Rule("text_only", F.coalesce(F.col("layout_type") == "text_only", off) & enough, False, "PDF_DIGITAL", floor=0.85, of=pdf),
        Rule("text_sparse", F.coalesce(F.col("layout_type") == "text_only", off), True, "PDF_SCANNED", of=pdf),
        Rule("low_band", score <= c.ocr_score_low_band_max, False, "PDF_DIGITAL", of=pdf),
        Rule("high_band", score >= c.ocr_score_high_band_min, True, "PDF_SCANNED", of=pdf),
        Rule("borderline_text", enough, False, "PDF_DIGITAL", of=pdf),
        Rule("borderline", F.lit(True), True, "PDF_SCANNED", of=pdf),
        Rule("structured", mime.isin("application/json", "application/xml") | ext.isin("json", "xml"), False, "STRUCTURED_DATA", high),
        Rule("html_text", html & enough, False, "HTML_WITH_TEXT", high),
        Rule("html", html, True, "HTML_MINIMAL", low),
        Rule("binary", F.coalesce(F.col("is_binary"), off), True, "UNKNOWN_BINARY", low),
        Rule("unknown", F.lit(True), True, "UNRECOGNIZED_TYPE", low),
    ]
    return ladder(df, rules, "ocr_score").drop(*(f"__{k}" for k in own))


def vision_gate(decided: DataFrame, layout_aware: bool = False, config: Config = Config()) -> DataFrame:
    """refine_mode: none, light (two pages) or full."""
    c = config
    guard = c.skip_opencv_image_guard or c.confidence_image_heavy_threshold
    conf, ic = F.col("confidence"), F.col("image_coverage")
    run = (F.coalesce(F.col("mime"), F.lit("")) == "application/pdf") & (F.lit(layout_aware) | (conf < c.layout_refinement_threshold)) & (conf < c.confidence_exit_threshold)
    run = run & ~((conf >= 0.75) & F.coalesce(ic <= guard, F.lit(True)))
    if c.skip_opencv_if_file_size_mb is not None or c.skip_opencv_if_page_count is not None:
        image_ok = F.lit(True) if c.skip_opencv_max_image_coverage is None else F.coalesce(ic <= c.skip_opencv_max_image_coverage, F.lit(False))
        size_ok = F.lit(False) if c.skip_opencv_if_file_size_mb is None else zero("file_size") / 1048576.0 >= c.skip_opencv_if_file_size_mb
        text_ok = F.lit(True) if c.skip_opencv_text_coverage_min is None else F.coalesce(F.col("text_coverage") >= c.skip_opencv_text_coverage_min, F.lit(False))
        pages_ok = F.lit(False) if c.skip_opencv_if_page_count is None else (zero("page_count") >= c.skip_opencv_if_page_count) & text_ok
        sure = F.lit(True) if c.skip_opencv_confidence_min is None else conf >= c.skip_opencv_confidence_min
        run = run & ~((size_ok | pages_ok) & image_ok & sure)
    light = (conf >= c.confidence_light_refinement_min) & (conf < 0.75)
    return decided.withColumn("refine_mode", F.when(~run, "none").when(light, "light").otherwise("full"))


def refine(decided: DataFrame, config: Config = Config()) -> DataFrame:
    """Reconsiders verdicts with the vision layout in vision_text_coverage, vision_image_coverage, vision_layout_type, vision_has_text."""
    c = config
    n, vt, vi = zero("text_length"), zero("vision_text_coverage"), zero("vision_image_coverage")
    layout, enough = F.coalesce(F.col("vision_layout_type"), F.lit("unknown")), n >= c.min_text_length
    df = decided.withColumns({"__needs": F.col("needs_ocr"), "__conf": F.col("confidence"), "__code": F.col("reason_code"), "vision_score": ocr_score(vi, c)})
    has_text = F.coalesce(F.col("vision_has_text"), F.lit(False))
    agrees = (F.col("__needs") & ~has_text) | (~F.col("__needs") & has_text)
    text_only, mixed = layout == "text_only", layout == "mixed"
    rules = [
        Rule("hard_digital", n >= c.hard_digital_text_threshold, False, "PDF_DIGITAL", c.high_confidence),
        Rule("hard_scan", (vi >= c.hard_scan_image_coverage_min) & (n < c.hard_scan_text_max), True, "PDF_SCANNED", c.high_confidence),
        Rule("hybrid_scan", (vi / 100.0 > 0.75) & (n < 30), True, "PDF_SCANNED", floor=0.90),
        Rule("digital_bias", (vt >= c.digital_bias_text_coverage_min) & (vi <= c.digital_bias_image_coverage_max) & enough, False, "PDF_DIGITAL", floor=0.85),
        Rule("text_but_images", text_only & (zero("image_coverage") > 70) & enough, True, "PDF_MIXED", floor=0.75),
        Rule("text_only", text_only & enough & (vt > 15), False, "PDF_DIGITAL", floor=0.85),
        Rule("text_unreadable", text_only & ~enough & (vt > 10), True, "PDF_SCANNED"),
        Rule("image_only", layout == "image_only", True, "PDF_SCANNED", floor=0.85),
        Rule("table_bias", mixed & (zero("text_density") >= c.table_bias_text_density_min) & (vt >= c.table_bias_text_coverage_min) & enough, False, "PDF_DIGITAL", floor=0.80),
        Rule("mixed_text", mixed & (vt > 15) & enough, False, "PDF_DIGITAL"),
        Rule("mixed", mixed, True, "PDF_MIXED"),
        Rule("confirmed", agrees, None, ""),
        Rule("refined", F.lit(True), None, ""),
    ]
    out = ladder(df, rules, "vision_score")
    rule, kept = F.col("rule"), F.col("rule").isin("confirmed", "refined")
    needs = F.when(kept, F.col("__needs")).otherwise(F.col("needs_ocr"))
    own = F.when(kept, score_confidence(F.col("vision_score"), F.col("__needs"))).otherwise(F.col("confidence"))
    share = F.when(rule.isin("image_only", "confirmed"), 0.3).when(rule == "refined", 0.5)
    blended = F.when(share.isNotNull(), r(F.least(F.col("__conf") * share + own * (1.0 - share), F.lit(c.high_confidence)), 2))
    out = out.withColumns({"needs_ocr": needs, "confidence": F.coalesce(blended, own), "reason_code": F.when(kept, F.col("__code")).otherwise(F.col("reason_code"))})
    return out.withColumn("category", F.when(F.col("needs_ocr"), "unstructured").otherwise("structured")).drop("__needs", "__conf", "__code")
