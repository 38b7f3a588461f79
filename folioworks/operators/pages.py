"""Page verdicts, their roll-up to documents, and the page planner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Config, PlannerConfig
from ..functions.numeric import clamp, exact_avg, exact_sum, r, zero
from ..functions.text import critical_score, intent_scores


def page_verdicts(pages: DataFrame, config: Config = Config()) -> DataFrame:
    n = zero("text_length")
    scanned = n < config.min_text_length
    return pages.withColumns(
        {
            "needs_ocr": scanned,
            "confidence": F.when(scanned & (n == 0), 0.8).when(scanned, 0.6).otherwise(0.95),
            "reason_code": F.when(scanned, "PDF_PAGE_SCANNED").otherwise("PDF_PAGE_DIGITAL"),
        }
    )


def page_rollup(verdicts: DataFrame, key: str = "file_path") -> DataFrame:
    """One row a document; unanimous pages are worth 0.1 more confidence, mixed ones 0.1 less."""
    g = verdicts.groupBy(key).agg(
        F.count(F.lit(1)).alias("page_count"), F.count_if("needs_ocr").alias("pages_needing_ocr"), F.count_if(~F.col("needs_ocr")).alias("pages_with_text"), exact_sum(F.col("confidence")).alias("__sum")
    )
    need, total = F.col("pages_needing_ocr"), F.col("page_count")
    one = (need == 0) | (need == total)
    mean = F.col("__sum").cast("double") / total
    return g.withColumns(
        {
            "needs_ocr": need > 0,
            "reason_code": F.when(need == 0, "PDF_DIGITAL").when(need == total, "PDF_SCANNED").otherwise("PDF_MIXED"),
            "confidence": r(clamp(mean + F.when(one, 0.1).otherwise(-0.1)), 2),
        }
    ).drop("__sum")


def variance_escalation(pages: DataFrame, config: Config = Config(), key: str = "file_path") -> DataFrame:
    """Whether a document's pages are alike enough to share its verdict: 3 or more, with little spread of being short."""
    w = Window.partitionBy(key)
    short = (zero("text_length") < config.min_text_length).cast("double")
    return pages.withColumns({"page_std": r(F.stddev_pop(short).over(w), 6), "__n": F.count(F.lit(1)).over(w)}).withColumn("reuse_verdict", (F.col("__n") >= 3) & (F.col("page_std") <= config.variance_page_escalation_std)).drop("__n")


def override_guard(documents: DataFrame, config: Config = Config()) -> DataFrame:
    """page_override: whether the pages' verdict replaces the document's."""
    c = config
    enough = zero("text_length") >= c.min_text_length
    digital = (zero("text_coverage") >= c.digital_bias_text_coverage_min) & (zero("image_coverage") <= c.digital_bias_image_coverage_max) & enough
    table = (zero("text_density") >= c.table_bias_text_density_min) & (zero("text_coverage") >= c.table_bias_text_coverage_min) & enough
    return documents.withColumn("page_override", ~(~F.col("needs_ocr") & (digital | table)))


# ------------------------------------------------------------------ planner


def planner_pages(pages: DataFrame, config: PlannerConfig = PlannerConfig(), text: str = "text") -> DataFrame:
    """Scores and verdicts of pages with text, coverages, extraction_failed and layout_missing."""
    c = config
    scores = intent_scores(F.coalesce(F.col(text), F.lit("")))
    df = pages.withColumn("intent", scores).withColumn("critical", critical_score(F.col("intent")))
    tc = clamp(zero("text_coverage") / 100.0)
    boost = F.when((zero("text_length") < c.very_low_text_threshold) & (zero("text_coverage") < 10), 0.3).otherwise(0.0)
    df = df.withColumns(
        {
            "intent_part": F.col("critical") * c.intent_share,
            "image_part": clamp(zero("image_coverage") / 100.0) * c.image_share,
            "weak_part": (1.0 - tc) * c.text_weakness_weight,
        }
    )
    df = df.withColumn("score", r(F.least(F.lit(1.0), F.col("intent_part") + F.col("image_part") + F.col("weak_part") + boost), 3))
    df = df.withColumns({k: r(F.col(k), 3) for k in ("intent_part", "image_part", "weak_part")})
    failed = F.coalesce(F.col("extraction_failed"), F.lit(False)) | F.coalesce(F.col("layout_missing"), F.lit(False))
    failsafe = F.lit(c.failsafe_override) & failed
    critical = F.lit(c.intent_override) & (F.col("critical") >= c.intent_high_threshold)
    override = F.when(failsafe, "failsafe").when(critical, "intent_critical")
    df = df.withColumn("override_reason", override)
    return df.withColumns(
        {
            "needs_ocr": F.col("override_reason").isNotNull() | (F.col("score") >= c.threshold),
            "decision_type": F.when(F.col("override_reason").isNotNull(), "terminal_override").otherwise("scored"),
            "confidence": F.when(F.col("override_reason") == "failsafe", 0.65).when(F.col("override_reason") == "intent_critical", F.col("critical")).otherwise(r(clamp(0.5 + F.abs(F.col("score") - c.threshold)), 3)),
        }
    )


def planner_rollup(decided: DataFrame, key: str = "file_path") -> DataFrame:
    """The plan of a document; pages_needing_ocr holds 0-based numbers."""
    g = decided.groupBy(key).agg(
        F.sort_array(F.collect_list(F.when(F.col("needs_ocr"), F.col("page_number") - 1))).alias("pages_needing_ocr"),  # pages of one document
        F.count(F.lit(1)).alias("page_count"),
        exact_avg(F.col("confidence"), 6).alias("__mean"),
    )
    need = F.size("pages_needing_ocr")
    one = (need == 0) | (need == F.col("page_count"))
    return g.withColumns({"needs_ocr_any": need > 0, "overall_confidence": r(clamp(F.col("__mean") + F.when(one, 0.1).otherwise(-0.1)), 2)}).drop("__mean")


def planner_exit(documents: DataFrame, config: PlannerConfig = PlannerConfig()) -> DataFrame:
    """Where planning ends: confidence_exit, fallback (no pages), fast_path (no image to speak of) or full."""
    return documents.withColumn(
        "exit",
        F.when(F.col("confidence") >= config.confidence_exit, "confidence_exit").when(zero("page_count") == 0, "fallback").when(zero("max_image_coverage") < config.fast_path_image_max, "fast_path").otherwise("full"),
    )


# ------------------------------------------------------------------ layout


def layout_type(text_coverage: Column, image_coverage: Column, chars: Column) -> Column:
    tc, ic = text_coverage, image_coverage
    return (
        F.when((tc > 10) & (ic < 5), "text_only").when((ic > 10) & (tc < 5) & (chars < 50), "image_only").when((tc > 5) & (ic > 5), "mixed").when(chars >= 50, "text_only").otherwise("unknown")
    )


def layout_rollup(pages: DataFrame, key: str = "file_path") -> DataFrame:
    """Area-weighted coverages (each page clamped to its area) and text density of a document."""
    text, image, area = F.least("text_area", "page_area"), F.least("image_area", "page_area"), F.col("page_area")
    g = pages.groupBy(key).agg(exact_sum(text).alias("t"), exact_sum(image).alias("i"), exact_sum(area).alias("a"), F.sum("chars").alias("chars"))
    share = lambda c, by: r(F.try_divide(F.col(c).cast("double") * by, F.col("a").cast("double")), 2)
    out = g.withColumns({"text_coverage": share("t", 100.0), "image_coverage": share("i", 100.0), "text_density": share("chars", 1000.0)})
    out = out.withColumn("layout_type", layout_type(F.col("text_coverage"), F.col("image_coverage"), F.col("chars")))
    return out.withColumn("is_mixed_content", F.col("layout_type") == "mixed").drop("t", "i", "a")


def vision_complexity(regions: Column) -> Column:
    """Of one page."""
    return F.when(regions < 5, "simple").when(regions < 20, "moderate").otherwise("complex")


def vision_rollup(pages: DataFrame, key: str = "file_path") -> DataFrame:
    """A document's regions, area-weighted coverages and complexity; also image coverage and mean regions a page where pages have image_coverage."""
    g = pages.groupBy(key).agg(
        F.sum("text_regions").alias("text_regions"), F.sum("image_regions").alias("image_regions"), F.bool_or(F.col("text_regions") > 0).alias("has_text_regions"), F.bool_or(F.col("image_regions") > 0).alias("has_image_regions"),
        exact_sum(F.col("text_coverage") * F.col("page_area")).alias("t"), exact_sum(F.col("page_area")).alias("a"),
        *([exact_sum(F.col("image_coverage") * F.col("page_area")).alias("__i"), exact_avg(F.col("text_regions"), 4).alias("mean_text_regions"), exact_avg(F.col("image_regions"), 4).alias("mean_image_regions")] if "image_coverage" in pages.columns else []),
    )
    if "image_coverage" in pages.columns:
        g = g.withColumn("image_coverage", r(F.try_divide(F.col("__i").cast("double"), F.col("a").cast("double")), 2)).drop("__i")
    n = F.col("text_regions") + F.col("image_regions")
    t, i = F.col("has_text_regions"), F.col("has_image_regions")
    return g.withColumns(
        {
            "text_coverage": r(F.try_divide(F.col("t").cast("double"), F.col("a").cast("double")), 2),
            "layout_complexity": F.when(n < 10, "simple").when(n < 30, "moderate").otherwise("complex"),
            "layout_type": F.when(t & i, "mixed").when(t, "text_only").when(i, "image_only").otherwise("unknown"),
        }
    ).drop("t", "a")
