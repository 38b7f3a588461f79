"""Verdicts on hand-built signals."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from folioworks.config import PRESETS, Config, PlannerConfig
from folioworks.operators import batch, pages, rules, signals

SCHEMA = """id string, mime string, extension string, is_binary boolean, text_length int, image_coverage double, text_coverage double, layout_type string, is_mixed_content boolean,
font_count int, text_density double, non_printable_ratio double, unicode_noise_ratio double"""


def decide(spark, rows, config=Config()):
    full = [(i, m, e, b, n, ic, tc, lay, None, None, None, None, None) for i, m, e, b, n, ic, tc, lay in rows]
    return {r.id: r for r in rules.decide(spark.createDataFrame(full, SCHEMA), config).collect()}


def test_ladder(spark):
    pdf = "application/pdf"
    got = decide(spark, [
        ("S1", "text/plain", "txt", False, 100, None, None, None), ("S2", "image/png", "png", True, 0, None, None, None), ("S3", pdf, "pdf", True, 500, None, None, None), ("S4", pdf, "pdf", True, 10, None, None, None),
        ("S5", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "docx", True, 200, None, None, None), ("S6", "application/octet-stream", "bin", True, 0, None, None, None),
        ("S7", pdf, "pdf", True, 500, 25.0, 68.0, "mixed"), ("S8", pdf, "pdf", True, 10, 80.0, None, "mixed"), ("S9", pdf, "pdf", True, 10, 60.0, 5.0, "mixed"), ("S10", pdf, "pdf", True, 100, 85.0, None, "mixed"), ("S12", pdf, "pdf", True, 15, 50.0, None, "mixed"),
    ])
    want = {
        "S1": (False, 0.9, "TEXT_FILE"), "S2": (True, 0.9, "IMAGE_FILE"), "S3": (False, 0.9, "PDF_DIGITAL"), "S4": (True, 0.69, "PDF_SCANNED"), "S5": (False, 0.9, "OFFICE_WITH_TEXT"), "S6": (True, 0.5, "UNKNOWN_BINARY"),
        "S7": (False, 0.9, "PDF_DIGITAL"), "S8": (True, 0.9, "PDF_SCANNED"), "S9": (True, 0.79, "PDF_SCANNED"), "S10": (False, 0.9, "PDF_DIGITAL"), "S12": (True, 0.77, "PDF_SCANNED"),
    }
    assert {k: (r.needs_ocr, r.confidence, r.reason_code) for k, r in got.items()} == want
    assert got["S4"].ocr_score == 0.433 and got["S9"].ocr_score == 0.643 and got["S12"].rule == "borderline"


def test_boundaries(spark):
    """Just below, at and above each threshold."""
    c = replace(Config(), hard_digital_text_threshold=1000)
    rows = [(f"{n}-{ic}", "application/pdf", "pdf", True, n, ic, 0.0, "text_only") for n in (19, 20, 49, 50) for ic in (79.99, 80.0, 80.01)]
    got = decide(spark, rows, c)
    assert [got[f"19-{x}"].rule for x in (79.99, 80.0, 80.01)] == ["hybrid_scan", "hard_scan", "hard_scan"]
    assert got["20-80.0"].rule == "hybrid_scan" and got["49-80.0"].rule == "text_sparse" and got["50-80.0"].rule == "text_only"


def test_config():
    assert len(PRESETS) == 5
    with pytest.raises(ValueError):
        Config(ocr_score_low_band_max=0.6)
    assert [PlannerConfig(mode=m).threshold for m in ("safety", "cost", "balanced")] == [0.45, 0.75, 0.6]
    g = PlannerConfig(domain="generic")
    assert (g.threshold, g.intent_share, g.intent_override, g.failsafe_override) == (0.65, 0.0, False, True)


def test_unknown_reason(spark):
    r = spark.range(1).select(rules.reason(F.lit("XYZ")).alias("a"), rules.reason(F.lit("PDF_MIXED")).alias("b")).head()
    assert r.a == "Unknown reason code: XYZ" and r.b


def test_pages(spark):
    texts = {"R1": (50, 0, 50), "R2": (100, 100), "R3": (0, 0), "R4": (100, 0, 100)}
    p = spark.createDataFrame([(k, i + 1, n) for k, v in texts.items() for i, n in enumerate(v)], "file_path string, page_number int, text_length int")
    got = {r.file_path: (r.needs_ocr, r.reason_code, r.confidence, r.pages_needing_ocr) for r in pages.page_rollup(pages.page_verdicts(p)).collect()}
    assert got == {"R1": (True, "PDF_MIXED", 0.8, 1), "R2": (False, "PDF_DIGITAL", 1.0, 0), "R3": (True, "PDF_SCANNED", 0.9, 2), "R4": (True, "PDF_MIXED", 0.8, 1)}


def test_layout(spark):
    rows = [(20.0, 2.0, 100, "text_only"), (2.0, 20.0, 10, "image_only"), (15.0, 15.0, 50, "mixed"), (5.0, 2.0, 100, "text_only"), (2.0, 2.0, 10, "unknown")]
    df = spark.createDataFrame(rows, "t double, i double, n int, want string")
    assert df.where(pages.layout_type(F.col("t"), F.col("i"), F.col("n")) != F.col("want")).count() == 0


def test_planner_intent(spark):
    df = spark.createDataFrame([(1, "PRESCRIPTION: Amoxicillin 500mg TID"), (2, "")], "page_number int, text string")
    df = df.withColumns({"text_length": F.length("text"), "text_coverage": F.lit(40.0), "image_coverage": F.lit(10.0), "extraction_failed": F.lit(False), "layout_missing": F.lit(False)})
    got = {r.page_number: r for r in pages.planner_pages(df).collect()}
    assert got[1].intent == {"prescription": 0.6} and got[1].critical == 0.6 and got[2].intent == {}


def test_hints(spark):
    df = spark.createDataFrame([(True, 80.0, 0), (False, 80.0, 0)], "needs boolean, image_coverage double, text_length int")
    yes, no = (r.h for r in df.select(signals.hints(F.col("needs"), F.lit("complex")).alias("h")).collect())
    assert yes.suggest_preprocessing == ["deskew", "otsu", "denoise"] and no.suggested_engine is None and no.ocr_complexity_score == 0.0


def test_empty_batch(spark):
    empty = spark.createDataFrame([], "file_path string, file_type string, needs_ocr boolean, error string")
    assert batch.batch_stats(empty).head().total == 0
    pairs = spark.createDataFrame([], "predicted boolean, actual boolean")
    assert batch.confusion(pairs).head().f1 == 0.0
