"""The signals row of a document and what is computed from it alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.numeric import clamp, r, zero
from ..functions.text import text_quality

OFFICE = ("docx", "pptx", "xlsx")


def collect_signals(files: DataFrame, text: str = "text") -> DataFrame:
    """Adds text_length, has_text and the quality measures to rows with a text."""
    q = text_quality(text)
    return files.withColumns({"text_length": F.length(F.coalesce(F.col(text), F.lit(""))), "has_text": F.length(F.coalesce(F.col(text), F.lit(""))) > 0, **q})


def ocr_score(image_coverage: Column, config: Config = Config(), text_length: str = "text_length") -> Column:
    """0 to 1; the more image and noise, and the less text and fonts, the higher."""
    text = F.when(zero(text_length) > 0, F.least(F.col(text_length) / 200.0, F.lit(1.0))).otherwise(0.0)
    image = clamp(F.coalesce(image_coverage, F.lit(0.0)) / 100.0)
    noise = clamp((zero("non_printable_ratio") + zero("unicode_noise_ratio")) / 2.0)
    font = F.when(zero("font_count") > 0, F.least(F.col("font_count") / 5.0, F.lit(1.0))).otherwise(0.0)
    c = config
    total = image * c.ocr_score_image_weight + noise * c.ocr_score_noise_weight + (1.0 - text) * c.ocr_score_text_weight + (1.0 - font) * c.ocr_score_font_weight
    return r(clamp(total), 3)


def score_confidence(score: Column, needs_ocr: bool | Column) -> Column:
    if isinstance(needs_ocr, bool):
        return r(F.lit(0.5) + (score if needs_ocr else 1.0 - score) * 0.45, 2)
    return r(F.lit(0.5) + F.when(needs_ocr, score).otherwise(1.0 - score) * 0.45, 2)


def confidence(needs_ocr: Column, score: Column | None = None, config: Config = Config()) -> Column:
    """By score where there is one, else by layout, else by text length."""
    by_layout = F.when(needs_ocr, 0.60 + F.least(zero("image_coverage") / 100.0, F.lit(1.0)) * 0.30).otherwise(0.70 + F.least(zero("text_coverage") / 100.0, F.lit(1.0)) * 0.25)
    n = zero("text_length")
    by_length = F.when(needs_ocr, F.when(n == 0, 0.65).otherwise(0.55 + (1.0 - F.least(n / float(config.min_text_length), F.lit(1.0))) * 0.20)).otherwise(0.75 + F.least(n / 1000.0, F.lit(1.0)) * 0.20)
    known = F.col("layout_type").isNotNull() & ~F.col("layout_type").isin("unknown", "")
    plain = r(F.when(known, by_layout).otherwise(by_length), 2)
    if score is None or not config.use_ocr_score_confidence:
        return plain
    return F.when(score.isNotNull(), score_confidence(score, needs_ocr)).otherwise(plain)


def file_type(mime: Column, extension: Column) -> Column:
    return (
        F.when(mime.startswith("image/"), "image")
        .when((mime == "application/pdf") | (extension == "pdf"), "pdf")
        .when(mime.contains("officedocument") | extension.isin(*OFFICE, "doc", "ppt", "xls"), "office")
        .when(mime.startswith("text/") | extension.isin("txt", "csv", "html", "htm"), "text")
        .when(mime.isin("application/json", "application/xml") | extension.isin("json", "xml"), "structured")
        .otherwise("unknown")
    )


def hints(needs_ocr: Column, complexity: Column) -> Column:
    """struct(suggested_engine, suggest_preprocessing, ocr_complexity_score); nulls and 0 where no recognition is needed."""
    layout = F.when(complexity == "complex", 0.6).when(complexity == "moderate", 0.4).otherwise(0.2)
    ic, n = zero("image_coverage"), zero("text_length")
    ratio = ic / 100.0
    weak = F.when(n < 20, 0.3).when(n < 50, 0.2).otherwise(0.0)
    raw = F.least(F.lit(1.0), layout * 0.3 + ratio * 0.35 + weak * 0.25 + F.when(ratio > 0.6, 0.1).otherwise(0.0) * 0.1)
    engine = F.when(raw < 0.3, "tesseract").when(raw < 0.7, "paddle").otherwise("vision_llm")
    steps = F.filter(F.array(F.when((ic > 60) | (layout >= 0.4), "deskew"), F.when((ic > 50) | (n < 30), "otsu"), F.when(ic > 70, "denoise")), lambda x: x.isNotNull())
    return F.struct(F.when(needs_ocr, engine).alias("suggested_engine"), F.when(needs_ocr, steps).alias("suggest_preprocessing"), F.when(needs_ocr, r(raw, 2)).otherwise(0.0).alias("ocr_complexity_score"))
