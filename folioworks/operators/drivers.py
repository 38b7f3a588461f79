"""From files to results: triage, planning and extraction end to end.

Files are split by kind, each kind goes through its own reader, and what comes out are
rows again, so that everything after the readers is one plan.  A file that fails is a row
with its error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, PlannerConfig
from ..functions.text import document_type, html_text, intent_scores, meaningful
from ..sources import files as sources
from ..sources.office import office_rows
from ..sources.pdf import page_blocks, page_sizes, pdf_pages, probe
from . import geometry, pages, rules, signals
from .extract import element_confidence, element_id, text_elements

EXTRACTED = "file_path string, page int, ordinal bigint, kind string, type string, text string, table int, row int, col int, x0 double, y0 double, x1 double, y1 double, confidence double, error string"


def kind_of(mime: Column, extension: Column) -> Column:
    """Which reader a file goes to: pdf, office, text, image or unknown."""
    return (
        F.when((mime == "application/pdf") | (extension == "pdf"), "pdf").when(mime.contains("officedocument") | extension.isin("docx", "pptx", "xlsx"), "office")
        .when(mime.startswith("image/"), "image").when(mime.startswith("text/") | mime.isin("application/json", "application/xml"), "text").otherwise("unknown")
    )


def text_of_file(content: Column, mime: Column) -> Column:
    """Plain text as it is, HTML without its markup, at most what a probe keeps."""
    plain = sources.plain_text(content)
    return F.when(mime.isin("text/html", "application/xhtml+xml"), html_text(plain)).otherwise(plain)


def signals_of(typed: DataFrame, probe_chars: int = 1000) -> DataFrame:
    """The signals row of each file from ``with_types``: PDFs by their pages, office files by their rows, text as it is."""
    kinds = typed.withColumn("kind", kind_of(F.col("mime"), F.col("extension")))
    base = ["path", "mime", "extension", "is_binary", "length", "kind"]
    none = lambda k: F.lit(None).cast(k)
    shape = lambda df, text, page_count, fonts, error: df.select(*base, text.alias("text"), page_count.cast("int").alias("page_count"), fonts.cast("int").alias("font_count"), error.alias("error"))
    pdf = kinds.where("kind = 'pdf'")
    read = pdf_pages(pdf)
    found = probe(read).select(F.col("file_path").alias("path"), F.col("text").alias("t"), F.col("page_count").alias("pc"), F.col("font_count").alias("fc"), F.col("error").alias("e"))
    out = shape(pdf.join(found, "path", "left"), F.coalesce("t", F.lit("")), F.coalesce("pc", F.lit(0)), F.col("fc"), F.when(F.coalesce("pc", F.lit(0)) == 0, F.col("e")))
    office = kinds.where("kind = 'office'")
    parts = F.array_sort(F.collect_list(F.struct("page", "ordinal", "text")))  # of one file
    rows = office_rows(office).groupBy("path").agg(F.array_join(F.transform(F.filter(parts, lambda x: x["text"].isNotNull()), lambda x: x["text"]), "\n").alias("t"), F.max("error").alias("e"))
    out = out.unionByName(shape(office.join(rows, "path", "left"), F.coalesce("t", F.lit("")), F.lit(0), none("int"), F.col("e")))
    text = kinds.where("kind = 'text'")
    out = out.unionByName(shape(text, text_of_file(F.col("content"), F.col("mime")), F.lit(0), none("int"), none("string")))
    rest = kinds.where("kind in ('image', 'unknown')")
    out = out.unionByName(shape(rest, F.lit(""), F.lit(0), none("int"), none("string")))
    full = signals.collect_signals(out).withColumn("has_text", meaningful(F.col("text")))
    blocks = page_blocks(read)
    areas = geometry.areas_of_blocks(page_sizes(read), blocks)
    layout = pages.layout_rollup(areas).select(F.col("file_path").alias("path"), "text_coverage", "image_coverage", "text_density", "layout_type", "is_mixed_content")
    return full.join(layout, "path", "left").withColumnRenamed("path", "file_path").withColumn("text", F.substring("text", 1, probe_chars))


def triage(spark: SparkSession, directory: str, extensions: list[str] | None = None, config: Config = Config(), resume: DataFrame | None = None) -> DataFrame:
    """Verdicts of all files below a directory but those that ``resume`` (file_path) has; rows of files that can't be read have an error and its kind."""
    typed = sources.with_types(sources.scan(spark, directory, extensions))
    if resume is not None:
        typed = typed.join(resume.select(F.col("file_path").alias("path")), "path", "left_anti")
    rows = signals_of(typed)
    out = rules.decide(rows, config)
    kind = F.when(F.col("error").isNotNull(), F.regexp_extract("error", r"^(\w+)", 1))
    return out.withColumns({"file_type": signals.file_type(F.col("mime"), F.col("extension")), "reason": rules.reason(F.col("reason_code")), "error_type": kind})


def results_and_errors(triaged: DataFrame) -> tuple[DataFrame, DataFrame]:
    return triaged.where("error is null"), triaged.where("error is not null").select("file_path", "error", "error_type")


# ------------------------------------------------------------------ planning


def plan(documents: DataFrame, page_rows: DataFrame, texts: DataFrame, config: PlannerConfig = PlannerConfig(), key: str = "file_path") -> DataFrame:
    """A plan for each document (confidence, needs_ocr, page_count): by confidence, by lack of pages or images, or page by page.

    page_rows (file_path, page_number, image_coverage, text_coverage, extraction_failed, layout_missing); texts (file_path, page_number, text).
    """
    most = geometry.max_image_coverage(page_rows)
    staged = pages.planner_exit(documents.join(most, key, "left"), config)
    full = staged.where("exit = 'full'").select(key)
    rows = geometry.page_texts(page_rows.join(full, key, "left_semi"), texts).withColumn("text_length", F.length("text"))
    decided = pages.planner_pages(rows, config)
    rolled = summaries(pages.planner_rollup(decided).join(overrides(decided), key, "left"))
    early = exits(staged.where("exit <> 'full'"), config)
    columns = [key, "exit", "needs_ocr_any", "overall_confidence", "summary_reason"]
    return rolled.withColumn("exit", F.lit("full")).select(*columns, "pages_needing_ocr").unionByName(early.select(*columns, "pages_needing_ocr"))


def overrides(decided: DataFrame, key: str = "file_path") -> DataFrame:
    return decided.groupBy(key).agg(F.count_if(F.col("decision_type") == "terminal_override").alias("n_overrides"), F.count_if(F.col("decision_type") != "terminal_override").alias("n_scored"))


def summaries(rolled: DataFrame) -> DataFrame:
    """The sentence that sums a plan up."""
    text = F.format_string("OCR required on %d of %d pages (%d overrides, %d scored).", F.size("pages_needing_ocr"), "page_count", "n_overrides", "n_scored")
    return rolled.withColumn("summary_reason", text)


def exits(staged: DataFrame, config: PlannerConfig = PlannerConfig()) -> DataFrame:
    """Plans of documents whose planning ends early: all their pages share the document's verdict (a fallback asks for recognition)."""
    fallback = F.col("exit") == "fallback"
    needs = F.when(fallback, True).when(F.col("exit") == "fast_path", False).otherwise(F.coalesce("needs_ocr", F.lit(True)))
    n = F.greatest(F.coalesce("page_count", F.lit(1)), F.lit(1)).cast("int")
    why = F.when(F.col("exit") == "confidence_exit", F.format_string("Confidence exit (%.2f); skipped planner.", "confidence")).when(fallback, "No pages; fallback.").otherwise("No images to speak of; fast path.")
    return staged.withColumns(
        {"needs_ocr_any": needs, "pages_needing_ocr": F.when(needs, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), "overall_confidence": F.when(fallback, 0.5).otherwise(F.round(F.col("confidence").cast("decimal(18,9)"), 2).cast("double")), "summary_reason": why}
    )


def plan_rows(planned: DataFrame) -> DataFrame:
    """Plans as rows of a batch's results."""
    return planned.select("file_path", F.col("needs_ocr_any").alias("needs_ocr"), F.col("overall_confidence").alias("confidence"), F.when(F.col("needs_ocr_any"), "PLANNER_OCR").otherwise("PLANNER_DIGITAL").alias("reason_code"), F.size("pages_needing_ocr").alias("pages_needing_ocr"), F.col("summary_reason").alias("reason"))


# ------------------------------------------------------------------ extraction


def extract(typed: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """EXTRACTED rows (elements, cells, images) of files from ``with_types``, by the reader of their kind; unknown kinds are rows with an error."""
    names = [x.split()[0] for x in EXTRACTED.split(", ")]
    types = {x.split()[0]: x.split()[1] for x in EXTRACTED.split(", ")}
    shape = lambda df, **c: df.select(*[c.get(n, F.col(n) if n in df.columns else F.lit(None)).cast(types[n]).alias(n) for n in names])
    kinds = typed.withColumn("file_kind", kind_of(F.col("mime"), F.col("extension")))
    read = geometry.only_pages(pdf_pages(kinds.where("file_kind = 'pdf'")), wanted)
    b = page_blocks(read).join(read.select(F.col("path").alias("file_path"), "page_number", "width", "height"), ["file_path", "page_number"])
    centred = F.abs((F.col("x0") + F.col("x1")) / 2 - F.col("width") / 2) < F.col("width") * 0.1
    bold = F.lower("font").rlike("bold|black|heavy")
    from .extract import element_type

    whole = F.lit(1.0)
    pdf = shape(b.where("coalesce(trim(text), 'x') <> ''"), page=F.col("page_number"), kind=F.when(F.col("kind") == "image", "image").otherwise("element"), type=F.when(F.col("kind") == "text", element_type(F.col("size"), bold, centred, F.col("y0"), F.col("height"))), confidence=element_confidence(F.lit(0.9), F.lit(0.9), whole, whole))
    cell = read.select(F.col("path").alias("file_path"), "page_number", F.posexplode("cells").alias("ordinal", "c"))
    # tables that are too empty or cut too small go
    from .tables import quality_filter

    good = quality_filter(cell.select("file_path", "page_number", "c.table", "c.row", "c.text"), ("file_path", "page_number", "table")).select("file_path", "page_number", "table")
    found = cell.select("file_path", "page_number", "ordinal", "c.*").join(good, ["file_path", "page_number", "table"], "left_semi")
    pdf = pdf.unionByName(shape(found, page=F.col("page_number"), kind=F.lit("cell"), confidence=F.lit(0.85)))
    form = read.select(F.col("path").alias("file_path"), "page_number", F.posexplode("forms").alias("ordinal", "f")).select("file_path", "page_number", "ordinal", F.col("f.name").alias("type"), F.col("f.value").alias("text"))
    pdf = pdf.unionByName(shape(form, page=F.col("page_number"), kind=F.lit("form"), confidence=F.lit(0.95)))
    broken = shape(read.where("error is not null"), file_path=F.col("path"), page=F.col("page_number"), kind=F.lit("error"))
    office = shape(office_rows(kinds.where("file_kind = 'office'")), file_path=F.col("path"), kind=F.coalesce("kind", F.lit("error")))
    text = kinds.where("file_kind = 'text' and extension <> 'csv'").withColumn("text", text_of_file(F.col("content"), F.col("mime")))
    plain = shape(text_elements(text, "path"), file_path=F.col("path"), page=F.lit(1), ordinal=F.col("line"), kind=F.lit("element"), confidence=F.lit(0.95))
    csv = sources.csv_cells(kinds.where("file_kind = 'text' and extension = 'csv'").withColumn("text", sources.plain_text(F.col("content"))))
    cells = shape(csv, file_path=F.col("path"), page=F.lit(1), kind=F.lit("cell"), table=F.lit(0), ordinal=F.col("row") * 10_000 + F.col("col"), confidence=F.lit(0.95))
    other = shape(kinds.where("file_kind in ('unknown', 'image')"), file_path=F.col("path"), kind=F.lit("error"), error=F.concat(F.lit("UnsupportedFormatError: "), "mime"))
    return pdf.unionByName(broken).unionByName(office).unionByName(plain).unionByName(cells).unionByName(other)


def clean(extracted: DataFrame, page_height: float = 792.0) -> DataFrame:
    """Elements outside table cells and outside the foot of their page, with ids and reading order; cells and images stay as they are."""
    from .extract import outside_cells, reading_order, zones

    e = extracted.where("kind = 'element'").withColumn("page_height", F.lit(page_height))
    cells = extracted.where("kind = 'cell' and x0 is not null")
    keyed = lambda df: df.withColumn("__page", F.concat_ws(":", "file_path", "page"))
    placed = keyed(e.where("x0 is not null"))
    free = outside_cells(placed, keyed(cells).select("__page", "x0", "y0", "x1", "y1"), "__page").drop("__page")
    body = zones(free).where("not in_footer or in_header").drop("in_header", "in_footer").unionByName(e.where("x0 is null"))
    return reading_order(body).withColumn("element_id", element_id("file_path", "page", "ordinal")).drop("page_height")


def document_types(elements: DataFrame, key: str = "file_path") -> DataFrame:
    """The kind of document by the words of all its elements in order."""
    return whole_text(elements, key).select(key, document_type(F.col("text")).alias("document_type"))


def whole_text(elements: DataFrame, key: str = "file_path") -> DataFrame:
    """Each document's texts in order, joined by spaces."""
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "text")))  # elements of one document
    return elements.where("text is not null").groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("text"))


def intent_classifier(patterns: dict[str, list[str]] | None = None):
    """A function from (text, layout_hints) to scores by label; the hints are taken and not used."""
    from ..functions.text import INTENT_PATTERNS

    own = patterns or INTENT_PATTERNS
    return lambda text, layout_hints=None: intent_scores(text, own)
