"""Page geometry from rows of blocks, characters and images: areas, coverages, fonts, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import exact_sum, r, zero
from .pages import layout_type

KEYS = ("file_path", "page_number")


def area(prefix: str = "") -> Column:
    return (F.col(f"{prefix}x1") - F.col(f"{prefix}x0")) * (F.col(f"{prefix}y1") - F.col(f"{prefix}y0"))


def bounding_box(items: DataFrame, *keys: str) -> DataFrame:
    """The box around all items of each group."""
    return items.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count(F.lit(1)).alias("n"))


def areas_of_blocks(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each page with text_area, image_area and chars summed over its blocks (kind text or image); pages without blocks have zeros."""
    text, image = F.col("kind") == "text", F.col("kind") == "image"
    g = blocks.groupBy(*KEYS).agg(exact_sum(F.when(text, area())).cast("double").alias("t"), exact_sum(F.when(image, area())).cast("double").alias("i"), F.sum(F.when(text, F.col("chars"))).alias("c"))
    return pages.join(g, list(KEYS), "left").select(*pages.columns, zero("t").alias("text_area"), zero("i").alias("image_area"), zero("c").alias("chars"))


def areas_of_chars(pages: DataFrame, chars: DataFrame) -> DataFrame:
    """Each page with the area of the box around all its characters as text_area, and how many there are."""
    box = bounding_box(chars, *KEYS).withColumn("t", area())
    return pages.join(box.select(*KEYS, "t", "n"), list(KEYS), "left").select(*pages.columns, zero("t").alias("text_area"), zero("n").alias("chars"))


def quick_image_coverage(pages: DataFrame, key: str = "file_path") -> DataFrame:
    """Percent of all pages' area that images take, not clamped."""
    g = pages.groupBy(key).agg(exact_sum(F.col("image_area")).alias("i"), exact_sum(F.col("page_area")).alias("a"))
    return g.select(key, r(F.coalesce(F.try_divide(F.col("i").cast("double") * 100.0, F.col("a").cast("double")), F.lit(0.0)), 2).alias("image_coverage"))


def max_image_coverage(pages: DataFrame, key: str = "file_path") -> DataFrame:
    """The greatest image coverage of a document's pages; 0 where none is known."""
    return pages.groupBy(key).agg(zero(F.max("image_coverage")).alias("max_image_coverage"))


def font_count(spans: DataFrame, most_pages: int = 5, key: str = "file_path") -> DataFrame:
    """Different fonts on a document's first pages."""
    return spans.where(F.col("page_number") <= most_pages).groupBy(key).agg(F.count_distinct("font").alias("font_count"))


def layout_or_unknown(files: DataFrame, layouts: DataFrame, key: str = "file_path") -> DataFrame:
    """Each file with its layout; one that no analyser has seen is unknown, with zeros."""
    lay = layouts.select(key, "text_coverage", "image_coverage", "chars")
    out = files.select(key).join(lay, key, "left")
    known = F.col("text_coverage").isNotNull()
    kind = F.when(known, layout_type(F.col("text_coverage"), F.col("image_coverage"), F.col("chars"))).otherwise("unknown")
    return out.select(key, zero("text_coverage").alias("text_coverage"), zero("image_coverage").alias("image_coverage"), kind.alias("layout_type"), (kind == "mixed").alias("is_mixed_content"))


def page_texts(pages: DataFrame, texts: DataFrame) -> DataFrame:
    """Each page with the text at its place; missing ones are empty, surplus ones go."""
    return pages.join(texts.select(*KEYS, "text"), list(KEYS), "left").select(*pages.columns, F.coalesce("text", F.lit("")).alias("text"))


def with_hints(pages: DataFrame, hints: DataFrame) -> DataFrame:
    """Each page with the caller's hint at its place, null where there is none."""
    return pages.join(hints.select(*KEYS, "hint"), list(KEYS), "left")


def only_pages(pages: DataFrame, wanted: list[int] | None) -> DataFrame:
    """The pages asked for (1-based); numbers that a document hasn't are passed over, none asked for means all."""
    return pages if wanted is None else pages.where(F.col("page_number").isin([int(x) for x in wanted]))


def sampled_pages(pages: DataFrame, few: int = 5, more: int = 2, most: int | None = None, key: str = "file_path") -> DataFrame:
    """Which pages to look at: all of up to ``few``, else the first, the middle, the last and ``more`` others, chosen by a hash, so that a second run takes the same ones; then the first ``most`` of that list."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    at = F.col("page_number") - 1
    fixed = F.when(at == 0, 0).when(at == F.floor(F.col("__n") / 2), 1).when(at == F.col("__n") - 1, 2)
    lot = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col("page_number").cast("string")))
    base = pages.withColumn("__n", n).withColumn("__fixed", fixed)
    drawn = F.row_number().over(Window.partitionBy(key, F.col("__fixed").isNull()).orderBy(lot, "page_number"))
    place = F.when(F.col("__n") <= few, at).when(F.col("__fixed").isNotNull(), F.col("__fixed")).when(drawn <= more, drawn + 2)
    out = base.withColumn("sample_place", place.cast("int")).where("sample_place is not null")
    if most:
        out = out.where(F.col("sample_place") < most)
    return out.drop("__n", "__fixed")


def last_page_wins(pages: DataFrame, value: str, key: str = "file_path") -> DataFrame:
    return pages.groupBy(key).agg(F.max_by(value, "page_number").alias(value))


def numbered(elements: DataFrame, start: int = 0, key: str = "file_path", kept: str = "kept") -> DataFrame:
    """A counter for ids: every block has its number on the page, blank ones too, so they leave gaps; a page starts at the number of elements kept on the pages before."""
    per_page = elements.groupBy(key, "page").agg(F.count_if(kept).alias("__k"))
    before = F.sum("__k").over(Window.partitionBy(key).orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    base = per_page.select(key, "page", F.coalesce(before, F.lit(0)).alias("__base"))
    own = F.row_number().over(Window.partitionBy(key, "page").orderBy("ordinal")) - 1
    return elements.withColumn("__own", own).join(base, [key, "page"]).withColumn("number", F.col("__base") + F.col("__own") + start).drop("__own", "__base")
