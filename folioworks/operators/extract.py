"""Elements, reading order, tables, invoices and their validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import clamp, exact_sum, r, zero
from ..functions.text import normalized


def text_elements(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One narrative element for each line with text; y is 20 points a line."""
    lines = docs.select(F.col(key), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line", "raw"))
    body = F.regexp_replace("raw", r"^\s+|\s+$", "")
    return lines.withColumn("text", body).where("text <> ''").select(key, "line", "text", F.lit("NarrativeText").alias("type"), (F.col("line") * 20.0).alias("y0"), element_id(key, "line").alias("element_id"))


def element_id(*parts: str) -> Column:
    """A name that doesn't change from run to run."""
    return F.substring(F.sha2(F.concat_ws(":", *[F.col(p).cast("string") for p in parts]), 256), 1, 12)


def html_elements(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Titles and headings, then paragraphs, then list items, each in their own order; one scan for all of them."""
    def found(rank: int, tag: str, kind: str) -> Column:
        texts = F.regexp_extract_all(F.col(html), F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))
        return F.transform(texts, lambda x, i: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("type"), i.alias("ordinal"), x.alias("raw")))

    lists = [found(rank, *x) for rank, x in enumerate((("h1", "Title"), ("h[2-6]", "Heading"), ("p", "NarrativeText"), ("li", "ListItem")))]
    each = pages.select(F.col(key), F.explode(F.concat(*lists)).alias("e")).select(key, "e.rank", "e.type", "e.ordinal", "e.raw")
    body = F.trim(F.regexp_replace(F.regexp_replace("raw", r"(?s)<[^>]+>", " "), r"\s+", " "))
    return each.withColumn("text", body).where("text <> ''").drop("raw")


def element_confidence(quality: Column, method: Column, completeness: Column, box: Column) -> Column:
    return r(clamp(quality * 0.3 + method * 0.3 + completeness * 0.2 + box * 0.2), 4)


def element_type(size: Column, bold: Column, centred: Column, y: Column, height: Column) -> Column:
    return F.when((size > 16) & centred & (y < height * 0.2), "Title").when((size > 12) & bold, "Heading").otherwise("NarrativeText")


def reading_order(elements: DataFrame, key: str = "file_path", ties: str = "ordinal") -> DataFrame:
    return elements.withColumn("reading_order", F.row_number().over(Window.partitionBy(key).orderBy("page", "y0", "x0", ties)) - 1)


def outside_cells(elements: DataFrame, cells: DataFrame, key: str = "file_path") -> DataFrame:
    """Elements whose centre lies in no cell of the same document."""
    e, c = elements.alias("e"), cells.alias("c")
    x, y = (F.col("e.x0") + F.col("e.x1")) / 2, (F.col("e.y0") + F.col("e.y1")) / 2
    inside = (F.col(f"e.{key}") == F.col(f"c.{key}")) & x.between(F.col("c.x0"), F.col("c.x1")) & y.between(F.col("c.y0"), F.col("c.y1"))
    return e.join(c, inside, "left_anti")


def iou(a: str, b: str) -> Column:
    """Overlap of two boxes given by the prefixes of their columns."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(F.col(f"{a}{hi}"), F.col(f"{b}{hi}")) - F.greatest(F.col(f"{a}{lo}"), F.col(f"{b}{lo}")))
    area = lambda p: (F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0"))
    inter = side("x0", "x1") * side("y0", "y1")
    return F.try_divide(inter, area(a) + area(b) - inter)


def table_confidence(cells: DataFrame, base: float, keys: tuple[str, ...] = ("file_path",)) -> DataFrame:
    """Structural confidence of each table: rows that look right, numbers that parse, empty cells, even columns."""
    t = F.trim(F.coalesce("text", F.lit("")))
    numeric = t.rlike(r"^-?[\d,. ]*\d[\d,. ]*$")
    parsed = F.regexp_replace(t, "[, ]", "").try_cast("double").isNotNull()
    rows = cells.groupBy(*keys, "row").agg(
        F.count(F.lit(1)).alias("cols"), F.count_if(t == "").alias("empty"), F.count_if(numeric).alias("numeric"), F.count_if(numeric & parsed).alias("parsed"),
        F.bool_or(F.lower(t).rlike("item|description|price|quantity|total")).alias("head"),
    )
    g = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("cols").alias("n_cells"), F.sum("empty").alias("empty"), F.sum("numeric").alias("numeric"), F.sum("parsed").alias("parsed"), F.count_if(F.col("head") | (F.col("numeric") > 0)).alias("good"), (F.min("cols") == F.max("cols")).alias("even"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(1.0))
    ratio = F.try_divide(F.col("empty").cast("double"), F.col("n_cells"))
    empty = F.when(ratio <= 0.2, 1.0).when(ratio <= 0.5, 1.0 - (ratio - 0.2) * 0.5).otherwise(F.greatest(F.lit(0.0), 0.85 - (ratio - 0.5)))
    total = F.lit(base * 0.4) + share("good", "n_rows") * 0.2 + share("parsed", "numeric") * 0.2 + empty * 0.1 + F.when(F.col("even"), 1.0).otherwise(0.7) * 0.1
    return g.withColumn("confidence", r(clamp(total), 2))


def first_line_items(items: DataFrame, key: str = "file_path", ties: str = "ordinal") -> DataFrame:
    """Of line items that say the same, the first."""
    same = [F.col(key), normalized(F.col("description")), "unit_price", "quantity", "total"]
    return items.withColumn("__n", F.row_number().over(Window.partitionBy(*same).orderBy(ties))).where("__n = 1").drop("__n")


def invoice_totals(items: DataFrame, invoices: DataFrame, key: str = "file_path", tolerance: float = 0.01) -> DataFrame:
    """Each invoice's stated total beside its lines' sum."""
    line = F.coalesce("total", F.col("unit_price") * F.col("quantity")).cast("decimal(18,2)")
    sums = items.groupBy(key).agg(F.sum(line).cast("double").alias("lines_total"), F.count(F.lit(1)).alias("n_lines"))
    out = invoices.join(sums, key, "left")
    return out.withColumn("matches", F.abs(F.round(F.col("stated_total"), 2) - zero("lines_total")) <= tolerance)


def zones(elements: DataFrame, head: float = 0.1, foot: float = 0.9) -> DataFrame:
    """in_header / in_footer by the share of the page's height; an element may be in both."""
    return elements.withColumns({"in_header": F.col("y0") < F.col("page_height") * head, "in_footer": F.col("y1") > F.col("page_height") * foot})


def markdown_table(cells: DataFrame, keys: tuple[str, ...] = ("file_path",)) -> DataFrame:
    """A table as markdown text, the first row as its head."""
    rows = cells.groupBy(*keys, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda x: x["text"]), " | ").alias("line"), F.count(F.lit(1)).alias("n"))  # cells of one row
    body = F.transform(F.array_sort(F.collect_list(F.struct("row", "line", "n"))), lambda x: F.concat(F.lit("| "), x["line"], F.lit(" |")))  # rows of one table
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.max_by("n", -F.col("row")).cast("int")))
    return rows.groupBy(*keys).agg(F.array_join(F.concat(F.slice(body, 1, 1), F.array(rule), F.slice(body, 2, 1 << 20)), "\n").alias("markdown"))


def markdown_page(elements: DataFrame, key: str = "page_id") -> DataFrame:
    """A page's elements in their order, titles and headings marked, a blank line between."""
    mark = F.when(F.col("type") == "Title", "# ").when(F.col("type") == "Heading", "## ").when(F.col("type") == "ListItem", "- ").otherwise("")
    parts = F.array_sort(F.collect_list(F.struct("rank", "ordinal", F.concat(mark, "text").alias("t"))))  # elements of one page
    return elements.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n").alias("markdown"))


def validation_flags(elements: DataFrame, reading: DataFrame, key: str = "file_path") -> DataFrame:
    """Duplicate ids, and ids in the reading order that no element has."""
    twice = elements.groupBy(key, "element_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").groupBy(key).agg(F.count(F.lit(1)).alias("n")).select(key, F.lit("DUPLICATE_ID").alias("code"), F.lit("error").alias("severity"), "n")
    lost = reading.join(elements.select(key, "element_id").distinct(), [key, "element_id"], "left_anti").groupBy(key).agg(F.count(F.lit(1)).alias("n")).select(key, F.lit("DANGLING_ORDER").alias("code"), F.lit("warning").alias("severity"), "n")
    return twice.unionByName(lost)

