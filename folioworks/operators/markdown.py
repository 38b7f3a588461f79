"""Markdown of pages and documents.

What only joins parts in order is a string aggregation.  The structured form reads a
page's texts one after another and decides by what it has just read, so each page goes
through a small machine in Python, by Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBER = re.compile(r"[\d\s.,\-+%]*\d[\d\s.,\-+%]*")


# ------------------------------------------------------------------ tables


def table_grid(cells: DataFrame, keys: tuple[str, ...] = ("file_path",)) -> DataFrame:
    """Each table as markdown: rows are filled up to the widest, empty columns at the end go, the first row is the head."""
    rows = cells.groupBy(*keys, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", F.coalesce("text", F.lit("")).alias("text")))).alias("m"), F.max(F.when(F.trim(F.coalesce("text", F.lit(""))) != "", F.col("col"))).alias("wide"))  # cells of one row
    g = rows.groupBy(*keys).agg(F.greatest(F.max("wide"), F.lit(0)).alias("last"), F.array_sort(F.collect_list(F.struct("row", F.map_entries("m").alias("e")))).alias("rows"))  # rows of one table
    columns = F.sequence(F.lit(0), F.coalesce(F.col("last"), F.lit(0)).cast("int"))

    def line(x: Column) -> Column:
        m = F.map_from_entries(x["e"])
        return F.concat(F.lit("| "), F.array_join(F.transform(columns, lambda c: F.coalesce(F.try_element_at(m, c), F.lit(""))), " | "), F.lit(" |"))

    lines = F.transform("rows", line)
    rule = F.array(F.concat(F.lit("| "), F.array_join(F.transform(columns, lambda c: F.lit("---")), " | "), F.lit(" |")))
    return g.select(*keys, F.array_join(F.concat(F.slice(lines, 1, 1), rule, F.slice(lines, 2, 1 << 30)), "\n").alias("markdown"))


def grid_of(rows: list[list[str]]) -> str:
    wide = max((len(x) for x in rows), default=0)
    full = [x + [""] * (wide - len(x)) for x in rows]
    while wide > 1 and not any(x[wide - 1].strip() for x in full):
        wide -= 1
    lines = ["| " + " | ".join(x[:wide]) + " |" for x in full]
    return "\n".join([*lines[:1], "| " + " | ".join(["---"] * wide) + " |", *lines[1:]]) if rows else ""


# ------------------------------------------------------------------ structured pages


def _numbers(row: list[str]) -> int:
    return sum(bool(_NUMBER.fullmatch(c.strip())) for c in row)


def _is_head(row: list[str]) -> bool:
    text = " ".join(c.strip() for c in row)
    letters, digits = sum(c.isalpha() for c in text), sum(c.isdigit() for c in text)
    filled = [c for c in row if c.strip()]
    if len(row) < 3 or not letters + digits or any(c.strip().endswith(":") for c in row):
        return False
    words = sum(len(c.split()) for c in filled) / max(1, len(filled))
    return letters > 0.6 * (letters + digits) and digits < 0.2 * (letters + digits) and _numbers(row) <= 1 and words <= 4


def _is_data(row: list[str]) -> bool:
    return len(row) >= 3 and (_numbers(row) > 0 or row[0].strip()[:1].isdigit())


def _is_section(text: str) -> bool:
    return 0 < len(text) <= 50 and not text.endswith(":") and not re.search(r"[\d/]", text) and not (text.isupper() and len(text) > 1) and len(text.split()) <= 5


def joined_rows(label: list[str], numbers: list[str]) -> list[str] | None:
    """A row of labels and the row of numbers below it as one row, if they are such rows."""
    index = bool(label) and label[0].strip().replace(".", "").isdigit()
    n = _numbers(label)
    if len(label) < 2 or len(numbers) < 2 or n > 1 or n == 1 and not index or not _numbers(numbers):
        return None
    if len(label) == len(numbers) == 3:
        out = [label[0], f"{label[1].strip()} {label[2].strip()}", *numbers]
    else:
        out = [*label[:-1], f"{label[-1].strip()} {numbers[0].strip()}", *numbers[1:]]
    return out if 3 <= len(out) <= 10 and len(out) >= max(len(label), len(numbers)) else None


def _cells(text: str) -> list[str]:
    return [p.strip() for p in text.strip().split("\n") if p.strip()]


def _table(texts: list[str], i: int) -> tuple[list[str], int]:
    """The table that begins at text ``i``, and what stands between its head and its first row: lines, and where reading goes on."""
    lines: list[str] = []
    head: list[str] | None = None
    rows: list[list[str]] = []
    while i < len(texts):
        row = _cells(texts[i])
        fits = len(row) >= 3 and not any(c.endswith(":") for c in row) and (_is_head(row) or _is_data(row))
        if fits and _is_head(row) and not rows:
            head = row
        elif fits:
            both = joined_rows(rows[-1], row) if rows else None
            if both:
                rows[-1] = both
            else:
                lead = re.fullmatch(r"(\d+)\s+(.+)", row[0], re.S) if head and len(head) == 5 and len(row) == 4 else None
                rows.append([lead[1], lead[2], *row[1:]] if lead else row)
        elif head and not rows and (len(row) < 3 or not (_is_head(row) or _is_data(row))):
            lines += [texts[i].rstrip("\n"), ""]
        else:
            break
        i += 1
    return [*lines, grid_of([head, *rows] if head else rows), ""], i


def _pairs(block: list[str]) -> Iterator[str]:
    j = 0
    while j < len(block):
        if block[j].endswith(":") and j + 1 < len(block) and len(block[j + 1]) < 80:
            yield f"**{block[j].rstrip(':')}** {block[j + 1]}"
            j += 2
        else:
            yield block[j]
            j += 1


def structured(elements: list[tuple[str, str]]) -> list[str]:
    """Lines of markdown from a page's elements (title, heading, list or narrative; text) in reading order."""
    out: list[str] = []
    texts = [t for _, t in elements]
    i = 0
    while i < len(elements):
        kind, text = elements[i]
        body = text.strip()
        block = _cells(text)
        after = texts[i + 1].strip() if i + 1 < len(texts) else None
        if kind in ("title", "heading"):
            out += [text, ""]
        elif kind == "narrative" and _is_section(body):
            out += [f"### {body}", ""]
        elif len(block) >= 3 and not any(x.endswith(":") for x in block) and (_is_head(block) or _is_data(block)):
            lines, i = _table(texts, i)
            out += lines
            continue
        elif "\n" in body:
            out += [*_pairs(block), ""]
        elif body.endswith(":") and after is not None and len(after) < 80 and not after.endswith(":") and not _is_section(after):
            out += [f"**{body.rstrip(':')}** {after}", ""]
            i += 1
        elif kind == "list":
            out += [text] if i + 1 < len(elements) and elements[i + 1][0] == "list" else [text, ""]
        else:
            out += [body, ""]
        i += 1
    return out


KINDS = {"Title": "title", "Heading": "heading", "ListItem": "list"}


def structured_markdown(elements: DataFrame, keys: tuple[str, ...] = ("file_path", "page"), order: str = "ordinal") -> DataFrame:
    """Each page's elements (type, text) as structured markdown."""
    mark = F.when(F.col("type") == "Title", "# ").when(F.col("type") == "Heading", "## ").when(F.col("type") == "ListItem", "- ").otherwise("")
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in KINDS.items() for x in p]), F.col("type")), F.lit("narrative"))
    parts = F.array_sort(F.collect_list(F.struct(order, kind.alias("kind"), F.concat(mark, F.coalesce("text", F.lit(""))).alias("text"))))  # elements of one page
    pages = elements.groupBy(*keys).agg(parts.alias("parts"))

    def run(parts: pd.Series) -> pd.Series:
        return parts.map(lambda p: "\n".join(structured([(x["kind"], x["text"]) for x in p])).rstrip("\n"))

    run.__annotations__ = {"parts": pd.Series, "return": pd.Series}
    return pages.select(*keys, F.pandas_udf(run, "string")("parts").alias("markdown"))


# ------------------------------------------------------------------ pages and documents


def with_reading_order(elements: DataFrame, order: DataFrame, key: str = "file_path") -> DataFrame:
    """Elements with their place in the reading order; 9999 for those that it lacks."""
    return elements.join(order.select(key, "element_id", "place"), [key, "element_id"], "left").withColumn("place", F.coalesce("place", F.lit(9999)))


def page_content(elements: DataFrame, tables: DataFrame, forms: DataFrame, key: str = "file_path") -> DataFrame:
    """Each page's forms, then tables by top edge (not decorative ones), then elements by reading order, as one text.

    elements (page, place, ordinal, type, text); tables (page, y0, decorative, markdown); forms (page, ordinal, name, value).
    """
    mark = F.when(F.col("type") == "Title", "# ").when(F.col("type") == "Heading", "## ").when(F.col("type") == "ListItem", "- ").otherwise("")
    part = lambda df, rank, at, text: df.select(key, "page", F.lit(rank).alias("rank"), at.cast("double").alias("at"), F.col("ordinal").cast("long").alias("ordinal"), text.alias("t"))
    f = part(forms, 0, F.col("ordinal"), F.concat(F.lit("**"), F.col("name"), F.lit(":** "), F.coalesce("value", F.lit(""))))
    t = part(tables.where("not decorative"), 1, F.col("y0"), F.col("markdown"))
    e = part(elements.where("coalesce(text, '') <> ''"), 2, F.col("place"), F.concat(mark, "text"))
    parts = F.array_sort(F.collect_list(F.struct("rank", "at", "ordinal", "t")))  # of one page
    return f.unionByName(t).unionByName(e).groupBy(key, "page").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n").alias("markdown"))


def document_markdown(pages: DataFrame, key: str = "file_path") -> DataFrame:
    """Each document's pages joined by a blank line, and as a map from page to text."""
    parts = F.array_sort(F.collect_list(F.struct("page", "markdown")))  # pages of one document
    return pages.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["markdown"]), "\n\n").alias("markdown"), F.map_from_entries(parts).alias("by_page"))


def percent(c: Column) -> Column:
    return F.concat(F.format_string("%.2f", F.round((c * 100).cast("decimal(18,9)"), 2).cast("double")), F.lit("%"))


def full_markdown(documents: DataFrame, tables: DataFrame, contents: DataFrame, errors: DataFrame, key: str = "file_path") -> DataFrame:
    """A document as markdown with its type, method and confidence, its tables, its content by page and its errors.

    documents (file_type, method, document_type, confidence); tables (table, page, confidence,
    n_rows, n_columns, markdown); contents (page, markdown); errors (ordinal, error).
    """
    head = F.concat_ws(
        "\n", F.concat(F.lit("# Document: "), F.col(key).cast("string")), F.lit(""), F.concat(F.lit("**File Type:** "), "file_type"), F.concat(F.lit("**Extraction Method:** "), "method"),
        F.when(F.col("document_type").isNotNull(), F.concat(F.lit("**Document Type:** "), "document_type")), F.concat(F.lit("**Overall Confidence:** "), percent(F.col("confidence"))),
    )

    def section(df: DataFrame, name: str, at: list[str], text: Column, title: str, gap: str) -> DataFrame:
        parts = F.array_sort(F.collect_list(F.struct(*at, text.alias("t"))))  # of one document
        return df.groupBy(key).agg(F.concat(F.lit(f"## {title}\n{gap}"), F.array_join(F.transform(parts, lambda x: x["t"]), "\n" + gap)).alias(name))

    t = F.concat(F.lit("### Table "), F.col("table").cast("string"), F.lit(" (Page "), F.col("page").cast("string"), F.lit(")\n**Confidence:** "), percent(F.col("confidence")), F.lit("\n**Dimensions:** "), F.col("n_rows").cast("string"), F.lit(" rows × "), F.col("n_columns").cast("string"), F.lit(" columns\n\n"), "markdown")
    out = documents.select(key, head.alias("head"))
    out = out.join(section(tables, "tables", ["page", "table"], t, "Tables", ""), key, "left")
    out = out.join(section(contents, "content", ["page"], F.concat(F.lit("### Page "), F.col("page").cast("string"), F.lit("\n\n"), "markdown"), "Content", "\n"), key, "left")
    out = out.join(section(errors, "errors", ["ordinal"], F.concat(F.lit("- "), "error"), "Errors", ""), key, "left")
    return out.select(key, F.concat_ws("\n\n", "head", "tables", "content", "errors").alias("markdown"))
