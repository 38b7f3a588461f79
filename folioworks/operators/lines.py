"""Characters and spans to words, lines and rows.

Greedy clusterings whose next step depends on what the last one made are folds over the sorted
items of one page or line (``aggregate`` over an array, in the JVM), all else window functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PAGE = ("file_path", "page")


def _fold(items: DataFrame, keys: tuple[str, ...], fields: list[str], state: str, start: Column, step) -> DataFrame:
    """One row for each group with ``s``: the fold of ``step(state, item)`` over the group's items in the order of ``fields``."""
    rows = F.array_sort(F.collect_list(F.struct(*fields)))  # items of one page or line
    return items.groupBy(*keys).agg(F.aggregate(rows, start.cast(state), lambda s, x: step(s, x).cast(state)).alias("s"))


def group_lines(items: DataFrame, threshold: float = 2.5, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """``items`` (x0, y0, rotated, ordinal) with the number of their line.

    In order of y0, then x0 (rotated pages: x0, then y0), an item joins the first line
    whose own first item is at most ``threshold`` away, else it begins a line.  A page
    is rotated if its first item is.
    """
    page = Window.partitionBy(*keys)
    turned = F.first("rotated").over(page.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    at = items.withColumn("__turned", turned).withColumns({"__a": F.when(F.col("__turned"), F.col("x0")).otherwise(F.col("y0")), "__b": F.when(F.col("__turned"), F.col("y0")).otherwise(F.col("x0"))})

    def step(s: Column, x: Column) -> Column:
        near = F.filter(F.sequence(F.lit(1), F.size(s["starts"])), lambda i: F.abs(F.element_at(s["starts"], i) - x["__a"]) <= threshold)
        some = (F.size(s["starts"]) > 0) & (F.size(near) > 0)
        line = F.when(some, F.try_element_at(near, F.lit(1))).otherwise(F.size(s["starts"]) + 1)
        return F.struct(F.when(some, s["starts"]).otherwise(F.concat(s["starts"], F.array(x["__a"]))).alias("starts"), F.concat(s["rows"], F.array(F.struct(x["ordinal"].cast("long").alias("ordinal"), line.cast("int").alias("line")))).alias("rows"))

    start = F.struct(F.array().cast("array<double>").alias("starts"), F.array().cast("array<struct<ordinal:bigint,line:int>>").alias("rows"))
    # sequence(1, 0) counts down; an empty page of lines is told by its size
    found = _fold(at, keys, ["__a", "__b", "ordinal"], "struct<starts:array<double>,rows:array<struct<ordinal:bigint,line:int>>>", start, step)
    lines = found.select(*keys, F.explode("s.rows").alias("r")).select(*keys, F.col("r.ordinal").alias("ordinal"), F.col("r.line").alias("line"))
    return items.join(lines, [*keys, "ordinal"])


def merge_characters(chars: DataFrame, ratio: float = 0.35, size_step: float = 0.5, keys: tuple[str, ...] = (*PAGE, "line")) -> DataFrame:
    """Words from the characters (text, x0, x1, y0, y1, font, size, ordinal) of horizontal lines.

    A character joins the word before it if its top is less than 2.5 from the word's, its
    font and size are the same, and the gap is less than ``ratio`` of the word's average
    character width.
    """
    state = "struct<words:array<struct<text:string,x0:double,x1:double,y0:double,y1:double>>,text:string,x0:double,x1:double,y0:double,y1:double,font:string,size:double>"

    def step(s: Column, x: Column) -> Column:
        wide = s["x1"] - s["x0"]
        each = F.when(wide > 0, wide / F.greatest(F.length(s["text"]), F.lit(1))).otherwise(x["size"])
        joins = s["text"].isNotNull() & (F.abs(s["y0"] - x["y0"]) < 2.5) & (s["font"] == x["font"]) & (F.abs(s["size"] - x["size"]) < size_step) & (x["x0"] - s["x1"] < each * ratio)
        word = F.array(F.struct(s["text"].alias("text"), s["x0"].alias("x0"), s["x1"].alias("x1"), s["y0"].alias("y0"), s["y1"].alias("y1")))
        whole = F.when(joins | s["text"].isNull(), s["words"]).otherwise(F.concat(s["words"], word))
        pick = lambda name, merged: F.when(joins, merged).otherwise(x[name]).alias(name)
        return F.struct(whole.alias("words"), pick("text", F.concat(s["text"], x["text"])), pick("x0", s["x0"]), pick("x1", x["x1"]), pick("y0", s["y0"]), pick("y1", F.greatest(s["y1"], x["y1"])), pick("font", s["font"]), pick("size", s["size"]))

    none = F.lit(None)
    start = F.struct(F.array().alias("words"), *[none.cast("string" if c in ("text", "font") else "double").alias(c) for c in ("text", "x0", "x1", "y0", "y1", "font", "size")])
    found = _fold(chars, keys, ["x0", "ordinal", "x1", "y0", "y1", "text", "font", "size"], state, start, step)
    last = F.array(F.struct(*[F.col(f"s.{c}").alias(c) for c in ("text", "x0", "x1", "y0", "y1")]))
    return found.select(*keys, F.posexplode(F.concat("s.words", last)).alias("word", "w")).select(*keys, "word", "w.*")


def spaced_words(words: DataFrame, keys: tuple[str, ...] = (*PAGE, "line")) -> DataFrame:
    """The text of each line: words joined, with a space where one that ends in a digit or a currency meets, at a small gap, one that begins with a letter."""
    w = Window.partitionBy(*keys).orderBy("x0", "word")
    before, end, begin = (F.lag(c).over(w) for c in ("text", "x1", "x0"))
    gap = F.col("x0") - end
    space = before.rlike(r"[\d$₹€£]$") & F.col("text").rlike("^[A-Za-z]") & (gap > 0) & (gap < (end - begin) / F.greatest(F.length(before), F.lit(1)) * 0.3)
    parts = words.withColumn("__t", F.when(F.coalesce(space, F.lit(False)), F.concat(F.lit(" "), "text")).otherwise(F.col("text")))
    return parts.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "word", "__t"))), lambda x: x["__t"]), "").alias("text"))  # words of one line


def span_text(spans: DataFrame, gap: float = 2.0, keys: tuple[str, ...] = (*PAGE, "block", "line")) -> DataFrame:
    """The text of each line of spans (text, x0, x1, ordinal): a space where a span begins more than ``gap`` after the last one ends."""
    apart = F.col("x0") - F.lag("x1").over(Window.partitionBy(*keys).orderBy("ordinal")) > gap
    parts = spans.withColumn("__t", F.when(F.coalesce(apart, F.lit(False)) & (F.col("text") != ""), F.concat(F.lit(" "), "text")).otherwise(F.col("text")))
    return parts.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "__t"))), lambda x: x["__t"]), "").alias("text"))  # spans of one line


def row_bucket(y: Column, height: float = 20.0) -> Column:
    """The row that a top edge lies in; halves go to the even row."""
    return F.bround(y / height).cast("long")


def first_of_each_row(elements: DataFrame, height: float = 20.0, keys: tuple[str, ...] = PAGE, ties: str = "ordinal") -> DataFrame:
    w = Window.partitionBy(*keys, row_bucket(F.col("y0"), height)).orderBy(ties)
    return elements.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def rows_of_cells(cells: DataFrame, height: float = 20.0, keys: tuple[str, ...] = ("file_path", "table")) -> DataFrame:
    """Cells with a dense number for their row, by top edge; rows that are headers go."""
    from .tables import header_words

    b = cells.withColumn("__b", row_bucket(F.col("y0"), height))
    row = Window.partitionBy(*keys, "__b")
    head = F.max(header_words(F.col("text")).cast("int")).over(row)
    b = b.withColumn("__head", (F.coalesce(head, F.lit(0)) > 0) & (F.count(F.lit(1)).over(row) <= 4)).where("not __head")
    return b.withColumn("row", F.dense_rank().over(Window.partitionBy(*keys).orderBy("__b")) - 1).drop("__b", "__head")


def rows_by_nearness(cells: DataFrame, height: float = 20.0, keys: tuple[str, ...] = ("file_path", "table")) -> DataFrame:
    """Cells with the number of their row: in order of ordinal each joins the first row whose first cell is less than ``height`` away; rows are numbered from the top."""
    state = "struct<starts:array<double>,rows:array<struct<ordinal:bigint,y:double>>>"

    def step(s: Column, x: Column) -> Column:
        near = F.filter(s["starts"], lambda y: F.abs(y - x["y0"]) < height)
        some = F.size(near) > 0
        y = F.when(some, F.try_element_at(near, F.lit(1))).otherwise(x["y0"])
        return F.struct(F.when(some, s["starts"]).otherwise(F.concat(s["starts"], F.array(x["y0"]))).alias("starts"), F.concat(s["rows"], F.array(F.struct(x["ordinal"].cast("long").alias("ordinal"), y.cast("double").alias("y")))).alias("rows"))

    start = F.struct(F.array().cast("array<double>").alias("starts"), F.array().cast("array<struct<ordinal:bigint,y:double>>").alias("rows"))
    found = _fold(cells, keys, ["ordinal", "y0"], state, start, step)
    rows = found.select(*keys, F.explode("s.rows").alias("r")).select(*keys, F.col("r.ordinal").alias("ordinal"), (F.dense_rank().over(Window.partitionBy(*keys).orderBy("r.y")) - 1).alias("row"))
    return cells.drop("row").join(rows, [*keys, "ordinal"])


def blocks_of_lines(items: DataFrame, threshold: float = 5.0, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """Items in their own order with the number of their block: a new one where the top edge moves by ``threshold`` or more."""
    w = Window.partitionBy(*keys).orderBy("ordinal")
    new = F.when(F.abs(F.col("y0") - F.lag("y0").over(w)) < threshold, 0).otherwise(1)
    return items.withColumn("__new", new).withColumn("block", F.sum("__new").over(w)).drop("__new")


def text_of_characters(chars: DataFrame, threshold: float = 2.5) -> DataFrame:
    """The text of each page from its characters: lines from the top, words with a space between."""
    words = merge_characters(group_lines(chars, threshold))
    lines = words.groupBy(*PAGE, "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "word", "text"))), lambda x: x["text"]), " ").alias("t"))  # words of one line
    return lines.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda x: x["t"]), "\n").alias("text"))  # lines of one page
