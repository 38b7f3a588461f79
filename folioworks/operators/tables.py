"""Tables: quality, headers, stitching, promotion of loose lines, invoices, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import first_int, money, normalized
from .lines import row_bucket

HEADER_WORDS = ("description", "item", "organic items", "price", "quantity", "subtotal", "unit")
MONEY = r"[\$₹€£]\s*(\d+\.?\d*)"


def quality_filter(cells: DataFrame, keys: tuple[str, ...] = ("file_path", "table")) -> DataFrame:
    """Tables worth keeping: two rows or more, a third or so (0.3) of the cells not blank, at most ten cells a row."""
    g = cells.groupBy(*keys).agg(F.count_distinct("row").alias("n_rows"), F.count(F.lit(1)).alias("n_cells"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) != "").alias("n_filled"))
    return g.where((F.col("n_rows") >= 2) & (F.col("n_filled") / F.col("n_cells") >= 0.3) & (F.col("n_cells") <= F.col("n_rows") * 10))


def header_words(text: Column) -> Column:
    """Whether a row's text has a word that heads columns."""
    low = F.lower(text)
    out = F.lit(False)
    for w in HEADER_WORDS:
        out = out | low.contains(w)
    return out


def header_rows(cells: DataFrame, most: int = 4, keys: tuple[str, ...] = ("file_path", "row")) -> DataFrame:
    """Rows of at most ``most`` cells, one of which has a header's word."""
    g = cells.groupBy(*keys).agg(F.bool_or(header_words(F.coalesce("text", F.lit("")))).alias("said"), F.count(F.lit(1)).alias("n"))
    return g.select(*keys, (F.col("said") & (F.col("n") <= most)).alias("is_header"))


# ------------------------------------------------------------------ rows as arrays of cells


def numeric_cells(row: Column) -> Column:
    """How many cells are numbers, apart from signs, separators and units at the end."""
    return F.size(F.filter(row, lambda c: F.trim(c).rlike(r"^[\d\s.,\-+%]*\d[\d\s.,\-+%]*$")))


def _index_like(row: Column) -> Column:
    return F.replace(F.trim(F.element_at(row, 1)), F.lit("."), F.lit("")).rlike(r"^\d+$")


def structural_header(row: Column) -> Column:
    """Three cells or more, none a label; mostly letters, at most one number, four words a cell at most."""
    text = F.array_join(F.transform(row, F.trim), " ")
    letters, digits = F.regexp_count(text, F.lit(r"\p{L}")), F.regexp_count(text, F.lit(r"\p{Nd}"))
    filled = F.filter(row, lambda c: F.trim(c) != "")
    words = F.aggregate(filled, F.lit(0), lambda a, c: a + F.size(F.split(F.trim(c), r"\s+")))
    labels = F.exists(row, lambda c: F.trim(c).endswith(":"))
    return (F.size(row) >= 3) & ~labels & (letters + digits > 0) & (letters / (letters + digits) > 0.6) & (digits / (letters + digits) < 0.2) & (numeric_cells(row) <= 1) & (words / F.greatest(F.size(filled), F.lit(1)) <= 4.0)


def structural_data(row: Column) -> Column:
    """Three cells or more with a number among them, or a first cell that begins with a digit."""
    return (F.size(row) >= 3) & ((numeric_cells(row) >= 1) | F.trim(F.element_at(row, 1)).rlike(r"^\d"))


def text_only(row: Column) -> Column:
    return numeric_cells(row) == 0


def label_row(row: Column) -> Column:
    """Two cells or more, of which at most the first is a number."""
    n = numeric_cells(row)
    return (F.size(row) >= 2) & ((n == 0) | ((n == 1) & _index_like(row)))


def section_header(text: Column) -> Column:
    """A short phrase on its own: up to 50 characters and 5 words, no digit, slash or colon at the end, not all capitals."""
    t = F.trim(text)
    shout = (t == F.upper(t)) & (F.upper(t) != F.lower(t)) & (F.length(t) > 1)
    return (F.length(t) <= 50) & (t != "") & ~t.endswith(":") & ~t.rlike(r"[\d/]") & ~shout & (F.size(F.split(t, r"\s+")) <= 5)


# ------------------------------------------------------------------ several tables


def stitch_tables(tables: DataFrame, gap: float = 40.0, overlap: float = 0.9, keys: tuple[str, ...] = ("file_path", "page")) -> DataFrame:
    """Tables (columns, x0, x1, y0, y1, ordinal) of a page with the number of the one that they are stitched into.

    In order of y0 a table joins the one before it if that has as many columns, their
    widths overlap by ``overlap`` of the narrower, and its top is less than ``gap`` from the lowest
    edge so far, above or below.  A fold over the tables of one page.
    """
    state = "struct<k:int,columns:bigint,x0:double,x1:double,y1:double,rows:array<struct<ordinal:bigint,k:int>>>"

    def step(s: Column, x: Column) -> Column:
        narrow = F.least(s["x1"] - s["x0"], x["x1"] - x["x0"])
        shared = F.greatest(F.lit(0.0), F.least(s["x1"], x["x1"]) - F.greatest(s["x0"], x["x0"]))
        joins = F.coalesce((s["columns"] == x["columns"]) & (F.try_divide(shared, narrow) >= overlap) & (F.abs(x["y0"] - s["y1"]) < gap), F.lit(False))
        k = F.when(joins, s["k"]).otherwise(s["k"] + 1)
        own = lambda c: F.when(joins, s[c]).otherwise(x[c]).alias(c)
        row = F.array(F.struct(x["ordinal"].cast("long").alias("ordinal"), k.cast("int").alias("k")))
        return F.struct(k.alias("k"), own("columns"), own("x0"), own("x1"), F.when(joins, F.greatest(s["y1"], x["y1"])).otherwise(x["y1"]).alias("y1"), F.concat(s["rows"], row).alias("rows"))

    start = F.struct(F.lit(0).alias("k"), F.lit(None).cast("long").alias("columns"), *[F.lit(None).cast("double").alias(c) for c in ("x0", "x1", "y1")], F.array().cast("array<struct<ordinal:bigint,k:int>>").alias("rows"))
    each = F.array_sort(F.collect_list(F.struct("y0", "ordinal", F.col("columns").cast("long").alias("columns"), "x0", "x1", "y1")))  # tables of one page
    found = tables.groupBy(*keys).agg(F.aggregate(each, start.cast(state), lambda s, x: step(s, x).cast(state)).alias("s"))
    numbers = found.select(*keys, F.explode("s.rows").alias("r")).select(*keys, F.col("r.ordinal").alias("ordinal"), F.col("r.k").alias("stitched"))
    return tables.join(numbers, [*keys, "ordinal"])


def narrative_duplicates(cells: DataFrame, narrative: DataFrame, least: float = 0.7, keys: tuple[str, ...] = ("file_path", "page")) -> DataFrame:
    """Tables whose words are those of their page's narrative: Jaccard similarity of the word sets."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    t = cells.where(F.coalesce("text", F.lit("")) != "").groupBy(*keys, "table").agg(words(F.array_join(F.collect_list("text"), " ")).alias("tw"))  # cells of one table
    n = narrative.where(F.coalesce("text", F.lit("")) != "").groupBy(*keys).agg(words(F.array_join(F.collect_list("text"), " ")).alias("nw"))  # of one page
    shared = F.size(F.array_intersect("tw", "nw"))
    share = F.try_divide(shared.cast("double"), F.size("tw") + F.size("nw") - shared)
    return t.join(n, list(keys)).withColumn("jaccard", share).where(F.col("jaccard") >= least).select(*keys, "table", "jaccard")


def column_of(x0: Column, table_x0: Column, table_x1: Column, columns: Column, index: int = 0, threshold: float = 50.0) -> Column:
    """Whether a left edge is less than ``threshold`` from where the table's column ``index`` begins."""
    return F.abs(x0 - (table_x0 + (table_x1 - table_x0) / F.greatest(columns, F.lit(1)) * index)) < threshold


def split_line_item(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda p: p != "")


def promoted_cells(tables: DataFrame, elements: DataFrame, height: float = 20.0, keys: tuple[str, ...] = ("file_path", "page")) -> DataFrame:
    """Loose lines with a price within a table's height and at its first column, as cells of it: one line for each row of ``height``."""
    t, e = tables.alias("t"), elements.alias("e")
    middle = (F.col("e.y0") + F.col("e.y1")) / 2
    same = [F.col(f"t.{k}") == F.col(f"e.{k}") for k in keys]
    parts = split_line_item(F.col("e.text"))
    fits = column_of(F.col("e.x0"), F.col("t.x0"), F.col("t.x1"), F.col("t.columns")) & F.col("e.text").rlike(r"[\$₹€£]\d+") & ~header_words(F.col("e.text")) & (F.size(parts) >= 2)
    met = t.join(e, [*same, middle.between(F.col("t.y0"), F.col("t.y1"))]).where(fits)
    first = Window.partitionBy(*[F.col(f"t.{k}") for k in keys], F.col("t.table"), row_bucket(F.col("e.y0"), height)).orderBy(F.col("e.ordinal"))
    one = met.select(*[F.col(f"t.{k}") for k in keys], F.col("t.table"), F.col("t.columns"), F.col("e.y0").alias("y0"), parts.alias("parts"), F.row_number().over(first).alias("n")).where("n = 1")
    return one.select(*keys, "table", "y0", "columns", F.posexplode("parts").alias("col", "text")).where("col < columns").drop("columns")


def label_value(elements: DataFrame, label: str, near: float = 30.0, key: str = "file_path") -> DataFrame:
    """For each document the first amount beside the first line that says ``label``: in it, else in the first other line less than ``near`` above or below."""
    says = elements.where(F.lower("text").contains(label.lower())).select(key, F.col("ordinal").alias("at"), F.col("y0").alias("y"), money_of("text").alias("own"))
    other = elements.select(key, "ordinal", "y0", money_of("text").alias("value")).where("value is not null")
    inside = says.where("own is not null").select(key, F.struct(F.col("at"), F.lit(-1).cast("long").alias("o")).alias("place"), F.col("own").alias("value"))
    beside = says.where("own is null").join(other, key).where((F.col("ordinal") != F.col("at")) & (F.abs(F.col("y0") - F.col("y")) < near))
    found = inside.unionByName(beside.select(key, F.struct(F.col("at"), F.col("ordinal").cast("long").alias("o")).alias("place"), "value"))
    return found.groupBy(key).agg(F.min_by("value", "place").alias("value"))


def money_of(text: str) -> Column:
    return F.regexp_extract(text, MONEY, 1).try_cast("double")


def first_match(elements: DataFrame, patterns: tuple[str, ...], key: str = "file_path", group: int = 1) -> DataFrame:
    """For each document the first match over its elements in order, of each element's first pattern that matches."""
    hit = F.coalesce(*[F.nullif(F.regexp_extract(F.lower("text"), p, group), F.lit("")) for p in patterns])
    return elements.withColumn("__m", hit).where("__m is not null").groupBy(key).agg(F.min_by("__m", "ordinal").alias("value"))


INVOICE_NUMBER = (r"invoice\s*#?\s*([A-Za-z0-9\-]+)", r"inv\s*#?\s*([A-Za-z0-9\-]+)", r"invoice\s*number\s*:?\s*([A-Za-z0-9\-]+)")
ADDRESS = ("bill to", "customer", "ship to", "billing address")
COLUMNS = ("description", "unit_price", "quantity", "total")


def first_saying(elements: DataFrame, words: tuple[str, ...] = ADDRESS, key: str = "file_path") -> DataFrame:
    """For each document the whole text of its first element with one of the words."""
    said = F.lit(False)
    for w in words:
        said = said | F.lower("text").contains(w)
    return elements.where(said).groupBy(key).agg(F.min_by("text", "ordinal").alias("value"))


def line_items(cells: DataFrame, keys: tuple[str, ...] = ("file_path", "table")) -> DataFrame:
    """Line items from the cells of tables by column (description, unit_price, quantity, total); header rows and rows without a description go, of items that say the same the first stays."""
    row = [*keys, "row"]
    heads = header_rows(cells, keys=tuple(row)).where("not is_header")
    value = lambda c: F.max(F.when(F.col("col") == c, F.trim(F.coalesce("text", F.lit("")))))
    rows = cells.join(heads.select(*row), row, "left_semi").groupBy(*row).agg(*[value(i).alias(c) for i, c in enumerate(COLUMNS)]).where("coalesce(description, '') <> ''")
    out = rows.select(*row, "description", money(F.col("unit_price")).alias("unit_price"), first_int(F.col("quantity")).alias("quantity"), money(F.col("total")).alias("total"))
    same = Window.partitionBy(keys[0], normalized(F.col("description")), "unit_price", "quantity", "total").orderBy(*keys[1:], "row")
    return out.withColumn("__n", F.row_number().over(same)).where("__n = 1").drop("__n")


ERRORS = ("duplicate_element_ids", "path_missing", "reading_order_mismatch")
FLAGS = tuple(sorted((*ERRORS, "column_inconsistent", "method_invalid", "missing_ref_ranges", "numeric_parse_failures")))


def validation(documents: DataFrame, ids: DataFrame, reading: DataFrame, cells: DataFrame, key: str = "file_path") -> DataFrame:
    """Each document (path, method) with its flags in alphabetical order, n_flags and status (VALID, WARNING, ERROR).

    Duplicate ids, ids of the reading order that nothing has, and an empty path are
    errors; an unknown method, uneven rows, numbers that don't parse and more than two
    rows without a reference range are warnings.  Each table is read once and summed up
    by document; of inputs that are partitioned alike by the key nothing is shuffled.
    """
    t = F.trim(F.coalesce("text", F.lit("")))
    no_range = (F.length(t) < 50) & (t != "") & ~t.rlike(r"[\d.]+\s*[-–]\s*[\d.]+") & ~t.rlike(r"^\d+$")
    failed = t.rlike(r"^[\d\s.,\-+%]+$") & F.regexp_replace(t, "[, ]", "").try_cast("double").isNull()
    row = cells.groupBy(key, "table", "row").agg(F.count(F.lit(1)).alias("n"), F.max_by(no_range, "col").alias("no_range"), F.bool_or(failed).alias("numeric_parse_failures"))
    table = row.groupBy(key, "table").agg((F.min("n") != F.max("n")).alias("column_inconsistent"), (F.count_if("no_range") > 2).alias("missing_ref_ranges"), F.bool_or("numeric_parse_failures").alias("numeric_parse_failures"))
    named = ids.select(key, "element_id", F.lit(1).alias("has"), F.lit(0).alias("read")).unionByName(reading.select(key, "element_id", F.lit(0).alias("has"), F.lit(1).alias("read")))
    name = named.groupBy(key, "element_id").agg(F.sum("has").alias("has"), F.sum("read").alias("read"))
    found = (
        table,
        name.select(key, (F.col("has") > 1).alias("duplicate_element_ids"), ((F.col("read") > 0) & ((F.col("has") == 0) | F.col("element_id").isNull())).alias("reading_order_mismatch")),
        documents.select(key, F.lit(1).alias("__n"), (F.trim(F.coalesce("path", F.lit(""))) == "").alias("path_missing"), (~F.coalesce(F.col("method"), F.lit("")).isin("native", "ocr", "pdfplumber", "pymupdf")).alias("method_invalid")),
    )
    each = None
    for x in found:
        own = x.groupBy(key).agg(*[(F.bool_or(f) if f in x.columns else F.lit(False)).alias(f) for f in FLAGS], (F.sum("__n") if "__n" in x.columns else F.lit(0).cast("long")).alias("__n"))
        each = own if each is None else each.unionByName(own)
    g = each.groupBy(key).agg(*[F.bool_or(f).alias(f) for f in FLAGS], F.sum("__n").alias("__n"))
    on = {f: F.col(key).isNotNull() & F.col(f) for f in FLAGS}
    n_flags = sum((c.cast("long") for c in on.values()), F.lit(0))
    bad = on[ERRORS[0]] | on[ERRORS[1]] | on[ERRORS[2]]
    status = F.when(bad, "ERROR").when(n_flags > 0, "WARNING").otherwise("VALID")
    out = g.where("__n > 0").select(key, F.concat_ws(",", *[F.when(c, f) for f, c in on.items()]).alias("flags"), n_flags.alias("n_flags"), status.alias("status"), "__n")
    return out.withColumn("__n", F.explode(F.array_repeat(F.lit(0), F.col("__n").cast("int")))).drop("__n")  # as many rows as the document has
