"""The catalogue's second part: geometry, lines, tables, markdown, joins, evaluation, streams; and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.numeric import exact_avg, r
from ..operators import batch, drivers, extract, geometry, lines, markdown, pages, rules, tables
from ..sinks import outputs
from ..sources import files
from . import oracles as O
from .shares import by_document

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def items(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders as boxes on pages, numbered within their order."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    li = by_document(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file_path"), *order, "l_discount", "l_tax"))
    li = li.withColumn("ordinal", F.row_number().over(Window.partitionBy("file_path").orderBy(*order)))
    x, y = (F.col("l_partkey") % 500).cast("double"), (F.col("l_suppkey") * 7 % 750).cast("double")
    return li.select(
        "file_path", F.col("ordinal").cast("long").alias("ordinal"), (F.col("l_linenumber") % 2 + 1).cast("int").alias("page"), x.alias("x0"), y.alias("y0"), (x + F.col("l_quantity") * 3).alias("x1"), (y + F.col("l_quantity")).alias("y1"),
        "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax",
    )


P = """p AS (SELECT l_orderkey AS file_path, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS ordinal, CAST(l_linenumber % 2 + 1 AS INT) AS page,
 (l_partkey % 500)::DOUBLE AS x0, (l_suppkey * 7 % 750)::DOUBLE AS y0, (l_partkey % 500)::DOUBLE + l_quantity * 3 AS x1, (l_suppkey * 7 % 750)::DOUBLE + l_quantity AS y1, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem)"""
TEXTS = "CASE WHEN l_partkey % 4 = 0 THEN concat('Peach $', l_suppkey % 9, '.50 ', l_partkey % 3) WHEN l_partkey % 4 = 1 THEN 'Unit price total' WHEN l_partkey % 4 = 2 THEN 'Grand Total:' ELSE concat('note ', l_partkey % 7) END"


def texts(df: DataFrame) -> DataFrame:
    k = F.col("l_partkey") % 4
    text = F.when(k == 0, F.concat(F.lit("Peach $"), F.col("l_suppkey") % 9, F.lit(".50 "), F.col("l_partkey") % 3)).when(k == 1, "Unit price total").when(k == 2, "Grand Total:").otherwise(F.concat(F.lit("note "), F.col("l_partkey") % 7))
    return df.withColumn("text", text)


# ------------------------------------------------------------------ tables


STITCH = f"""WITH RECURSIVE {P}, b AS (SELECT file_path, page, ordinal, (l_partkey % 3 * 20)::DOUBLE AS x0, (l_partkey % 3 * 20 + 300)::DOUBLE AS x1, y0, y1, l_partkey % 2 + 3 AS columns FROM p),
t AS (SELECT *, row_number() OVER (PARTITION BY file_path, page ORDER BY y0, ordinal) AS rn FROM b),
s AS (SELECT file_path, page, rn, ordinal, 1 AS k, columns, x0, x1, y1 FROM t WHERE rn = 1 UNION ALL
 SELECT file_path, page, rn, ordinal, CASE WHEN j THEN k ELSE k + 1 END, CASE WHEN j THEN c0 ELSE c1 END, CASE WHEN j THEN a0 ELSE b0 END, CASE WHEN j THEN a1 ELSE b1 END, CASE WHEN j THEN greatest(ya, yb) ELSE yb END
 FROM (SELECT t.file_path, t.page, t.rn, t.ordinal, s.k, s.columns AS c0, t.columns AS c1, s.x0 AS a0, t.x0 AS b0, s.x1 AS a1, t.x1 AS b1, s.y1 AS ya, t.y1 AS yb,
  s.columns = t.columns AND greatest(0.0, least(s.x1, t.x1) - greatest(s.x0, t.x0)) / least(s.x1 - s.x0, t.x1 - t.x0) >= 0.9 AND abs(t.y0 - s.y1) < 40 AS j FROM s JOIN t ON t.file_path = s.file_path AND t.page = s.page AND t.rn = s.rn + 1))
SELECT file_path, page, ordinal, k AS stitched FROM s"""


@query(STITCH)
def table_stitch(spark, d):
    b = items(spark, d)
    b = b.select("file_path", "page", "ordinal", (F.col("l_partkey") % 3 * 20).cast("double").alias("x0"), (F.col("l_partkey") % 3 * 20 + 300).cast("double").alias("x1"), "y0", "y1", (F.col("l_partkey") % 2 + 3).alias("columns"))
    return tables.stitch_tables(b).select("file_path", "page", "ordinal", "stitched")


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Two tables a document, their rows numbered from 1, texts that are headers, numbers or nothing."""
    b = items(spark, d)
    head = F.col("ordinal") <= 2
    values = F.array(F.when(head, "Item description").otherwise(F.concat(F.lit("Part "), F.col("l_partkey") % 3)), F.when(head, "Unit price").otherwise("$5.00"), F.when(head, "Quantity").otherwise(F.col("l_quantity").cast("int").cast("string")), F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.concat(F.lit("$"), (F.col("l_quantity") * 5).cast("int").cast("string"))))
    return b.select("file_path", (F.col("page") - 1).alias("table"), F.col("ordinal").alias("row"), "y0", "page", F.posexplode(values).alias("col", "text"))


C = P + """, cells AS (SELECT file_path, page - 1 AS "table", ordinal AS row, y0, page, CAST(generate_subscripts(xs, 1) - 1 AS INT) AS col, unnest(xs) AS text FROM (SELECT file_path, page, ordinal, y0,
 [CASE WHEN ordinal <= 2 THEN 'Item description' ELSE concat('Part ', l_partkey % 3) END, CASE WHEN ordinal <= 2 THEN 'Unit price' ELSE '$5.00' END, CASE WHEN ordinal <= 2 THEN 'Quantity' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) END, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE concat('$', CAST(l_quantity * 5 AS INT)) END] AS xs FROM p))"""


@query(f'WITH {C} SELECT file_path, "table", count(DISTINCT row) AS n_rows, count(*) AS n_cells, count(*) FILTER (trim(text) <> \'\') AS n_filled FROM cells WHERE page = 1 OR col <> 1 GROUP BY ALL HAVING count(DISTINCT row) >= 2 AND count(*) FILTER (trim(text) <> \'\') / count(*) >= 0.3 AND count(*) <= 10 * count(DISTINCT row)')
def table_quality_filter(spark, d):
    return tables.quality_filter(cells(spark, d).where("page = 1 or col <> 1"))


HEADS = " OR ".join(f"contains(lower(text), '{w}')" for w in tables.HEADER_WORDS)


@query(f"WITH {C} SELECT file_path, row, bool_or({HEADS}) AND count(*) <= 4 AS is_header FROM cells GROUP BY ALL")
def header_rows(spark, d):
    return tables.header_rows(cells(spark, d))


_N = r"regexp_full_match(trim(c), '[\d\s.,\-+%]*\d[\d\s.,\-+%]*')"
ROWS = C + f""", r AS (SELECT file_path, row, list(text ORDER BY col) AS cs FROM cells GROUP BY ALL), m AS (SELECT *, len(list_filter(cs, lambda c: {_N})) AS nums, array_to_string(list_transform(cs, lambda c: trim(c)), ' ') AS t, list_filter(cs, lambda c: trim(c) <> '') AS full_cells FROM r),
n AS (SELECT *, len(regexp_extract_all(t, '\\p{{L}}')) AS letters, len(regexp_extract_all(t, '\\p{{Nd}}')) AS digits, list_sum(list_transform(full_cells, lambda c: len(string_split_regex(trim(c), '\\s+')))) / greatest(len(full_cells), 1) AS words FROM m)"""


@query(f"WITH {ROWS} SELECT file_path, row, CAST(nums AS INT) AS numeric_cells, letters + digits > 0 AND letters / (letters + digits) > 0.6 AND digits / (letters + digits) < 0.2 AND nums <= 1 AND words <= 4 AS header, nums >= 1 OR regexp_matches(trim(cs[1]), '^\\d') AS data, nums = 0 AS text_only, nums = 0 OR (nums = 1 AND regexp_full_match(replace(trim(cs[1]), '.', ''), '\\d+')) AS label_row FROM n")
def row_structure(spark, d):
    rows = cells(spark, d).groupBy("file_path", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda x: x["text"]).alias("cs"))  # cells of one row
    c = F.col("cs")
    return rows.select("file_path", "row", tables.numeric_cells(c).alias("numeric_cells"), tables.structural_header(c).alias("header"), tables.structural_data(c).alias("data"), tables.text_only(c).alias("text_only"), tables.label_row(c).alias("label_row"))


@query(r"SELECT doc_id, count(*) AS n_lines, count(*) FILTER (length(t) <= 50 AND t <> '' AND NOT ends_with(t, ':') AND NOT regexp_matches(t, '[\d/]') AND NOT (t = upper(t) AND upper(t) <> lower(t) AND length(t) > 1) AND len(string_split_regex(t, '\s+')) <= 5) AS n_headers FROM (SELECT doc_id, trim(unnest(string_split(coalesce(text, ''), chr(10)))) AS t FROM documents) GROUP BY 1")
def section_headers(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("t"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(tables.section_header(F.col("t"))).alias("n_headers"))


WORDSET = r"list_distinct(list_filter(string_split_regex(lower({}), '\s+'), lambda w: w <> ''))"


@query(f"""WITH l AS (SELECT doc_id AS file_path, CAST(generate_subscripts(xs, 1) AS INT) AS k, unnest(xs) AS text FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS xs FROM documents)),
t AS (SELECT file_path, {WORDSET.format("string_agg(text, ' ')")} AS a FROM l WHERE text <> '' AND k % 4 <> 0 GROUP BY 1), n AS (SELECT file_path, {WORDSET.format("string_agg(text, ' ')")} AS b FROM l WHERE text <> '' GROUP BY 1)
SELECT file_path, 1 AS page, 0 AS "table", {O.R("j", 6)} AS jaccard FROM (SELECT file_path, len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) AS j FROM t JOIN n USING (file_path)) WHERE j >= 0.7""")
def table_narrative_duplicates(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("file_path"), F.lit(1).alias("page"), F.lit(0).alias("table"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("k", "text"))
    return tables.narrative_duplicates(rows.where("(k + 1) % 4 <> 0"), rows).withColumn("jaccard", r(F.col("jaccard"), 6))


@query(f"""WITH {P}, t AS (SELECT file_path, page, ordinal AS "table", x0, x1 + 400 AS x1, y0, y1 + 200 AS y1, 3 AS columns FROM p WHERE ordinal % 3 = 1), e AS (SELECT *, {TEXTS} AS text FROM p),
m AS (SELECT t.file_path, t.page, t."table", e.y0, string_split_regex(trim(e.text), '\\s+') AS parts, columns, row_number() OVER (PARTITION BY t.file_path, t.page, t."table", round_even(e.y0 / 20, 0) ORDER BY e.ordinal) AS n
 FROM t JOIN e ON t.file_path = e.file_path AND t.page = e.page AND (e.y0 + e.y1) / 2 BETWEEN t.y0 AND t.y1 WHERE abs(e.x0 - t.x0) < 50 AND regexp_matches(e.text, '[\\$₹€£]\\d+') AND NOT ({HEADS}) AND len(string_split_regex(trim(e.text), '\\s+')) >= 2)
SELECT * FROM (SELECT file_path, page, "table", y0, CAST(generate_subscripts(parts, 1) - 1 AS INT) AS col, unnest(parts) AS text, columns FROM m WHERE n = 1) WHERE col < columns""".replace("SELECT * FROM (SELECT file_path", "SELECT file_path, page, \"table\", y0, col, text FROM (SELECT file_path"))
def table_promotion(spark, d):
    b = items(spark, d)
    t = b.where("ordinal % 3 = 1").select("file_path", "page", F.col("ordinal").alias("table"), "x0", (F.col("x1") + 400).alias("x1"), "y0", (F.col("y1") + 200).alias("y1"), F.lit(3).alias("columns"))
    return tables.promoted_cells(t, texts(b).select("file_path", "page", "ordinal", "x0", "x1", "y0", "y1", "text"))


@query(rf"""WITH {P}, e AS (SELECT *, {TEXTS} AS text FROM p), m AS (SELECT *, TRY_CAST(regexp_extract(text, '[\$₹€£]\s*(\d+\.?\d*)', 1) AS DOUBLE) AS v FROM e),
s AS (SELECT a.file_path, a.ordinal AS spot, o.ordinal AS o, o.v FROM m a JOIN m o ON a.file_path = o.file_path AND contains(lower(a.text), 'total') AND a.v IS NULL AND o.v IS NOT NULL AND o.ordinal <> a.ordinal AND abs(o.y0 - a.y0) < 30)
SELECT file_path, arg_min(v, (spot, o)) AS value FROM s GROUP BY 1""")
def label_value(spark, d):
    return tables.label_value(texts(items(spark, d)), "total")


@query(f"WITH {C}, h AS (SELECT *, round_even(y0 / 20, 0)::BIGINT AS b FROM cells WHERE col < 2), k AS (SELECT *, bool_or({HEADS}) OVER w AND count(*) OVER w <= 4 AS head FROM h WINDOW w AS (PARTITION BY file_path, \"table\", b)) SELECT file_path, \"table\", row AS cell_row, col, text, CAST(dense_rank() OVER (PARTITION BY file_path, \"table\" ORDER BY b) - 1 AS INT) AS row FROM k WHERE NOT head")
def table_row_index(spark, d):
    c = cells(spark, d).where("col < 2").withColumnRenamed("row", "cell_row")
    return lines.rows_of_cells(c).select("file_path", "table", "cell_row", "col", "text", "row")


@query(f"WITH {P} SELECT file_path, page, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY file_path, page, round_even(y0 / 20, 0) ORDER BY ordinal) AS n FROM p) WHERE n = 1")
def first_of_each_row(spark, d):
    return lines.first_of_each_row(items(spark, d)).select("file_path", "page", "ordinal")


@query(f"""WITH {C}, g AS (SELECT file_path, "table", row, bool_or({HEADS}) AND count(*) <= 4 AS head, max(trim(text)) FILTER (col = 0) AS a, max(trim(text)) FILTER (col = 1) AS b, max(trim(text)) FILTER (col = 2) AS c, max(trim(text)) FILTER (col = 3) AS e FROM cells GROUP BY ALL),
v AS (SELECT file_path, "table", row, a AS description, TRY_CAST(regexp_extract(b, '[\\$₹€£]?\\s*(\\d+\\.?\\d*)', 1) AS DOUBLE) AS unit_price, TRY_CAST(regexp_extract(c, '(\\d+)', 1) AS INT) AS quantity, TRY_CAST(regexp_extract(e, '[\\$₹€£]?\\s*(\\d+\\.?\\d*)', 1) AS DOUBLE) AS total FROM g WHERE NOT head AND a <> '')
SELECT file_path, "table", row, description, unit_price, quantity, total FROM (SELECT *, row_number() OVER (PARTITION BY file_path, lower(description), unit_price, quantity, total ORDER BY "table", row) AS n FROM v) WHERE n = 1""")
def invoice_line_items(spark, d):
    return tables.line_items(cells(spark, d))


_ELEMENTS = f"e AS (SELECT file_path, ordinal, CASE WHEN l_partkey % 4 = 0 THEN concat('Invoice #A-', l_suppkey % 9) WHEN l_partkey % 4 = 1 THEN 'Ship To: 5 Main St' ELSE 'other' END AS text FROM p)"


def invoice_elements(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_partkey") % 4
    return items(spark, d).select("file_path", "ordinal", F.when(k == 0, F.concat(F.lit("Invoice #A-"), F.col("l_suppkey") % 9)).when(k == 1, "Ship To: 5 Main St").otherwise("other").alias("text"))


@query(f"WITH {P}, {_ELEMENTS}, n AS (SELECT file_path, arg_min(concat('a-', substr(text, 12)), ordinal) AS number FROM e WHERE text LIKE 'Invoice%' GROUP BY 1), s AS (SELECT file_path, arg_min(text, ordinal) AS bill_to FROM e WHERE text LIKE 'Ship%' GROUP BY 1) SELECT file_path, number, bill_to FROM n FULL JOIN s USING (file_path)")
def invoice_heads(spark, d):
    e = invoice_elements(spark, d)
    number = tables.first_match(e, tables.INVOICE_NUMBER).withColumnRenamed("value", "number")
    return number.join(tables.first_saying(e).withColumnRenamed("value", "bill_to"), "file_path", "full")


@query(f"""WITH {C}, b AS (SELECT file_path, file_path % 7 = 0 AS bare, file_path % 5 = 0 AS odd, file_path % 3 = 0 AS twice, file_path % 4 = 0 AS lost FROM (SELECT DISTINCT file_path FROM p)),
x AS (SELECT file_path, "table", row, col, CASE WHEN col = 2 AND file_path % 6 = 0 THEN '1-2' ELSE text END AS text FROM cells WHERE NOT (file_path % 8 = 0 AND row = 2 AND col = 3)),
rw AS (SELECT file_path, "table", row, count(*) AS n, arg_max(trim(text), col) AS last FROM x GROUP BY ALL), u AS (SELECT DISTINCT file_path FROM (SELECT file_path, "table" FROM rw GROUP BY ALL HAVING count(DISTINCT n) > 1)),
nf AS (SELECT DISTINCT file_path FROM x WHERE text = '1-2'), m AS (SELECT DISTINCT file_path FROM (SELECT file_path, "table" FROM rw WHERE length(last) < 50 AND last <> '' AND NOT regexp_matches(last, '[\\d.]+\\s*[-–]\\s*[\\d.]+') AND NOT regexp_full_match(last, '\\d+') GROUP BY ALL HAVING count(*) > 2)),
f AS (SELECT file_path, list_filter([CASE WHEN file_path IN (SELECT file_path FROM u) THEN 'column_inconsistent' END, CASE WHEN twice THEN 'duplicate_element_ids' END, CASE WHEN odd THEN 'method_invalid' END, CASE WHEN file_path IN (SELECT file_path FROM m) THEN 'missing_ref_ranges' END, CASE WHEN file_path IN (SELECT file_path FROM nf) THEN 'numeric_parse_failures' END, CASE WHEN bare THEN 'path_missing' END, CASE WHEN lost THEN 'reading_order_mismatch' END], lambda v: v IS NOT NULL) AS fl, bare OR twice OR lost AS bad FROM b)
SELECT file_path, array_to_string(fl, ',') AS flags, len(fl) AS n_flags, CASE WHEN bad THEN 'ERROR' WHEN len(fl) > 0 THEN 'WARNING' ELSE 'VALID' END AS status FROM f""")
def validation_status(spark, d):
    k = F.col("file_path")
    docs = by_document(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file_path"))).distinct()
    e1, e2, e9 = F.lit("e1"), F.lit("e2"), F.lit("e9")
    ids = docs.select("file_path", F.explode(F.array(e1, F.when(k % 3 == 0, e1).otherwise(e2))).alias("element_id"))
    reading = docs.select("file_path", F.explode(F.when(k % 4 == 0, F.array(e1, e9)).otherwise(F.array(e1))).alias("element_id"))
    docs = docs.select("file_path", F.when(k % 7 == 0, " ").otherwise("x").alias("path"), F.when(k % 5 == 0, "magic").otherwise("native").alias("method"))
    c = cells(spark, d).where(~((k % 8 == 0) & (F.col("row") == 2) & (F.col("col") == 3))).withColumn("text", F.when((F.col("col") == 2) & (k % 6 == 0), "1-2").otherwise(F.col("text")))
    return tables.validation(docs, ids, reading, c)


# ------------------------------------------------------------------ lines and characters


LINES = f"""WITH RECURSIVE {P}, a AS (SELECT file_path, page, ordinal, file_path % 10 = 0 AS turned, CASE WHEN file_path % 10 = 0 THEN x0 ELSE y0 END AS u, CASE WHEN file_path % 10 = 0 THEN y0 ELSE x0 END AS v FROM p),
t AS (SELECT *, row_number() OVER (PARTITION BY file_path, page ORDER BY u, v, ordinal) AS rn FROM a), s AS (SELECT file_path, page, rn, ordinal, 1 AS line, u AS top FROM t WHERE rn = 1 UNION ALL
SELECT t.file_path, t.page, t.rn, t.ordinal, CASE WHEN abs(s.top - t.u) <= 25 THEN s.line ELSE s.line + 1 END, CASE WHEN abs(s.top - t.u) <= 25 THEN s.top ELSE t.u END FROM s JOIN t ON t.file_path = s.file_path AND t.page = s.page AND t.rn = s.rn + 1)
SELECT file_path, page, ordinal, line FROM s"""


@query(LINES)
def line_groups(spark, d):
    """Items are sorted by the edge that lines are told by, so the first line that is near is the last one begun; the SQL relies on it, the operator doesn't."""
    return lines.group_lines(items(spark, d).withColumn("rotated", F.col("file_path") % 10 == 0), 25.0).select("file_path", "page", "ordinal", "line")


def spans(spark: SparkSession, d: str) -> DataFrame:
    b = items(spark, d)
    x = F.col("ordinal") * 10.0 + F.col("l_partkey") % 4
    return b.select("file_path", "page", F.lit(1).alias("block"), (F.col("l_linenumber") % 3).cast("int").alias("line"), "ordinal", x.alias("x0"), (x + 7).alias("x1"), F.when(F.col("l_partkey") % 5 == 0, F.concat(F.lit("$"), F.col("l_suppkey") % 9)).otherwise(F.concat(F.lit("w"), F.col("l_partkey") % 9)).alias("text"))


S = P + ", s AS (SELECT file_path, page, 1 AS block, CAST(l_linenumber % 3 AS INT) AS line, ordinal, ordinal * 10.0::DOUBLE + l_partkey % 4 AS x0, ordinal * 10.0::DOUBLE + l_partkey % 4 + 7 AS x1, CASE WHEN l_partkey % 5 = 0 THEN concat('$', l_suppkey % 9) ELSE concat('w', l_partkey % 9) END AS text FROM p)"


@query(f"WITH {S}, g AS (SELECT *, CASE WHEN x0 - lag(x1) OVER (PARTITION BY file_path, page, block, line ORDER BY ordinal) > 2 THEN concat(' ', text) ELSE text END AS t FROM s) SELECT file_path, page, block, line, string_agg(t, '' ORDER BY ordinal) AS text FROM g GROUP BY ALL")
def span_text(spark, d):
    return lines.span_text(spans(spark, d))


@query(f"WITH {S}, w AS (SELECT *, x1 - 7 + 9.9 AS xe FROM s), g AS (SELECT *, lag(text) OVER v AS bt, lag(x0) OVER v AS b0, lag(xe) OVER v AS b1 FROM w WINDOW v AS (PARTITION BY file_path, page, line ORDER BY x0, ordinal)), h AS (SELECT *, CASE WHEN regexp_matches(bt, '[\\d$₹€£]$') AND regexp_matches(text, '^[A-Za-z]') AND x0 - b1 > 0 AND x0 - b1 < (b1 - b0) / greatest(length(bt), 1) * 0.3 THEN concat(' ', text) ELSE text END AS t FROM g) SELECT file_path, page, line, string_agg(t, '' ORDER BY x0, ordinal) AS text FROM h GROUP BY ALL")
def price_word_spacing(spark, d):
    w = spans(spark, d).withColumns({"x1": F.col("x1") - 7 + 9.9, "word": F.col("ordinal")})
    return lines.spaced_words(w)


@query(f"WITH {P} SELECT file_path, page, ordinal, sum(n) OVER (PARTITION BY file_path, page ORDER BY ordinal) AS block FROM (SELECT *, CASE WHEN abs(y0 - lag(y0) OVER (PARTITION BY file_path, page ORDER BY ordinal)) < 100 THEN 0 ELSE 1 END AS n FROM p)")
def line_blocks(spark, d):
    return lines.blocks_of_lines(items(spark, d), 100.0).select("file_path", "page", "ordinal", "block")


CHARS = P + """, c AS (SELECT file_path, page, 1 AS line, ordinal, ordinal * 6.0::DOUBLE + l_partkey % 3 * 2 AS x0, ordinal * 6.0::DOUBLE + l_partkey % 3 * 2 + 5 AS x1, 100.0::DOUBLE AS y0, 110.0::DOUBLE AS y1, substr('abcdefghij', CAST(l_partkey % 10 + 1 AS INT), 1) AS text, CASE WHEN l_suppkey % 4 = 0 THEN 'Bold' ELSE 'Plain' END AS font, 10.0::DOUBLE AS size FROM p)"""


def chars(spark: SparkSession, d: str) -> DataFrame:
    b = items(spark, d)
    x = F.col("ordinal") * 6.0 + F.col("l_partkey") % 3 * 2
    return b.select("file_path", "page", F.lit(1).alias("line"), "ordinal", x.alias("x0"), (x + 5).alias("x1"), F.lit(100.0).alias("y0"), F.lit(110.0).alias("y1"), F.substring(F.lit("abcdefghij"), (F.col("l_partkey") % 10 + 1).cast("int"), F.lit(1)).alias("text"), F.when(F.col("l_suppkey") % 4 == 0, "Bold").otherwise("Plain").alias("font"), F.lit(10.0).alias("size"))


@query(f"""WITH RECURSIVE {CHARS}, t AS (SELECT *, row_number() OVER (PARTITION BY file_path, page ORDER BY x0, ordinal) AS rn FROM c),
s AS (SELECT file_path, page, rn, 0 AS word, text, x0, x1, font FROM t WHERE rn = 1 UNION ALL SELECT file_path, page, rn, CASE WHEN j THEN word ELSE word + 1 END, CASE WHEN j THEN concat(ta, tb) ELSE tb END, CASE WHEN j THEN a0 ELSE b0 END, b1, fb
 FROM (SELECT t.file_path, t.page, t.rn, s.word, s.text AS ta, t.text AS tb, s.x0 AS a0, t.x0 AS b0, t.x1 AS b1, t.font AS fb, s.font = t.font AND t.x0 - s.x1 < (s.x1 - s.x0) / length(s.text) * 0.35 AS j FROM s JOIN t ON t.file_path = s.file_path AND t.page = s.page AND t.rn = s.rn + 1))
SELECT file_path, page, 1 AS line, word, arg_max(text, rn) AS text, min(x0) AS x0, max(x1) AS x1 FROM s GROUP BY file_path, page, word""")
def merged_characters(spark, d):
    return lines.merge_characters(chars(spark, d)).select("file_path", "page", "line", "word", "text", "x0", "x1")


@query(f"WITH {CHARS} SELECT file_path, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM c GROUP BY ALL")
def character_box(spark, d):
    return geometry.bounding_box(chars(spark, d), "file_path", "page")


# ------------------------------------------------------------------ geometry of pages


def page_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("file_path"), (F.col("turn") + 1).cast("int").alias("page_number"), F.col("text"), F.lit(484704.0).alias("page_area"))


def block_rows(spark: SparkSession, d: str) -> DataFrame:
    """Two blocks for each other page, from the length of its text."""
    p = page_rows(spark, d).where("(file_path + page_number) % 2 = 0").withColumn("n", F.length(F.coalesce("text", F.lit(""))))
    each = p.select("*", F.explode(F.array(F.lit("text"), F.lit("image"))).alias("kind"))
    return each.select("file_path", "page_number", "kind", F.lit(10.0).alias("x0"), F.lit(20.0).alias("y0"), (F.lit(10.0) + F.col("n") % 600).alias("x1"), (F.lit(20.0) + F.when(F.col("kind") == "image", 300).otherwise(100)).alias("y1"), F.col("n").alias("chars"), F.concat(F.lit("F"), F.col("n") % 5).alias("font"))


PR = "pr AS (SELECT conv_id AS file_path, CAST(turn + 1 AS INT) AS page_number, text, length(coalesce(text, '')) AS n, 484704.0::DOUBLE AS page_area FROM conversations)"
AREAS = PR + ", ar AS (SELECT file_path, page_number, page_area, CASE WHEN (file_path + page_number) % 2 = 0 THEN n % 600 * 100.0::DOUBLE ELSE 0.0 END AS text_area, CASE WHEN (file_path + page_number) % 2 = 0 THEN n % 600 * 300.0::DOUBLE ELSE 0.0 END AS image_area, CASE WHEN (file_path + page_number) % 2 = 0 THEN n ELSE 0 END AS chars FROM pr)"


@query(f"WITH {AREAS} SELECT file_path, page_number, page_area, text_area, image_area, chars FROM ar")
def block_areas(spark, d):
    return geometry.areas_of_blocks(page_rows(spark, d).drop("text"), block_rows(spark, d))


@query(f"WITH {AREAS} SELECT file_path, {O.R('sum(image_area::DECIMAL(28,9))::DOUBLE * 100.0::DOUBLE / sum(page_area::DECIMAL(28,9))::DOUBLE', 2)} AS image_coverage FROM ar GROUP BY 1")
def quick_image_coverage(spark, d):
    return geometry.quick_image_coverage(geometry.areas_of_blocks(page_rows(spark, d).drop("text"), block_rows(spark, d)))


@query(f"WITH {PR} SELECT file_path, count(DISTINCT n % 5) AS font_count FROM pr WHERE (file_path + page_number) % 2 = 0 AND page_number <= 5 GROUP BY 1")
def font_count(spark, d):
    return geometry.font_count(block_rows(spark, d))


@query(f"""WITH {PR}, f AS (SELECT DISTINCT file_path FROM pr), l AS (SELECT file_path, (file_path % 40)::DOUBLE AS t, (file_path % 17)::DOUBLE AS i, file_path % 90 AS c FROM f WHERE file_path % 4 <> 0), k AS (SELECT f.file_path, coalesce(t, 0.0) AS text_coverage, coalesce(i, 0.0) AS image_coverage,
 CASE WHEN t IS NULL THEN 'unknown' WHEN t > 10 AND i < 5 THEN 'text_only' WHEN i > 10 AND t < 5 AND c < 50 THEN 'image_only' WHEN t > 5 AND i > 5 THEN 'mixed' WHEN c >= 50 THEN 'text_only' ELSE 'unknown' END AS layout_type FROM f LEFT JOIN l USING (file_path)) SELECT *, layout_type = 'mixed' AS is_mixed_content FROM k""")
def layout_dispatch(spark, d):
    f = page_rows(spark, d).select("file_path").distinct()
    k = F.col("file_path")
    lay = f.where(k % 4 != 0).select("file_path", (k % 40).cast("double").alias("text_coverage"), (k % 17).cast("double").alias("image_coverage"), (k % 90).alias("chars"))
    return geometry.layout_or_unknown(f, lay)


@query("WITH p AS (SELECT conv_id AS file_path, unnest(range(1, max(turn) + 4))::INT AS page_number FROM conversations GROUP BY 1) SELECT p.file_path, p.page_number, coalesce(c.text, '') AS text FROM p LEFT JOIN conversations c ON c.conv_id = p.file_path AND c.turn + 1 = p.page_number AND c.turn % 5 <> 3")
def page_texts(spark, d):
    """Pages beyond the texts, and pages whose text is missing, are empty."""
    rows = page_rows(spark, d)
    p = rows.groupBy("file_path").agg(F.max("page_number").alias("m")).select("file_path", F.explode(F.sequence(F.lit(1), F.col("m") + 2)).alias("page_number"))
    return geometry.page_texts(p, rows.where("(page_number - 1) % 5 <> 3"))


@query(f"WITH {PR} SELECT file_path, page_number, CASE WHEN page_number % 3 = 0 THEN concat('h', file_path) END AS hint FROM pr")
def page_hints(spark, d):
    p = page_rows(spark, d).select("file_path", "page_number")
    hints = p.where("page_number % 3 = 0").withColumn("hint", F.concat(F.lit("h"), "file_path")).unionByName(p.selectExpr("file_path", "page_number + 1000 as page_number", "'lost' as hint"))
    return geometry.with_hints(p, hints)


@query(f"WITH {PR} SELECT file_path, page_number FROM pr WHERE page_number IN (1, 3)")
def page_pruning(spark, d):
    return geometry.only_pages(page_rows(spark, d).select("file_path", "page_number"), [1, 3, 999])


@query("""WITH p AS (SELECT l_orderkey AS file_path, unnest(range(1, 2 + l_orderkey % 12))::INT AS page_number FROM (SELECT DISTINCT l_orderkey FROM lineitem)), c AS (SELECT *, count(*) OVER (PARTITION BY file_path) AS n FROM p), f AS (SELECT *, CASE WHEN page_number = 1 THEN 0 WHEN page_number - 1 = n // 2 THEN 1 WHEN page_number = n THEN 2 END AS fx FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY file_path, fx IS NULL ORDER BY md5(concat(file_path, ':', page_number)), page_number) AS k FROM f), s AS (SELECT file_path, page_number, CAST(CASE WHEN n <= 5 THEN page_number - 1 WHEN fx IS NOT NULL THEN fx WHEN k <= 2 THEN k + 2 END AS INT) AS sample_place FROM r) SELECT * FROM s WHERE sample_place < 4""")
def page_sampling(spark, d):
    docs = by_document(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file_path"))).distinct()
    p = docs.select("file_path", F.explode(F.sequence(F.lit(1), (F.col("file_path") % 12 + 1).cast("int"))).alias("page_number"))
    return geometry.sampled_pages(p, most=4)


@query("SELECT conv_id AS file_path, arg_max(role, turn) AS role FROM conversations GROUP BY 1")
def last_page_wins(spark, d):
    return geometry.last_page_wins(table(spark, d, "conversations").select(F.col("conv_id").alias("file_path"), (F.col("turn") + 1).alias("page_number"), "role"), "role")


@query(f"WITH {P}, k AS (SELECT *, l_partkey % 3 <> 0 AS kept FROM p), g AS (SELECT file_path, page, count(*) FILTER (kept) AS c FROM k GROUP BY ALL), b AS (SELECT file_path, page, coalesce(sum(c) OVER (PARTITION BY file_path ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM g) SELECT k.file_path, k.page, k.ordinal, (base + row_number() OVER (PARTITION BY k.file_path, k.page ORDER BY k.ordinal) - 1)::BIGINT AS number FROM k JOIN b ON k.file_path = b.file_path AND k.page = b.page")
def element_numbers(spark, d):
    e = items(spark, d).withColumn("kept", F.col("l_partkey") % 3 != 0)
    return geometry.numbered(e).select("file_path", "page", "ordinal", "number")


@query(f"WITH {P} SELECT file_path, max(l_quantity) AS max_image_coverage FROM p GROUP BY 1")
def max_image_coverage(spark, d):
    return geometry.max_image_coverage(items(spark, d).withColumn("image_coverage", F.col("l_quantity")))


@query(f"WITH {P}, x AS (SELECT file_path, 1000.0::DOUBLE AS a, l_quantity AS tc, l_quantity / 2 AS ic, l_partkey % 9 AS t, l_suppkey % 4 AS i FROM p) SELECT file_path, {O.R('sum((ic * a)::DECIMAL(28,9))::DOUBLE / sum(a::DECIMAL(28,9))::DOUBLE', 2)} AS image_coverage, {O.AVG('t', 4)} AS mean_text_regions, {O.AVG('i', 4)} AS mean_image_regions FROM x GROUP BY 1")
def vision_image_coverage(spark, d):
    v = items(spark, d).select("file_path", F.lit(1000.0).alias("page_area"), F.col("l_quantity").alias("text_coverage"), (F.col("l_quantity") / 2).alias("image_coverage"), (F.col("l_partkey") % 9).alias("text_regions"), (F.col("l_suppkey") % 4).alias("image_regions"))
    return pages.vision_rollup(v).select("file_path", "image_coverage", "mean_text_regions", "mean_image_regions")


# ------------------------------------------------------------------ joins


@query(f"WITH {P}, f AS (SELECT file_path, ordinal FROM p WHERE y1 > 792 * 0.9) SELECT file_path, ordinal FROM p ANTI JOIN f USING (file_path, ordinal)")
def reading_order_without_footers(spark, d):
    b = items(spark, d).withColumn("page_height", F.lit(792.0))
    return b.join(extract.zones(b).where("in_footer").select("file_path", "ordinal"), ["file_path", "ordinal"], "left_anti").select("file_path", "ordinal")


@query(f"WITH {P} SELECT file_path, ordinal AS element_id, CASE WHEN l_partkey % 3 = 0 THEN 9999 ELSE ordinal END AS place FROM p")
def reading_order_default(spark, d):
    e = items(spark, d).select("file_path", F.col("ordinal").alias("element_id"), "l_partkey")
    return markdown.with_reading_order(e, e.where("l_partkey % 3 <> 0").withColumn("place", F.col("element_id"))).select("file_path", "element_id", "place")


@query("WITH c AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY ALL) SELECT e.event_id, c.value AS last FROM events e ASOF LEFT JOIN c ON e.user_id = c.user_id AND e.ts >= c.ts WHERE e.event_type = 'purchase'")
def as_of_join(spark, d):
    e = table(spark, d, "events")
    clicks = e.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return batch.as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), clicks, "user_id", "ts", "value").select("event_id", "last")


@query("SELECT o_orderpriority AS priority, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + INTERVAL 60 DAY GROUP BY 1")
def interval_join(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    soon = (F.col("l_shipdate") >= F.col("o_orderdate")) & (F.col("l_shipdate") < F.col("o_orderdate") + F.expr("interval 60 days"))
    return o.join(li, (F.col("l_orderkey") == F.col("o_orderkey")) & soon).groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT coalesce(d.k, l.k) AS k, d.n AS documents, l.n AS labels FROM (SELECT doc_id % 50 AS k, count(*) AS n FROM documents WHERE doc_id % 50 < 40 GROUP BY 1) d FULL JOIN (SELECT doc_id % 50 AS k, count(*) AS n FROM labels WHERE doc_id % 50 >= 10 GROUP BY 1) l ON d.k = l.k")
def full_outer_join(spark, d):
    k = (F.col("doc_id") % 50).alias("k")
    a = table(spark, d, "documents").groupBy(k).agg(F.count(F.lit(1)).alias("documents")).where("k < 40")
    b = table(spark, d, "labels").groupBy(k).agg(F.count(F.lit(1)).alias("labels")).where("k >= 10")
    return a.join(b, "k", "full")


@query("""SELECT event_id, ntile(4) OVER w AS quarter, lag(event_type) OVER w AS before, lead(event_type) OVER w AS after, rank() OVER (PARTITION BY user_id ORDER BY event_type) AS type_rank, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS last_hour
FROM (SELECT *, ts FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""".replace("(SELECT *, ts FROM events)", "events").replace("epoch(ts)::BIGINT", "floor(epoch(ts))::BIGINT"))
def window_frames(spark, d):
    e = table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    hour = Window.partitionBy("user_id").orderBy(F.unix_seconds(F.col("ts").cast("timestamp"))).rangeBetween(-3600, 0)
    return e.select("event_id", F.ntile(4).over(w).alias("quarter"), F.lag("event_type").over(w).alias("before"), F.lead("event_type").over(w).alias("after"), F.rank().over(Window.partitionBy("user_id").orderBy("event_type")).alias("type_rank"), F.count(F.lit(1)).over(hour).alias("last_hour"))


# ------------------------------------------------------------------ batches and evaluation


def paged_results(spark: SparkSession, d: str) -> DataFrame:
    from .queries import event_results

    e = event_results(spark, d)
    n = F.length("event_type") % 5
    return e.withColumns({"page_count": n, "pages_needing_ocr": F.floor(n / 2).cast("int"), "pages_with_text": n - F.floor(n / 2).cast("int"), "category": F.when(F.col("needs_ocr"), "unstructured").otherwise("structured")})


PAGED = O.RESULTS + ", g AS (SELECT *, length(event_type) % 5 AS pc, (length(event_type) % 5) // 2 AS pn, CASE WHEN needs_ocr THEN 'unstructured' ELSE 'structured' END AS category FROM r)"


@query(f"WITH {PAGED} SELECT count(*) FILTER (error IS NULL) AS processed, sum(pc) FILTER (error IS NULL)::BIGINT AS total_pages, sum(pn) FILTER (error IS NULL)::BIGINT AS pages_needing_ocr, sum(pc - pn) FILTER (error IS NULL)::BIGINT AS pages_with_text, count(*) FILTER (error IS NULL AND pc > 0) AS files_with_pages FROM g")
def batch_pages(spark, d):
    return batch.batch_stats(paged_results(spark, d)).select("processed", "total_pages", "pages_needing_ocr", "pages_with_text", "files_with_pages")


@query(f"WITH {PAGED} SELECT coalesce(file_type, 'unknown') AS file_type, category, count(*) AS total, count(*) FILTER (needs_ocr) AS needs_ocr, sum(pc)::BIGINT AS total_pages, sum(pn)::BIGINT AS pages_needing_ocr FROM g WHERE error IS NULL GROUP BY ALL")
def batch_by_type_and_category(spark, d):
    return batch.by_type(paged_results(spark, d), "category")


@query(f"WITH {PAGED} SELECT pc AS pages, count(*) AS n, {O.AVG('value', 4)} AS mean FROM g GROUP BY 1")
def latency_by_pages(spark, d):
    return batch.latency_by(paged_results(spark, d), F.col("page_count"), name="pages")


@query("SELECT file_path, coalesce(max(score), 0.5) AS score FROM (SELECT conv_id AS file_path, CASE WHEN conv_id % 4 <> 0 THEN (turn * 7 % 10) / 10.0::DOUBLE END AS score FROM conversations) GROUP BY 1")
def document_scores(spark, d):
    c = table(spark, d, "conversations")
    return batch.document_scores(c.select(F.col("conv_id").alias("file_path"), F.when(F.col("conv_id") % 4 != 0, (F.col("turn") * 7 % 10) / 10.0).alias("score")))


@query(f"WITH x AS (SELECT event_id, event_id % 3 = 0 AS a, event_id % 6 = 0 AS b, value AS sa, value * 2 AS sb FROM events WHERE event_id % 5 <> 0) SELECT count(*) AS n, count(*) FILTER (a = b) AS agree, {O.AVG('CASE WHEN a = b THEN 1.0 ELSE 0.0 END', 4)} AS agreement, round(sum(sa::DECIMAL(28,9)), 4)::DOUBLE AS total_a, round(sum(sb::DECIMAL(28,9)), 4)::DOUBLE AS total_b, {O.AVG('sa', 4)} AS average_a, {O.AVG('sb', 4)} AS average_b FROM x")
def agreement_times(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("file_path"), "value")
    a = e.select("file_path", (F.col("file_path") % 3 == 0).alias("needs_ocr"), F.col("value").alias("seconds"))
    b = e.where("file_path % 5 <> 0").select("file_path", (F.col("file_path") % 6 == 0).alias("needs_ocr"), (F.col("value") * 2).alias("seconds"))
    return batch.agreement(a, b)


@query(f"WITH {O.RESULTS} SELECT count(*) FILTER (error IS NULL) AS ok, count(*) FILTER (error IS NOT NULL) AS failed, round(sum(CASE WHEN error IS NULL THEN value END::DECIMAL(28,9)), 4)::DOUBLE AS total, {O.AVG('CASE WHEN error IS NULL THEN value END', 4)} AS average FROM r")
def preprocess_stats(spark, d):
    from .queries import event_results

    return batch.preprocess_stats(event_results(spark, d).select("error", F.col("value").alias("seconds")))


@query(f"WITH {P}, c AS (SELECT file_path, l_discount * 10 AS confidence FROM p UNION ALL SELECT file_path, 0.75::DOUBLE FROM p WHERE ordinal % 2 = 0) SELECT file_path, {O.AVG('confidence', 2)} AS confidence FROM c GROUP BY 1")
def extraction_confidence(spark, d):
    b = items(spark, d)
    return batch.extraction_confidence(b.select("file_path", (F.col("l_discount") * 10).alias("confidence")), b.where("ordinal % 2 = 0").select("file_path", F.lit(0.75).alias("confidence")))


@query("SELECT conv_id AS file_path, md5(string_agg(text, ' ' ORDER BY turn)) AS digest FROM conversations WHERE text IS NOT NULL GROUP BY 1")
def whole_text(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("file_path"), F.col("turn").alias("ordinal"), "text")
    return drivers.whole_text(c).select("file_path", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"WITH {O.RESULTS} SELECT coalesce(file_type, 'unknown') AS file_type, count(DISTINCT user_id) AS n, true AS near FROM r GROUP BY 1")
def distinct_sketches(spark, d):
    """Numbers of different users by type, and whether both sketches come within a tenth of them."""
    from .queries import event_results

    e = event_results(spark, d).withColumn("file_type", F.coalesce("file_type", F.lit("unknown")))
    exact = e.groupBy("file_type").agg(F.count_distinct("user_id").alias("n"))
    both = exact.join(batch.sketched(e, "file_type", value="user_id"), "file_type")
    return both.select("file_type", "n", ((F.abs(F.col("approx") - F.col("n")) <= F.col("n") * 0.1 + 1) & (F.abs(F.col("sketched") - F.col("n")) <= F.col("n") * 0.1 + 1)).alias("near"))


@query("SELECT event_type, count(*) FILTER (event_id % 3 = 0) AS yes, count(*) FILTER (event_id % 3 <> 0) AS no FROM events GROUP BY 1")
def crosstab(spark, d):
    e = table(spark, d, "events").select("event_type", F.when(F.col("event_id") % 3 == 0, "yes").otherwise("no").alias("verdict"))
    return batch.crosstab(e, "event_type", "verdict", ["yes", "no"]).fillna(0)


@query(f"WITH {O.RESULTS} SELECT count(*) AS total, count(*) FILTER (error IS NOT NULL) AS errors, count(*) FILTER (error IS NULL AND needs_ocr) AS needs_ocr, count(*) FILTER (error IS NULL AND NOT needs_ocr) AS no_ocr FROM r")
def telemetry_totals(spark, d):
    """Totals observed while the rows go by on their way elsewhere, without a pass of their own."""
    from .queries import event_results

    rows, seen = outputs.observed(event_results(spark, d))
    rows.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([tuple(seen.get[k] for k in ("total", "errors", "needs_ocr", "no_ocr"))], "total long, errors long, needs_ocr long, no_ocr long")


@query(f"WITH {O.RESULTS} SELECT file_path, error FROM r WHERE error IS NOT NULL ORDER BY file_path LIMIT 10")
def first_errors(spark, d):
    from .queries import event_results

    return outputs.first_errors(event_results(spark, d))


@query(f"WITH {O.RESULTS} SELECT file_path, file_type, needs_ocr, confidence FROM r ORDER BY file_path LIMIT 50")
def first_rows(spark, d):
    from .queries import event_results

    return outputs.first_rows(event_results(spark, d))


@query(f"""WITH {O.RESULTS} SELECT file_path, to_json({{'file_path': file_path, 'needs_ocr': needs_ocr, 'reason_code': reason_code}})::VARCHAR AS json FROM r""")
def result_json(spark, d):
    from .queries import event_results

    e = event_results(spark, d).select("file_path", "needs_ocr", "reason_code", F.struct("value").alias("signals"))
    return outputs.result_json(e)


@query(f"WITH {O.RESULTS} SELECT file_path, needs_ocr, file_type, CASE WHEN needs_ocr THEN 'unstructured' ELSE 'structured' END AS category, confidence, reason_code FROM r")
def batch_rows(spark, d):
    return outputs.batch_rows(paged_results(spark, d))


@query("SELECT concat(doc_id, '.txt') AS file, NULL::BOOLEAN AS needs_ocr, '' AS notes FROM documents")
def truth_template(spark, d):
    return batch.truth_template(table(spark, d, "documents").select(F.concat("doc_id", F.lit(".txt")).alias("file_path")))


@query("SELECT doc_id AS file_path, doc_id % 6 = 0 OR trim(coalesce(text, '')) = '' AS needs_ocr FROM documents WHERE doc_id % 2 = 0")
def auto_labels(spark, d):
    docs = table(spark, d, "documents")
    return batch.auto_labels(docs.select(F.col("doc_id").alias("file_path"), F.when(F.col("doc_id") % 2 == 0, "application/pdf").otherwise("text/plain").alias("mime"), F.when(F.col("doc_id") % 6 == 0, " ").otherwise(F.col("text")).alias("text")))


@query("""WITH l AS (SELECT doc_id AS ordinal, concat('d', doc_id % 3, '/', doc_id // 2, '.pdf') AS file, quality = 0 AS y FROM labels), f AS (SELECT file AS name, arg_max(y, ordinal) AS needs_ocr FROM l GROUP BY 1), b AS (SELECT string_split(file, '/')[2] AS name, arg_min(y, ordinal) AS needs_ocr FROM l GROUP BY 1)
SELECT * FROM f UNION ALL SELECT * FROM b WHERE name NOT IN (SELECT name FROM f)""")
def truth_names(spark, d):
    k = F.col("doc_id")
    return files.truth_names(table(spark, d, "labels").select(k.alias("ordinal"), F.concat(F.lit("d"), k % 3, F.lit("/"), F.floor(k / 2).cast("string"), F.lit(".pdf")).alias("file"), (F.col("quality") == 0).alias("needs_ocr")))


@query("SELECT DISTINCT concat(lang, '/', source) AS path FROM documents ORDER BY path LIMIT 7")
def files_sorted_and_limited(spark, d):
    return table(spark, d, "documents").select(F.concat("lang", F.lit("/"), "source").alias("path")).distinct().orderBy("path").limit(7)


# ------------------------------------------------------------------ planning


@query(O.planned(0.6, 0.3, 0.6, True) + """, su AS (SELECT file_path, count(*) FILTER (needs_ocr) AS k, count(*) AS n, count(*) FILTER (decision_type = 'terminal_override') AS o FROM pl GROUP BY 1) SELECT file_path, concat('OCR required on ', k, ' of ', n, ' pages (', o, ' overrides, ', n - o, ' scored).') AS summary_reason FROM su""")
def planner_summaries(spark, d):
    from .queries import conversation_pages

    decided = pages.planner_pages(conversation_pages(spark, d))
    rolled = pages.planner_rollup(decided).join(drivers.overrides(decided), "file_path")
    return drivers.summaries(rolled).select("file_path", "summary_reason")


@query(f"""WITH x AS (SELECT o_orderkey AS file_path, (o_orderkey % 100) / 100.0::DOUBLE AS confidence, o_orderkey % 2 = 0 AS needs_ocr, o_orderkey % 4 AS pc, CASE WHEN o_orderkey % 100 >= 85 THEN 'confidence_exit' WHEN o_orderkey % 4 = 0 THEN 'fallback' WHEN o_orderkey % 3 = 0 THEN 'fast_path' END AS exit FROM orders)
SELECT file_path, exit, CASE exit WHEN 'fallback' THEN true WHEN 'fast_path' THEN false ELSE needs_ocr END AS needs_ocr_any, CASE WHEN exit = 'fallback' THEN 0.5 ELSE {O.R('confidence', 2)} END AS overall_confidence,
 CASE WHEN CASE exit WHEN 'fallback' THEN true WHEN 'fast_path' THEN false ELSE needs_ocr END THEN array_to_string(range(0, greatest(pc, 1)), ',') ELSE '' END AS pages FROM x WHERE exit IS NOT NULL""")
def planner_early_exits(spark, d):
    k = F.col("o_orderkey")
    docs = table(spark, d, "orders").select(k.alias("file_path"), ((k % 100) / 100.0).alias("confidence"), (k % 2 == 0).alias("needs_ocr"), (k % 4).cast("int").alias("page_count"), F.when(k % 3 == 0, 0.0).otherwise(50.0).alias("max_image_coverage"))
    out = drivers.exits(pages.planner_exit(docs).where("exit <> 'full'"))
    return out.select("file_path", "exit", "needs_ocr_any", "overall_confidence", F.array_join(F.transform("pages_needing_ocr", lambda x: x.cast("string")), ",").alias("pages"))


@query(O.planned(0.6, 0.3, 0.6, True).replace("length(coalesce(text, '')) AS n", "length(text) AS n") + f"""
, doc AS (SELECT file_path, (file_path % 100) / 100.0::DOUBLE AS confidence, file_path % 2 = 0 AS nd, count(*) AS pc, max(ic) AS mi FROM p GROUP BY 1), ex AS (SELECT *, CASE WHEN confidence >= 0.85 THEN 'confidence_exit' WHEN mi < 10 THEN 'fast_path' ELSE 'full' END AS exit FROM doc), fu AS (SELECT file_path, bool_or(needs_ocr) AS need, count(*) FILTER (needs_ocr) AS k FROM pl GROUP BY 1)
SELECT ex.file_path, CASE exit WHEN 'full' THEN need WHEN 'fast_path' THEN false ELSE nd END AS needs_ocr, CASE WHEN CASE exit WHEN 'full' THEN need WHEN 'fast_path' THEN false ELSE nd END THEN 'PLANNER_OCR' ELSE 'PLANNER_DIGITAL' END AS reason_code, CASE exit WHEN 'full' THEN k WHEN 'fast_path' THEN 0 ELSE CASE WHEN nd THEN pc ELSE 0 END END AS pages_needing_ocr FROM ex JOIN fu USING (file_path)""")
def planner_driver(spark, d):
    """Documents through the planner's exits, page by page where none applies."""
    from .queries import conversation_pages

    p = conversation_pages(spark, d)
    k = F.col("file_path")
    docs = p.groupBy("file_path").agg(F.count(F.lit(1)).alias("page_count")).select("file_path", ((k % 100) / 100.0).alias("confidence"), (k % 2 == 0).alias("needs_ocr"), "page_count")
    planned = drivers.plan(docs, p.drop("text", "text_length"), p.select("file_path", "page_number", "text"))
    return drivers.plan_rows(planned).select("file_path", "needs_ocr", "reason_code", F.col("pages_needing_ocr").cast("long").alias("pages_needing_ocr"))


# ------------------------------------------------------------------ markdown


@query(f"""WITH {C}, g AS (SELECT file_path, "table", row, [max(coalesce(text, '')) FILTER (col = 0), max(text) FILTER (col = 1), max(text) FILTER (col = 2), max(text) FILTER (col = 3)] AS xs FROM cells WHERE NOT (file_path % 3 = 0 AND col > 1) GROUP BY ALL), w AS (SELECT *, max(CASE WHEN coalesce(trim(xs[4]), '') <> '' THEN 4 WHEN coalesce(trim(xs[3]), '') <> '' THEN 3 WHEN coalesce(trim(xs[2]), '') <> '' THEN 2 ELSE 1 END) OVER (PARTITION BY file_path, "table") AS wide, row_number() OVER (PARTITION BY file_path, "table" ORDER BY row) AS k FROM g),
l AS (SELECT *, concat('| ', array_to_string(list_transform(xs[1:wide], lambda c: coalesce(c, '')), ' | '), ' |') AS line, concat('| ', array_to_string(list_transform(xs[1:wide], lambda c: '---'), ' | '), ' |') AS rule FROM w)
SELECT file_path, "table", string_agg(CASE WHEN k = 1 THEN concat(line, chr(10), rule) ELSE line END, chr(10) ORDER BY row) AS markdown FROM l GROUP BY ALL""")
def markdown_grid(spark, d):
    return markdown.table_grid(cells(spark, d).where("not (file_path % 3 = 0 and col > 1)"), ("file_path", "table"))


def md_elements(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_partkey") % 4
    return items(spark, d).select("file_path", "page", "ordinal", F.col("ordinal").alias("place"), "y0", F.when(k == 0, "Title").when(k == 1, "Heading").when(k == 2, "ListItem").otherwise("NarrativeText").alias("type"), F.concat(F.lit("text "), F.col("l_partkey") % 7).alias("text"), "l_partkey")


MD = P + ", e AS (SELECT file_path, page, ordinal, y0, concat(CASE l_partkey % 4 WHEN 0 THEN '# ' WHEN 1 THEN '## ' WHEN 2 THEN '- ' ELSE '' END, 'text ', l_partkey % 7) AS t, l_partkey FROM p)"
CONTENT = MD + """, a AS (SELECT file_path, page, 2 AS rk, ordinal::DOUBLE AS spot, ordinal, t FROM e UNION ALL SELECT file_path, page, 1, y0, ordinal, concat('T', ordinal) FROM e WHERE l_partkey % 5 = 0 AND l_partkey % 3 <> 0 UNION ALL SELECT file_path, page, 0, ordinal, ordinal, concat('**f', ordinal, ':** ', CASE WHEN l_partkey % 22 = 0 THEN '' ELSE 'v' END) FROM e WHERE l_partkey % 11 = 0),
c AS (SELECT file_path, page, string_agg(t, chr(10) || chr(10) ORDER BY rk, spot, ordinal) AS markdown FROM a GROUP BY ALL)"""


def contents(spark: SparkSession, d: str) -> DataFrame:
    e = md_elements(spark, d)
    t = e.where("l_partkey % 5 = 0").select("file_path", "page", "ordinal", "y0", (F.col("l_partkey") % 3 == 0).alias("decorative"), F.concat(F.lit("T"), "ordinal").alias("markdown"))
    f = e.where("l_partkey % 11 = 0").select("file_path", "page", "ordinal", F.concat(F.lit("f"), "ordinal").alias("name"), F.when(F.col("l_partkey") % 22 != 0, "v").alias("value"))
    return markdown.page_content(e, t, f)


@query(f"WITH {CONTENT} SELECT file_path, page, markdown FROM c")
def page_content(spark, d):
    return contents(spark, d)


@query(f"WITH {CONTENT} SELECT file_path, string_agg(markdown, chr(10) || chr(10) ORDER BY page) AS markdown, string_agg(concat(page, '=', length(markdown)), ',' ORDER BY page) AS by_page FROM c GROUP BY 1")
def document_markdown(spark, d):
    out = markdown.document_markdown(contents(spark, d))
    by = F.array_join(F.transform(F.array_sort(F.map_entries("by_page")), lambda x: F.concat(x["key"].cast("string"), F.lit("="), F.length(x["value"]).cast("string"))), ",")
    return out.select("file_path", "markdown", by.alias("by_page"))


@query(f"""WITH {CONTENT}, x AS (SELECT file_path, string_agg(concat('### Page ', page, chr(10), chr(10), markdown), chr(10) || chr(10) ORDER BY page) AS body FROM c GROUP BY 1), t AS (SELECT file_path, string_agg(concat('### Table ', ordinal, ' (Page ', page, ')', chr(10), '**Confidence:** 90.00%', chr(10), '**Dimensions:** 2 rows × 3 columns', chr(10), chr(10), '| x |'), chr(10) ORDER BY page, ordinal) AS body FROM e WHERE l_partkey % 5 = 0 GROUP BY 1),
f AS (SELECT DISTINCT file_path FROM e) SELECT f.file_path, concat('# Document: ', f.file_path, chr(10), chr(10), '**File Type:** pdf', chr(10), '**Extraction Method:** native', CASE WHEN f.file_path % 2 = 0 THEN chr(10) || '**Document Type:** invoice' ELSE '' END, chr(10), '**Overall Confidence:** ', f.file_path % 9 + 10, '.00%',
 coalesce(chr(10) || chr(10) || '## Tables' || chr(10) || t.body, ''), coalesce(chr(10) || chr(10) || '## Content' || chr(10) || chr(10) || x.body, ''), CASE WHEN f.file_path % 5 = 0 THEN concat(chr(10), chr(10), '## Errors', chr(10), '- broken') ELSE '' END) AS markdown FROM f LEFT JOIN t USING (file_path) LEFT JOIN x USING (file_path)""")
def full_markdown(spark, d):
    e = md_elements(spark, d)
    k = F.col("file_path")
    docs = e.select("file_path").distinct().select("file_path", F.lit("pdf").alias("file_type"), F.lit("native").alias("method"), F.when(k % 2 == 0, "invoice").alias("document_type"), ((k % 9 + 10) / 100.0).alias("confidence"))
    t = e.where("l_partkey % 5 = 0").select("file_path", F.col("ordinal").alias("table"), "page", F.lit(0.9).alias("confidence"), F.lit(2).alias("n_rows"), F.lit(3).alias("n_columns"), F.lit("| x |").alias("markdown"))
    errors = docs.where("file_path % 5 = 0").select("file_path", F.lit(0).alias("ordinal"), F.lit("broken").alias("error"))
    return markdown.full_markdown(docs, t, contents(spark, d), errors)


@query()
def structured_markdown(spark, d):
    """Pages of documents, a line an element, as structured markdown."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("file_path"), F.lit(1).alias("page"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("ordinal", "text"), F.lit("NarrativeText").alias("type"))
    return markdown.structured_markdown(rows)


# ------------------------------------------------------------------ scalars


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(ts, '%d/%m/%Y %H:%M') AS shown FROM events")
def date_formats(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.date_format("ts", "dd/MM/yyyy HH:mm").alias("shown"))


_TURNED = "CASE WHEN doc_id % 3 = 0 THEN 'eciovni latot' WHEN doc_id % 3 = 1 THEN 'invoice total' ELSE lang END"
_BACK = " OR ".join(f"regexp_matches(lower(reverse(t)), '\\b{w}\\b') AND NOT regexp_matches(lower(t), '\\b{w}\\b')" for w in T.TURNED_WORDS)


@query(f"SELECT doc_id, CASE WHEN {_BACK} THEN reverse(t) ELSE t END AS text FROM (SELECT doc_id, {_TURNED} AS t FROM documents)")
def text_repair(spark, d):
    k = F.col("doc_id") % 3
    t = F.when(k == 0, "eciovni latot").when(k == 1, "invoice total").otherwise(F.col("lang"))
    return table(spark, d, "documents").select("doc_id", T.turned_back(t).alias("text"))


@query(f"WITH {ROWS}, x AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY row) AS k FROM n) SELECT file_path, row, {O.R('words', 4)} AS words_a_cell, nums > 0 AS has_number FROM x")
def row_heuristics(spark, d):
    rows = cells(spark, d).groupBy("file_path", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda x: x["text"]).alias("cs"))  # cells of one row
    filled = F.filter("cs", lambda c: F.trim(c) != "")
    words = F.aggregate(filled, F.lit(0), lambda a, c: a + F.size(F.split(F.trim(c), r"\s+")))
    return rows.select("file_path", "row", r(words / F.greatest(F.size(filled), F.lit(1)), 4).alias("words_a_cell"), (tables.numeric_cells(F.col("cs")) > 0).alias("has_number"))


# ------------------------------------------------------------------ what the first part's stream and pixel queries come to


ORACLE_SQL["stream_triage"] = "SELECT event_type AS file_type, count(*) AS total, count(*) FILTER (event_id % 3 = 0) AS needs_ocr FROM events GROUP BY 1"
ORACLE_SQL["stream_watermark"] = "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL HAVING date_trunc('day', min(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"
ORACLE_SQL["stream_dedupe"] = "SELECT DISTINCT user_id AS file_path FROM events"
ORACLE_SQL["ground_truth_match"] = """WITH l AS (SELECT doc_id, quality = 0 AS y, CASE WHEN doc_id % 3 < 2 AND doc_id % 5 < 2 THEN doc_id % 5 = 0 END AS contrary FROM labels)
SELECT d.doc_id, CASE WHEN doc_id % 3 = 2 THEN y ELSE CASE WHEN y OR contrary THEN true ELSE coalesce(contrary, CASE WHEN doc_id % 3 = 1 THEN y END) END END AS needs_ocr FROM documents d LEFT JOIN l USING (doc_id)"""
ORACLE_SQL["word_set_ops"] = f"WITH x AS (SELECT d.doc_id, {O.WORDS.format('d.text')} AS a, {O.WORDS.format('b.text')} AS b FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 40) SELECT doc_id, len(a) + len(b) > 0 AS some, CAST(len(list_intersect(a, b)) AS INT) AS both, CAST(len(a) + len(b) - len(list_intersect(a, b)) AS INT) AS either, CAST(len(a) - len(list_intersect(a, b)) AS INT) AS only_first FROM x"
ORACLE_SQL["otsu_binarize"] = """WITH px AS (SELECT vec_id, CAST(trunc(greatest(0.0::DOUBLE, least(255.0::DOUBLE, (x::DOUBLE + 4) * 32))) AS INT) AS v FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings)),
c AS (SELECT vec_id, v, count(*)::DOUBLE AS c FROM px GROUP BY ALL), k AS (SELECT vec_id, v, sum(c) OVER w AS w, sum(c * v) OVER w AS m, sum(c) OVER a AS wt, sum(c * v) OVER a AS mt FROM c WINDOW w AS (PARTITION BY vec_id ORDER BY v), a AS (PARTITION BY vec_id)),
b AS (SELECT *, CASE WHEN w < wt THEN (mt * w - m * wt) * (mt * w - m * wt) / (w * (wt - w)) ELSE 0.0 END AS between_class FROM k), t AS (SELECT vec_id, CASE WHEN max(between_class) > 0 THEN min(v) FILTER (between_class = mx) ELSE 0 END AS threshold FROM (SELECT *, max(between_class) OVER (PARTITION BY vec_id) AS mx FROM b) GROUP BY 1),
s AS (SELECT px.vec_id, threshold, avg(CASE WHEN v > threshold THEN 255.0 ELSE 0.0 END) AS mean, avg(CASE WHEN v > threshold THEN 1.0::DOUBLE ELSE 0.0 END) AS white, bool_and(v IN (0, 255)) AS flat, avg(CASE WHEN v = 255 THEN 1.0::DOUBLE ELSE 0.0 END) AS own FROM px JOIN t ON t.vec_id = px.vec_id GROUP BY ALL)
SELECT vec_id, threshold, CASE WHEN flat THEN own WHEN mean < 127 THEN 1 - white ELSE white END AS white FROM s"""
