"""Tasks whose share doesn't grow with the tables: partitions by rows, whatever spark.sql.shuffle.partitions says."""

import re

import pytest

from compare import rows
from folioworks.operators import tables
from folioworks.plans import shares
from folioworks.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", ["agreement_rate", "page_sampling", "table_confidence", "table_quality_filter", "validation_status"])
def test_partitions_follow_rows(spark, duck, data, name, monkeypatch):
    monkeypatch.setattr(shares, "ROWS", 500)
    out = QUERIES[name](spark, data)
    plan = out._jdf.queryExecution().executedPlan().toString()
    dealt = [int(n) for n in re.findall(r"Exchange hashpartitioning\(.*, (\d+)\), ", plan)]
    assert dealt and min(dealt) >= spark.read.parquet(f"{data}/lineitem.parquet").count() / 500
    assert rows(out.toPandas()) == rows(duck.sql(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", ["decide_default", "decide_preset_cost", "vision_gate"])
def test_ladders_are_compiled(spark, data, name, capsys):
    """The JVM interprets methods of more than 8,000 bytes; agreement_rate decides twice as these do."""
    capsys.readouterr()
    QUERIES[name](spark, data).explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000


def test_validation_reads_its_tables_once(spark, data):
    plan = QUERIES["validation_status"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 4 and "Join" not in plan  # cells, documents, ids and reading


def test_validation_of_odd_rows(spark):
    """A document listed twice, keys and ids that are null, keys that no document has."""
    documents = spark.createDataFrame([(1, "x", "native"), (1, "x", "native"), (2, " ", "ocr"), (3, None, None), (None, " ", "odd"), (5, "x", "ocr")], "file_path long, path string, method string")
    ids = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (4, "z"), (4, "z"), (None, "a"), (None, "a")], "file_path long, element_id string")
    reading = spark.createDataFrame([(1, "a"), (2, None), (3, "q"), (None, "q")], "file_path long, element_id string")
    cells = [(1, 0, 1, 0, "1-2"), (1, 0, 2, 0, "5"), (1, 0, 2, 1, "6"), *[(5, 0, i, c, ("low", None)[c and i == 4]) for i in range(5) for c in (0, 1)], *[(2, i, 1, 0, "high") for i in range(3)], (None, 0, 0, 0, "1-2")]
    out = tables.validation(documents, ids, reading, spark.createDataFrame(cells, 'file_path long, `table` int, row int, col int, text string'))
    assert out.columns == ["file_path", "flags", "n_flags", "status"]
    one = (1, "column_inconsistent,duplicate_element_ids,numeric_parse_failures", 3, "ERROR")
    wanted = [one, one, (2, "path_missing,reading_order_mismatch", 2, "ERROR"), (3, "method_invalid,path_missing,reading_order_mismatch", 3, "ERROR"), (5, "missing_ref_ranges", 1, "WARNING"), (None, "", 0, "VALID")]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(wanted, key=str)
