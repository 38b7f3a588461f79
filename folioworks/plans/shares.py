"""Tables dealt out by document, so that no task's share grows with the table."""

from __future__ import annotations

from pyspark.sql import DataFrame

ROWS = 1 << 18


def by_document(rows: DataFrame, key: str = "file_path", most: int | None = None) -> DataFrame:
    """``rows`` with those of a document in one partition, about ``most`` (ROWS) rows in each.

    Grouping and windows by the key, alone or with other columns, then need no shuffle.
    The number of partitions follows the rows, not spark.sql.shuffle.partitions; for a
    selection of a parquet table they are counted from its footers.
    """
    n = -(-rows.count() // (most or ROWS))
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, n), key)
