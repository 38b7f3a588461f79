"""Shared plumbing: the shared folder, tables written there, streaming of whole groups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[str] = []
_paths: dict[int, tuple[DataFrame, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; set here only where it is unset."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='folioworks-')}"  # one machine, as in tests
    spark.conf.set("spark.checkpoint.dir", own)
    spark.sparkContext.setCheckpointDir(own)
    return own


def shared_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there, so lost executors cost nothing before it."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (out, path)
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table that ``written`` made, once nothing that is still to run reads it."""
    _, path = _paths.pop(id(df), (None, None))
    if path:
        delete(df.sparkSession, path)
        _written.remove(path)


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it knows it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    fs, at = filesystem(spark, path)
    fs.delete(at, True)


def release(spark: SparkSession) -> None:
    """Deletes the tables that ``written`` made; results that still read them are lost."""
    _paths.clear()
    while _written:
        delete(spark, _written.pop())


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: str = "text") -> Column:
    return F.coalesce(F.octet_length(column), F.lit(0))


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str], most: int, size: str | None = None) -> Iterator[pa.Table]:
    """Tables of whole groups of equal ``keys`` (none of them null) from batches sorted by them.

    A table ends after the group that takes it to ``most`` rows (or to that sum of
    ``size``); so at most one group and ``most`` rows are held at a time.
    """
    held: list[pa.RecordBatch] = []
    count = 0

    def changes(b: pa.Table) -> np.ndarray:
        out = np.zeros(max(0, b.num_rows - 1), bool)
        for k in keys:
            x = b.column(k).to_numpy()
            out |= x[1:] != x[:-1]
        return np.flatnonzero(out) + 1

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += int(np.sum(batch.column(batch.schema.get_field_index(size)).to_numpy())) if size else batch.num_rows
        if count >= most:
            table = pa.Table.from_batches(held).combine_chunks()
            cuts = changes(table)
            if len(cuts):
                weights = table.column(size).to_numpy() if size else np.ones(table.num_rows, np.int64)
                total, a = np.cumsum(weights), 0
                for c in cuts:
                    if total[c - 1] - (total[a - 1] if a else 0) >= most:
                        yield table.slice(a, c - a)
                        a = c
                last = int(cuts[-1])
                if last > a:
                    yield table.slice(a, last - a)
                rest = table.slice(last).combine_chunks()
                held = rest.to_batches()
                count = int(weights[last:].sum())
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def annotate(df: DataFrame, results: str, compute, column: str = "text", most: int = 4 << 20) -> DataFrame:
    """``df`` with more columns, named and typed by the DDL ``results``, from ``compute(block) -> arrays``.

    Every other column passes through; a column of ``df`` that bears a result's
    name is replaced by it.  One Arrow pass, no shuffle.
    """
    from pyspark.sql.types import StructType

    from . import _text

    new = StructType.fromDDL(results)
    kept = [c for c in df.columns if c not in new.names]
    schema = StructType([f for f in df.schema.fields if f.name in kept] + new.fields)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            for b in _text.blocks(batch, column, most):
                arrays = [b.column(c) for c in kept] + [narrow(x) for x in compute(b)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return df.mapInArrow(run, schema)


def narrow(x) -> pa.Array:
    """As Spark takes it: no large strings or chunks."""
    x = x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x)
    if isinstance(x, pa.ChunkedArray):
        x = x.combine_chunks()
    return x.cast(pa.string()) if pa.types.is_large_string(x.type) else x
