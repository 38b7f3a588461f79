"""The same triage over arriving data with Structured Streaming."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving(spark: SparkSession, path: str, schema, files_a_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def unseen(files: DataFrame, key: str = "file_path", time: str = "ts", within: str = "1 day") -> DataFrame:
    """Each file once within the watermark."""
    return files.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def rates(events: DataFrame, kind: str = "event_type", time: str = "ts", size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events of each kind in tumbling (or sliding) windows; later ones than ``late`` are dropped."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    base = events.withWatermark(time, late) if events.isStreaming else events
    return base.groupBy(w.alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def sessions(events: DataFrame, key: str = "user_id", time: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    base = events.withWatermark(time, late) if events.isStreaming else events
    return base.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def running_summary(results: DataFrame, kind: str = "file_type") -> DataFrame:
    return results.groupBy(kind).agg(F.count(F.lit(1)).alias("total"), F.count_if("needs_ocr").alias("needs_ocr"))


def finish(stream: DataFrame, to: Callable[[DataFrame, int], None] | None = None, mode: str = "append", checkpoint: str | None = None, path: str | None = None) -> DataFrame | None:
    """Runs a stream over all that is there now, into ``to`` or a table at ``path``; returns what was written.

    Appended rows go to the file sink, a complete result replaces the table.  Without a
    path the table is in the folder of spark.checkpoint.dir (a temporary one of this machine only
    where there is one machine).
    """
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True)
    if to:
        if checkpoint:
            writer = writer.option("checkpointLocation", checkpoint)
        writer.foreachBatch(to).start().awaitTermination()
        return None
    path = path or f"{_shared(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    writer = writer.option("checkpointLocation", checkpoint or f"{path}-progress")
    if mode == "append":
        writer.format("parquet").option("path", path).start().awaitTermination()
    else:
        writer.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(path)).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def _shared(spark: SparkSession) -> str:
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.mkdtemp(prefix='folioworks-')}"


def ttl_cache(requests: DataFrame, seconds: int = 3600, late: str = "10 minutes") -> DataFrame:
    """cache_key, ts, hit: whether a request came within ``seconds`` of the entry of its key, by event time.

    An entry is state that the watermark removes once it has expired.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    names = ["cache_key", "ts", "hit"]

    def each(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=names)
            return
        written = state.get[0] if state.exists else None
        rows = []
        for f in frames:
            for ts in sorted(f["ts"]):
                t = ts.timestamp()
                hit = written is not None and t - written < seconds
                if not hit:
                    written = t
                rows.append((key[0], ts, hit))
        state.update((written,))
        state.setTimeoutTimestamp(max(int((written + seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=names)

    keyed = requests.withWatermark("ts", late).groupBy("cache_key")
    return keyed.applyInPandasWithState(each, "cache_key string, ts timestamp, hit boolean", "written double", "append", GroupStateTimeout.EventTimeTimeout)
