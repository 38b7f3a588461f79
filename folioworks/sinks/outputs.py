"""Result cache, JSON and CSV of batches, text summaries, telemetry.

What is written is a table of Spark's; what is printed has a bounded number of lines.
"""

from __future__ import annotations

import json
import logging
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import exact_avg

BATCH_COLUMNS = ("file_path", "needs_ocr", "file_type", "category", "confidence", "reason_code")
log = logging.getLogger("folioworks")


def write_cache(results: DataFrame, path: str, now: Column | None = None) -> None:
    """Adds results (cache_key, ...) to the cache's table, with the time of writing."""
    stamped = results.withColumn("written_at", F.current_timestamp() if now is None else now)
    stamped.write.mode("append").parquet(path)


def clear_cache(spark: SparkSession, path: str) -> int:
    """Empties the cache's table; how many entries it had."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return 0
    n = spark.read.parquet(path).count()
    fs.delete(at, True)
    return n


def result_json(results: DataFrame, with_signals: bool = False) -> DataFrame:
    """Each result as one JSON object; ``signals`` is left out unless asked for."""
    names = [c for c in results.columns if with_signals or c != "signals"]
    return results.select(*[c for c in ("file_path",) if c in names], F.to_json(F.struct(*names)).alias("json"))


def batch_rows(results: DataFrame) -> DataFrame:
    return results.select(*BATCH_COLUMNS)


def write_batch(results: DataFrame, path: str, kind: str = "json") -> None:
    """The six columns of a batch as JSON lines or CSV with a header."""
    writer = batch_rows(results).write.mode("overwrite")
    if kind == "json":
        writer.json(path)
    elif kind == "csv":
        writer.option("header", True).csv(path)
    else:
        raise ValueError(f"unknown format {kind!r}")


def write_result(rows: DataFrame, path: str, kind: str) -> None:
    """Extraction rows as a table (rows), JSON lines (json), or texts of markdown (markdown)."""
    if kind == "rows":
        rows.write.mode("overwrite").parquet(path)
    elif kind == "json":
        rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(path)
    elif kind == "markdown":
        rows.select("markdown").write.mode("overwrite").text(path, lineSep="\f")
    else:
        raise ValueError(f"unknown format {kind!r}")


def duration(seconds: float) -> str:
    """As seconds, minutes or hours, whichever suits."""
    if seconds < 60:
        return f"{seconds:.2f} seconds"
    if seconds < 3600:
        return f"{int(seconds // 60)}m {seconds % 60:.1f}s"
    return f"{int(seconds // 3600)}h {int(seconds % 3600 // 60)}m {seconds % 60:.1f}s"


def first_errors(results: DataFrame, most: int = 10) -> DataFrame:
    return results.where("error is not null").orderBy("file_path").limit(most).select("file_path", "error")


def first_rows(results: DataFrame, most: int = 50) -> DataFrame:
    """The first rows of a batch by path, as its text table has them."""
    return results.orderBy("file_path").limit(most).select("file_path", "file_type", "needs_ocr", "confidence")


def text_table(results: DataFrame, most: int = 50) -> str:
    """The first ``most`` rows of a batch, then counts and the average confidence of all."""
    s = results.agg(F.count(F.lit(1)).alias("n"), F.count_if("needs_ocr").alias("need"), exact_avg(F.col("confidence"), 2).alias("avg")).head()
    lines = [f"{str(x.file_path)[-50:]:50} {x.file_type or 'unknown':12} {'yes' if x.needs_ocr else 'no':4} {x.confidence or 0:.2f}" for x in first_rows(results, most).collect()]
    more = [f"... and {s.n - most} more"] if s.n > most else []
    return "\n".join([*lines, *more, f"Total: {s.n}", f"Need OCR: {s.need}", f"Average confidence: {s.avg or 0:.2f}"])


def summary(results: DataFrame, seconds: float | None = None, skipped: int = 0) -> str:
    """Counts, pages, time, types in alphabetical order and the first ten errors of a batch."""
    from ..operators.batch import batch_stats, by_type

    s = batch_stats(results, seconds).head().asDict()
    share = lambda a, b: f"{100 * a / b if b else 0:.1f}%"
    out = [f"Total files found: {s['total'] + skipped}", f"Files processed: {s['processed']}"]
    out += [f"Files skipped: {skipped}"] if skipped else []
    out += [f"Files with errors: {s['errors']}"] if s["errors"] else []
    out += [f"Needing OCR: {s['needs_ocr']} ({share(s['needs_ocr'], s['processed'])})", f"Ready: {s['no_ocr']} ({share(s['no_ocr'], s['processed'])})"]
    if s.get("total_pages"):
        out += [f"Pages: {s['total_pages']}, {s['pages_needing_ocr']} needing OCR ({share(s['pages_needing_ocr'], s['total_pages'])})"]
    if seconds:
        out += [f"Total time: {duration(seconds)}", f"Speed: {s['files_per_second']:.2f} files a second"]
    for x in by_type(results).orderBy("file_type").limit(1000).collect():
        out.append(f"{x.file_type:12} {x.total:3} files, {x.needs_ocr} needing OCR ({share(x.needs_ocr, x.total)})")
    shown = first_errors(results).collect()
    out += [f"{x.file_path}: {x.error}" for x in shown] + ([f"... and {s['errors'] - len(shown)} more errors"] if s["errors"] > len(shown) else [])
    return "\n".join(out)


def file_view(result: dict, pages: list[dict] = (), most: int = 5) -> str:
    """One file's verdict for people, and its first pages."""
    out = [f"File: {result.get('file_path')}", f"Type: {result.get('file_type')}", f"Needs OCR: {'yes' if result.get('needs_ocr') else 'no'}", f"Confidence: {result.get('confidence') or 0:.2f}", f"Reason: {result.get('reason')}"]
    out += [f"  Page {p['page_number']}: {'OCR' if p['needs_ocr'] else 'text'} ({p.get('confidence') or 0:.2f})" for p in pages[:most]]
    return "\n".join(out + ([f"  ... and {len(pages) - most} more pages"] if len(pages) > most else []))


# ------------------------------------------------------------------ telemetry


def emit(event: str, callback: Callable[[dict], None] | None = None, variable: str = "FOLIOWORKS_TELEMETRY", **facts) -> dict:
    """A JSON line in the log, if the environment asks for it, and a call of ``callback``."""
    record = {"event": event, **facts}
    if os.environ.get(variable, "").lower() in ("1", "true", "yes"):
        log.info(json.dumps(record, default=str, sort_keys=True))
    if callback:
        callback(record)
    return record


class Stage:
    """Times a stage: ``with Stage("triage", callback): ...`` emits its seconds, and its error if it has one."""

    def __init__(self, name: str, callback: Callable[[dict], None] | None = None) -> None:
        self.name, self.callback = name, callback

    def __enter__(self) -> Stage:
        import time

        self.began = time.perf_counter()
        return self

    def __exit__(self, kind, error, trace) -> None:
        import time

        facts = {"error": kind.__name__} if kind else {}
        self.record = emit("stage", self.callback, stage=self.name, seconds=time.perf_counter() - self.began, **facts)


def observed(results: DataFrame, name: str = "batch") -> tuple[DataFrame, Observation]:
    """``results``, and an observation that has their totals once any action has run over them: no pass of its own."""
    seen = Observation(name)
    failed = F.col("error").isNotNull()
    return results.observe(seen, F.count(F.lit(1)).alias("total"), F.count_if(failed).alias("errors"), F.count_if(~failed & F.col("needs_ocr")).alias("needs_ocr"), F.count_if(~failed & ~F.col("needs_ocr")).alias("no_ocr")), seen
