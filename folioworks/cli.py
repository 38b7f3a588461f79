"""Commands: ``check FILE`` for one file, ``batch DIRECTORY`` for many."""

from __future__ import annotations

import argparse
import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import drivers, reports
from .sinks import outputs
from .sources import files, pdf


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="folioworks")
    commands = p.add_subparsers(dest="command", required=True)
    one = commands.add_parser("check", help="the verdict on one file")
    one.add_argument("file")
    one.add_argument("--format", choices=("text", "json"), default="text")
    one.add_argument("--signals", action="store_true", help="with the signals, in JSON")
    many = commands.add_parser("batch", help="the verdicts on a directory's files")
    many.add_argument("directory")
    many.add_argument("--format", choices=("text", "json", "csv", "html", "summary"), default="text")
    many.add_argument("--output", help="where JSON, CSV or HTML goes")
    many.add_argument("--extensions", nargs="*")
    many.add_argument("--limit", type=int, help="only the first files by path")
    many.add_argument("--resume", help="results of an earlier batch, whose files are passed over")
    return p


SIGNALS = ("text_length", "page_count", "font_count", "image_coverage", "text_coverage", "layout_type", "non_printable_ratio", "unicode_noise_ratio")


def check(spark: SparkSession, path: str, kind: str = "text", with_signals: bool = False) -> str:
    directory, name = os.path.split(os.path.abspath(path))
    out = drivers.triage(spark, directory, [name.rsplit(".", 1)[-1]] if "." in name else ["*"])
    out = out.where(F.col("file_path").endswith("/" + name))
    if kind == "json":
        rows = out.withColumn("signals", F.struct(*SIGNALS)).select("file_path", "needs_ocr", "file_type", "category", "confidence", "reason_code", "reason", "error", "signals")
        found = outputs.result_json(rows, with_signals).select("json").head()
        return found[0] if found else json.dumps({"file_path": path, "error": "not found"})
    found = out.head()
    if not found:
        return f"{path}: not found"
    pages = []
    if found.file_type == "pdf":
        read = pdf.pdf_pages(files.with_types(spark.read.format("binaryFile").load(path))).where("page_number is not null").select("page_number", F.length("text").alias("n")).orderBy("page_number")
        pages = [{"page_number": r.page_number, "needs_ocr": (r.n or 0) < 50, "confidence": 0.95 if (r.n or 0) >= 50 else 0.6} for r in read.limit(1000).collect()]
    return outputs.file_view(found.asDict(), pages)


def batch(spark: SparkSession, directory: str, kind: str = "text", output: str | None = None, extensions: list[str] | None = None, limit: int | None = None, resume: str | None = None) -> str:
    began = time.perf_counter()
    done = files.results(spark, resume).select("file_path") if resume else None
    out = drivers.triage(spark, directory, extensions, resume=done)
    if limit is not None:
        out = out.orderBy("file_path").limit(limit)
    out = out.withColumn("pages_needing_ocr", F.when(F.col("needs_ocr"), F.col("page_count")).otherwise(0)).withColumn("pages_with_text", F.col("page_count") - F.col("pages_needing_ocr"))
    out = out.cache()  # read once, for the rows and for their summary
    try:
        if kind in ("json", "csv"):
            outputs.write_batch(out.where("error is null"), output or f"{directory.rstrip('/')}-results", kind)
            return outputs.summary(out, time.perf_counter() - began)
        if kind == "html":
            page = reports.html_report(out.where("error is null"))
            if output:
                with open(output, "w") as f:
                    f.write(page)
            return output or page
        return outputs.summary(out, time.perf_counter() - began) if kind == "summary" else outputs.text_table(out.where("error is null"))
    finally:
        out.unpersist()


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> str:
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("folioworks").getOrCreate()
    if a.command == "check":
        said = check(spark, a.file, a.format, a.signals)
    else:
        said = batch(spark, a.directory, a.format, a.output, a.extensions, a.limit, a.resume)
    print(said)
    return said


if __name__ == "__main__":
    main()
