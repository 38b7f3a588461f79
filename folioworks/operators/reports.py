"""Report rows in Spark, pages of HTML at the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import exact_avg, r
from ..functions.text import escape_html


def confidence_class(c: Column) -> Column:
    return F.when(c >= 0.8, "high").when(c >= 0.6, "medium").otherwise("low")


def report_summary(results: DataFrame) -> DataFrame:
    need = F.coalesce(F.col("needs_ocr"), F.lit(False))
    g = results.agg(F.count(F.lit(1)).alias("total"), F.count_if(need).alias("needs_ocr"), F.count_if(~need).alias("digital"), exact_avg(F.col("confidence"), 4).alias("avg_confidence"))
    return g.withColumn("needs_ocr_percent", r(F.coalesce(F.try_divide(F.col("needs_ocr") * 100.0, F.col("total")), F.lit(0.0)), 2))


def report_rows(results: DataFrame) -> DataFrame:
    """file_path and its row of the HTML table."""
    cells = [escape_html(F.col("file_path")), F.coalesce("file_type", F.lit("unknown")), F.when(F.col("needs_ocr"), "yes").otherwise("no"), F.format_string("%.2f", "confidence")]
    inner = F.concat(*[x for c in cells for x in (F.lit("<td>"), c, F.lit("</td>"))])
    return results.select("file_path", F.concat(F.lit('<tr class="'), confidence_class(F.col("confidence")), F.lit('">'), inner, F.lit("</tr>")).alias("row_html"))


THEMES = {"light": ("#ffffff", "#1f2328", "#f3f4f6"), "dark": ("#14171a", "#e6e6e6", "#22262b")}


def style(theme: str = "light") -> str:
    back, ink, card = THEMES[theme]
    return (
        f"body{{font-family:sans-serif;background:{back};color:{ink};margin:2em}}.card{{display:inline-block;background:{card};padding:1em 1.5em;margin:.4em;border-radius:6px}}"
        f".card b{{display:block;font-size:1.6em}}table{{border-collapse:collapse;width:100%}}td,th{{padding:.3em .6em;text-align:left;border-bottom:1px solid {card}}}"
        ".high{border-left:4px solid #2e8b57}.medium{border-left:4px solid #d9a400}.low{border-left:4px solid #c0392b}.bar{display:inline-block;height:.8em;background:#4477aa}"
    )


def cards(facts: dict[str, object]) -> str:
    return "".join(f'<div class="card"><b>{v}</b>{k}</div>' for k, v in facts.items())


def bars(counts: list[tuple[str, int]], title: str) -> str:
    """A bar for each count, as wide as its share of the largest."""
    most = max((n for _, n in counts), default=1) or 1
    rows = "".join(f'<tr><td>{k}</td><td><span class="bar" style="width:{round(200 * n / most)}px"></span> {n}</td></tr>' for k, n in counts)
    return f"<h2>{title}</h2><table>{rows}</table>"


def html_report(results: DataFrame, title: str = "Triage", most: int = 1000, theme: str = "light", made: str | None = None) -> str:
    """A page for people: the summary of all results, their types and reasons, and the first ``most`` rows, with how many more there are."""
    from .batch import by_type

    s = report_summary(results).head()
    facts = {"files": s.total, "need OCR": f"{s.needs_ocr} ({s.needs_ocr_percent}%)", "digital": s.digital, "average confidence": s.avg_confidence}
    types = [(x.file_type, x.total) for x in by_type(results if "error" in results.columns else results.withColumn("error", F.lit(None))).orderBy("file_type").limit(100).collect()]
    reasons = [(x.reason_code, x["count"]) for x in results.groupBy(F.coalesce("reason_code", F.lit("UNKNOWN")).alias("reason_code")).count().orderBy("reason_code").limit(100).collect()]
    rows = "".join(x.row_html for x in report_rows(results).orderBy("file_path").limit(most).collect())
    more = f"<p>The first {most} of {s.total} rows.</p>" if s.total > most else ""
    head = f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{title}</title><style>{style(theme)}</style></head><body><h1>{title}</h1>" + (f"<p>{made}</p>" if made else "")
    table = f"<h2>Files</h2>{more}<table><tr><th>File</th><th>Type</th><th>Needs OCR</th><th>Confidence</th></tr>{rows}</table>"
    return f"{head}{cards(facts)}{bars(types, 'Types')}{bars(reasons, 'Reasons')}{table}<footer>{s.total} files</footer></body></html>"
