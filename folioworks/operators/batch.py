"""Batch statistics, resume, the result cache, evaluation and latency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import exact_avg, r, zero


def batch_stats(results: DataFrame, seconds: float | None = None) -> DataFrame:
    failed = F.col("error").isNotNull()
    need = F.coalesce(F.col("needs_ocr"), F.lit(False))
    counts = [F.count(F.lit(1)).alias("total"), F.count_if(~failed).alias("processed"), F.count_if(failed).alias("errors"), F.count_if(~failed & need).alias("needs_ocr"), F.count_if(~failed & ~need).alias("no_ocr")]
    out = results.agg(*counts, *(_pages(~failed) + [F.count_if(~failed & (zero("page_count") > 0)).alias("files_with_pages")] if "page_count" in results.columns else []))
    return out if seconds is None else out.withColumn("files_per_second", r(F.col("processed") / seconds, 3))


def _pages(where: Column) -> list[Column]:
    """Sums of pages, those that need recognition and those with text."""
    return [zero(F.sum(F.when(where, zero(c)))).alias(name) for c, name in (("page_count", "total_pages"), ("pages_needing_ocr", "pages_needing_ocr"), ("pages_with_text", "pages_with_text"))]


def by_type(results: DataFrame, *more: str) -> DataFrame:
    """Results by type (and ``more`` columns, such as category): how many, how many need recognition, and their pages where there are any."""
    pages = _pages(F.lit(True))[:2] if "page_count" in results.columns else []
    return results.where("error is null").groupBy(F.coalesce("file_type", F.lit("unknown")).alias("file_type"), *more).agg(F.count(F.lit(1)).alias("total"), F.count_if("needs_ocr").alias("needs_ocr"), *pages)


def resume(files: DataFrame, done: DataFrame, key: str = "file_path") -> DataFrame:
    """Files without a result yet."""
    return files.join(done.select(key), key, "left_anti")


def cache_key(path: Column, mtime: Column, config_hash: str = "") -> Column:
    return F.md5(F.concat_ws(":", path, mtime, *([F.lit(config_hash)] if config_hash else [])))


def cache_hits(files: DataFrame, cache: DataFrame, now: Column, seconds: int = 3600, key: str = "cache_key") -> DataFrame:
    """Cached results that are young enough."""
    fresh = cache.where(F.col("written_at") > now - F.make_dt_interval(secs=F.lit(seconds)))
    return files.join(fresh, key)


def confusion(pairs: DataFrame, *by: str) -> DataFrame:
    """Of rows (predicted, actual): tp fp tn fn and percentages, 0 where undefined."""
    p, a = F.col("predicted"), F.col("actual")
    g = (pairs.groupBy(*by) if by else pairs.groupBy()).agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & ~a).alias("tn"), F.count_if(~p & a).alias("fn"))
    share = lambda x, y: F.coalesce(F.try_divide(x * 100.0, y), F.lit(0.0))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return g.withColumns({"accuracy": r(share(tp + tn, tp + fp + tn + fn), 2), "precision": r(share(tp, tp + fp), 2), "recall": r(share(tp, tp + fn), 2), "f1": r(share(tp * 2, tp * 2 + fp + fn), 2)})


def threshold_sweep(scored: DataFrame, thresholds: Sequence[float] = (0.4, 0.5, 0.6, 0.7, 0.8)) -> DataFrame:
    """The confusion at each threshold in one pass over rows (score, actual): each row meets the few thresholds, not the reverse."""
    each = scored.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    return confusion(each.withColumn("predicted", F.col("score") >= F.col("threshold")), "threshold")


def latency_stats(times: DataFrame, value: str = "value", *by: str, bins: int = 4096) -> DataFrame:
    """min, max, mean, median and p95 (0-based rank int(0.95 n)) of each group, exactly.

    Ranks are found in two steps, so that no task holds or orders all values: counts of
    equal values are summed before the shuffle and again by ``bins`` equal bins from each
    group's least to its greatest value; running sums over the bins name the one that holds
    a wanted rank, and only that bin's values are ordered.
    """
    from pyspark.sql.window import Window

    keys = [F.pmod(F.xxhash64(value), F.lit(1)).alias("__g"), *map(F.col, by)]  # 0, but no constant: joins on it stay equi-joins
    names = ["__g", *by]
    counts = times.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    g = counts.groupBy(*names).agg(F.sum("__c").alias("n"), F.min("__v").alias("min"), F.max("__v").alias("max"), F.sum(F.col("__v").cast("decimal(28,9)") * F.col("__c")).alias("__sum"))
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in names]
    low = g.select(*[F.col(k).alias(f"g_{k}") for k in names], F.col("min").alias("lo"), F.col("max").alias("hi"))
    onto = lambda df, other: df.join(other, [df[k].eqNullSafe(other[f"g_{k}"]) for k in names]).drop(*[f"g_{k}" for k in names])
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("__v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
    binned = onto(counts, low).withColumn("__b", place.cast("int")).drop("lo", "hi")
    # at most ``bins`` rows a group
    per_bin = binned.groupBy(*names, "__b").agg(F.sum("__c").alias("__c"))
    w = Window.partitionBy(*names).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    upto = per_bin.withColumns({"__upto": F.sum("__c").over(w), "__n": F.sum("__c").over(Window.partitionBy(*names))})
    ranks = F.array(F.floor((F.col("__n") - 1) / 2), F.floor(F.col("__n") / 2), F.least(F.floor(F.col("__n") * 0.95), F.col("__n") - 1))
    holds = upto.select("*", F.posexplode(ranks).alias("__t", "__rank")).where((F.col("__rank") < F.col("__upto")) & (F.col("__rank") >= F.col("__upto") - F.col("__c")))
    asked = holds.select(*[F.col(k).alias(f"g_{k}") for k in names], F.col("__b").alias("b"), "__t", (F.col("__rank") - (F.col("__upto") - F.col("__c"))).alias("__left"))
    inside = binned.join(F.broadcast(asked), [*[binned[k].eqNullSafe(asked[f"g_{k}"]) for k in names], binned["__b"] == asked["b"]]).drop(*[f"g_{k}" for k in names], "b")
    w = Window.partitionBy(*names, "__t").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    at = inside.withColumn("__upto", F.sum("__c").over(w)).where(F.col("__upto") > F.col("__left")).groupBy(*names, "__t").agg(F.min("__v").alias("__v"))
    pick = lambda t: F.max(F.when(F.col("__t") == t, F.col("__v")))
    found = at.groupBy(*names).agg(((pick(0) + pick(1)) / 2).alias("median"), pick(2).alias("p95"))
    out = g.join(found, same(g, found)).select(*[g[k] for k in names], "n", "min", "max", F.round((F.col("__sum").cast("double") / F.col("n")).cast("decimal(18,9)"), 4).cast("double").alias("mean"), r(F.col("median"), 4).alias("median"), "p95")
    return out.drop("__g")


def latency_by(times: DataFrame, bucket: Column, value: str = "value", name: str = "bucket") -> DataFrame:
    """How many and how long on average, by page count, confidence decile or what else ``bucket`` is."""
    return times.groupBy(bucket.alias(name)).agg(F.count(F.lit(1)).alias("n"), exact_avg(F.col(value), 4).alias("mean"))


def decile(confidence: Column) -> Column:
    return (F.floor(confidence * 10) * 10).cast("long")


def truth_of(files: DataFrame, truth: DataFrame) -> DataFrame:
    """files (path, resolved, base) with needs_ocr from truth (name, needs_ocr: unique names).

    A label that says no at one name gives way to the next (path, resolved path, base
    name), so yes at any of them wins; if none says anything at the base name, the
    resolved path's no stands.
    """
    label = lambda key, name: truth.select(F.col("name").alias(key), F.col("needs_ocr").alias(name))
    out = files.join(label("path", "__p"), "path", "left").join(label("resolved", "__r"), "resolved", "left").join(label("base", "__b"), "base", "left")
    yes = F.coalesce(F.col("__p"), F.lit(False)) | F.coalesce(F.col("__r"), F.lit(False)) | F.coalesce(F.col("__b"), F.lit(False))
    return out.withColumn("needs_ocr", F.when(yes, True).otherwise(F.coalesce("__b", "__r"))).drop("__p", "__r", "__b")


def agreement(a: DataFrame, b: DataFrame, key: str = "file_path") -> DataFrame:
    """How often two runs (needs_ocr, seconds) agree on the files that both have, and their total and average times."""
    x = a.select(key, F.col("needs_ocr").alias("a"), F.col("seconds").alias("sa")).join(b.select(key, F.col("needs_ocr").alias("b"), F.col("seconds").alias("sb")), key)
    total = lambda c, n: F.round(F.sum(F.col(c).cast("decimal(28,9)")), 4).cast("double").alias(n)
    return x.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") == F.col("b")).alias("agree"), exact_avg((F.col("a") == F.col("b")).cast("double"), 4).alias("agreement"), total("sa", "total_a"), total("sb", "total_b"), exact_avg(F.col("sa"), 4).alias("average_a"), exact_avg(F.col("sb"), 4).alias("average_b"))


def document_scores(pages: DataFrame, key: str = "file_path") -> DataFrame:
    """A document's score is its pages' greatest; 0.5 where no page has one."""
    return pages.groupBy(key).agg(F.coalesce(F.max("score"), F.lit(0.5)).alias("score"))


def preprocess_stats(runs: DataFrame) -> DataFrame:
    """Runs of conditioning (error, seconds): successes, failures, and the times of the successes."""
    ok = F.col("error").isNull()
    return runs.agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.round(F.sum(F.when(ok, F.col("seconds")).cast("decimal(28,9)")), 4).cast("double").alias("total"), exact_avg(F.when(ok, F.col("seconds")), 4).alias("average"))


def extraction_confidence(elements: DataFrame, tables: DataFrame, key: str = "file_path") -> DataFrame:
    """The plain mean of the confidences of a document's elements and tables."""
    return elements.select(key, "confidence").unionByName(tables.select(key, "confidence")).groupBy(key).agg(exact_avg(F.col("confidence"), 2).alias("confidence"))


def sketched(results: DataFrame, *by: str, value: str = "file_path") -> DataFrame:
    """Approximate numbers of different values by group, from sketches that merge."""
    return results.groupBy(*by).agg(F.hll_sketch_agg(value, F.lit(12)).alias("__s"), F.approx_count_distinct(value, 0.02).alias("approx")).withColumn("sketched", F.hll_sketch_estimate("__s")).drop("__s")


def crosstab(results: DataFrame, row: str, column: str, values: list) -> DataFrame:
    return results.groupBy(row).pivot(column, values).agg(F.count(F.lit(1)))


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str, name: str = "last") -> DataFrame:
    """Each row of ``left`` with the ``value`` of the latest row of ``right`` with its key and no later time.

    Rows of both are merged by time and the last value is carried on: linear in the rows of a
    key, where a range join would be quadratic.
    """
    from pyspark.sql.window import Window

    names = left.columns
    l = left.select("*", F.lit(1).alias("__side"), F.lit(None).cast(right.schema[value].dataType).alias("__value"))  # noqa: E741
    r_ = right.select(F.col(key), F.col(time), F.lit(0).alias("__side"), F.col(value).alias("__value"))
    w = Window.partitionBy(key).orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r_, allowMissingColumns=True).withColumn(name, F.last("__value", ignorenulls=True).over(w))
    return both.where("__side = 1").select(*names, name)


def truth_template(files: DataFrame) -> DataFrame:
    """A row to fill in for each file."""
    return files.select(F.col("file_path").alias("file"), F.lit(None).cast("boolean").alias("needs_ocr"), F.lit("").alias("notes"))


def auto_labels(probed: DataFrame) -> DataFrame:
    """A PDF without text needs recognition; other files get no label."""
    return probed.where("mime = 'application/pdf'").select("file_path", (F.length(F.trim(F.coalesce("text", F.lit("")))) == 0).alias("needs_ocr"))
