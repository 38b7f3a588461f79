"""The query catalogue: each inventory entry over the given tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import PRESETS, RELAXED, Config, PlannerConfig
from ..functions import text as T
from ..functions.numeric import exact_avg, exact_sum, r
from ..operators import batch, extract, images, pages, reports, rules, signals
from ..operators.similar import similar_to
from ..sources import files
from ..streaming import streams
from . import oracles
from .shares import by_document

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def grid(spark: SparkSession, d: str) -> DataFrame:
    """``lineitem`` as a grid of signals that reaches every rule."""
    li = table(spark, d, "lineitem")
    k = F.col("l_linenumber") % 7
    mime = (
        F.when(F.col("l_orderkey") % 3 != 0, "application/pdf").when(k == 0, "text/plain").when(k == 1, files.MIME["docx"]).when(k == 2, "image/png").when(k == 3, "application/json")
        .when(k == 4, "application/xhtml+xml").when(k == 5, "application/octet-stream").otherwise("application/x-other")
    )
    layout = F.element_at(F.array(*map(F.lit, ("text_only", "image_only", "mixed", "unknown"))), (F.col("l_orderkey") % 4 + 1).cast("int"))
    df = li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("file_path"), mime.alias("mime"), F.lit("").alias("extension"), (F.col("l_linenumber") % 2 == 1).alias("is_binary"), (F.col("l_partkey") % 60).cast("int").alias("text_length"),
        (F.col("l_quantity") * 2).alias("image_coverage"), F.round((F.col("l_discount") * 1000).cast("decimal(18,6)"), 3).cast("double").alias("text_coverage"), F.when(F.col("l_suppkey") % 11 != 0, (F.col("l_suppkey") % 6).cast("int")).alias("font_count"),
        F.round((F.col("l_tax") * 30).cast("decimal(18,6)"), 3).cast("double").alias("text_density"), ((F.col("l_orderkey") % 5) * 2 / 100.0).alias("non_printable_ratio"), ((F.col("l_orderkey") % 7) * 2 / 100.0).alias("unicode_noise_ratio"),
        layout.alias("layout_type"), (layout == "mixed").alias("is_mixed_content"), (F.col("l_partkey") % 40).cast("double").alias("vision_tc"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"),
    )
    return df


VERDICT = ["file_path", "needs_ocr", "confidence", "category", "reason_code", "rule", "ocr_score"]


@query
def triage_by_reason(spark, d):
    out = rules.decide(grid(spark, d))
    return out.groupBy("reason_code", "needs_ocr").agg(F.count(F.lit(1)).alias("n"), exact_avg(F.col("confidence"), 4).alias("avg_confidence"))


def _decide(config: Config) -> Callable:
    return lambda spark, d: rules.decide(grid(spark, d), config).select(VERDICT)


for _name, _config in {"decide_default": Config(), "decide_relaxed": RELAXED, **{f"decide_preset_{k}": v for k, v in PRESETS.items()}}.items():
    QUERIES[_name] = _decide(_config)


@query
def ocr_score(spark, d):
    return grid(spark, d).select("file_path", signals.ocr_score(F.col("image_coverage")).alias("ocr_score"))


@query
def confidence_modes(spark, d):
    g = grid(spark, d)
    needs = F.col("text_length") < 30
    return g.select("file_path", signals.confidence(needs).alias("plain"), signals.confidence(needs, signals.ocr_score(F.col("image_coverage"))).alias("scored"))


@query
def hints_engine(spark, d):
    g = rules.decide(grid(spark, d), RELAXED)
    level = F.element_at(F.array(F.lit("simple"), F.lit("moderate"), F.lit("complex")), (F.col("l_partkey") % 3 + 1).cast("int"))
    h = g.withColumn("h", signals.hints(F.col("needs_ocr"), level))
    return h.select("file_path", F.col("h.suggested_engine").alias("engine"), F.array_join("h.suggest_preprocessing", ",").alias("steps"), F.col("h.ocr_complexity_score").alias("complexity"))


@query
def vision_gate(spark, d):
    return rules.vision_gate(rules.decide(grid(spark, d), RELAXED), layout_aware=True).select("file_path", "refine_mode")


@query
def vision_gate_skips(spark, d):
    g = rules.decide(grid(spark, d), RELAXED).withColumns({"page_count": F.col("l_partkey") % 200, "file_size": F.col("l_partkey") * 5000})
    return rules.vision_gate(g, True, PRESETS["cost"]).select("file_path", "refine_mode")


@query
def refine_ladder(spark, d):
    g = rules.decide(grid(spark, d), RELAXED).where("mime = 'application/pdf'")
    kinds = F.element_at(F.array(*map(F.lit, ("mixed", "text_only", "image_only", "unknown"))), (F.col("l_partkey") % 4 + 1).cast("int"))
    v = g.withColumns({"vision_text_coverage": F.col("vision_tc") * 2, "vision_image_coverage": (F.col("l_partkey") % 95).cast("double"), "vision_layout_type": kinds, "vision_has_text": F.col("l_partkey") % 3 == 0})
    return rules.refine(v, RELAXED).select("file_path", "needs_ocr", "confidence", "reason_code", "rule", "category")


@query
def file_type_category(spark, d):
    g = grid(spark, d)
    return g.groupBy(signals.file_type(F.col("mime"), F.col("extension")).alias("file_type")).agg(F.count(F.lit(1)).alias("n"))


@query
def mime_dimension(spark, d):
    exts = list(files.MIME) + ["zip", "bin"]
    ext = F.element_at(F.array(*map(F.lit, exts)), (F.col("p_partkey") % len(exts) + 1).cast("int"))
    p = table(spark, d, "part").withColumn("ext", ext)
    return p.groupBy("ext", files.mime_of_extension(F.col("ext")).alias("mime")).agg(F.count(F.lit(1)).alias("n"))


@query
def magic_bytes(spark, d):
    heads = F.element_at(F.array(*map(F.lit, ("%PDF-1.4", "GIF89a", "BM6", "plain"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    p = table(spark, d, "part").withColumns({"content": heads.cast("binary"), "ext": F.lit("txt")})
    mime = files.mime_of(F.col("content"), F.col("ext"))
    return p.groupBy(mime.alias("mime"), files.is_binary(mime).alias("is_binary")).agg(F.count(F.lit(1)).alias("n"))


@query
def text_quality(spark, d):
    noisy = F.concat(F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("​​"), F.lit("\u0001"), F.lit("�"))).otherwise(""), "text")
    q = T.text_quality(noisy, include_unassigned=False)
    return table(spark, d, "documents").select("doc_id", *[c.alias(k) for k, c in q.items()])


@query
def meaningful_text(spark, d):
    return table(spark, d, "documents").groupBy("lang", T.meaningful(F.col("text")).alias("meaningful")).agg(F.count(F.lit(1)).alias("n"))


@query
def text_probe_truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length("text").alias("text_length"), F.length(F.substring("text", 1, 1000)).alias("probe_length"), F.md5(F.substring("text", 1, 1000).cast("binary")).alias("probe_md5"))


@query
def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


@query
def html_elements(spark, d):
    return extract.html_elements(table(spark, d, "pages")).select("page_id", "rank", "ordinal", "type", "text")


@query
def html_element_counts(spark, d):
    return extract.html_elements(table(spark, d, "pages")).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query
def plain_text_elements(spark, d):
    return extract.text_elements(table(spark, d, "documents")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("y0").alias("last_y"), F.sum(F.length("text")).alias("chars"))


@query
def element_ids(spark, d):
    return extract.text_elements(table(spark, d, "documents")).select("doc_id", "line", "element_id")


def boxes(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    x, y = (F.col("l_partkey") % 500).cast("double"), (F.col("l_suppkey") * 7 % 750).cast("double")
    return li.select(
        F.col("l_orderkey").alias("file_path"), F.col("l_linenumber").alias("ordinal"), (F.col("l_linenumber") % 2 + 1).alias("page"), x.alias("x0"), y.alias("y0"), (x + F.col("l_quantity") * 3).alias("x1"), (y + F.col("l_quantity")).alias("y1"),
        F.lit(792.0).alias("page_height"), (F.col("l_partkey") % 3 + 2).alias("columns"), F.concat(F.col("l_orderkey"), F.lit("-"), F.col("l_linenumber")).alias("element_id"), "l_quantity", "l_discount", "l_tax",
    )


@query
def reading_order(spark, d):
    return extract.reading_order(boxes(spark, d)).select("file_path", "ordinal", "reading_order")


@query
def element_confidence(spark, d):
    b = boxes(spark, d)
    return b.select("element_id", extract.element_confidence(F.col("l_discount") * 10, F.lit(0.9), F.col("l_tax") * 10, F.lit(1.0)).alias("confidence"))


@query
def element_types(spark, d):
    b = boxes(spark, d)
    kind = extract.element_type(F.col("l_quantity") / 2, F.col("ordinal") % 2 == 0, F.abs((F.col("x0") + F.col("x1")) / 2 - 306) < 61.2, F.col("y0"), F.col("page_height"))
    return b.groupBy(kind.alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query
def elements_in_cells_anti(spark, d):
    b = boxes(spark, d)
    return extract.outside_cells(b.where("ordinal % 2 = 0"), b.where("ordinal % 2 = 1").withColumns({"x1": F.col("x1") + 100, "y1": F.col("y1") + 100})).select("file_path", "ordinal")


@query
def region_iou_anti(spark, d):
    b = boxes(spark, d)
    i = b.where("ordinal % 2 = 0").select("file_path", "ordinal", *[F.col(c).alias(f"i_{c}") for c in ("x0", "y0", "x1", "y1")])
    t = b.where("ordinal % 2 = 1").select(F.col("file_path").alias("t_file"), *[F.col(c).alias(f"t_{c}") for c in ("x0", "y0", "x1", "y1")])
    return i.join(t, (F.col("file_path") == F.col("t_file")) & (extract.iou("i_", "t_") >= 0.2), "left_anti").select("file_path", "ordinal")


@query
def band_self_join(spark, d):
    b = boxes(spark, d)
    a, c = b.where("ordinal = 1").alias("a"), b.where("ordinal > 1").alias("c")
    near = a.join(c, (F.col("a.file_path") == F.col("c.file_path")) & (F.abs(F.col("a.y0") - F.col("c.y0")) < 30))
    return near.groupBy(F.col("a.file_path").alias("file_path")).agg(F.min("c.ordinal").alias("first_near"))


@query
def zone_tag_filter(spark, d):
    return extract.zones(boxes(spark, d)).groupBy("in_header", "in_footer").agg(F.count(F.lit(1)).alias("n"))


@query
def sections(spark, d):
    z = extract.zones(boxes(spark, d))
    parts = z.select("file_path", "page", "ordinal", F.explode(F.filter(F.array(F.when(F.col("in_header"), "header"), F.when(F.col("in_footer"), "footer"), F.when(~F.col("in_header") & ~F.col("in_footer"), "body")), lambda x: x.isNotNull())).alias("section"))
    return parts.groupBy("file_path", "page", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list("ordinal")), lambda x: x.cast("string")), ",").alias("ids"))


@query
def section_prune(spark, d):
    b = boxes(spark, d)
    own = ["file_path", "ordinal", "x0", "y0", "y1"]  # numbers of lines repeat in these tables
    alive = extract.zones(b).where("not in_footer").select(own)
    return b.join(alive, own, "left_semi").groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ pages and planner


def conversation_pages(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as documents of pages; tokens that the prose lacks are added."""
    c = table(spark, d, "conversations")
    token = F.when(F.col("conv_id") % 7 == 0, " Rx dose 5mg PRESCRIPTION rx").when(F.col("conv_id") % 7 == 1, " lab results: wbc").when(F.col("conv_id") % 7 == 2, " diagnosis ICD-10").otherwise("")
    text = F.concat(F.coalesce("text", F.lit("")), token)
    return c.select(
        F.col("conv_id").alias("file_path"), (F.col("turn") + 1).cast("int").alias("page_number"), text.alias("text"), F.length(F.coalesce("text", F.lit(""))).alias("text_length"), (F.col("conv_id") % 50).cast("double").alias("image_coverage"),
        (F.col("turn") * 17 % 100).cast("double").alias("text_coverage"), (F.col("conv_id") % 13 == 0).alias("extraction_failed"), (F.col("conv_id") % 17 == 0).alias("layout_missing"),
    )


@query
def page_verdicts(spark, d):
    return pages.page_verdicts(conversation_pages(spark, d)).select("file_path", "page_number", "needs_ocr", "confidence", "reason_code")


@query
def page_rollup(spark, d):
    return pages.page_rollup(pages.page_verdicts(conversation_pages(spark, d)))


@query
def variance_escalation(spark, d):
    return pages.variance_escalation(conversation_pages(spark, d)).select("file_path", "reuse_verdict", "page_std").distinct()


@query
def page_override_guard(spark, d):
    return pages.override_guard(rules.decide(grid(spark, d), RELAXED), RELAXED).groupBy("page_override", "needs_ocr").agg(F.count(F.lit(1)).alias("n"))


@query
def layout_type(spark, d):
    g = grid(spark, d)
    return g.groupBy(pages.layout_type(F.col("text_coverage"), F.col("image_coverage"), F.col("text_length")).alias("layout")).agg(F.count(F.lit(1)).alias("n"))


def layout_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file_path"), F.lit(484704.0).alias("page_area"), (F.col("l_quantity") * 12000).alias("text_area"), (F.col("l_partkey") % 40 * 13000).cast("double").alias("image_area"), (F.col("l_partkey") % 900).alias("chars"))


@query
def layout_rollup(spark, d):
    return pages.layout_rollup(layout_pages(spark, d))


@query
def vision_rollup(spark, d):
    v = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file_path"), F.lit(1000.0).alias("page_area"), F.col("l_quantity").alias("text_coverage"), (F.col("l_partkey") % 9).alias("text_regions"), (F.col("l_suppkey") % 4).alias("image_regions"))
    return pages.vision_rollup(v)


@query
def intent_scores(spark, d):
    p = conversation_pages(spark, d).withColumn("s", T.intent_scores(F.col("text")))
    return p.select("file_path", "page_number", *[F.try_element_at("s", F.lit(k)).alias(k) for k in T.INTENT_PATTERNS])


@query
def intent_top_label(spark, d):
    p = conversation_pages(spark, d).withColumn("s", T.intent_scores(F.col("text")))
    order = F.create_map(*[x for i, k in enumerate(T.INTENT_PATTERNS) for x in (F.lit(k), F.lit(i))])
    ranked = F.array_sort(F.transform(F.map_entries("s"), lambda e: F.struct((-e["value"]).alias("v"), F.element_at(order, e["key"]).alias("i"), e["key"].alias("k"))))
    top = p.withColumn("label", F.try_element_at(ranked, F.lit(1))["k"])
    return top.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


PLANNED = ["file_path", "page_number", "score", "needs_ocr", "decision_type", "confidence", "override_reason"]


@query
def planner_pages(spark, d):
    return pages.planner_pages(conversation_pages(spark, d)).select(PLANNED)


@query
def planner_pages_generic(spark, d):
    return pages.planner_pages(conversation_pages(spark, d), PlannerConfig(domain="generic", overrides="none")).select(PLANNED)


@query
def planner_rollup(spark, d):
    out = pages.planner_rollup(pages.planner_pages(conversation_pages(spark, d)))
    return out.withColumn("pages_needing_ocr", F.array_join(F.transform("pages_needing_ocr", lambda x: x.cast("string")), ","))


@query
def planner_exits(spark, d):
    g = rules.decide(grid(spark, d), RELAXED).withColumns({"page_count": F.col("l_partkey") % 4, "max_image_coverage": F.col("image_coverage") / 3})
    return pages.planner_exit(g).groupBy("exit").agg(F.count(F.lit(1)).alias("n"))


@query
def override_histogram(spark, d):
    return pages.planner_pages(conversation_pages(spark, d)).where("override_reason is not null").groupBy("override_reason").agg(F.count(F.lit(1)).alias("n"))


@query
def page_layout_left_join(spark, d):
    p = conversation_pages(spark, d).select("file_path", "page_number", "text_length")
    lay = p.where("page_number % 3 <> 0").select("file_path", "page_number", (F.col("page_number") * 10.0).alias("image_coverage"))
    return p.join(lay, ["file_path", "page_number"], "left").select("file_path", "page_number", "text_length", F.coalesce("image_coverage", F.lit(0.0)).alias("image_coverage"), F.col("image_coverage").isNull().alias("layout_missing"))


# ------------------------------------------------------------------ batch and evaluation


def event_results(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").cast("string").alias("file_path"), F.when(F.col("event_id") % 9 != 0, F.col("event_type")).alias("file_type"), (F.col("event_id") % 3 == 0).alias("needs_ocr"), F.when(F.col("event_id") % 20 == 0, "broken").alias("error"),
        F.element_at(F.array(*map(F.lit, ("PDF_SCANNED", "PDF_DIGITAL", "TEXT_FILE"))), (F.col("event_id") % 3 + 1).cast("int")).alias("reason_code"), ((F.col("event_id") % 100) / 100.0).alias("confidence"), "value", "ts", "user_id", "event_type",
    )


@query
def batch_stats(spark, d):
    return batch.batch_stats(event_results(spark, d), 5.0)


@query
def batch_by_type(spark, d):
    return batch.by_type(event_results(spark, d))


@query
def batch_by_reason(spark, d):
    return event_results(spark, d).where("error is null").groupBy(F.coalesce("reason_code", F.lit("UNKNOWN")).alias("reason_code")).agg(F.count(F.lit(1)).alias("n"))


@query
def batch_grouping_sets(spark, d):
    g = event_results(spark, d).groupingSets([["file_type"], ["reason_code"], []], "file_type", "reason_code")
    return g.agg(F.count(F.lit(1)).alias("n"), F.count_if("needs_ocr").alias("needs_ocr"))


@query
def batch_cube(spark, d):
    return event_results(spark, d).cube("file_type", "needs_ocr").agg(F.count(F.lit(1)).alias("n"))


@query
def batch_rollup(spark, d):
    return event_results(spark, d).rollup("file_type", "reason_code").agg(F.count(F.lit(1)).alias("n"), exact_sum(F.col("value")).cast("decimal(18,4)").cast("double").alias("value"))


@query
def resume_anti_join(spark, d):
    return batch.resume(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query
def resume_skipped_count(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").agg(F.count(F.lit(1)).alias("skipped"))


@query
def ext_size_filter(spark, d):
    return table(spark, d, "documents").where(F.col("n_chars").between(1000, 10000)).select("doc_id", F.concat(F.col("doc_id"), F.lit(".txt")).alias("file_path"), "n_chars")


@query
def cache_key(spark, d):
    return table(spark, d, "documents").select("doc_id", batch.cache_key(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")), F.col("n_chars").cast("string")).alias("cache_key"))


@query
def cache_ttl(spark, d):
    last = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("written_at"))
    end = F.lit(last.agg(F.max("written_at")).head()[0])  # one value
    return batch.cache_hits(last.select("user_id"), last, end, 86400, "user_id").select("user_id", "written_at")


def labelled(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return docs.join(labels, "doc_id").select("doc_id", "lang", (F.col("quality") == 0).alias("actual"), (F.least(F.col("n_chars"), F.lit(2000)) / 2000.0).alias("score"), (F.col("n_chars") < 900).alias("predicted"))


@query
def ground_truth_match(spark, d):
    """Labels by path, resolved path and base name; some files have contrary labels at two of them."""
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("in/"), F.col("doc_id"), F.lit(".txt")).alias("path"), F.concat(F.lit("/data/in/"), F.col("doc_id"), F.lit(".txt")).alias("resolved"), F.concat(F.col("doc_id"), F.lit(".txt")).alias("base"))
    labels = table(spark, d, "labels")
    where = F.element_at(F.array(F.lit("in/"), F.lit("/data/in/"), F.lit("")), (F.col("doc_id") % 3 + 1).cast("int"))
    truth = labels.select(F.concat(where, F.col("doc_id"), F.lit(".txt")).alias("name"), (F.col("quality") == 0).alias("needs_ocr"))
    contrary = labels.where("doc_id % 3 < 2 and doc_id % 5 < 2").select(F.concat(F.col("doc_id"), F.lit(".txt")).alias("name"), (F.col("doc_id") % 5 == 0).alias("needs_ocr"))
    return batch.truth_of(docs, truth.unionByName(contrary)).select("doc_id", "needs_ocr")


@query
def confusion_matrix(spark, d):
    return batch.confusion(labelled(spark, d))


@query
def confusion_by_type(spark, d):
    return batch.confusion(labelled(spark, d), "lang")


@query
def threshold_sweep(spark, d):
    return batch.threshold_sweep(labelled(spark, d))


@query
def agreement_rate(spark, d):
    a = by_document(rules.decide(grid(spark, d)).select("file_path", F.col("needs_ocr").alias("a")))
    b = by_document(rules.decide(grid(spark, d), PRESETS["cost"]).select("file_path", F.col("needs_ocr").alias("b")))
    return a.join(b, "file_path").agg(F.count(F.lit(1)).alias("n"), exact_avg((F.col("a") == F.col("b")).cast("double"), 4).alias("agreement"))


@query
def latency_stats(spark, d):
    return batch.latency_stats(table(spark, d, "events"))


@query
def latency_by_type(spark, d):
    return batch.latency_stats(table(spark, d, "events"), "value", "event_type")


@query
def latency_by_decile(spark, d):
    return batch.latency_by(event_results(spark, d), batch.decile(F.col("confidence")), name="decile")


@query
def report_summary(spark, d):
    return reports.report_summary(rules.decide(grid(spark, d)))


@query
def html_report_rows(spark, d):
    g = rules.decide(grid(spark, d)).withColumn("file_type", signals.file_type(F.col("mime"), F.col("extension")))
    return reports.report_rows(g.withColumn("file_path", F.concat(F.lit("<a>&"), F.col("file_path"))))


# ------------------------------------------------------------------ text, invoices, sets


@query
def jaccard_duplicates(spark, d):
    """Documents that hold much of a benchmark item's words: the items are a stated set of queries against all documents."""
    return similar_to(table(spark, d, "documents"), table(spark, d, "benchmark"), 0.2)


@query
def word_set_ops(spark, d):
    # each document beside the one benchmark item that its id names
    docs = table(spark, d, "documents").withColumn("item_id", F.pmod("doc_id", F.lit(40)))
    docs = docs.join(table(spark, d, "benchmark").select("item_id", F.col("text").alias("item_text")), "item_id")
    a, b = T.word_set(F.col("text")), T.word_set(F.col("item_text"))
    return docs.select("doc_id", T.jaccard(a, b).isNotNull().alias("some"), F.size(F.array_intersect(a, b)).alias("both"), F.size(F.array_union(a, b)).alias("either"), F.size(F.array_except(a, b)).alias("only_first"))


def injected(spark: SparkSession, d: str) -> DataFrame:
    """Documents with tokens that the prose lacks."""
    k = F.col("doc_id") % 9
    token = F.when(k == 0, " Invoice number: 77 total USD 12.50").when(k == 1, " receipt GST $3.99").when(k == 2, " Product catalogue £5").when(k == 3, " user guide €7.25").when(k == 4, " services").when(k == 5, " abc$9.10").otherwise("")
    return table(spark, d, "documents").select("doc_id", F.concat("text", token).alias("text"), F.trim(token).alias("token"))


@query
def doc_type_detect(spark, d):
    return injected(spark, d).groupBy(T.document_type(F.col("text")).alias("doc_type")).agg(F.count(F.lit(1)).alias("n"))


@query
def currency_detect(spark, d):
    return injected(spark, d).groupBy(T.currency(F.col("token")).alias("currency")).agg(F.count(F.lit(1)).alias("n"))


@query
def money_parse(spark, d):
    return injected(spark, d).select("doc_id", T.money(F.col("token")).alias("money"), T.first_int(F.col("token")).alias("whole"))


@query
def price_spacing(spark, d):
    return injected(spark, d).groupBy(T.spaced_prices(F.col("token")).alias("token")).agg(F.count(F.lit(1)).alias("n"))


def line_items(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order repeat their number in these tables; part and quantity make the ordinal one row's."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    li = by_document(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file_path"), *order))
    li = li.withColumn("ordinal", F.row_number().over(Window.partitionBy("file_path").orderBy(*order)))
    return li.select("file_path", "ordinal", F.concat(F.lit(" Part  "), F.col("l_partkey") % 3).alias("description"), F.lit(5.0).alias("unit_price"), F.col("l_quantity").alias("quantity"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity") * 5).alias("total"))


@query
def invoice_build(spark, d):
    li = line_items(spark, d)
    return li.groupBy("file_path").agg(F.count(F.lit(1)).alias("n_lines"), F.min_by(T.normalized(F.col("description")), "ordinal").alias("first_description"), F.sum("quantity").alias("quantity"), F.max_by("quantity", "ordinal").alias("last_quantity"))


@query
def invoice_validate(spark, d):
    li = line_items(spark, d)
    stated = li.groupBy("file_path").agg((F.sum("quantity") * 5 + F.when(F.col("file_path") % 4 == 0, 1.0).otherwise(0.0)).alias("stated_total"))
    return extract.invoice_totals(li, stated).select("file_path", "lines_total", "n_lines", "matches")


@query
def line_item_dedupe(spark, d):
    li = line_items(spark, d).withColumns({"quantity": F.lit(1.0), "total": F.lit(5.0)})
    return extract.first_line_items(li).select("file_path", "ordinal")


def invoice_cells(spark: SparkSession, d: str) -> DataFrame:
    li = line_items(spark, d)
    texts = F.array(F.trim("description"), F.lit("5.00"), F.col("quantity").cast("int").cast("string"), F.when(F.col("total").isNotNull(), F.col("total").cast("int").cast("string")).otherwise(""))
    return li.select("file_path", F.col("ordinal").alias("row"), F.posexplode(texts).alias("col", "text"))


@query
def table_confidence(spark, d):
    return extract.table_confidence(invoice_cells(spark, d), 0.9).select("file_path", "n_rows", "n_cells", "empty", "confidence")


@query
def numeric_parse(spark, d):
    t = F.when(F.col("doc_id") % 4 == 0, "1,234.50").when(F.col("doc_id") % 4 == 1, "12.5.1").when(F.col("doc_id") % 4 == 2, " 77 ").otherwise("x")
    n = F.regexp_replace(F.trim(t), ",", "").try_cast("double")
    return table(spark, d, "documents").groupBy(n.alias("parsed"), n.isNull().alias("failed")).agg(F.count(F.lit(1)).alias("n"))


@query
def duplicate_ids(spark, d):
    b = boxes(spark, d).withColumn("element_id", (F.col("ordinal") % 3).cast("string"))
    order = b.select("file_path", (F.col("ordinal") % 5).cast("string").alias("element_id")).distinct()
    return extract.validation_flags(b, order)


@query
def markdown_table(spark, d):
    return extract.markdown_table(invoice_cells(spark, d))


@query
def markdown_page(spark, d):
    return extract.markdown_page(extract.html_elements(table(spark, d, "pages")))


@query
def page_union_distinct(spark, d):
    b = boxes(spark, d)
    return b.where("ordinal <= 3").select("file_path", "page").union(b.where("ordinal >= 2").select("file_path", "page")).union(b.where("columns = 3").select("file_path", "page")).distinct()


@query
def resume_except(spark, d):
    return table(spark, d, "documents").select("doc_id").exceptAll(table(spark, d, "labels").select("doc_id"))


@query
def label_intersect(spark, d):
    return table(spark, d, "documents").where("lang = 'en'").select("doc_id").intersect(table(spark, d, "labels").where("quality = 1").select("doc_id"))


@query
def image_entropy_hist(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.explode("embedding").alias("x")).withColumn("v", F.floor((F.col("x").cast("double") + 4) * 4))
    c = e.groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("c"))
    n = c.groupBy("vec_id").agg(F.sum("c").alias("n"), F.sum((F.col("c") * F.log2("c")).cast("decimal(28,12)")).alias("s"))
    return n.select("vec_id", r(F.log2("n") - F.col("s").cast("double") / F.col("n"), 4).alias("entropy"))


@query
def array_hofs(spark, d):
    e = table(spark, d, "embeddings")
    x = F.transform("embedding", lambda v: v.cast("double"))
    return e.select("vec_id", F.size(F.filter(x, lambda v: v > 0)).alias("positive"), r(F.array_max(x), 5).alias("largest"), F.exists(x, lambda v: v > 3).alias("any_big"), F.forall(x, lambda v: v < 10).alias("all_small"), F.size(x).alias("n"))


@query
def json_props_extract(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.size(F.json_object_keys("props")).alias("n_keys"), F.length("props").alias("n_chars"))


@query
def tumbling_rate(spark, d):
    return streams.rates(table(spark, d, "events"))


@query
def sliding_rate(spark, d):
    return streams.rates(table(spark, d, "events"), size="2 hours", slide="1 hour")


@query
def session_gaps(spark, d):
    return streams.sessions(table(spark, d, "events"), gap="6 hours")


@query
def step_planner(spark, d):
    """Step lists for the combinations of wanted steps: each combination is planned once, by the library's planner."""
    kinds = 1 << len(images.STEPS)
    wanted = [[s for i, s in enumerate(images.STEPS) if k & 1 << i] for k in range(kinds)]
    planned = F.array(*[F.struct(F.lit(",".join(images.plan_steps(w)[0])).alias("steps"), F.lit(",".join(images.plan_steps(w, fast=True)[0])).alias("fast")) for w in wanted])
    one = F.element_at(planned, (F.pmod("p_partkey", F.lit(kinds)) + 1).cast("int"))
    return table(spark, d, "part").select(one.alias("p")).groupBy("p.steps", "p.fast").agg(F.count(F.lit(1)).alias("n"))


@query
def otsu_binarize(spark, d):
    """The threshold and the share of white of each vector, taken as pixels."""
    import numpy as np
    import pandas as pd

    def otsu_of(v):
        rows = []
        for x in v:
            px = np.clip((np.asarray(x, float) + 4) * 32, 0, 255).astype(np.uint8)
            rows.append((images.otsu_threshold(px), float((images.binarize(px)[0] == 255).mean())))
        return pd.DataFrame(rows, columns=["threshold", "white"])

    otsu_of.__annotations__ = {"v": pd.Series, "return": pd.DataFrame}
    otsu = F.pandas_udf(otsu_of, "threshold int, white double")
    return table(spark, d, "embeddings").select("vec_id", otsu("embedding").alias("o")).select("vec_id", "o.threshold", "o.white")


# ------------------------------------------------------------------ streams, against what a batch gives


def _events_stream(spark: SparkSession, d: str) -> DataFrame:
    return streams.arriving(spark, f"{d}/events.parquet*", table(spark, d, "events").schema).withColumn("ts", F.col("ts").cast("timestamp"))


@query
def stream_triage(spark, d):
    s = _events_stream(spark, d).select(F.col("event_type").alias("file_type"), (F.col("event_id") % 3 == 0).alias("needs_ocr"))
    return streams.finish(streams.running_summary(s), mode="complete")


@query
def stream_watermark(spark, d):
    """Days that the watermark has closed; the last ones stay open, and events of closed days are dropped."""
    return streams.finish(streams.rates(_events_stream(spark, d), size="1 day"))


@query
def stream_dedupe(spark, d):
    s = _events_stream(spark, d).select(F.col("user_id").alias("file_path"), "ts")
    return streams.finish(streams.unseen(s, within="3650 days")).select("file_path")


from . import more  # noqa: E402  (it uses the tables of this module)

QUERIES.update(more.QUERIES)
ORACLE_SQL = oracles.build() | more.ORACLE_SQL
