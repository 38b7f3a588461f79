"""The catalogue in SQL, written apart from the DataFrame code, for a second engine to check it."""

from __future__ import annotations

from ..config import PRESETS, RELAXED, Config
from ..functions.text import DOCUMENT_TYPES
from ..operators.images import STEPS
from ..sources.files import MIME


def R(x: str, n: int) -> str:
    return f"CAST(round(CAST(({x}) AS DECIMAL(18,9)), {n}) AS DOUBLE)"


def AVG(x: str, n: int) -> str:
    return R(f"CAST(sum(CAST(({x}) AS DECIMAL(28,9))) AS DOUBLE) / count({x})", n)


GRID = f"""grid AS (SELECT concat(l_orderkey, '-', l_linenumber) AS file_path,
 CASE WHEN l_orderkey % 3 <> 0 THEN 'application/pdf' WHEN l_linenumber % 7 = 0 THEN 'text/plain' WHEN l_linenumber % 7 = 1 THEN '{MIME["docx"]}' WHEN l_linenumber % 7 = 2 THEN 'image/png'
  WHEN l_linenumber % 7 = 3 THEN 'application/json' WHEN l_linenumber % 7 = 4 THEN 'application/xhtml+xml' WHEN l_linenumber % 7 = 5 THEN 'application/octet-stream' ELSE 'application/x-other' END AS mime,
 '' AS ext, l_linenumber % 2 = 1 AS is_binary, CAST(l_partkey % 60 AS INT) AS n, l_quantity * 2 AS ic, CAST(round(CAST(l_discount * 1000 AS DECIMAL(18,6)), 3) AS DOUBLE) AS tc,
 CASE WHEN l_suppkey % 11 <> 0 THEN CAST(l_suppkey % 6 AS INT) END AS fonts, CAST(round(CAST(l_tax * 30 AS DECIMAL(18,6)), 3) AS DOUBLE) AS td,
 ((l_orderkey % 5) * 2) / 100.0::DOUBLE AS np, ((l_orderkey % 7) * 2) / 100.0::DOUBLE AS un,
 CASE l_orderkey % 4 WHEN 0 THEN 'text_only' WHEN 1 THEN 'image_only' WHEN 2 THEN 'mixed' ELSE 'unknown' END AS layout, l_orderkey % 4 = 2 AS mixed, l_partkey, l_orderkey, l_linenumber FROM lineitem)"""


def score(c: Config, ic: str = "ic") -> str:
    text = "CASE WHEN n > 0 THEN least(n / 200.0::DOUBLE, 1.0::DOUBLE) ELSE 0.0::DOUBLE END"
    image = f"greatest(0.0::DOUBLE, least({ic} / 100.0::DOUBLE, 1.0::DOUBLE))"
    noise = "greatest(0.0::DOUBLE, least((np + un) / 2.0::DOUBLE, 1.0::DOUBLE))"
    font = "CASE WHEN coalesce(fonts, 0) > 0 THEN least(fonts / 5.0::DOUBLE, 1.0::DOUBLE) ELSE 0.0::DOUBLE END"
    w = [f"{x}::DOUBLE" for x in (c.ocr_score_image_weight, c.ocr_score_noise_weight, c.ocr_score_text_weight, c.ocr_score_font_weight)]
    return R(f"greatest(0.0::DOUBLE, least({image} * {w[0]} + {noise} * {w[1]} + (1.0::DOUBLE - ({text})) * {w[2]} + (1.0::DOUBLE - ({font})) * {w[3]}, 1.0::DOUBLE))", 3)


YES, NO = R("0.5::DOUBLE + ocr_score * 0.45::DOUBLE", 2), R("0.5::DOUBLE + (1.0::DOUBLE - ocr_score) * 0.45::DOUBLE", 2)


def decided(c: Config = Config()) -> str:
    """WITH ... decided AS (file_path, needs_ocr, confidence, ...) over the grid."""
    m = c.min_text_length
    known = "layout <> 'unknown'"
    pdf = "mime = 'application/pdf'"
    ladder = [
        ("text", "mime LIKE 'text/%'", False, "TEXT_FILE", c.high_confidence, 0),
        ("office_text", f"mime LIKE '%officedocument%' AND n >= {c.min_office_text_length}", False, "OFFICE_WITH_TEXT", c.high_confidence, 0),
        ("office", "mime LIKE '%officedocument%'", True, "OFFICE_NO_TEXT", c.medium_confidence, 0),
        ("image", "mime LIKE 'image/%'", True, "IMAGE_FILE", c.high_confidence, 0),
        ("hard_digital", f"{pdf} AND n >= {c.hard_digital_text_threshold}", False, "PDF_DIGITAL", c.high_confidence, 0),
        ("hard_scan", f"{pdf} AND ic >= {c.hard_scan_image_coverage_min} AND n < {c.hard_scan_text_max}", True, "PDF_SCANNED", c.high_confidence, 0),
        ("no_fonts", f"{pdf} AND fonts = 0 AND n < {c.hard_scan_text_max}", True, "PDF_SCANNED", c.high_confidence, 0),
        ("noise", f"{pdf} AND (np > 0.05 OR un > 0.08) AND n > 0 AND ocr_score > 0.6", True, "PDF_SCANNED", None, 0.75),
        ("digital_bias", f"{pdf} AND tc >= {c.digital_bias_text_coverage_min} AND ic <= {c.digital_bias_image_coverage_max} AND n >= {m}", False, "PDF_DIGITAL", None, 0.85),
        ("hybrid_scan", f"{pdf} AND ic / 100.0 > 0.75 AND n < 30", True, "PDF_SCANNED", None, 0.9),
        ("low_text", f"{pdf} AND n < 30 AND {known} AND (ic > 50 OR (mixed AND ic > tc))", True, "PDF_SCANNED", None, 0),
        ("table_bias", f"{pdf} AND mixed AND td >= {c.table_bias_text_density_min} AND tc >= {c.table_bias_text_coverage_min} AND n >= {m}", False, "PDF_DIGITAL", None, 0.8),
        ("mixed_text", f"{pdf} AND mixed AND n >= {m} AND tc > 10", False, "PDF_DIGITAL", None, 0),
        ("mixed", f"{pdf} AND mixed", True, "PDF_MIXED", None, 0),
        ("image_only", f"{pdf} AND layout = 'image_only'", True, "PDF_SCANNED", None, 0.85),
        ("text_only", f"{pdf} AND layout = 'text_only' AND n >= {m}", False, "PDF_DIGITAL", None, 0.85),
        ("text_sparse", f"{pdf} AND layout = 'text_only'", True, "PDF_SCANNED", None, 0),
        ("low_band", f"{pdf} AND ocr_score <= {c.ocr_score_low_band_max}", False, "PDF_DIGITAL", None, 0),
        ("high_band", f"{pdf} AND ocr_score >= {c.ocr_score_high_band_min}", True, "PDF_SCANNED", None, 0),
        ("borderline_text", f"{pdf} AND n >= {m}", False, "PDF_DIGITAL", None, 0),
        ("borderline", pdf, True, "PDF_SCANNED", None, 0),
        ("structured", "mime IN ('application/json', 'application/xml')", False, "STRUCTURED_DATA", c.high_confidence, 0),
        ("html_text", f"mime = 'application/xhtml+xml' AND n >= {m}", False, "HTML_WITH_TEXT", c.high_confidence, 0),
        ("html", "mime = 'application/xhtml+xml'", True, "HTML_MINIMAL", c.low_confidence, 0),
        ("binary", "is_binary", True, "UNKNOWN_BINARY", c.low_confidence, 0),
        ("unknown", "true", True, "UNRECOGNIZED_TYPE", c.low_confidence, 0),
    ]
    rule = "CASE " + " ".join(f"WHEN {w} THEN '{k}'" for k, w, *_ in ladder) + " END"
    pick = lambda f: "CASE rule " + " ".join(f"WHEN '{x[0]}' THEN {f(x)}" for x in ladder) + " END"
    conf = pick(lambda x: f"{x[4]}::DOUBLE" if x[4] is not None else f"greatest({YES if x[2] else NO}, {x[5]}::DOUBLE)")
    return f"""WITH {GRID}, scored AS (SELECT *, {score(c)} AS ocr_score FROM grid), ruled AS (SELECT *, {rule} AS rule FROM scored),
decided AS (SELECT *, {pick(lambda x: str(x[2]).lower())} AS needs_ocr, {conf} AS confidence, {pick(lambda x: f"'{x[3]}'")} AS reason_code, CASE WHEN {pick(lambda x: str(x[2]).lower())} THEN 'unstructured' ELSE 'structured' END AS category FROM ruled)"""


VERDICT = " SELECT file_path, needs_ocr, confidence, category, reason_code, rule, ocr_score FROM decided"


def refined() -> str:
    c = RELAXED
    vs = score(c, "vi")
    return (
        decided(c)
        + f""", seen AS (SELECT *, (l_partkey % 40) * 2.0::DOUBLE AS vt, (l_partkey % 95)::DOUBLE AS vi, CASE l_partkey % 4 WHEN 0 THEN 'mixed' WHEN 1 THEN 'text_only' WHEN 2 THEN 'image_only' ELSE 'unknown' END AS vl, l_partkey % 3 = 0 AS has FROM decided WHERE mime = 'application/pdf'),
s2 AS (SELECT * EXCLUDE (ocr_score, rule), {vs} AS ocr_score FROM seen), s3 AS (SELECT *, {YES} AS yes, {NO} AS no,
 CASE WHEN n >= {c.hard_digital_text_threshold} THEN 'hard_digital' WHEN vi >= 80 AND n < 20 THEN 'hard_scan' WHEN vi / 100.0 > 0.75 AND n < 30 THEN 'hybrid_scan' WHEN vt >= 65 AND vi <= 50 AND n >= 50 THEN 'digital_bias'
  WHEN vl = 'text_only' AND ic > 70 AND n >= 50 THEN 'text_but_images' WHEN vl = 'text_only' AND n >= 50 AND vt > 15 THEN 'text_only' WHEN vl = 'text_only' AND n < 50 AND vt > 10 THEN 'text_unreadable' WHEN vl = 'image_only' THEN 'image_only'
  WHEN vl = 'mixed' AND td >= 1.5 AND vt >= 40 AND n >= 50 THEN 'table_bias' WHEN vl = 'mixed' AND vt > 15 AND n >= 50 THEN 'mixed_text' WHEN vl = 'mixed' THEN 'mixed' WHEN needs_ocr <> has THEN 'confirmed' ELSE 'refined' END AS rule FROM s2),
s4 AS (SELECT file_path, rule, CASE WHEN rule IN ('hard_digital', 'digital_bias', 'text_only', 'table_bias', 'mixed_text') THEN false WHEN rule IN ('confirmed', 'refined') THEN needs_ocr ELSE true END AS needs, needs_ocr AS was, confidence AS c0, reason_code AS rc, yes, no FROM s3)
SELECT file_path, needs AS needs_ocr, rule, CASE WHEN needs THEN 'unstructured' ELSE 'structured' END AS category,
 CASE WHEN rule IN ('confirmed', 'refined') THEN rc WHEN rule IN ('text_but_images', 'mixed') THEN 'PDF_MIXED' WHEN needs THEN 'PDF_SCANNED' ELSE 'PDF_DIGITAL' END AS reason_code,
 CASE rule WHEN 'hard_digital' THEN 0.9 WHEN 'hard_scan' THEN 0.9 WHEN 'hybrid_scan' THEN greatest(yes, 0.9) WHEN 'digital_bias' THEN greatest(no, 0.85) WHEN 'text_but_images' THEN greatest(yes, 0.75) WHEN 'text_only' THEN greatest(no, 0.85) WHEN 'text_unreadable' THEN yes
  WHEN 'image_only' THEN {R("least(c0 * 0.3::DOUBLE + greatest(yes, 0.85::DOUBLE) * 0.7::DOUBLE, 0.9::DOUBLE)", 2)} WHEN 'table_bias' THEN greatest(no, 0.8) WHEN 'mixed_text' THEN no WHEN 'mixed' THEN yes
  WHEN 'confirmed' THEN {R("least(c0 * 0.3::DOUBLE + (CASE WHEN was THEN yes ELSE no END) * 0.7::DOUBLE, 0.9::DOUBLE)", 2)} ELSE {R("least(c0 * 0.5::DOUBLE + (CASE WHEN was THEN yes ELSE no END) * 0.5::DOUBLE, 0.9::DOUBLE)", 2)} END::DOUBLE AS confidence FROM s4"""
    )


HTML = "trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"
ELEMENTS = "elements AS (" + " UNION ALL ".join(
    f"""SELECT page_id, {i} AS rank, '{kind}' AS type, CAST(generate_subscripts(xs, 1) - 1 AS INT) AS ordinal, trim(regexp_replace(regexp_replace(unnest(xs), '(?s)<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM (SELECT page_id, regexp_extract_all(html, '(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>', 1) AS xs FROM pages)"""
    for i, (tag, kind) in enumerate((("h1", "Title"), ("h[2-6]", "Heading"), ("p", "NarrativeText"), ("li", "ListItem")))
) + ")"
LINES = r"lines AS (SELECT doc_id, line, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS text FROM (SELECT doc_id, CAST(generate_subscripts(xs, 1) - 1 AS INT) AS line, unnest(xs) AS raw FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS xs FROM documents)))"
BOXES = "b AS (SELECT l_orderkey AS file_path, l_linenumber AS ordinal, l_linenumber % 2 + 1 AS page, (l_partkey % 500)::DOUBLE AS x0, (l_suppkey * 7 % 750)::DOUBLE AS y0, (l_partkey % 500)::DOUBLE + l_quantity * 3 AS x1, (l_suppkey * 7 % 750)::DOUBLE + l_quantity AS y1, 792.0::DOUBLE AS page_height, l_partkey % 3 + 2 AS columns, concat(l_orderkey, '-', l_linenumber) AS element_id, l_quantity, l_discount, l_tax FROM lineitem)"
PAGES = """p AS (SELECT conv_id AS file_path, CAST(turn + 1 AS INT) AS page_number, concat(coalesce(text, ''), CASE conv_id % 7 WHEN 0 THEN ' Rx dose 5mg PRESCRIPTION rx' WHEN 1 THEN ' lab results: wbc' WHEN 2 THEN ' diagnosis ICD-10' ELSE '' END) AS text,
 length(coalesce(text, '')) AS n, (conv_id % 50)::DOUBLE AS ic, (turn * 17 % 100)::DOUBLE AS tc, conv_id % 13 = 0 AS failed, conv_id % 17 = 0 AS missing FROM conversations)"""
VERDICTS = PAGES + ", v AS (SELECT *, n < 50 AS needs_ocr, CASE WHEN n = 0 THEN 0.8 WHEN n < 50 THEN 0.6 ELSE 0.95 END::DOUBLE AS confidence, CASE WHEN n < 50 THEN 'PDF_PAGE_SCANNED' ELSE 'PDF_PAGE_DIGITAL' END AS reason_code FROM p)"
_NB, _NA = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
#: The label's best pattern: how often its most frequent word occurs (the added tokens are the only hits)
_INTENTS = {
    "prescription": ["prescription", "rx", "medication", "dispense", "dose", "pharmacy"],
    "diagnosis": ["diagnosis", "diagnoses"],
    "chief_complaint": ["chief complaint"],
    "discharge_summary": ["discharge summary", "discharge diagnosis"],
    "lab_report": ["lab", "laboratory", "results?", "hemoglobin", "wbc"],
}


def _hits(word: str) -> str:
    # words are padded, so that neighbouring ones don't share their border
    return rf"len(regexp_extract_all(regexp_replace(lower(text), '([^\p{{L}}\p{{N}}_])', '\1\1', 'g'), '{_NB}{word}{_NA}'))"


def _intent(label: str) -> str:
    hits = [_hits(w) for w in _INTENTS[label]]
    if label == "prescription":
        hits += ["len(regexp_extract_all(text, 'PRESCRIPTION'))", "len(regexp_extract_all(lower(text), 'medications?'))"]
    if label == "diagnosis":
        hits.append(rf"len(regexp_extract_all(lower(text), '{_NB}icd[- ]?[0-9]'))")
    if label == "chief_complaint":
        hits.append(rf"len(regexp_extract_all(lower(text), '{_NB}cc\s*:'))")
    if label == "discharge_summary":
        hits.append("len(regexp_extract_all(text, 'DISCHARGE'))")
    h = f"greatest({', '.join(hits)})"
    return f"CASE WHEN {h} > 0 THEN {R(f'least(0.5::DOUBLE + {h} * 0.1::DOUBLE, 1.0::DOUBLE)', 2)} END AS {label}"


INTENTS = PAGES + ", s AS (SELECT *, " + ", ".join(map(_intent, _INTENTS)) + " FROM p)"


def planned(intent: float, image: float, threshold: float, overrides: bool) -> str:
    crit = "greatest(" + ", ".join(f"coalesce({k}, 0.0)" for k in _INTENTS) + ")::DOUBLE"
    override = "CASE WHEN failed OR missing THEN 'failsafe' WHEN critical >= 0.7 THEN 'intent_critical' END" if overrides else "NULL::VARCHAR"
    total = f"least(1.0::DOUBLE, critical * {intent}::DOUBLE + least(ic / 100.0::DOUBLE, 1.0::DOUBLE) * {image}::DOUBLE + (1.0::DOUBLE - least(tc / 100.0::DOUBLE, 1.0::DOUBLE)) * 0.3::DOUBLE + CASE WHEN n < 20 AND tc < 10 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END)"
    return f"""WITH {INTENTS}, c AS (SELECT *, {crit} AS critical FROM s), d AS (SELECT *, {R(total, 3)} AS score, {override} AS override_reason FROM c),
pl AS (SELECT file_path, page_number, score, override_reason IS NOT NULL OR score >= {threshold} AS needs_ocr, CASE WHEN override_reason IS NULL THEN 'scored' ELSE 'terminal_override' END AS decision_type,
 CASE override_reason WHEN 'failsafe' THEN 0.65::DOUBLE WHEN 'intent_critical' THEN critical ELSE {R(f"greatest(0.0::DOUBLE, least(0.5::DOUBLE + abs(score - {threshold}::DOUBLE), 1.0::DOUBLE))", 3)} END AS confidence, override_reason FROM d)"""


RESULTS = """r AS (SELECT event_id::VARCHAR AS file_path, CASE WHEN event_id % 9 <> 0 THEN event_type END AS file_type, event_id % 3 = 0 AS needs_ocr, CASE WHEN event_id % 20 = 0 THEN 'broken' END AS error,
 CASE event_id % 3 WHEN 0 THEN 'PDF_SCANNED' WHEN 1 THEN 'PDF_DIGITAL' ELSE 'TEXT_FILE' END AS reason_code, (event_id % 100) / 100.0::DOUBLE AS confidence, value, ts, user_id, event_type FROM events)"""
LABELLED = "l AS (SELECT doc_id, lang, quality = 0 AS actual, least(n_chars, 2000) / 2000.0::DOUBLE AS score, n_chars < 900 AS predicted FROM documents JOIN labels USING (doc_id))"


def _confusion(by: str = "", source: str = "l") -> str:
    share = lambda a, b: R(f"coalesce(({a}) * 100.0::DOUBLE / nullif({b}, 0), 0.0::DOUBLE)", 2)
    g = f"SELECT {by + ', ' if by else ''}count(*) FILTER (predicted AND actual) AS tp, count(*) FILTER (predicted AND NOT actual) AS fp, count(*) FILTER (NOT predicted AND NOT actual) AS tn, count(*) FILTER (NOT predicted AND actual) AS fn FROM {source} {'GROUP BY ' + by if by else ''}"
    return f"SELECT *, {share('tp + tn', 'tp + fp + tn + fn')} AS accuracy, {share('tp', 'tp + fp')} AS precision, {share('tp', 'tp + fn')} AS recall, {share('tp * 2', 'tp * 2 + fp + fn')} AS f1 FROM ({g})"


def _latency(by: str = "") -> str:
    return f"SELECT {by + ', ' if by else ''}count(*) AS n, min(value) AS min, max(value) AS max, {AVG('value', 4)} AS mean, {R('median(value)', 4)} AS median, list_sort(list(value))[CAST(floor(count(*) * 0.95) AS INT) + 1] AS p95 FROM events WHERE value IS NOT NULL {'GROUP BY ' + by if by else ''}"


TOKEN = "CASE doc_id % 9 WHEN 0 THEN ' Invoice number: 77 total USD 12.50' WHEN 1 THEN ' receipt GST $3.99' WHEN 2 THEN ' Product catalogue £5' WHEN 3 THEN ' user guide €7.25' WHEN 4 THEN ' services' WHEN 5 THEN ' abc$9.10' ELSE '' END"
ITEMS = "li AS (SELECT l_orderkey AS file_path, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS ordinal, concat(' Part  ', l_partkey % 3) AS description, 5.0::DOUBLE AS unit_price, l_quantity AS quantity, CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity * 5 END AS total FROM lineitem)"
CELLS = ITEMS + ", cells AS (SELECT file_path, ordinal AS row, CAST(generate_subscripts(xs, 1) - 1 AS INT) AS col, unnest(xs) AS text FROM (SELECT file_path, ordinal, [trim(description), '5.00', CAST(CAST(quantity AS INT) AS VARCHAR), coalesce(CAST(CAST(total AS INT) AS VARCHAR), '')] AS xs FROM li))"
WORDS = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+'))"


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    q["triage_by_reason"] = decided() + f" SELECT reason_code, needs_ocr, count(*) AS n, {AVG('confidence', 4)} AS avg_confidence FROM decided GROUP BY ALL"
    for name, c in {"decide_default": Config(), "decide_relaxed": RELAXED, **{f"decide_preset_{k}": v for k, v in PRESETS.items()}}.items():
        q[name] = decided(c) + VERDICT
    q["ocr_score"] = f"WITH {GRID} SELECT file_path, {score(Config())} AS ocr_score FROM grid"
    by_layout = "CASE WHEN n < 30 THEN 0.6::DOUBLE + least(ic / 100.0::DOUBLE, 1.0::DOUBLE) * 0.3::DOUBLE ELSE 0.7::DOUBLE + least(tc / 100.0::DOUBLE, 1.0::DOUBLE) * 0.25::DOUBLE END"
    by_length = "CASE WHEN n < 30 THEN CASE WHEN n = 0 THEN 0.65::DOUBLE ELSE 0.55::DOUBLE + (1.0::DOUBLE - least(n / 50.0::DOUBLE, 1.0::DOUBLE)) * 0.2::DOUBLE END ELSE 0.75::DOUBLE + least(n / 1000.0::DOUBLE, 1.0::DOUBLE) * 0.2::DOUBLE END"
    q["confidence_modes"] = f"WITH {GRID}, x AS (SELECT *, {score(Config())} AS ocr_score FROM grid) SELECT file_path, {R(f"CASE WHEN layout <> 'unknown' THEN {by_layout} ELSE {by_length} END", 2)} AS plain, CASE WHEN n < 30 THEN {YES} ELSE {NO} END AS scored FROM x"
    raw = "least(1.0::DOUBLE, lc * 0.3::DOUBLE + ic / 100.0::DOUBLE * 0.35::DOUBLE + (CASE WHEN n < 20 THEN 0.3 WHEN n < 50 THEN 0.2 ELSE 0.0 END)::DOUBLE * 0.25::DOUBLE + (CASE WHEN ic / 100.0::DOUBLE > 0.6::DOUBLE THEN 0.1 ELSE 0.0 END)::DOUBLE * 0.1::DOUBLE)"
    q["hints_engine"] = decided(RELAXED) + f""", h AS (SELECT *, (CASE l_partkey % 3 WHEN 0 THEN 0.2 WHEN 1 THEN 0.4 ELSE 0.6 END)::DOUBLE AS lc FROM decided), h2 AS (SELECT *, {raw} AS raw FROM h)
 SELECT file_path, CASE WHEN needs_ocr THEN CASE WHEN raw < 0.3::DOUBLE THEN 'tesseract' WHEN raw < 0.7::DOUBLE THEN 'paddle' ELSE 'vision_llm' END END AS engine,
 CASE WHEN needs_ocr THEN array_to_string(list_filter([CASE WHEN ic > 60 OR lc >= 0.4 THEN 'deskew' END, CASE WHEN ic > 50 OR n < 30 THEN 'otsu' END, CASE WHEN ic > 70 THEN 'denoise' END], lambda x: x IS NOT NULL), ',') END AS steps, CASE WHEN needs_ocr THEN {R("raw", 2)} ELSE 0.0::DOUBLE END AS complexity FROM h2"""
    mode = "CASE WHEN NOT (mime = 'application/pdf' AND confidence < {exit} AND NOT (confidence >= 0.75 AND ic <= 50){skip}) THEN 'none' WHEN confidence >= {light} AND confidence < 0.75 THEN 'light' ELSE 'full' END AS refine_mode"
    q["vision_gate"] = decided(RELAXED) + " SELECT file_path, " + mode.format(exit=0.9, light=0.5, skip="") + " FROM decided"
    q["vision_gate_skips"] = decided(RELAXED) + " SELECT file_path, " + mode.format(exit=0.9, light=0.4, skip=" AND NOT (l_partkey * 5000 / 1048576.0 >= 20 OR l_partkey % 200 >= 50)") + " FROM decided"
    q["refine_ladder"] = refined()
    q["file_type_category"] = f"WITH {GRID} SELECT CASE WHEN mime LIKE 'image/%' THEN 'image' WHEN mime = 'application/pdf' THEN 'pdf' WHEN mime LIKE '%officedocument%' THEN 'office' WHEN mime LIKE 'text/%' THEN 'text' WHEN mime = 'application/json' THEN 'structured' ELSE 'unknown' END AS file_type, count(*) AS n FROM grid GROUP BY 1"
    exts = list(MIME) + ["zip", "bin"]
    values = ", ".join(f"({i}, '{e}', '{MIME.get(e, 'application/octet-stream')}')" for i, e in enumerate(exts))
    q["mime_dimension"] = f"SELECT ext, mime, count(*) AS n FROM part JOIN (VALUES {values}) t(i, ext, mime) ON p_partkey % {len(exts)} = i GROUP BY ALL"
    q["magic_bytes"] = "SELECT mime, mime <> 'text/plain' AS is_binary, count(*) AS n FROM (SELECT CASE p_partkey % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/gif' WHEN 2 THEN 'image/bmp' ELSE 'text/plain' END AS mime FROM part) GROUP BY ALL"
    t = "substr(concat(CASE WHEN doc_id % 5 = 0 THEN concat(chr(8203), chr(8203), chr(1), chr(65533)) ELSE '' END, text), 1, 1000)"
    q["text_quality"] = rf"""WITH t AS (SELECT doc_id, {t} AS t FROM documents), w AS (SELECT *, regexp_extract_all(t, '[\p{{L}}\p{{M}}\p{{N}}_]+') AS ws FROM t)
 SELECT doc_id, CASE WHEN length(t) >= 10 THEN {R(r"length(regexp_replace(t, '[^\p{Cc}\p{Cf}\p{Co}]|[\t\n\x0B\f\r\x1C-\x1F\x{85}]', '', 'g')) / length(t)::DOUBLE", 4)} END AS non_printable_ratio,
 CASE WHEN length(t) >= 10 THEN {R(r"length(regexp_replace(t, '[^\x{FFFD}\p{Cf}\p{Co}]', '', 'g')) / length(t)::DOUBLE", 4)} END AS unicode_noise_ratio,
 CASE WHEN length(t) >= 10 THEN CASE WHEN len(ws) > 0 THEN {R("list_sum(list_transform(ws, lambda x: length(x)))::DOUBLE / len(ws)", 2)} ELSE 0.0 END END AS avg_word_length FROM w"""
    q["meaningful_text"] = r"SELECT lang, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 50 AS meaningful, count(*) AS n FROM documents GROUP BY ALL"
    q["text_probe_truncate"] = "SELECT doc_id, length(text) AS text_length, length(substr(text, 1, 1000)) AS probe_length, md5(substr(text, 1, 1000)) AS probe_md5 FROM documents"
    q["html_text"] = f"SELECT page_id, {HTML} AS text FROM pages"
    q["html_elements"] = f"WITH {ELEMENTS} SELECT page_id, rank, ordinal, type, text FROM elements WHERE text <> ''"
    q["html_element_counts"] = f"WITH {ELEMENTS} SELECT type, count(*) AS n, sum(length(text)) AS chars FROM elements WHERE text <> '' GROUP BY 1"
    q["plain_text_elements"] = f"WITH {LINES} SELECT doc_id, count(*) AS n, max(line * 20.0::DOUBLE) AS last_y, sum(length(text)) AS chars FROM lines WHERE text <> '' GROUP BY 1"
    q["element_ids"] = f"WITH {LINES} SELECT doc_id, line, substr(sha256(concat(doc_id, ':', line)), 1, 12) AS element_id FROM lines WHERE text <> ''"
    q["reading_order"] = f"WITH {BOXES} SELECT file_path, ordinal, row_number() OVER (PARTITION BY file_path ORDER BY page, y0, x0, ordinal) - 1 AS reading_order FROM b"
    q["element_confidence"] = f"WITH {BOXES} SELECT element_id, {R('greatest(0.0::DOUBLE, least(l_discount * 10 * 0.3::DOUBLE + 0.9::DOUBLE * 0.3::DOUBLE + l_tax * 10 * 0.2::DOUBLE + 1.0::DOUBLE * 0.2::DOUBLE, 1.0::DOUBLE))', 4)} AS confidence FROM b"
    q["element_types"] = f"WITH {BOXES} SELECT CASE WHEN l_quantity / 2 > 16 AND abs((x0 + x1) / 2 - 306) < 61.2 AND y0 < page_height * 0.2 THEN 'Title' WHEN l_quantity / 2 > 12 AND ordinal % 2 = 0 THEN 'Heading' ELSE 'NarrativeText' END AS type, count(*) AS n FROM b GROUP BY 1"
    q["elements_in_cells_anti"] = f"WITH {BOXES} SELECT file_path, ordinal FROM b e WHERE ordinal % 2 = 0 AND NOT EXISTS (SELECT 1 FROM b c WHERE c.ordinal % 2 = 1 AND c.file_path = e.file_path AND (e.x0 + e.x1) / 2 BETWEEN c.x0 AND c.x1 + 100 AND (e.y0 + e.y1) / 2 BETWEEN c.y0 AND c.y1 + 100)"
    inter = "greatest(0.0, least(i.x1, t.x1) - greatest(i.x0, t.x0)) * greatest(0.0, least(i.y1, t.y1) - greatest(i.y0, t.y0))"
    q["region_iou_anti"] = f"WITH {BOXES} SELECT file_path, ordinal FROM b i WHERE ordinal % 2 = 0 AND NOT EXISTS (SELECT 1 FROM b t WHERE t.ordinal % 2 = 1 AND t.file_path = i.file_path AND {inter} / ((i.x1 - i.x0) * (i.y1 - i.y0) + (t.x1 - t.x0) * (t.y1 - t.y0) - {inter}) >= 0.2)"
    q["band_self_join"] = f"WITH {BOXES} SELECT a.file_path, min(c.ordinal) AS first_near FROM b a JOIN b c ON a.file_path = c.file_path AND a.ordinal = 1 AND c.ordinal > 1 AND abs(a.y0 - c.y0) < 30 GROUP BY 1"
    q["zone_tag_filter"] = f"WITH {BOXES} SELECT y0 < page_height * 0.1 AS in_header, y1 > page_height * 0.9 AS in_footer, count(*) AS n FROM b GROUP BY ALL"
    q["sections"] = f"WITH {BOXES}, z AS (SELECT file_path, page, ordinal, 'header' AS section FROM b WHERE y0 < page_height * 0.1 UNION ALL SELECT file_path, page, ordinal, 'footer' FROM b WHERE y1 > page_height * 0.9 UNION ALL SELECT file_path, page, ordinal, 'body' FROM b WHERE NOT y0 < page_height * 0.1 AND NOT y1 > page_height * 0.9) SELECT file_path, page, section, string_agg(ordinal::VARCHAR, ',' ORDER BY ordinal) AS ids FROM z GROUP BY ALL"
    q["section_prune"] = f"WITH {BOXES} SELECT file_path, count(*) AS n FROM b WHERE NOT y1 > page_height * 0.9 GROUP BY 1"
    q["page_verdicts"] = f"WITH {VERDICTS} SELECT file_path, page_number, needs_ocr, confidence, reason_code FROM v"
    q["page_rollup"] = f"WITH {VERDICTS}, g AS (SELECT file_path, count(*) AS page_count, count(*) FILTER (needs_ocr) AS pages_needing_ocr, count(*) FILTER (NOT needs_ocr) AS pages_with_text, sum(confidence::DECIMAL(28,9))::DOUBLE / count(*) AS m FROM v GROUP BY 1) SELECT file_path, page_count, pages_needing_ocr, pages_with_text, pages_needing_ocr > 0 AS needs_ocr, CASE WHEN pages_needing_ocr = 0 THEN 'PDF_DIGITAL' WHEN pages_needing_ocr = page_count THEN 'PDF_SCANNED' ELSE 'PDF_MIXED' END AS reason_code, {R('greatest(0.0::DOUBLE, least(m + CASE WHEN pages_needing_ocr IN (0, page_count) THEN 0.1::DOUBLE ELSE -0.1::DOUBLE END, 1.0::DOUBLE))', 2)} AS confidence FROM g"
    q["variance_escalation"] = f"WITH {PAGES}, g AS (SELECT file_path, count(*) AS c, {R('stddev_pop(CASE WHEN n < 50 THEN 1.0 ELSE 0.0 END)', 6)} AS page_std FROM p GROUP BY 1) SELECT file_path, c >= 3 AND page_std <= 0.18 AS reuse_verdict, page_std FROM g"
    q["page_override_guard"] = decided(RELAXED) + " SELECT NOT (NOT needs_ocr AND ((tc >= 65 AND ic <= 50 AND n >= 50) OR (td >= 1.5 AND tc >= 40 AND n >= 50))) AS page_override, needs_ocr, count(*) AS n FROM decided GROUP BY ALL"
    lay = "CASE WHEN {t} > 10 AND {i} < 5 THEN 'text_only' WHEN {i} > 10 AND {t} < 5 AND {c} < 50 THEN 'image_only' WHEN {t} > 5 AND {i} > 5 THEN 'mixed' WHEN {c} >= 50 THEN 'text_only' ELSE 'unknown' END"
    q["layout_type"] = f"WITH {GRID} SELECT {lay.format(t='tc', i='ic', c='n')} AS layout, count(*) AS n FROM grid GROUP BY 1"
    q["layout_rollup"] = f"""WITH x AS (SELECT l_orderkey AS file_path, 484704.0::DOUBLE AS a, least(l_quantity * 12000, 484704.0) AS t, least((l_partkey % 40 * 13000)::DOUBLE, 484704.0) AS i, l_partkey % 900 AS c FROM lineitem), g AS (SELECT file_path, sum(t::DECIMAL(28,9))::DOUBLE AS t, sum(i::DECIMAL(28,9))::DOUBLE AS i, sum(a::DECIMAL(28,9))::DOUBLE AS a, sum(c)::BIGINT AS chars FROM x GROUP BY 1), h AS (SELECT file_path, chars, {R("t * 100.0::DOUBLE / a", 2)} AS text_coverage, {R("i * 100.0::DOUBLE / a", 2)} AS image_coverage, {R("chars * 1000.0::DOUBLE / a", 2)} AS text_density FROM g)
 SELECT *, {lay.format(t="text_coverage", i="image_coverage", c="chars")} AS layout_type, {lay.format(t="text_coverage", i="image_coverage", c="chars")} = 'mixed' AS is_mixed_content FROM h"""
    q["vision_rollup"] = f"WITH x AS (SELECT l_orderkey AS file_path, 1000.0::DOUBLE AS a, l_quantity AS tc, l_partkey % 9 AS t, l_suppkey % 4 AS i FROM lineitem), g AS (SELECT file_path, sum(t)::BIGINT AS text_regions, sum(i)::BIGINT AS image_regions, bool_or(t > 0) AS has_text_regions, bool_or(i > 0) AS has_image_regions, {R('sum((tc * a)::DECIMAL(28,9))::DOUBLE / sum(a::DECIMAL(28,9))::DOUBLE', 2)} AS text_coverage FROM x GROUP BY 1) SELECT *, CASE WHEN text_regions + image_regions < 10 THEN 'simple' WHEN text_regions + image_regions < 30 THEN 'moderate' ELSE 'complex' END AS layout_complexity, CASE WHEN has_text_regions AND has_image_regions THEN 'mixed' WHEN has_text_regions THEN 'text_only' WHEN has_image_regions THEN 'image_only' ELSE 'unknown' END AS layout_type FROM g"
    q["intent_scores"] = f"WITH {INTENTS} SELECT file_path, page_number, {', '.join(_INTENTS)} FROM s"
    best = f"greatest({', '.join(f'coalesce({k}, 0.0)' for k in _INTENTS)})"
    q["intent_top_label"] = f"WITH {INTENTS} SELECT CASE WHEN {best} = 0 THEN NULL {' '.join(f'WHEN {k} = {best} THEN {chr(39)}{k}{chr(39)}' for k in _INTENTS)} END AS label, count(*) AS n FROM s GROUP BY 1"
    plan = "SELECT file_path, page_number, score, needs_ocr, decision_type, confidence, override_reason FROM pl"
    q["planner_pages"] = f"{planned(0.6, 0.3, 0.6, True)} {plan}"
    q["planner_pages_generic"] = f"{planned(0.0, 0.2, 0.65, False)} {plan}"
    q["planner_rollup"] = planned(0.6, 0.3, 0.6, True) + f", g AS (SELECT file_path, coalesce(string_agg((page_number - 1)::VARCHAR, ',' ORDER BY page_number) FILTER (needs_ocr), '') AS pages_needing_ocr, count(*) AS page_count, count(*) FILTER (needs_ocr) AS k, {AVG('confidence', 6)} AS m FROM pl GROUP BY 1) SELECT file_path, pages_needing_ocr, page_count, k > 0 AS needs_ocr_any, {R('greatest(0.0::DOUBLE, least(m + CASE WHEN k IN (0, page_count) THEN 0.1::DOUBLE ELSE -0.1::DOUBLE END, 1.0::DOUBLE))', 2)} AS overall_confidence FROM g"
    q["planner_exits"] = decided(RELAXED) + " SELECT CASE WHEN confidence >= 0.85 THEN 'confidence_exit' WHEN l_partkey % 4 = 0 THEN 'fallback' WHEN ic / 3 < 10 THEN 'fast_path' ELSE 'full' END AS exit, count(*) AS n FROM decided GROUP BY 1"
    q["override_histogram"] = planned(0.6, 0.3, 0.6, True) + " SELECT override_reason, count(*) AS n FROM pl WHERE override_reason IS NOT NULL GROUP BY 1"
    q["page_layout_left_join"] = f"WITH {PAGES} SELECT file_path, page_number, n AS text_length, CASE WHEN page_number % 3 <> 0 THEN page_number * 10.0::DOUBLE ELSE 0.0 END AS image_coverage, page_number % 3 = 0 AS layout_missing FROM p"
    q["batch_stats"] = f"WITH {RESULTS} SELECT count(*) AS total, count(*) FILTER (error IS NULL) AS processed, count(*) FILTER (error IS NOT NULL) AS errors, count(*) FILTER (error IS NULL AND needs_ocr) AS needs_ocr, count(*) FILTER (error IS NULL AND NOT needs_ocr) AS no_ocr, {R('count(*) FILTER (error IS NULL) / 5.0::DOUBLE', 3)} AS files_per_second FROM r"
    q["batch_by_type"] = f"WITH {RESULTS} SELECT coalesce(file_type, 'unknown') AS file_type, count(*) AS total, count(*) FILTER (needs_ocr) AS needs_ocr FROM r WHERE error IS NULL GROUP BY 1"
    q["batch_by_reason"] = f"WITH {RESULTS} SELECT reason_code, count(*) AS n FROM r WHERE error IS NULL GROUP BY 1"
    q["batch_grouping_sets"] = f"WITH {RESULTS} SELECT file_type, reason_code, count(*) AS n, count(*) FILTER (needs_ocr) AS needs_ocr FROM r GROUP BY GROUPING SETS ((file_type), (reason_code), ())"
    q["batch_cube"] = f"WITH {RESULTS} SELECT file_type, needs_ocr, count(*) AS n FROM r GROUP BY CUBE (file_type, needs_ocr)"
    q["batch_rollup"] = f"WITH {RESULTS} SELECT file_type, reason_code, count(*) AS n, sum(value::DECIMAL(28,9))::DECIMAL(18,4)::DOUBLE AS value FROM r GROUP BY ROLLUP (file_type, reason_code)"
    q["resume_anti_join"] = "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"
    q["resume_skipped_count"] = "SELECT count(*) AS skipped FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"
    q["ext_size_filter"] = "SELECT doc_id, concat(doc_id, '.txt') AS file_path, n_chars FROM documents WHERE n_chars BETWEEN 1000 AND 10000"
    q["cache_key"] = "SELECT doc_id, md5(concat(doc_id, '.txt:', n_chars)) AS cache_key FROM documents"
    q["cache_ttl"] = "WITH l AS (SELECT user_id, max(ts) AS written_at FROM events GROUP BY 1) SELECT user_id, written_at FROM l WHERE written_at > (SELECT max(written_at) FROM l) - INTERVAL 86400 SECONDS"
    q["confusion_matrix"] = f"WITH {LABELLED} {_confusion()}"
    q["confusion_by_type"] = f"WITH {LABELLED} {_confusion('lang')}"
    q["threshold_sweep"] = f"WITH {LABELLED}, x AS (SELECT threshold, actual, score >= threshold AS predicted FROM l, (SELECT unnest([0.4::DOUBLE, 0.5, 0.6, 0.7, 0.8]) AS threshold)) {_confusion('threshold', 'x')}"
    a, b = decided(), decided(PRESETS["cost"])
    q["agreement_rate"] = f"SELECT count(*) AS n, {AVG('CASE WHEN a = b THEN 1.0 ELSE 0.0 END', 4)} AS agreement FROM ({a} SELECT file_path, needs_ocr AS a FROM decided) JOIN ({b} SELECT file_path, needs_ocr AS b FROM decided) USING (file_path)"
    q["latency_stats"], q["latency_by_type"] = _latency(), _latency("event_type")
    q["latency_by_decile"] = f"WITH {RESULTS} SELECT CAST(floor(confidence * 10) * 10 AS BIGINT) AS decile, count(*) AS n, {AVG('value', 4)} AS mean FROM r GROUP BY 1"
    q["report_summary"] = decided() + f" SELECT count(*) AS total, count(*) FILTER (needs_ocr) AS needs_ocr, count(*) FILTER (NOT needs_ocr) AS digital, {AVG('confidence', 4)} AS avg_confidence, {R('count(*) FILTER (needs_ocr) * 100.0::DOUBLE / count(*)', 2)} AS needs_ocr_percent FROM decided"
    kind = "CASE WHEN mime LIKE 'image/%' THEN 'image' WHEN mime = 'application/pdf' THEN 'pdf' WHEN mime LIKE '%officedocument%' THEN 'office' WHEN mime LIKE 'text/%' THEN 'text' WHEN mime = 'application/json' THEN 'structured' ELSE 'unknown' END"
    q["html_report_rows"] = decided() + f""" SELECT concat('<a>&', file_path) AS file_path, concat('<tr class="', CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END, '"><td>&lt;a&gt;&amp;', file_path, '</td><td>', {kind}, '</td><td>', CASE WHEN needs_ocr THEN 'yes' ELSE 'no' END, '</td><td>', printf('%.2f', confidence), '</td></tr>') AS row_html FROM decided"""
    q["jaccard_duplicates"] = f"WITH d AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents), i AS (SELECT item_id, {WORDS.format('text')} AS w FROM benchmark), c AS (SELECT doc_id, item_id, count(*) AS k FROM (SELECT doc_id, unnest(w) AS x FROM d) JOIN (SELECT item_id, unnest(w) AS x FROM i) USING (x) GROUP BY ALL) SELECT doc_id, item_id, {R('k / (len(d.w) + len(i.w) - k)::DOUBLE', 4)} AS jaccard FROM c JOIN d USING (doc_id) JOIN i USING (item_id) WHERE {R('k / (len(d.w) + len(i.w) - k)::DOUBLE', 4)} >= 0.2"
    types = " ".join(f"WHEN {' OR '.join(f'contains(t, {chr(39)}{w}{chr(39)})' for w in ws)} THEN '{k}'" for k, ws in DOCUMENT_TYPES.items())
    q["doc_type_detect"] = f"SELECT CASE {types} END AS doc_type, count(*) AS n FROM (SELECT lower(concat(text, {TOKEN})) AS t FROM documents) GROUP BY 1"
    q["currency_detect"] = f"SELECT CASE WHEN contains(u, 'GST') OR contains(u, 'VIC') OR contains(u, 'AUD') THEN 'AUD' WHEN contains(u, 'USD') OR contains(t, 'US$') THEN 'USD' WHEN contains(u, 'EUR') OR contains(t, '€') THEN 'EUR' WHEN contains(u, 'GBP') OR contains(t, '£') THEN 'GBP' WHEN contains(u, 'INR') OR contains(t, '₹') THEN 'INR' END AS currency, count(*) AS n FROM (SELECT trim({TOKEN}) AS t, upper(trim({TOKEN})) AS u FROM documents) GROUP BY 1"
    q["money_parse"] = rf"SELECT doc_id, try_cast(regexp_extract(trim({TOKEN}), '[\$₹€£]?\s*(\d+\.?\d*)', 1) AS DOUBLE) AS money, try_cast(regexp_extract(trim({TOKEN}), '(\d+)', 1) AS INT) AS whole FROM documents"
    q["price_spacing"] = rf"SELECT regexp_replace(trim({TOKEN}), '([A-Za-z])(\$\d)', '\1 \2', 'g') AS token, count(*) AS n FROM documents GROUP BY 1"
    q["invoice_build"] = rf"WITH {ITEMS} SELECT file_path, count(*) AS n_lines, arg_min(regexp_replace(trim(lower(description)), '\s+', ' ', 'g'), ordinal) AS first_description, sum(quantity) AS quantity, arg_max(quantity, ordinal) AS last_quantity FROM li GROUP BY 1"
    q["invoice_validate"] = f"WITH {ITEMS}, g AS (SELECT file_path, sum(coalesce(total, unit_price * quantity)::DECIMAL(18,2))::DOUBLE AS lines_total, count(*) AS n_lines, sum(quantity) * 5 + CASE WHEN file_path % 4 = 0 THEN 1.0 ELSE 0.0 END AS stated FROM li GROUP BY 1) SELECT file_path, lines_total, n_lines, abs(round(stated, 2) - lines_total) <= 0.01 AS matches FROM g"
    q["line_item_dedupe"] = f"WITH {ITEMS} SELECT file_path, min(ordinal) AS ordinal FROM li GROUP BY file_path, description"
    good = r"bool_or(regexp_matches(lower(text), 'item|description|price|quantity|total')) AS head"
    q["table_confidence"] = rf"WITH {CELLS}, r AS (SELECT file_path, row, count(*) AS c, count(*) FILTER (trim(text) = '') AS e, count(*) FILTER (regexp_full_match(trim(text), '-?[\d,. ]*\d[\d,. ]*')) AS k, {good} FROM cells GROUP BY ALL), g AS (SELECT file_path, count(*) AS n_rows, sum(c)::BIGINT AS n_cells, sum(e)::BIGINT AS empty, count(*) FILTER (head OR k > 0) AS good, min(c) = max(c) AS even FROM r GROUP BY 1), h AS (SELECT *, empty::DOUBLE / n_cells AS q FROM g) SELECT file_path, n_rows, n_cells, empty, " + R("0.9::DOUBLE * 0.4::DOUBLE + good::DOUBLE / n_rows * 0.2::DOUBLE + 0.2::DOUBLE + (CASE WHEN q <= 0.2 THEN 1.0::DOUBLE WHEN q <= 0.5 THEN 1.0::DOUBLE - (q - 0.2::DOUBLE) * 0.5::DOUBLE ELSE greatest(0.0::DOUBLE, 0.85::DOUBLE - (q - 0.5::DOUBLE)) END) * 0.1::DOUBLE + (CASE WHEN even THEN 1.0 ELSE 0.7 END)::DOUBLE * 0.1::DOUBLE", 2) + " AS confidence FROM h"
    q["numeric_parse"] = "SELECT parsed, parsed IS NULL AS failed, count(*) AS n FROM (SELECT CASE doc_id % 4 WHEN 0 THEN 1234.5::DOUBLE WHEN 2 THEN 77.0::DOUBLE END AS parsed FROM documents) GROUP BY ALL"
    q["duplicate_ids"] = f"WITH {BOXES}, e AS (SELECT file_path, ordinal % 3 AS id, count(*) AS c FROM b GROUP BY ALL), o AS (SELECT DISTINCT file_path, ordinal % 5 AS id FROM b) SELECT file_path, 'DUPLICATE_ID' AS code, 'error' AS severity, count(*) AS n FROM e WHERE c > 1 GROUP BY 1 UNION ALL SELECT file_path, 'DANGLING_ORDER', 'warning', count(*) FROM o WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.file_path = o.file_path AND e.id = o.id) GROUP BY 1"
    q["markdown_table"] = f"WITH {CELLS}, r AS (SELECT file_path, row, '| ' || string_agg(text, ' | ' ORDER BY col) || ' |' AS line FROM cells GROUP BY ALL), x AS (SELECT file_path, row, line, row_number() OVER (PARTITION BY file_path ORDER BY row) AS k FROM r) SELECT file_path, string_agg(CASE WHEN k = 1 THEN line || chr(10) || '| --- | --- | --- | --- |' ELSE line END, chr(10) ORDER BY row) AS markdown FROM x GROUP BY 1"
    q["markdown_page"] = f"WITH {ELEMENTS} SELECT page_id, string_agg(concat(CASE type WHEN 'Title' THEN '# ' WHEN 'Heading' THEN '## ' WHEN 'ListItem' THEN '- ' ELSE '' END, text), chr(10) || chr(10) ORDER BY rank, ordinal) AS markdown FROM elements WHERE text <> '' GROUP BY 1"
    q["page_union_distinct"] = f"WITH {BOXES} SELECT file_path, page FROM b WHERE ordinal <= 3 UNION SELECT file_path, page FROM b WHERE ordinal >= 2 UNION SELECT file_path, page FROM b WHERE columns = 3"
    q["resume_except"] = "SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels"
    q["label_intersect"] = "SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels WHERE quality = 1"
    q["image_entropy_hist"] = f"WITH e AS (SELECT vec_id, floor((x::DOUBLE + 4) * 4) AS v FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings)), c AS (SELECT vec_id, v, count(*) AS c FROM e GROUP BY ALL), n AS (SELECT vec_id, sum(c) AS n, sum((c * log2(c))::DECIMAL(28,12)) AS s FROM c GROUP BY 1) SELECT vec_id, {R('log2(n) - s::DOUBLE / n', 4)} AS entropy FROM n"
    q["array_hofs"] = f"SELECT vec_id, CAST(len(list_filter(embedding, lambda v: v > 0)) AS INT) AS positive, {R('list_max(embedding)::DOUBLE', 5)} AS largest, list_max(embedding) > 3 AS any_big, list_max(embedding) < 10 AS all_small, CAST(len(embedding) AS INT) AS n FROM embeddings"
    q["json_props_extract"] = "SELECT event_id, CAST(len(json_keys(props)) AS INT) AS n_keys, length(props) AS n_chars FROM events"
    q["tumbling_rate"] = "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL"
    q["sliding_rate"] = "SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY ALL"
    q["session_gaps"] = 'WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM x) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS "end", count(*) AS n FROM s GROUP BY user_id, k'
    want = ", ".join(f"CASE WHEN p_partkey & {1 << i} <> 0 {'OR p_partkey & 4 <> 0' if s == 'denoise' else ''} THEN '{s}' END" for i, s in enumerate(STEPS))
    slow = ", ".join(f"CASE WHEN p_partkey & {1 << i} <> 0 THEN '{s}' END" for i, s in enumerate(STEPS) if s in ("deskew", "otsu"))
    q["step_planner"] = f"SELECT array_to_string(list_filter([{want}], lambda x: x IS NOT NULL), ',') AS steps, array_to_string(list_filter([{slow}], lambda x: x IS NOT NULL), ',') AS fast, count(*) AS n FROM part GROUP BY ALL"
    return q
