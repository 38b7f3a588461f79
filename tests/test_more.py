"""Greedy groupings against plain Python, readers and drivers on files, sinks, image steps."""

import io
import json
import random
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioworks.operators import batch, drivers, extract, images, lines, markdown, tables
from folioworks.operators.similar import similar_to
from folioworks.sinks import outputs
from folioworks.sources import files, office, pdf


def pdf_bytes(pages, compress=True, extra=b""):
    """A small PDF: one content stream a page, one font, one image."""
    n = len(pages)
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (5 + 2 * i) for i in range(n)) + b"] /Count %d /MediaBox [0 0 612 792] >>" % n]
    objects += [b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica-Bold >>", b"<< /Type /XObject /Subtype /Image /Width 2 /Height 2 /Length 0 >>\nstream\n\nendstream"]
    for i, content in enumerate(pages):
        body = zlib.compress(content) if compress else content
        objects.append(b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Resources << /Font << /F1 3 0 R >> /XObject << /I1 4 0 R >> >> >>" % (6 + 2 * i))
        objects.append(b"<< " + (b"/Filter /FlateDecode " if compress else b"") + b"/Length %d >>\nstream\n" % len(body) + body + b"\nendstream")
    return b"%PDF-1.4\n" + extra + b"".join(b"%d 0 obj\n" % (i + 1) + o + b"\nendobj\n" for i, o in enumerate(objects)) + b"trailer << /Root 1 0 R >>"


TEXT = b"BT /F1 20 Tf 200 740 Td (Quarterly Report) Tj ET BT /F1 10 Tf 72 600 Td 14 TL " + b" ".join(b"(This is line %d of a page of digital text with words.) Tj T*" % i for i in range(8)) + b" ET"
SCAN = b"q 612 0 0 792 0 0 cm /I1 Do Q"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "digital.pdf").write_bytes(pdf_bytes([TEXT, TEXT]))
    (tmp_path / "scan.pdf").write_bytes(pdf_bytes([SCAN], False))
    (tmp_path / "broken.pdf").write_bytes(b"%PDF-1.4\n")
    (tmp_path / "locked.pdf").write_bytes(pdf_bytes([TEXT], extra=b"/Encrypt "))
    (tmp_path / "a.txt").write_text("INVOICE\n\nfirst line of plain text that is long enough to count as text\nsecond")
    (tmp_path / "t.csv").write_text('a,"b, with comma"\n\n1,"two\nlines"\n')
    (tmp_path / "p.html").write_text("<html><script>x</script><p>Some visible text &amp; more</p></html>")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:d xmlns:w="u"><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:t>Head</w:t></w:p><w:tbl><w:tr><w:tc><w:p><w:t>c1</w:t></w:p></w:tc><w:tc><w:p><w:t>c2</w:t></w:p></w:tc></w:tr></w:tbl><w:p><w:t>after the table, a paragraph of words that goes on for a while, so that it is enough text</w:t></w:p></w:d>')
    with zipfile.ZipFile(tmp_path / "s.pptx", "w") as z:
        z.writestr("ppt/slides/slide1.xml", '<p:s xmlns:p="u" xmlns:a="v"><p:sp><p:ph type="title"/><a:p><a:t>Slide</a:t></a:p></p:sp><p:sp><a:p><a:t>body</a:t></a:p></p:sp></p:s>')
    (tmp_path / "x.xlsx").write_bytes(b"no zip")
    return tmp_path


def typed(spark, folder):
    return files.with_types(files.scan(spark, str(folder)))


def names(rows):
    return {r["file_path"].rsplit("/", 1)[1]: r for r in rows}


def test_pdf_pages(spark, folder):
    got = {(r.path.rsplit("/", 1)[1], r.page_number): r for r in pdf.pdf_pages(typed(spark, folder).where("mime = 'application/pdf'")).collect()}
    one = got[("digital.pdf", 1)]
    assert one.page_count == 2 and one.text.startswith("Quarterly Report\nThis is line 0") and one.text.count("\n") == 8 and one.fonts == ["Helvetica-Bold"]
    assert got[("scan.pdf", 1)].text == "" and [tuple(x) for x in got[("scan.pdf", 1)].images] == [(0.0, 0.0, 612.0, 792.0)]
    assert got[("broken.pdf", None)].error == "no pages" and got[("locked.pdf", None)].error == "ValueError: encrypted"
    p = names(pdf.probe(pdf.pdf_pages(typed(spark, folder).where("mime = 'application/pdf'"))).collect())
    assert (p["digital.pdf"].page_count, p["digital.pdf"].font_count, p["scan.pdf"].text_length, p["broken.pdf"].page_count) == (2, 1, 0, 0)


def test_pdf_strings_and_maps():
    assert list(pdf.tokens(rb"(a\(b\)\101\n) <48 6> /N#61me [1 -2.5 (x)] << /K 3 0 R >> Tj")) == [b"a(b)A\n", b"H\x60", "Name", [1, -2.5, b"x"], {"K": 3}, "Tj"]
    cmap = b"1 beginbfchar <01> <0041> endbfchar 1 beginbfrange <02> <04> <0061> endbfrange"
    assert pdf._unicode_map(cmap) == {b"\x01": "A", b"\x02": "a", b"\x03": "b", b"\x04": "c"}


def test_triage_and_extraction(spark, folder):
    out = names(drivers.triage(spark, str(folder)).collect())
    assert not out["digital.pdf"].needs_ocr and out["scan.pdf"].needs_ocr and out["scan.pdf"].reason_code == "PDF_SCANNED" and out["digital.pdf"].page_count == 2
    assert not out["a.txt"].needs_ocr and out["d.docx"].reason_code == "OFFICE_WITH_TEXT" and out["x.xlsx"].error_type == "BadZipFile" and out["locked.pdf"].error
    seen = spark.createDataFrame([(out["a.txt"].file_path,)], "file_path string")
    assert "a.txt" not in names(drivers.triage(spark, str(folder), resume=seen).collect())
    ok, bad = drivers.results_and_errors(drivers.triage(spark, str(folder)))
    assert {"x.xlsx", "locked.pdf", "broken.pdf"} == set(names(bad.collect())) and "a.txt" in names(ok.collect())
    e = drivers.extract(typed(spark, folder), [1]).collect()
    kind = lambda f, k: [r for r in e if r.file_path.endswith(f) and r.kind == k]
    assert [r.type for r in kind("digital.pdf", "element")][0] == "Title" and len(kind("digital.pdf", "element")) == 9 and len(kind("scan.pdf", "image")) == 1
    assert [(r.row, r.col, r.text) for r in kind("t.csv", "cell")] == [(0, 0, "a"), (0, 1, "b, with comma"), (1, 0, "1"), (1, 1, "two\nlines")]
    assert [(r.type, r.text[:5]) for r in kind("d.docx", "element")] == [("Heading", "Head"), ("NarrativeText", "after")] and len(kind("d.docx", "cell")) == 2
    assert [r.type for r in kind("s.pptx", "element")] == ["Title", "NarrativeText"] and kind("x.xlsx", "error")[0].error == "BadZipFile"
    cleaned = drivers.clean(drivers.extract(typed(spark, folder)))
    assert cleaned.where("file_path like '%digital.pdf'").count() == 18 and cleaned.select("element_id").distinct().count() == cleaned.count()
    kinds = {r.file_path.rsplit("/", 1)[1]: r.document_type for r in drivers.document_types(cleaned).collect()}
    assert kinds["a.txt"] == "invoice" and kinds["d.docx"] is None


def test_xlsx_places(spark, tmp_path):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", '<w xmlns="u"><row><c r="B1"><v>5</v></c><c r="AA1"><v>6</v></c></row></w>')
    df = spark.createDataFrame([("x", "xlsx", bytearray(b.getvalue()))], "path string, extension string, content binary")
    assert [(r.page, r.row, r.col, r.text) for r in office.office_rows(df).collect()] == [(1, 0, 1, "5"), (1, 0, 26, "6")]


def test_lines_by_brute_force(spark):
    r = random.Random(2)
    rows = [(f, 1, i, float(r.randrange(200)), float(r.randrange(60)), f % 3 == 0, float(r.randrange(4))) for f in range(12) for i in range(25)]
    df = spark.createDataFrame(rows, "file_path long, page int, ordinal long, x0 double, y0 double, rotated boolean, table double")
    want = {}
    near = {}
    for f in range(12):
        own = [x for x in rows if x[0] == f]
        turned = own[0][5]
        tops = []
        for x in sorted(own, key=lambda x: (x[3], x[4], x[2]) if turned else (x[4], x[3], x[2])):
            at = x[3] if turned else x[4]
            k = next((k for k, t in enumerate(tops) if abs(t - at) <= 2.5), None)
            if k is None:
                tops.append(at)
                k = len(tops) - 1
            want[f, x[2]] = k + 1
        for t in {x[6] for x in own}:
            rows_y = []
            member = {}
            for x in (x for x in own if x[6] == t):
                y = next((y for y in rows_y if abs(y - x[4]) < 20), None)
                if y is None:
                    rows_y.append(x[4])
                    y = x[4]
                member[x[2]] = y
            near |= {(f, i): sorted(rows_y).index(y) for i, y in member.items()}
    assert {(x.file_path, x.ordinal): x.line for x in lines.group_lines(df).collect()} == want
    assert {(x.file_path, x.ordinal): x.row for x in lines.rows_by_nearness(df).collect()} == near


def test_text_of_characters(spark):
    rows = []
    for k, (word, x, y) in enumerate([("Hi", 10, 5), ("there", 40, 6), ("$9", 10, 40), ("each", 20.5, 40)]):
        rows += [("f", 1, 10 * k + i, c, x + 5.0 * i, x + 5.0 * i + 5, float(y), y + 9.0, "F" if k < 3 else "G", 10.0, False) for i, c in enumerate(word)]
    df = spark.createDataFrame(rows, "file_path string, page int, ordinal long, text string, x0 double, x1 double, y0 double, y1 double, font string, size double, rotated boolean")
    assert lines.text_of_characters(df).head().text == "Hi there\n$9 each"
    words = lines.merge_characters(lines.group_lines(df))
    assert {x.line: x.text for x in lines.spaced_words(words).collect()}[2] == "$9 each"


def test_structured_markdown(spark):
    texts = ["Results", "Test name\nValue measured\nUnit\nUsual range", "a note, with 1 figure", "Glucose\n90\nmg\n70-99", "Sodium in the blood, by electrode\nmmol\n(Na)", "140\n135-145\nok", "Name:\nBob\n1 more", "Age:", "41 years, they say", "Some longer sentence, which isn't a heading at all."]
    got = markdown.structured([("title", "# T"), *[("narrative", x) for x in texts], ("list", "- x"), ("list", "- y")])
    grid = "| Test name | Value measured | Unit | Usual range |  |\n| --- | --- | --- | --- | --- |\n| Glucose | 90 | mg | 70-99 |  |\n| Sodium in the blood, by electrode | mmol (Na) | 140 | 135-145 | ok |"
    assert got[:7] == ["# T", "", "### Results", "", "a note, with 1 figure", "", grid]
    assert got[7:] == ["", "**Name** Bob", "1 more", "", "**Age** 41 years, they say", "", "Some longer sentence, which isn't a heading at all.", "", "- x", "- y", ""]
    assert markdown.joined_rows(["1", "Iron", "(Fe)"], ["5", "1-9", "mg"]) == ["1", "Iron (Fe)", "5", "1-9", "mg"] and markdown.joined_rows(["a", "5", "6"], ["1", "2"]) is None
    assert markdown.grid_of([["a", ""], ["b", " "]]) == "| a |\n| --- |\n| b |"
    df = spark.createDataFrame([("f", 1, 0, "Title", "T"), ("f", 1, 1, "ListItem", "x")], "file_path string, page int, ordinal int, type string, text string")
    assert markdown.structured_markdown(df).head().markdown == "# T\n\n- x"


def test_stitching_boundaries(spark):
    """Overlap of exactly 0.9, gaps of 39 and 40 below and above, another number of columns."""
    rows = [(1, 0.0, 0.0, 100.0, 10.0, 2), (2, 49.0, 10.0, 110.0, 60.0, 2), (3, 100.0, 10.0, 110.0, 120.0, 2), (4, 150.0, 10.0, 110.0, 170.0, 3), (5, 150.5, 10.1, 110.1, 400.0, 3), (6, 361.0, 10.0, 110.0, 370.0, 3)]
    df = spark.createDataFrame([("f", 1, *x) for x in rows], "file_path string, page int, ordinal long, y0 double, x0 double, x1 double, y1 double, columns long")
    assert {x.ordinal: x.stitched for x in tables.stitch_tables(df).collect()} == {1: 1, 2: 1, 3: 2, 4: 3, 5: 3, 6: 3}


def test_truth(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"in/a.pdf": false, "b.pdf": {"needs_ocr": true}}')
    assert {x.name: x.needs_ocr for x in files.ground_truth(spark, str(tmp_path / "d.json")).collect()} == {"in/a.pdf": False, "a.pdf": False, "b.pdf": True}
    (tmp_path / "l.json").write_text('[{"file": "y/a.pdf", "needs_ocr": true}, {"file": "x/a.pdf", "needs_ocr": false}]')
    truth = files.ground_truth(spark, str(tmp_path / "l.json"))
    assert {x.name: x.needs_ocr for x in truth.collect()} == {"y/a.pdf": True, "x/a.pdf": False, "a.pdf": True}  # the first of a name
    f = spark.createDataFrame([("x/a.pdf", "/r/x/a.pdf", "a.pdf"), ("q/c.pdf", "/r/q/c.pdf", "c.pdf")], "path string, resolved string, base string")
    assert {x.path: x.needs_ocr for x in batch.truth_of(f, truth).collect()} == {"x/a.pdf": True, "q/c.pdf": None}  # a no gives way


def test_latency_by_brute_force(spark):
    r = random.Random(4)
    rows = [(g, v) for g in ("a", "b", None) for v in [float(r.choice((7, 7, r.randrange(10**6)))) for _ in range(r.randrange(1, 400))]] + [("one", 3.0), ("two", 1.0), ("two", 2.0)]
    got = {x.g: x for x in batch.latency_stats(spark.createDataFrame(rows, "g string, value double"), "value", "g", bins=16).collect()}
    for g in {x for x, _ in rows}:
        v = sorted(y for x, y in rows if x == g)
        assert (got[g].n, got[g].min, got[g].max, got[g].p95) == (len(v), v[0], v[-1], v[int(len(v) * 0.95)]) and abs(got[g].median - np.median(v)) < 1e-4 and abs(got[g]["mean"] - np.mean(v)) < 1e-3
    whole = batch.latency_stats(spark.createDataFrame(rows, "g string, value double")).head()
    v = sorted(y for _, y in rows)
    assert whole.n == len(v) and whole.p95 == v[int(len(v) * 0.95)]


@pytest.mark.parametrize("block_words", [1 << 20, 10])
def test_similar_to(spark, block_words):
    r = random.Random(7)
    docs = [(i, " ".join(r.choice("abcdefghij") + str(r.randrange(4)) for _ in range(r.randrange(30)))) for i in range(60)] + [(99, None)]
    items = [(i, " ".join(r.choice("abcdefghij") + str(r.randrange(4)) for _ in range(10))) for i in range(9)]
    got = {(x.doc_id, x.item_id): x.jaccard for x in similar_to(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 0.2, block_words).collect()}
    want = {}
    for i, a in docs:
        for j, b in items:
            x, y = set((a or "").split()), set(b.split())
            if x | y and round(len(x & y) / len(x | y), 4) >= 0.2:
                want[i, j] = round(len(x & y) / len(x | y), 4)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1.1e-4 for k in want)


def test_html_in_one_scan(spark, data):
    plan = extract.html_elements(spark.read.parquet(f"{data}/pages.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_sinks(spark, tmp_path):
    rows = [(f"f{i}", i % 2 == 0, "pdf", "structured", 0.5, "X", None, 2, 1, 1) for i in range(12)] + [("bad", None, None, None, None, None, "boom", None, None, None)]
    df = spark.createDataFrame(rows, "file_path string, needs_ocr boolean, file_type string, category string, confidence double, reason_code string, error string, page_count int, pages_needing_ocr int, pages_with_text int")
    for kind in ("json", "csv"):
        outputs.write_batch(df, str(tmp_path / kind), kind)
        assert sorted(files.results(spark, str(tmp_path / kind)) .columns if kind == "csv" else spark.read.json(str(tmp_path / kind)).columns) == sorted(outputs.BATCH_COLUMNS)
    s = outputs.summary(df, 90.0, skipped=3)
    assert "Total files found: 16" in s and "Files with errors: 1" in s and "1m 30.0s" in s and "bad: boom" in s and "Pages: 24, 12 needing OCR (50.0%)" in s
    assert [outputs.duration(x) for x in (5, 61, 3725)] == ["5.00 seconds", "1m 1.0s", "1h 2m 5.0s"]
    t = outputs.text_table(df, 3)
    assert "... and 10 more" in t and "Total: 13" in t
    assert "signals" not in json.loads(outputs.result_json(df.withColumn("signals", F.struct("page_count"))).head().json) and "signals" in json.loads(outputs.result_json(df.withColumn("signals", F.struct("page_count")), True).head().json)
    cache = str(tmp_path / "cache")
    outputs.write_cache(df.select(F.col("file_path").alias("cache_key"), "needs_ocr"), cache, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    held = spark.read.parquet(cache)
    asked = df.select(F.col("file_path").alias("cache_key"))
    assert batch.cache_hits(asked, held, F.lit("2024-01-01 00:30:00").cast("timestamp")).count() == 13 and batch.cache_hits(asked, held, F.lit("2024-01-01 01:00:01").cast("timestamp")).count() == 0
    assert outputs.clear_cache(spark, cache) == 13 and outputs.clear_cache(spark, cache) == 0
    for kind in ("rows", "json"):
        outputs.write_result(df, str(tmp_path / f"r{kind}"), kind)
    with pytest.raises(ValueError):
        outputs.write_result(df, str(tmp_path / "no"), "xml")
    told = []
    with outputs.Stage("x", told.append):
        pass
    assert told[0]["stage"] == "x" and told[0]["seconds"] >= 0
    view = outputs.file_view({"file_path": "a", "needs_ocr": True, "confidence": 0.8}, [{"page_number": i, "needs_ocr": False} for i in range(7)])
    assert "Page 4" in view and "... and 2 more pages" in view


def test_image_steps(spark):
    px = np.full((90, 90), 255, np.uint8)
    px[30:36, 10:80] = 0
    turned = images.rotate(px, -6)
    assert 5 < abs(images.least_box_angle(turned)) < 7 and not images.deskew(px)[1]
    back, did = images.deskew(turned)
    assert did and abs(images.least_box_angle(back)) < 1 and not images.deskew(images.rotate(px, -1.2), severe_only=True)[1]
    r = np.random.default_rng(1)
    noisy = np.clip(128 + r.normal(0, 8, (30, 30)), 0, 255).astype(np.uint8)
    clean, did = images.non_local_means(noisy)
    assert did and clean.std() < noisy.std() / 2
    assert images.normalized_steps({"otsu": None, "nope": {}, "deskew": {"severe_only": True}}) == {"deskew": {"severe_only": True}, "otsu": {}}
    df = spark.createDataFrame([("f", 1, 90, 90, bytearray(turned.tobytes())), ("f", 2, 90, 90, bytearray(b"short"))], "file_path string, page_number int, height int, width int, pixels binary")
    got = {x.page_number: x for x in images.prepare_for_ocr(df, ["deskew", "otsu"], auto_fix=False).collect()}
    assert got[1].applied == ["deskew", "otsu"] and got[1].warnings == ["otsu without denoise"] and set(got[1].pixels) == {0, 255} and got[2].error.startswith("ValueError")
    page = np.full((300, 300), 255, np.uint8)
    for y in (20, 40, 60):
        page[y : y + 8, 20:200:3] = 0
    page[150:280, 50:250] = r.integers(0, 256, (130, 200))
    text, image = images.page_regions(page)
    assert sum(b[3] <= 75 for b in text) == 3 and any(images.overlap(b, (50, 150, 250, 280)) > 0.7 for b in image)
    v = images.vision_pages(spark.createDataFrame([("f", 1, 300, 300, bytearray(page.tobytes()))], "file_path string, page_number int, height int, width int, pixels binary")).head()
    assert v.text_regions >= 3 and v.image_regions >= 1 and 15 < v.image_coverage < 60
    mask = np.zeros((6, 8), bool)
    mask[0, 0:3] = mask[1, 3] = mask[4, 5:8] = True
    assert sorted(images._boxes(mask)) == [(0, 0, 4, 2), (5, 4, 8, 5)]


def test_grey_pixels(spark):
    df = spark.createDataFrame([(1, 2, 3, bytearray([255, 0, 0, 0, 0, 255])), (1, 1, 1, bytearray([7]))], "height int, width int, nChannels int, data binary")
    assert [list(x.pixels) for x in files.grey_pixels(df).collect()] == [[29, 76], [7]]


def test_classifier_accessor(spark):
    score = drivers.intent_classifier({"x": [r"(?i)hello"]})
    assert spark.range(1).select(score(F.lit("Hello hello"), layout_hints=["table"]).alias("s")).head().s == {"x": 0.7}


def test_loggers_and_errors(monkeypatch):
    from folioworks import errors, logs

    monkeypatch.setenv("FOLIOWORKS_LOG_LEVEL", "debug")
    assert logs.logger("folioworks.x").level == 10 and issubclass(errors.CacheError, errors.FolioError)
    heard = []
    assert outputs.emit("e", heard.append, n=1) == heard[0] == {"event": "e", "n": 1}


def test_pdf_tables_and_forms(spark, tmp_path):
    rows = [("Item", "Price", "Qty"), ("Peach", "$2.99", "1"), ("Plum", "$1.50", "12")]
    text = b" ".join(b"BT /F1 10 Tf %d %d Td (%s) Tj ET" % (72 + 150 * c, 700 - 14 * r, v.encode()) for r, row in enumerate(rows) for c, v in enumerate(row))
    data = pdf_bytes([text]) .replace(b"trailer", b"90 0 obj\n<< /FT /Tx /T (name) /V (Bob) >>\nendobj\n91 0 obj\n<< /FT /Btn /T (agree) /V /Yes >>\nendobj\ntrailer")
    (tmp_path / "t.pdf").write_bytes(data)
    e = drivers.extract(typed(spark, tmp_path)).collect()
    assert [(r.table, r.row, r.col, r.text) for r in e if r.kind == "cell"] == [(0, i, j, v) for i, row in enumerate(rows) for j, v in enumerate(row)]
    assert [(r.type, r.text) for r in e if r.kind == "form"] == [("agree", "Yes"), ("name", "Bob")]


def test_commands(spark, folder, capsys):
    from folioworks import cli

    assert "Needs OCR: yes" in cli.main(["check", str(folder / "scan.pdf")], spark) and "Page 1: OCR" in capsys.readouterr().out
    got = json.loads(cli.main(["check", str(folder / "digital.pdf"), "--format", "json"], spark))
    assert got["needs_ocr"] is False and "signals" not in got
    assert "Total: 2" in cli.main(["batch", str(folder), "--limit", "2", "--extensions", "txt", "html", "pptx"], spark)
    s = cli.main(["batch", str(folder), "--format", "json", "--output", str(folder.parent / "results")], spark)
    assert "Files with errors: 3" in s and spark.read.json(str(folder.parent / "results")).count() == 7
    again = cli.batch(spark, str(folder), "summary", resume=str(folder.parent / "results"), extensions=["pdf"])
    assert "Total files found: 2" in again
    page = cli.batch(spark, str(folder), "html")
    assert "<style>" in page and 'class="card"' in page and page.count('<tr class="') == 7 and cli.check(spark, str(folder / "no.pdf")).endswith("not found")


def test_report_says_what_it_leaves_out(spark):
    from folioworks.operators import reports

    df = spark.createDataFrame([(f"f{i:03}", "pdf", i % 2 == 0, 0.9, "X") for i in range(30)], "file_path string, file_type string, needs_ocr boolean, confidence double, reason_code string")
    page = reports.html_report(df, most=10, theme="dark", made="2024-01-01")
    assert "The first 10 of 30 rows." in page and page.count('<tr class="high"') == 10 and "15 (50.0%)" in page


def test_table_and_aggregate_functions(spark):
    from folioworks.functions.udfs import TextPages, trimmed_mean

    assert [tuple(r) for r in TextPages(F.lit("a\fb")).collect()] == [(1, "a"), (2, "b")] and TextPages(F.lit(None).cast("string")).count() == 0
    df = spark.createDataFrame([("a", float(i)) for i in range(9)] + [("a", 1000.0)], "k string, v double")
    assert df.groupBy("k").agg(trimmed_mean("v").alias("m")).head().m == 4.5
