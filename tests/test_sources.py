"""Files on disk through the sources, images, streams."""

import struct
import zipfile
import zlib

import numpy as np
from pyspark.sql import functions as F

from folioworks.operators import images
from folioworks.sources import files
from folioworks.streaming import streams


def test_scan_and_types(spark, tmp_path):
    (tmp_path / "a.TXT").write_text("hello wörld")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4\n")
    (tmp_path / "c.bin").write_bytes(bytes(range(6)))
    (tmp_path / "d.txt").write_bytes("caf\xe9".encode("latin-1"))
    got = {r.path.rsplit("/", 1)[1]: r for r in files.with_types(files.scan(spark, str(tmp_path))).withColumn("text", files.plain_text(F.col("content"))).collect()}
    assert set(got) == {"a.TXT", "b.pdf", "d.txt"}
    assert got["b.pdf"].mime == "application/pdf" and got["b.pdf"].is_binary and got["a.TXT"].mime == "text/plain" and got["d.txt"].text == "café"
    assert files.scan(spark, str(tmp_path), ["txt"], least=5, most=11).count() == 0
    assert files.scan(spark, str(tmp_path), [".BIN"]).count() == 1


def test_office(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.docx", "w") as z:
        z.writestr("word/document.xml", '<w:d xmlns:w="u"><w:p><w:t>one</w:t><w:t> two</w:t></w:p><w:p/></w:d>')
    with zipfile.ZipFile(tmp_path / "y.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", '<s xmlns="u"><si><t>head</t></si></s>')
        z.writestr("xl/worksheets/sheet1.xml", '<w xmlns="u"><row><c t="s"><v>0</v></c><c><v>5</v></c></row></w>')
    (tmp_path / "bad.pptx").write_bytes(b"no zip")
    got = {(r.path.rsplit("/", 1)[1], r.page_number): (r.text, r.error) for r in files.office_text(files.with_types(files.scan(spark, str(tmp_path)))).collect()}
    assert got == {("x.docx", 1): ("one two", None), ("y.xlsx", 1): ("head 5", None), ("bad.pptx", None): (None, "BadZipFile")}


def test_html_and_csv(spark):
    df = spark.createDataFrame([("p", "<p>a &amp; b</p><script>x</script><b>c</b>", "x,, y\nz")], "path string, html string, text string")
    assert df.select(files.parsed_html("html")).head()[0] == "a & b c"
    assert sorted((r.row, r.col, r.text) for r in files.csv_cells(df).collect()) == [(0, 0, "x"), (0, 2, "y"), (1, 0, "z")]


def png(pixels: np.ndarray) -> bytes:
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    h, w = pixels.shape
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_images(spark, tmp_path):
    px = np.arange(128, dtype=np.uint8).reshape(8, 16)
    (tmp_path / "i.png").write_bytes(png(px))
    r = files.images(spark, str(tmp_path)).withColumn("entropy", images.image_entropy("data")).head()
    assert (r.width, r.height, len(r.data), round(r.entropy, 6)) == (16, 8, 128, 7.0)
    square = np.zeros((50, 50), np.uint8)
    square[10:40, 10:40] = 255
    assert not images.binarize(square)[1] and images.binarize(px)[1]
    assert images.rescale(px, 100, 200)[0].shape == (16, 32) and not images.rescale(px, 300)[1]
    assert images.plan_steps(["otsu"]) == (["denoise", "otsu"], []) and images.plan_steps(["otsu"], auto_fix=False)[1] and images.plan_steps("auto", fast=True)[0] == ["deskew", "otsu"]


def test_results_and_truth(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"file_path":"a","needs_ocr":"Yes","confidence":"0.5"}\n{"file_path":"b","needs_ocr":"0","confidence":"x"}')
    got = [(r.needs_ocr, r.confidence) for r in files.results(spark, str(tmp_path / "r.json")).orderBy("file_path").collect()]
    assert got == [(True, 0.5), (False, None)]
    (tmp_path / "t.json").write_text('[{"file":"x/a.pdf","needs_ocr":true},{"file":"y/a.pdf","needs_ocr":false}]')
    assert {r.name: r.needs_ocr for r in files.ground_truth(spark, str(tmp_path / "t.json")).collect()} == {"x/a.pdf": True, "y/a.pdf": False, "a.pdf": True}


def test_streams(spark, data, tmp_path):
    src = tmp_path / "in"
    events = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(src))
    stream = streams.arriving(spark, str(src), events.schema, 1)
    out = streams.finish(streams.rates(stream, size="1 day", late="3650 days"), mode="complete")
    assert sum(r.n for r in out.collect()) == events.count()
    cached = streams.ttl_cache(streams.arriving(spark, str(src), events.schema).select(F.col("user_id").cast("string").alias("cache_key"), "ts"))
    got = streams.finish(cached, checkpoint=str(tmp_path / "c"))
    assert got.count() == events.count() and got.where("not hit").count() >= events.select("user_id").distinct().count()
