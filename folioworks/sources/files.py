"""Files as rows: directory scans, type detection, texts of plain, HTML, office and table files, images."""

from __future__ import annotations

import html.parser
import io
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

EXTENSIONS = ("pdf", "docx", "pptx", "xlsx", "txt", "csv", "html", "htm", "json", "xml", "png", "jpg", "jpeg", "tiff")
MIME = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "doc": "application/msword", "ppt": "application/vnd.ms-powerpoint", "xls": "application/vnd.ms-excel",
    "txt": "text/plain", "csv": "text/csv", "html": "text/html", "htm": "text/html", "json": "application/json", "xml": "application/xml",
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "tiff": "image/tiff", "tif": "image/tiff", "webp": "image/webp", "md": "text/markdown", "log": "text/plain", "rtf": "application/rtf",
}
MAGIC = ((b"%PDF", "application/pdf"), (b"\x89PNG", "image/png"), (b"\xff\xd8\xff", "image/jpeg"), (b"GIF8", "image/gif"), (b"BM", "image/bmp"), (b"II*\0", "image/tiff"), (b"MM\0*", "image/tiff"))


def normalized_extensions(extensions: Sequence[str] | None = None) -> list[str]:
    """Lower case, without the dot."""
    return [e.lower().lstrip(".") for e in (extensions or EXTENSIONS)]


def glob_of(extensions: Sequence[str]) -> str:
    """A glob that takes the extensions in any case."""
    return "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions) + "}"


def scan(spark: SparkSession, directory: str, extensions: Sequence[str] | None = None, recursive: bool = True, least: int | None = None, most: int | None = None) -> DataFrame:
    """path, modificationTime, length, content of the files with these extensions and sizes (both ends included)."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob_of(normalized_extensions(extensions))).option("recursiveFileLookup", str(recursive).lower())
    df = reader.load(directory)
    if least is not None:
        df = df.where(F.col("length") >= least)
    if most is not None:
        df = df.where(F.col("length") <= most)
    return df


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def mime_of_extension(ext: Column) -> Column:
    table = F.create_map(*[x for k, v in MIME.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(table, ext), F.lit("application/octet-stream"))


def mime_of(content: Column, ext: Column) -> Column:
    """By the first bytes, else by the extension."""
    out = None
    for magic, mime in MAGIC:
        c = F.substring(content, 1, len(magic)) == F.lit(magic)
        out = F.when(c, mime) if out is None else out.when(c, mime)
    return out.otherwise(mime_of_extension(ext))


def is_binary(mime: Column) -> Column:
    return ~(mime.startswith("text/") | mime.isin("application/json", "application/xml"))


def with_types(files: DataFrame) -> DataFrame:
    df = files.withColumn("extension", extension(F.col("path")))
    df = df.withColumn("mime", mime_of(F.col("content"), F.col("extension")))
    return df.withColumn("is_binary", is_binary(F.col("mime")))


def plain_text(content: Column) -> Column:
    """UTF-8 where valid, else Latin-1, which takes any bytes."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


class _Visible(html.parser.HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.parts.append(data.strip())


@F.pandas_udf(StringType())
def parsed_html(pages: pd.Series) -> pd.Series:
    """Visible text by a parser, entities decoded."""

    def one(x):
        if x is None:
            return None
        p = _Visible()
        p.feed(x)
        return " ".join(p.parts)

    return pages.map(one)


def _texts(root: ElementTree.Element, paragraph: str, run: str) -> Iterator[str]:
    for p in root.iter():
        if p.tag.endswith("}" + paragraph):
            t = "".join(x.text or "" for x in p.iter() if x.tag.endswith("}" + run))
            if t.strip():
                yield t


def office_pages(content: bytes, ext: str) -> list[tuple[int, str]]:
    """(page, text) of a docx (one page), pptx (a slide each) or xlsx (a sheet each)."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        number = lambda n: int("".join(c for c in n.rsplit("/", 1)[-1] if c.isdigit()) or 0)
        if ext == "docx":
            from .office import docx_rows

            return [(1, "\n".join(r[4] for r in docx_rows(z) if r[4].strip()))]  # paragraphs, then cells
        if ext == "pptx":
            slides = sorted((n for n in names if n.startswith("ppt/slides/slide") and n.endswith(".xml")), key=number)
            return [(i + 1, "\n".join(_texts(ElementTree.fromstring(z.read(n)), "p", "t"))) for i, n in enumerate(slides)]
        shared = ["".join(t.text or "" for t in si.iter() if t.tag.endswith("}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        out = []
        for i, n in enumerate(sorted((n for n in names if n.startswith("xl/worksheets/sheet") and n.endswith(".xml")), key=number)):
            lines = []
            for row in (x for x in ElementTree.fromstring(z.read(n)).iter() if x.tag.endswith("}row")):
                cells = []
                for c in row:
                    v = next((x.text for x in c.iter() if x.tag.endswith(("}v", "}t")) and x.text), None)
                    if v is not None:
                        cells.append(shared[int(v)] if c.get("t") == "s" else v)
                if cells:
                    lines.append(" ".join(cells))
            out.append((i + 1, "\n".join(lines)))
        return out


def office_text(files: DataFrame) -> DataFrame:
    """path, page_number, text, error of office files; a file that can't be read is a row with its error."""

    def run(frames):
        for f in frames:
            rows = []
            for path, ext, content in zip(f["path"], f["extension"], f["content"]):
                try:
                    rows += [(path, p, t, None) for p, t in office_pages(bytes(content), ext)]
                except Exception as e:  # what a broken file raises is the row's result
                    rows.append((path, None, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "page_number", "text", "error"])

    mime = F.col("mime") if "mime" in files.columns else F.lit("")
    kind = F.when(F.col("extension").isin("docx", "pptx", "xlsx"), F.col("extension")).when(mime.contains("wordprocessingml"), "docx").when(mime.contains("presentationml"), "pptx").when(mime.contains("spreadsheetml"), "xlsx")
    return files.withColumn("extension", kind).where("extension is not null").select("path", "extension", "content").mapInPandas(run, "path string, page_number int, text string, error string")


@F.pandas_udf(ArrayType(StructType([StructField("row", IntegerType()), StructField("col", IntegerType()), StructField("text", StringType())])))
def _csv_cells(texts: pd.Series) -> pd.Series:
    import csv

    def cells(t):
        if t is None:
            return None
        rows = (r for r in csv.reader(io.StringIO(t, newline="")) if any(c.strip() for c in r))
        return [(i, j, c.strip()) for i, r in enumerate(rows) for j, c in enumerate(r) if c.strip()]

    return texts.map(cells)


def csv_cells(files: DataFrame, text: str = "text", key: str = "path") -> DataFrame:
    """A row for each cell with text of comma-separated files (quoted cells may hold commas and line breaks): row, col, box on a grid of 100 by 20."""
    cells = files.select(key, F.explode(_csv_cells(text)).alias("c")).select(key, "c.row", "c.col", "c.text")
    return cells.select(key, "row", "col", "text", (F.col("col") * 100.0).alias("x0"), (F.col("row") * 20.0).alias("y0"), (F.col("col") * 100.0 + 100).alias("x1"), (F.col("row") * 20.0 + 20).alias("y1"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """Width, height, channels and pixels, by Spark's own reader."""
    return spark.read.format("image").load(path).select("image.origin", "image.width", "image.height", "image.nChannels", "image.data")


def results(spark: SparkSession, path: str) -> DataFrame:
    """Results of an earlier batch from JSON or CSV; booleans and numbers are read leniently."""
    one = spark.read.format("binaryFile").load(path).select("path").head()  # a table's first file tells its kind
    df = spark.read.json(path) if one and one[0].endswith("json") else spark.read.option("header", True).csv(path)
    if "needs_ocr" in df.columns:
        df = df.withColumn("needs_ocr", F.lower(F.col("needs_ocr").cast("string")).isin("true", "1", "yes"))
    if "confidence" in df.columns:
        df = df.withColumn("confidence", F.col("confidence").cast("string").try_cast("double"))
    return df


def truth_names(labels: DataFrame) -> DataFrame:
    """name, needs_ocr from labels (ordinal, file, needs_ocr): by full path (the last of a path) and by base name (the first of a name, unless a path is that name)."""
    full = labels.groupBy(F.col("file").alias("name")).agg(F.max_by("needs_ocr", "ordinal").alias("needs_ocr"))
    base = labels.groupBy(F.regexp_extract("file", r"([^/]+)$", 1).alias("name")).agg(F.min_by("needs_ocr", "ordinal").alias("needs_ocr"))
    return full.unionByName(base.join(full, "name", "left_anti"))


@F.pandas_udf(ArrayType(StructType([StructField("file", StringType()), StructField("needs_ocr", BooleanType())])))
def _truth_pairs(texts: pd.Series) -> pd.Series:
    import json

    def pairs(t):
        x = json.loads(t)
        if isinstance(x, dict):
            return [(k, v.get("needs_ocr") if isinstance(v, dict) else v) for k, v in x.items()]
        return [(y["file"], y["needs_ocr"]) for y in x]

    return texts.map(pairs)


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Labels by full path and by base name from a JSON list of objects (file, needs_ocr), or an object from file to label."""
    pairs = spark.read.text(path, wholetext=True).select(F.posexplode(_truth_pairs("value")).alias("ordinal", "x"))
    return truth_names(pairs.select("ordinal", "x.file", "x.needs_ocr"))


def grey_pixels(frames: DataFrame, data: str = "data") -> DataFrame:
    """Frames (height, width, nChannels, blue first) with ``pixels``: grey bytes by the usual weights."""

    def run(data: pd.Series, channels: pd.Series) -> pd.Series:
        import numpy as np

        def one(x, n):
            if x is None:
                return None
            px = np.frombuffer(x, np.uint8)
            if n == 1:
                return px.tobytes()
            px = px.reshape(-1, n)[:, :3].astype(np.float64)
            return np.clip(np.round(px @ np.array([0.114, 0.587, 0.299])), 0, 255).astype(np.uint8).tobytes()

        return pd.Series([one(x, n) for x, n in zip(data, channels)])

    run.__annotations__ = {"data": pd.Series, "channels": pd.Series, "return": pd.Series}
    return frames.withColumn("pixels", F.pandas_udf(run, "binary")(data, "nChannels"))


def listed(spark: SparkSession, pattern: str, most: int | None = None) -> DataFrame:
    """Paths and sizes that a glob finds, in order of path, each once; the first ``most`` if asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(pattern).select("path", "length").distinct().orderBy("path")
    return files if most is None else files.limit(most)
