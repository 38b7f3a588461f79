"""Elements and table cells of office files, from their zipped XML, one file a step of ``mapInPandas``."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = "path string, page int, ordinal int, kind string, type string, text string, table int, row int, col int, confidence double, error string"
_NAMES = [x.split()[0] for x in ROWS.split(", ")]


def _local(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _text(e: ElementTree.Element) -> str:
    return "".join(x.text or "" for x in e.iter() if _local(x) == "t")


def _number(name: str) -> int:
    return int("".join(c for c in name.rsplit("/", 1)[-1] if c.isdigit()) or 0)


def docx_rows(z: zipfile.ZipFile) -> Iterator[tuple]:
    """Paragraphs (headings by their style), then the cells of tables."""
    body = ElementTree.fromstring(z.read("word/document.xml"))
    inside = {id(p) for t in body.iter() if _local(t) == "tbl" for p in t.iter()}
    k = 0
    for p in body.iter():
        if _local(p) == "p" and id(p) not in inside and _text(p).strip():
            style = next((v for s in p.iter() if _local(s) == "pStyle" for a, v in s.attrib.items() if a.endswith("val")), "").lower()
            kind = "Heading" if "heading" in style or "title" in style else "ListItem" if "list" in style else "NarrativeText"
            yield 1, k, "element", kind, _text(p).strip(), None, None, None, 0.95
            k += 1
    for t, table in enumerate(x for x in body.iter() if _local(x) == "tbl"):
        for r, row in enumerate(x for x in table if _local(x) == "tr"):
            for c, cell in enumerate(x for x in row if _local(x) == "tc"):
                yield 1, k, "cell", None, "\n".join(_text(p) for p in cell.iter() if _local(p) == "p").strip(), t, r, c, 0.95
                k += 1


def pptx_rows(z: zipfile.ZipFile) -> Iterator[tuple]:
    """Shapes with text, a slide a page; title placeholders are titles."""
    k = 0
    slides = sorted((n for n in z.namelist() if n.startswith("ppt/slides/slide") and n.endswith(".xml")), key=_number)
    for i, name in enumerate(slides):
        for shape in (x for x in ElementTree.fromstring(z.read(name)).iter() if _local(x) == "sp"):
            text = "\n".join(t for p in shape.iter() if _local(p) == "p" for t in [_text(p)] if t.strip())
            if text.strip():
                place = next((x.attrib.get("type", "") for x in shape.iter() if _local(x) == "ph"), "")
                yield i + 1, k, "element", "Title" if place in ("title", "ctrTitle") else "NarrativeText", text.strip(), None, None, None, 0.9
                k += 1


def xlsx_rows(z: zipfile.ZipFile) -> Iterator[tuple]:
    """A sheet is a table on a page of its own; empty cells are left out."""
    shared = [_text(si) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
    k = 0
    for s, name in enumerate(sorted((n for n in z.namelist() if n.startswith("xl/worksheets/sheet") and n.endswith(".xml")), key=_number)):
        for r, row in enumerate(x for x in ElementTree.fromstring(z.read(name)).iter() if _local(x) == "row"):
            for j, c in enumerate(x for x in row if _local(x) == "c"):
                v = next((x.text for x in c.iter() if _local(x) in ("v", "t") and x.text), None)
                if v is not None:
                    letters = "".join(x for x in c.attrib.get("r", "") if x.isalpha())
                    col = j
                    if letters:
                        col = -1
                        for x in letters.upper():
                            col = (col + 1) * 26 + ord(x) - 65
                    yield s + 1, k, "cell", None, shared[int(v)] if c.attrib.get("t") == "s" else v, s, r, col, 0.95
                    k += 1


READERS = {"docx": docx_rows, "pptx": pptx_rows, "xlsx": xlsx_rows}


def office_rows(files: DataFrame) -> DataFrame:
    """ROWS of office files (path, extension, content): elements and table cells; a file that can't be read is a row with its error."""

    def run(frames):
        for f in frames:
            rows = []
            for path, ext, content in zip(f["path"], f["extension"], f["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                        rows += [(path, *r, None) for r in READERS[ext](z)]
                except Exception as e:  # what a broken file raises is the row's result
                    rows.append((path, *[None] * 9, type(e).__name__))
            yield pd.DataFrame(rows, columns=_NAMES)

    mime = F.col("mime") if "mime" in files.columns else F.lit("")
    kind = F.when(F.col("extension").isin(*READERS), F.col("extension")).when(mime.contains("wordprocessingml"), "docx").when(mime.contains("presentationml"), "pptx").when(mime.contains("spreadsheetml"), "xlsx")
    return files.withColumn("extension", kind).where("extension is not null").select("path", "extension", "content").mapInPandas(run, ROWS)
