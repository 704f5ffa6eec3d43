"""Files as documents: texts and markdown whole, office documents by paragraph. Spark lists and reads them, so they may lie in any store."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def texts(spark: SparkSession, path: str) -> DataFrame:
    """path, kind (by the name's ending, markdown as md) and text of text files."""
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return rows.select("path", F.when(kind == "markdown", "md").otherwise(kind).alias("kind"), "text")


def paragraphs(content: bytes) -> Iterator[tuple[int, str, list[str], str]]:
    """place, style, headings above (its own included) and text of the paragraphs of an office document; none if it cannot be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return
    stack: list[tuple[int, str]] = []
    for place, p in enumerate(body.iter(f"{_W}p")):
        style = p.find(f"{_W}pPr/{_W}pStyle")
        name = style.get(f"{_W}val", "Normal") if style is not None else "Normal"
        text = "".join(t.text or "" for t in p.iter(f"{_W}t"))
        if level := re.fullmatch(r"[Hh]eading ?([1-6])", name):
            stack = [x for x in stack if x[0] < int(level[1])] + [(int(level[1]), text)]
        yield place, name, [x for _, x in stack], text


def docx(spark: SparkSession, path: str) -> DataFrame:
    """path, place, style, headings, text of the paragraphs of .docx files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int32(), pa.string(), pa.list_(pa.string()), pa.string())
        for b in batches:
            for row in range(b.num_rows):
                made = list(paragraphs(b.column(1)[row].as_py()))
                columns = list(zip(*made, strict=True)) if made else [[]] * 4
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([row] * len(made), pa.int64())), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], ["path", "place", "style", "headings", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, place int, style string, headings array<string>, text string")
