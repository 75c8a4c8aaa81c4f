"""Blocks of text from tables and files."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.functions import text as T

BLOCK = "block_index int, page int, text string, block_type string, source_location string, ocr_confidence double"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def line_blocks(text: str | Column = "text") -> Column:
    """The lines of a text that are not blank, stripped, in an array."""
    lines = F.transform(F.split(T.col(text), "\n", -1), lambda x: F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""))
    return F.filter(lines, lambda x: x != "")


def from_documents(docs: DataFrame) -> DataFrame:
    """doc_id and the columns of a block, one for each line that is not blank; no shuffle."""
    each = docs.select("doc_id", F.posexplode(line_blocks()).alias("block_index", "text"))
    place = F.concat(F.lit("第"), (F.col("block_index") + 1).cast("string"), F.lit("段"))
    return each.select("doc_id", "block_index", F.lit(0).alias("page"), "text", F.lit("paragraph").alias("block_type"), place.alias("source_location"), F.lit(None).cast("double").alias("ocr_confidence"))


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id and blocks, an array of structs: the shape that packing takes."""
    made = F.transform(line_blocks(), lambda t, i: F.struct(i.alias("block_index"), t.alias("text"), F.lit("paragraph").alias("block_type"), F.lit(0).alias("page")))
    return docs.select("doc_id", made.alias("blocks"))


def kind_of(path: str | Column = "path") -> Column:
    """docx or pdf by the file's suffix; any other is an error."""
    suffix = F.lower(F.regexp_extract(T.col(path), r"\.([^./]+)$", 1))
    return F.when(suffix.isin("docx", "pdf"), suffix).otherwise(F.raise_error(F.concat(F.lit("unsupported format: "), T.col(path))))


def route(text: Column, ocr: str = "auto", least: int = 20) -> Column:
    """native or ocr for a page by its text layer."""
    native = F.length(T.strip(text)) >= least
    if ocr == "force":
        return F.lit("ocr")
    return F.when(native, "native").otherwise(F.raise_error(F.lit("a page has no text layer")) if ocr == "off" else F.lit("ocr"))


def paragraph_text(p: ElementTree.Element) -> str:
    """All text of a paragraph in document order, whatever it is wrapped in; deleted text is not there."""
    marks = {f"{WORD}tab": "\t", f"{WORD}br": "\n", f"{WORD}cr": "\n", f"{WORD}noBreakHyphen": "-"}
    return "".join((x.text or "") if x.tag == f"{WORD}t" else marks.get(x.tag, "") for x in p.iter())


def docx_blocks(data: bytes) -> list[tuple]:
    """The paragraphs of a file with text. Relations are never followed, so dangling ones do no harm."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD}body")
        styles = ElementTree.fromstring(z.read("word/styles.xml")) if "word/styles.xml" in z.namelist() else None
    names = {}
    for s in styles.iter(f"{WORD}style") if styles is not None else ():
        name = s.find(f"{WORD}name")
        names[s.get(f"{WORD}styleId")] = name.get(f"{WORD}val") if name is not None else ""
    out = []
    for at, p in enumerate(body.findall(f"{WORD}p"), 1):
        text = paragraph_text(p).strip()
        style = p.find(f"{WORD}pPr/{WORD}pStyle")
        name = names.get(style.get(f"{WORD}val"), style.get(f"{WORD}val")) if style is not None else ""
        if text:
            heading = re.match(r"(?i)heading|title$", name or "")
            out.append((len(out), 0, text, "heading" if heading else "paragraph", f"第{at}段", None))
    return out


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """path and the blocks of every .docx under a path; one file is one record, read where it lies."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[dD][oO][cC][xX]").option("recursiveFileLookup", "true").load(path)
    names = ["path", *(x.split()[0] for x in BLOCK.split(", "))]

    def run(frames):
        for pdf in frames:
            rows = [(p, *b) for p, c in zip(pdf["path"], pdf["content"], strict=True) for b in docx_blocks(c)]
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, "path string, " + BLOCK)


def replayed(spark: SparkSession, path: str) -> DataFrame:
    """Findings saved as a JSON array, in their order."""
    schema = "original_text string, issue_type string, category string, confidence string, suggestion string, reason string, block_index int, page_location string, chunk_index int, located boolean"
    return spark.read.schema(schema).json(path, multiLine=True).withColumn("ord", F.monotonically_increasing_id())
