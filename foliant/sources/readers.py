"""Scans: documents as files, glossaries, style guides and saved records."""

from __future__ import annotations

import csv
import io
import json
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as T

RECORD = (
    "id string, name string, original_path string, source_language string, target_language string, detected_language string, status string, progress int, error string, "
    "retry struct<retry_number:int,max_retries:int,delay_seconds:double,reason:string,segment_ids:array<string>>, created_at string, updated_at string, "
    "segments array<struct<id:string,source:string,translation:string,status:string,locked:boolean>>"
)
TERM = "file string, row_no int, source string, target string, source_lang string, target_lang string, domain string, notes string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


_BREAKS = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n", f"{_W}noBreakHyphen": "-"}


def _runs(node: ElementTree.Element) -> Iterator[ElementTree.Element]:
    """The runs of a paragraph and of its links; what is drawn in it, such as text boxes, is no text of its own."""
    for child in node:
        if child.tag == f"{_W}r":
            yield child
        elif child.tag == f"{_W}hyperlink":
            yield from child.findall(f"{_W}r")


def _paragraph(node: ElementTree.Element) -> str:
    return "".join(x.text or "" if x.tag == f"{_W}t" else _BREAKS.get(x.tag, "") for run in _runs(node) for x in run).strip()


def _paragraph_nodes(root: ElementTree.Element) -> list[ElementTree.Element]:
    """Paragraphs with visible text: those of the body, then those of the cells of its top-level tables by rows."""
    body = root.find(f"{_W}body")
    nodes = list(body.findall(f"{_W}p"))
    for table in body.findall(f"{_W}tbl"):
        for cell in table.findall(f"{_W}tr/{_W}tc"):
            merge = cell.find(f"{_W}tcPr/{_W}vMerge")
            if merge is None or merge.get(f"{_W}val") == "restart":
                nodes += cell.findall(f"{_W}p")
    return [n for n in nodes if _paragraph(n)]


def docx_paragraphs(content: bytes) -> list[str]:
    """Visible paragraphs of a document: those of the body, then those of the cells of its top-level tables by rows.

    Cells merged downwards are read where they begin; nested tables, headers and footers are left out.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return [_paragraph(n) for n in _paragraph_nodes(ElementTree.fromstring(z.read("word/document.xml")))]


class CountMismatch(ValueError):
    """A template has another number of paragraphs than there are texts."""


def docx_filled(content: bytes, texts: list[str]) -> bytes:
    """A copy of a document with other texts in its visible paragraphs: the first piece of text takes all of it, the others are emptied, drawings stay."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parts = {i: z.read(i) for i in z.infolist()}
    main = next(i for i in parts if i.filename == "word/document.xml")
    for _, pair in ElementTree.iterparse(io.BytesIO(parts[main]), ["start-ns"]):
        ElementTree.register_namespace(*pair)  # so that prefixes stay as they are
    root = ElementTree.fromstring(parts[main])
    nodes = _paragraph_nodes(root)
    if len(nodes) != len(texts):
        raise CountMismatch(f"{len(nodes)} paragraphs and {len(texts)} texts")
    for node, text in zip(nodes, texts, strict=True):
        held = [x for run in _runs(node) for x in run if x.tag == f"{_W}t"]
        if not held:
            held = [ElementTree.SubElement(ElementTree.SubElement(node, f"{_W}r"), f"{_W}t")]
        for x in held:
            x.text = ""
        held[0].text = text
        held[0].set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for info, data in parts.items():
            z.writestr(info, ElementTree.tostring(root, encoding="utf-8", xml_declaration=True) if info is main else data)
    return out.getvalue()


def docx(spark: SparkSession, path: str, most: int = 80 * 1024 * 1024) -> DataFrame:
    """(path, ordinal, source, error): paragraphs of the files under a path; an unreadable, empty or too large file is one row with its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for p, content, size in zip(pdf["path"], pdf["content"], pdf["length"], strict=True):
                if size > most:
                    rows.append((p, None, None, "too large"))
                    continue
                try:
                    found = docx_paragraphs(bytes(content))
                    rows += [(p, i, t, None) for i, t in enumerate(found, 1)] or [(p, None, None, "no text")]
                except (zipfile.BadZipFile, KeyError, AttributeError, ElementTree.ParseError) as exc:
                    rows.append((p, None, None, f"unreadable: {exc}"[:500]))
            yield pd.DataFrame(rows, columns=["path", "ordinal", "source", "error"]).astype({"ordinal": "Int32"})

    return spark.read.format("binaryFile").load(path).select("path", "content", "length").mapInPandas(run, "path string, ordinal int, source string, error string")


def _rows_of(name: str, text: str) -> list[dict]:
    text = text.removeprefix("﻿")
    if name.lower().endswith(".json"):
        data = json.loads(text)
        data = data.get("terms") if isinstance(data, dict) else data
        return [x for x in data if isinstance(x, dict)] if isinstance(data, list) else []
    return list(csv.DictReader(io.StringIO(text, newline=""), delimiter="\t" if name.lower().endswith(".tsv") else ","))


def glossary(spark: SparkSession, folder: str) -> DataFrame:
    """Terms (TERM) of the csv, tsv and json files of a folder, in the order of files and rows; hidden and broken files are skipped whole."""
    fields = ["source", "target", "source_lang", "target_lang", "domain", "notes"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                name = path.rsplit("/", 1)[-1]
                if name.startswith(".") or not name.lower().endswith((".csv", ".tsv", ".json")):
                    continue
                try:
                    rows = _rows_of(name, bytes(content).decode("utf-8"))
                except (ValueError, csv.Error):
                    continue
                out += [(name, i, *(None if r.get(f) is None else str(r.get(f)) for f in fields)) for i, r in enumerate(rows, 1)]
            yield pd.DataFrame(out, columns=["file", "row_no", *fields])

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInPandas(run, TERM)


def style_guide(spark: SparkSession, path: str, most: int = 12_000) -> DataFrame:
    """(style): the first ``most`` characters of a file, stripped then; the empty text where there is no such file."""
    try:
        return spark.read.text(path, wholetext=True).select(T.strip(F.substring("value", 1, most)).alias("style"))
    except AnalysisException:
        return spark.sql("SELECT '' AS style")


def records(spark: SparkSession, pattern: str) -> DataFrame:
    """Saved document records; files that are no record, or whose id has another form, are skipped."""
    return spark.read.schema(RECORD + ", _broken string").option("multiLine", True).option("columnNameOfCorruptRecord", "_broken").json(pattern).where("_broken is null and id is not null and name is not null").where(F.col("id").rlike("^[a-f0-9]{12}$")).drop("_broken")


def page_texts(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, text): texts of pages; a page that could not be read is empty, a repeated one counts once."""
    return pages.groupBy("doc_id", "page_no").agg(F.coalesce(F.max("text"), F.lit("")).alias("text"))


def inside(path: Column) -> Column:
    """Whether a relative path stays below its root: neither absolute nor climbing above it by ``..``."""
    steps = F.filter(F.split(path, r"[/\\\\]"), lambda x: ~x.isin("", "."))
    depth = F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), lambda acc, x: F.struct((acc["at"] + F.when(x == "..", -1).otherwise(1)).alias("at"), F.least(acc["low"], acc["at"] + F.when(x == "..", -1).otherwise(1)).alias("low")))
    return F.coalesce(~path.rlike(r"^([/\\\\]|[A-Za-z]:)") & (F.length(path) > 0) & (depth["low"] >= 0), F.lit(False))


def originals(spark: SparkSession, records: DataFrame, root: str) -> DataFrame:
    """(doc_id, path, content): the files of records, of which only those below the root are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")
    wanted = records.where(inside(F.col("original_path"))).select("doc_id", F.regexp_replace("original_path", r"\\\\", "/").alias("_tail"))
    tail = F.substring(F.col("path"), F.length(F.lit(root.rstrip("/"))) + 2 + F.locate(root.rstrip("/"), F.col("path")) - 1, 4096)
    return files.withColumn("_tail", tail).join(wanted, "_tail").select("doc_id", "path", "content")


def record_segments(saved: DataFrame) -> DataFrame:
    """(doc_id, ordinal, segment_id, source, translation, status, locked) of saved records."""
    rows = saved.select(F.col("id").alias("doc_id"), F.posexplode("segments").alias("_p", "_s"))
    return rows.select("doc_id", (F.col("_p") + 1).alias("ordinal"), F.col("_s.id").alias("segment_id"), "_s.source", "_s.translation", "_s.status", "_s.locked")
