"""Corpus readers and writers.

JSON lines are parsed by Spark's reader; rows whose doc_id or text is missing,
empty or not a string are bad and counted, not fatal. Archives, pages and
office files are read as bytes and opened in Arrow batches.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jsonops import split_stream
from ..functions.text import html_to_text

CORPUS_DDL = "doc_id string, text string"


def parsed_lines(lines: DataFrame) -> DataFrame:
    """value -> doc_id, text, ok: both must be non-empty JSON strings."""
    v = F.try_parse_json("value")
    get = lambda k: F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")) == "STRING", F.try_variant_get(v, f"$.{k}", "string"))
    own = lines.where(F.trim("value") != "").select(get("doc_id").alias("doc_id"), get("text").alias("text"))
    return own.withColumn("ok", F.coalesce((F.col("doc_id") != "") & (F.col("text") != ""), F.lit(False)))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text of the good lines."""
    return parsed_lines(spark.read.text(path)).where("ok").select("doc_id", "text")


def count_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row: lines, good, bad."""
    return parsed_lines(spark.read.text(path)).agg(F.count("*").alias("lines_total"), F.coalesce(F.sum(F.col("ok").cast("long")), F.lit(0)).alias("lines_ok"), F.coalesce(F.sum((~F.col("ok")).cast("long")), F.lit(0)).alias("lines_bad"))


def read_json_stream(spark: SparkSession, path: str) -> DataFrame:
    """path, pos, doc, error of files that hold concatenated or comma-separated JSON documents."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.select("path", F.explode(split_stream("value")).alias("d")).select("path", "d.pos", "d.doc", "d.error")


def read_json_file(spark: SparkSession, path: str) -> DataFrame:
    """path, value (variant) of files with one JSON document each; null if it is not JSON."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("value"))


def write_jsonl(corpus: DataFrame, path: str) -> None:
    """Good rows as JSON lines."""
    corpus.where("doc_id is not null and text is not null and text <> ''").select(F.col("doc_id").cast("string").alias("doc_id"), "text").write.json(path)


# --- files -------------------------------------------------------------------


def docx_text(data: bytes) -> str:
    """Paragraphs, then table rows with cells separated by tabs."""
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{ns}body")
    words = lambda node: "".join(t.text or "" for t in node.iter(f"{ns}t"))
    out = [words(p) for p in body.findall(f"{ns}p")]
    for row in body.iter(f"{ns}tr"):
        out.append("\t".join(words(c) for c in row.findall(f"{ns}tc")))
    return "\n".join(out)


def file_text(name: str, data: bytes, pdf=None) -> str | None:
    """Text by extension; anything unknown is UTF-8 with invalid bytes dropped.

    ``pdf`` is a function from bytes to text; without it a PDF has no text.
    """
    kind = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    try:
        if kind == "docx":
            return docx_text(data)
        if kind == "pdf":
            return pdf(data) if pdf else None
        text = data.decode("utf-8", "ignore")
        return html_to_text(text) if kind in ("html", "htm") else text
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError):
        return None


def extract(files: DataFrame, pdf=None) -> DataFrame:
    """path, content (bytes) -> path, text; files without text are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b.path, "text": [file_text(p, bytes(c), pdf) for p, c in zip(b.path, b.content, strict=True)]})

    return files.select("path", "content").mapInPandas(run, "path string, text string").where("text is not null")


def members(files: DataFrame) -> DataFrame:
    """path, content of zip archives -> path, member, content of their files (no folders, no resource forks, no empty files)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b.path, b.content, strict=True):
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    for i in z.infolist():
                        if not i.is_dir() and "__MACOSX" not in i.filename and i.file_size:
                            yield pd.DataFrame({"path": [path], "member": [i.filename], "content": [z.read(i)]})

    return files.select("path", "content").mapInPandas(run, "path string, member string, content binary")


def read_files(spark: SparkSession, path: str, pdf=None) -> DataFrame:
    """path, text of a folder's files; archives are opened."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    inside = members(files.where("lower(path) like '%.zip'")).select(F.concat_ws("!", "path", "member").alias("path"), "content")
    return extract(files.where("not lower(path) like '%.zip'").unionByName(inside), pdf)


def new_documents(files: DataFrame, shard: int = 0, for_base: bool = True) -> DataFrame:
    """Catalog rows for extracted files: a fresh id, the file's name as title."""
    name = F.element_at(F.split("path", r"[/!]"), -1)
    return files.select(F.expr("uuid()").alias("external_id"), F.lit(shard).alias("shard_id"), F.lit("l5_uploaded" if for_base else "uploaded").alias("status"), name.alias("title"), "text")
