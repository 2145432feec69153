"""Sources: texts, files, HTML pages, Word documents, and model answers."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, suffix, asset_key, content): any files, addressed by their content."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return b.select("path", F.lower(F.regexp_extract("path", "(\\.[^./]+)$", 1)).alias("suffix"), F.substring(F.sha1("content"), 1, 16).alias("asset_key"), "content")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_paragraphs(content: bytes) -> list[tuple[str, str]]:
    """(style, text) of a Word document's paragraphs and table rows in order; [] for what is no such file."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_WORD}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return []
    text = lambda e: "".join(x.text or "" for x in e.iter(f"{_WORD}t")).strip()
    out = []
    for e in body if body is not None else []:
        if e.tag == f"{_WORD}p":
            style = e.find(f"{_WORD}pPr/{_WORD}pStyle")
            out.append((style.get(f"{_WORD}val", "") if style is not None else "", text(e)))
        elif e.tag == f"{_WORD}tbl":
            for i, row in enumerate(e.iter(f"{_WORD}tr")):
                cells = [text(c) for c in row.iter(f"{_WORD}tc")]
                out.append(("TableHead" if i == 0 else "TableRow", "| " + " | ".join(cells) + " |"))
    return [(s, x) for s, x in out if x]


def read_docx(files: DataFrame) -> DataFrame:
    """(path, ordinal, style, text) of the .docx files among read_files' rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, i, s, x) for p, c in zip(pdf.path, pdf.content) for i, (s, x) in enumerate(docx_paragraphs(c))]
            yield pd.DataFrame(rows, columns=["path", "ordinal", "style", "text"])

    return files.where("suffix = '.docx'").select("path", "content").mapInPandas(run, "path string, ordinal int, style string, text string")


def docx_lines(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs as marked lines: headings, list items, captions; table-of-contents styles go."""
    style = F.lower("style")
    line = (
        F.when(style.startswith("heading") | (style == "title"), F.concat(F.lit("## "), "text")).when(style.startswith("list"), F.concat(F.lit("- "), "text")).when(style == "caption", F.concat(F.lit("! "), "text")).otherwise(F.col("text"))
    )
    return paragraphs.where(~style.startswith("toc")).select("path", "ordinal", line.alias("line"))


def html_text(html: Column) -> Column:
    """A page's text: scripts, styles, comments and tags go; block ends become line feeds; five entities are read."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), "(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, "(?i)<br\\s*/?>|</(p|div|li|h[1-6]|tr|article|section)\\s*>", "\n")
    out = F.regexp_replace(out, "<[^>]+>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(out, "[ \\t]+", " "), " ?\\n[ \\n]*", "\n"))


def answers(prompts: DataFrame, complete: Callable[[str], str]) -> DataFrame:
    """(prompt_hash, raw): a model's answers, through any function that is given; one call a distinct prompt."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"prompt_hash": pdf.prompt_hash, "raw": [complete(p) for p in pdf.prompt]})

    return prompts.select("prompt_hash", "prompt").dropDuplicates(["prompt_hash"]).mapInPandas(run, "prompt_hash string, raw string")


def resolve_sources(requests: DataFrame, texts: DataFrame, prompts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects): each request's text by its kind: its own, its file's, or its prompt's answer.

    requests: request_id, content_type, content, path, prompt_hash.
    """
    t, p = texts.select(F.col("path").alias("_path"), F.col("text").alias("file_text")), prompts.select(F.col("prompt_hash").alias("_hash"), F.col("raw").alias("answer"))
    both = requests.join(t, requests["path"] == t["_path"], "left").join(p, requests["prompt_hash"] == p["_hash"], "left")
    text = F.when(F.col("content_type") == "text", F.col("content")).when(F.col("content_type") == "file", F.col("file_text")).when(F.col("content_type") == "prompt", F.col("answer"))
    out = both.select("request_id", "content_type", text.alias("text"))
    ok = F.coalesce(F.regexp_replace("text", "(?U)\\s", "") != "", F.lit(False))
    return out.where(ok), out.where(~ok)
