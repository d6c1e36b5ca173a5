"""Sources: discovered files, JSON layout exports, cached layouts checked by hash, index rows, text lines, limits.

PDF decoding, layout models, spreadsheets and the network stay behind tables: whoever has them fills `pages`, `items`,
`cells`, `words`, `chars`, `index_rows`; the operators start there.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.collect import ALIASES, normal_header

#: Contract tables: DDL of what the operators read.
CONTRACT = {
    "documents": "doc_id STRING, path STRING, sha256 STRING, bytes BIGINT",
    "pages": "doc_id STRING, page_no INT, width DOUBLE, height DOUBLE, text STRING",
    "words": "doc_id STRING, page_no INT, seq INT, text STRING, x0 DOUBLE, x1 DOUBLE, top DOUBLE, bottom DOUBLE, direction STRING",
    "chars": "doc_id STRING, page_no INT, seq INT, text STRING, fontname STRING, x0 DOUBLE, x1 DOUBLE, top DOUBLE, bottom DOUBLE, matrix ARRAY<DOUBLE>",
    "items": "doc_id STRING, item_seq INT, kind STRING, text STRING, orig STRING, marker STRING, page_no INT, l DOUBLE, t DOUBLE, r DOUBLE, b DOUBLE, origin STRING, width DOUBLE, height DOUBLE",
    "cells": "doc_id STRING, item_seq INT, cell_seq INT, text STRING, r0 INT, r1 INT, c0 INT, c1 INT",
    "index_rows": "file STRING, sheet STRING, position INT, cells ARRAY<STRING>",
    "registry": "chave STRING, entry STRING",
}
MOST_PAGES, MOST_MB = 500, 100


def contract(spark: SparkSession, name: str, df: DataFrame | None = None) -> DataFrame:
    """A contract table: df with its columns cast and ordered, missing ones null; empty without df."""
    schema = T.StructType.fromDDL(CONTRACT[name])
    if df is None:
        return spark.createDataFrame([], schema)
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def discover(spark: SparkSession, source: str, suffix: str = ".pdf") -> DataFrame:
    """path, target (the path below source as Markdown), bytes: files of a suffix, in any letter case, whose contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source).select("path", F.col("length").alias("bytes"))
    base = F.lit(source.rstrip("/").split("://")[-1].lstrip("/"))
    below = F.regexp_replace(F.element_at(F.split("path", F.concat(F.lit(r"\Q"), base, F.lit(r"\E/?"))), -1), r"\.[^.]*$", ".md")
    return files.filter(F.lower("path").endswith(suffix)).select("path", below.alias("target"), "bytes").orderBy("path")


def refused(files: DataFrame, most_mb: int = MOST_MB, most_pages: int = MOST_PAGES) -> DataFrame:
    """files (bytes and, where a reader told, pages, encrypted, broken) with reason: null for those within the limits."""
    have = lambda c, d: F.col(c) if c in files.columns else F.lit(d)
    reason = (
        F.when(F.col("bytes") > most_mb * 1024 * 1024, F.concat(F.lit("mais de "), F.lit(str(most_mb)), F.lit(" MB")))
        .when(have("broken", False), "ficheiro corrompido").when(have("encrypted", False), "protegido por palavra-passe")
        .when(have("pages", 0) > most_pages, F.concat(F.lit("mais de "), F.lit(str(most_pages)), F.lit(" páginas")))
    )
    return files.withColumn("reason", reason)


def hashed(spark: SparkSession, path: str, glob: str = "*", inner: str = "") -> DataFrame:
    """path, stem, sha256 of files; inner: a pattern of what stands before the suffix and isn't part of the stem."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", F.regexp_replace(name, rf"(?:{inner})?\.[^.]*$", "").alias("stem"), F.sha2("content", 256).alias("sha256"))


def cached_layouts(layouts: DataFrame, sources: DataFrame, quality: DataFrame) -> DataFrame:
    """stem, path, state of cached layouts: `ambiguous` stem, `missing` record, `stale_source`, `stale_layout`, or `valid`.

    layouts, sources: stem, path, sha256; quality: stem, source_sha256, document_sha256 as recorded with the layout.
    """
    many = F.count("*").over(Window.partitionBy("stem"))
    rows = layouts.withColumn("many", many).join(sources.select("stem", F.col("sha256").alias("now")), "stem", "left").join(quality, "stem", "left")
    state = (
        F.when(F.col("many") > 1, "ambiguous").when(F.col("now").isNull() | F.col("source_sha256").isNull(), "missing")
        .when(F.col("now") != F.col("source_sha256"), "stale_source").when(F.col("sha256") != F.col("document_sha256"), "stale_layout").otherwise("valid")
    )
    return rows.select("stem", "path", state.alias("state"))


def layout_items(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, item_seq, kind, label, text, orig, marker, page_no, box, of layout exports in JSON (one document a file)."""
    box = "struct<l:double,t:double,r:double,b:double,coord_origin:string>"
    item = f"array<struct<self_ref:string,label:string,text:string,orig:string,marker:string,prov:array<struct<page_no:int,bbox:{box}>>>>"
    raw = spark.read.schema(f"name string, texts {item}").json(path, multiLine=True)
    rows = raw.select(F.col("name").alias("doc_id"), F.posexplode("texts").alias("item_seq", "i"))
    first = F.get("i.prov", F.lit(0))
    return rows.select(
        "doc_id", "item_seq", F.when(F.col("i.label") == "list_item", "list").otherwise("text").alias("kind"), F.col("i.label").alias("label"), "i.text", "i.orig", "i.marker",
        first["page_no"].alias("page_no"), *[first["bbox"][c].alias(c) for c in ("l", "t", "r", "b")], first["bbox"]["coord_origin"].alias("origin"),
    )


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no, value of text files; numbers follow the file's order."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", "\n")).alias("line_no", "value"))
    return whole.withColumn("line_no", F.col("line_no") + 1)


def delimited_sheet(content: bytes, delimiter: str = ",") -> list[tuple[str, list[list[str | None]]]]:
    """Delimited text as one sheet, `1`."""
    return [("1", [[v or None for v in row] for row in csv.reader(io.StringIO(content.decode("utf-8-sig")), delimiter=delimiter)])]


def index_rows(spark: SparkSession, path: str, reader: Callable[[bytes], list[tuple[str, list[list]]]] = delimited_sheet) -> DataFrame:
    """file, sheet, position (from 1), header, cells of every sheet of index files; and rows with a problem instead.

    reader turns a file's bytes into (sheet, rows) pairs, the first row of each being its own header; one for spreadsheets
    is injected where there is a library for them. A sheet that names neither title nor address is no index and is left
    out; a file without such a sheet, without rows, or that the reader refuses gives one row with its problem.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    wanted = {name for field in ("titulo", "url") for name in ALIASES[field]}

    def text(v) -> str | None:
        return None if v is None or v == "" else str(v).strip()

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name, rows, problem = file.rsplit("/", 1)[-1], [], None
                try:
                    for sheet, found in reader(content):
                        if found and wanted & {normal_header(str(h or "")) for h in found[0]}:
                            header = [str(h or "") for h in found[0]]
                            rows += [(name, sheet, k, header, [text(v) for v in row], None) for k, row in enumerate(found[1:], 1)]
                    problem = None if rows else f"Sem linhas válidas de índice BTE em {name}."
                except Exception as exc:  # a file that can't be read is a row of its own, not the job's end
                    rows, problem = [], f"Índice inválido: {name}: {type(exc).__name__}"
                if problem:
                    rows = [(name, None, None, None, None, problem)]
                strings = pa.list_(pa.string())
                types = (pa.string(), pa.string(), pa.int64(), strings, strings, pa.string())
                for a in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 10_000], strict=True), types, strict=True)], ["file", "sheet", "position", "header", "cells", "problem"])

    return files.mapInArrow(run, "file string, sheet string, position long, header array<string>, cells array<string>, problem string")


def local_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """path (below the folder, `year/number/file`), local_sha256 of the documents at hand; none where there is no folder yet."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "path string, local_sha256 string")
    files = hashed(spark, folder, "*.pdf")
    return files.select(F.array_join(F.slice(F.split("path", "/"), -3, 3), "/").alias("path"), F.col("sha256").alias("local_sha256"))
