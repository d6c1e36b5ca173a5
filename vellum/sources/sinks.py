"""Sinks: tables that refuse to overwrite, a sorted registry, the sets of files of documents."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.report import atomic_write


def write_table(df: DataFrame, path: str, overwrite: bool = False, by: str | None = None) -> None:
    """Parquet by Spark's commit protocol; an existing table is an error unless overwrite."""
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_registry(registry: DataFrame, path: str, files: int | None = None) -> None:
    """JSON lines sorted by key (chave, entry); `files` joins small parts, sorted as a whole all the same."""
    ordered = registry.orderBy("chave").select(F.col("entry").alias("value"))
    (ordered.coalesce(files) if files else ordered).write.mode("overwrite").text(path)


#: A document's files, in the order they are written: the final text is last, so that it stands for a whole set.
OUTPUTS = {"raw": "_auditoria/{}.layout.md", "quality": "_auditoria/{}.qualidade.json", "diagnostic": "_auditoria/{}.qualidade.md", "layout": "_auditoria/{}.layout.json", "markdown": "{}.md"}


def write_documents(rendered: DataFrame, folder: str, overwrite: bool = False, doc: str = "doc_id") -> int:
    """The files of OUTPUTS that rendered has columns for, a set for each document, below a folder that all executors see.

    Without overwrite, nothing is written if any of the files exists. Executors write the files, each by temporary name and
    rename; a set's final text comes last. Returns the number of documents. Use write_table for large sets.
    """
    names = {c: OUTPUTS[c] for c in OUTPUTS if c in rendered.columns}
    rows = rendered.select(F.col(doc).cast("string").alias("x_doc"), *names)

    def paths(key: str) -> list[str]:
        below = [os.path.normpath(os.path.join(folder, pattern.format(key))) for pattern in names.values()]
        if any(os.path.commonpath([os.path.abspath(folder), os.path.abspath(p)]) != os.path.abspath(folder) for p in below):
            raise ValueError(f"a path outside of {folder}: {key}")
        return below

    def clashes(batches):
        for batch in batches:
            there = [p for key in batch.column(0).to_pylist() for p in paths(key) if os.path.exists(p)]
            yield pa.RecordBatch.from_arrays([pa.array(there, pa.string())], ["path"])

    def write(batches):
        for batch in batches:
            for key, *texts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for path, text in zip(paths(key), texts, strict=True):
                    if text is not None:
                        atomic_write(path, text)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    if not overwrite and (there := rows.select("x_doc").mapInArrow(clashes, "path string").orderBy("path").first()):
        raise FileExistsError(there[0])
    return rows.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0
