"""Shared helpers of the corpus operators: shared scratch tables, Arrow batches, text rules."""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import KEPT, shared_dir

#: ASCII white space as the contracts define it; everything else belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Scratch:
    """Tables written to the shared folder to cut lineage; a lost executor rereads them instead of recomputing.

    Those that a result reads stay until sources.scratch.clear deletes them.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{shared_dir(self.spark).rstrip('/')}/vellum-{uuid.uuid4().hex}"
        df.write.parquet(path)
        KEPT.append(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)  # while it is held, no other table gets its id
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing will read again."""
        for df in tables:
            if held := self.paths.pop(id(df), None):
                path = held[0]
                if path in KEPT:
                    KEPT.remove(path)
                jvm = self.spark.sparkContext._jvm
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else. Texts of ASCII only take the faster `lower`, which does the same to them."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def columns_of(docs: DataFrame) -> list[Column]:
    """All columns of docs, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def free_name(docs: DataFrame, name: str) -> str:
    """A name that starts with `name` and that no column of docs starts with, whatever its case."""
    taken = [c.lower() for c in docs.columns]
    while any(c.startswith(name.lower()) for c in taken):
        name += "_"
    return name


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and each row's offsets into them (null: empty)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[off[0] : off[-1]], off - off[0]


def slices(column: pa.Array, most: int):
    """Ranges of rows whose texts take about `most` bytes together; one text is never cut."""
    _, off = utf8(column)
    start = 0
    while start < len(off) - 1:
        end = max(start + 1, int(np.searchsorted(off, off[start] + most, side="right")) - 1)
        yield start, min(end, len(off) - 1)
        start = end


def blocks(batches, column: str, most: int):
    """Arrow batches cut so that each holds about `most` bytes of the named text column."""
    for batch in batches:
        if batch.num_rows:
            for a, b in slices(batch.column(batch.schema.get_field_index(column)), most):
                yield batch.slice(a, b - a)
