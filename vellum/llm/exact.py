"""Exact dedup with a heavy-hitter split.

Every partition keeps a Misra-Gries summary of its digests; summed, the summaries name every digest that may be frequent.
An exact count of those few names verifies them, and the verified winners (at most `heavy` rows) are broadcast, so rows of
a frequent text are settled where they are read. All other digests are rare and take an ordinary shuffle.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, columns_of, free_name


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text, computed in the JVM: no batch of whole texts goes to a Python worker."""
    return F.unhex(F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256))


def _misra_gries(counters: int):
    def run(batches):
        held: dict[bytes, int] = {}
        for batch in batches:
            for sha in batch.column("x_sha").to_pylist():
                if sha in held:
                    held[sha] += 1
                elif len(held) < counters:
                    held[sha] = 1
                else:
                    held = {k: v - 1 for k, v in held.items() if v > 1}
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary()), pa.array(held.values(), pa.int64())], ["x_sha", "x_n"])

    return run


def _settled(rows: DataFrame) -> DataFrame:
    """Adds what all rows of a digest share: the winner, the id that stays, and the count."""
    return rows.groupBy("x_sha").agg(F.max(F.struct("x_id", "x_row")).alias("x_top"), F.count("*").alias("x_size"))


def exact_dedup(docs: DataFrame, text: str = "text", id: str = "doc_id", heavy: int = 1024) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. The largest id of a group stays; of repeated rows with that id,
    one stays. A null text counts as empty; a null id is smaller than any other; an empty table gives no rows. Other
    columns are ignored. `heavy` bounds the counters of a partition and the broadcast (heavy rows of about 70 bytes).
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.save(docs.select(F.col(id).cast("long").alias("x_id"), F.monotonically_increasing_id().alias("x_row"), digest(F.col(text)).alias("x_sha")))
    total = rows.count()
    # Misra-Gries never counts too many, so at most `heavy` digests can reach total / heavy; none with twice that many rows is missed.
    named = (
        rows.select("x_sha").mapInArrow(_misra_gries(2 * heavy), "x_sha binary, x_n long")
        .groupBy("x_sha").agg(F.sum("x_n").alias("x_n")).filter(F.col("x_n") * heavy >= max(total, 2 * heavy)).select("x_sha")
    )
    winners = scratch.save(_settled(rows.join(F.broadcast(named), "x_sha", "left_semi")))
    settled = rows.join(F.broadcast(winners), "x_sha", "left")
    # Counted with map-side sums and joined back: the join, unlike a window, can be split where a digest has many rows.
    light = settled.filter(F.col("x_size").isNull()).select("x_id", "x_row", "x_sha")
    rest = light.join(_settled(light), "x_sha").select("x_id", "x_row", "x_sha", "x_top", "x_size")
    return settled.filter(F.col("x_size").isNotNull()).select(*rest.columns).unionByName(rest).select(
        F.col("x_id").alias("doc_id"),
        F.col("x_top.x_id").alias("keep_id"),
        F.col("x_size").alias("group_size"),
        (F.col("x_row") == F.col("x_top.x_row")).alias("kept"),
        F.lower(F.hex("x_sha")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, decided: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The rows of docs that exact_dedup's table keeps, with all columns of docs, whatever their names.

    Repeated rows (one id, equal texts) leave one, of which the other columns are those of any of them.
    """
    d, s, n, k = free_name(docs, "x_d"), free_name(docs, "x_s"), free_name(docs, "x_n"), free_name(docs, "x_k")
    own = docs.withColumns({d: F.col(id).cast("long"), s: digest(F.col(text))})
    per = decided.groupBy(F.col("doc_id").alias("x_left"), F.unhex("text_sha256").alias("x_right")).agg(F.max("kept").alias(k), F.count("*").alias(n))
    per = Scratch(docs.sparkSession).save(per.filter(k).drop(k))
    hit = own.join(per.toDF(d + "_", s + "_", n), F.col(d).eqNullSafe(F.col(d + "_")) & (F.col(s) == F.col(s + "_")))
    if per.filter(F.col(n) > 1).isEmpty():
        return hit.select(columns_of(docs))
    again = hit.filter(F.col(n) > 1).dropDuplicates([d, s])
    return hit.filter(F.col(n) == 1).select(columns_of(docs)).unionByName(again.select(columns_of(docs)))
