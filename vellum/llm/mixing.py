"""Mixing sources to target weights, and sharding by stratified interleaving. Both rank rows by distributed prefix sums.

A row's key is the MD5 of seed, id, the text's size and its ends, so keys are uniform: equal ranges of keys hold about equal shares of any source,
however large. Rows are sorted inside (source, key range) only; the sums of the ranges before are added to what a row has
before it in its own range. No task sees a whole source, and a rerun finds the same order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, columns_of, free_name

WEIGHTS = (5, 2, 1)
#: Sources up to this many are broadcast (about 100 bytes each); beyond, the join shuffles and splits skewed keys.
SMALL = 50_000


#: Rows of a source and a range of keys, about, where there are more than the least number of ranges would hold.
RANGE = 1 << 20


def _key(seed: int, id: Column, text: Column) -> Column:
    """Uniform over rows that differ in id, size or the text's ends, so that very many rows under one id, or none, spread as well."""
    parts = [F.coalesce(id.cast("string"), F.lit("null")), F.octet_length(text).cast("string"), F.substring(text, 1, 32), F.substring(text, -32, 32)]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts).cast("binary"))


def _range(key: str, ranges: int) -> Column:
    return (F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * ranges / 2**32).cast("int")


def _with_source(rows: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    right = sources.withColumnRenamed("x_source", "x_source_")
    right = F.broadcast(right) if n <= SMALL else right
    return rows.join(right, rows["x_source"].eqNullSafe(right["x_source_"]), "left").drop("x_source_")


def _before(rows: DataFrame, group: str, range_: str, amount: str, order: list) -> DataFrame:
    """Adds x_before: the sum of amount over the rows of the same group that come earlier, ranges first, then order."""
    sums = rows.groupBy(group, range_).agg(F.sum(amount).alias("x_sum"))
    earlier = Window.partitionBy(group).orderBy(range_).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col(group).alias("x_g"), F.col(range_).alias("x_r"), F.coalesce(F.sum("x_sum").over(earlier), F.lit(0)).alias("x_offset")
    )
    inside = Window.partitionBy(group, range_).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("x_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    joined = rows.join(sums, (rows[group] == sums["x_g"]) & (rows[range_] == sums["x_r"]))
    return joined.withColumn("x_before", F.col("x_inside") + F.col("x_offset")).drop("x_g", "x_r", "x_inside", "x_offset", "x_sum")


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """Water filling over (x_source, x_size): x_rank by code point with null last, x_target capped at most * size.

    A source is above its cap exactly if, with sources by cap per weight, its cap is no more than its share of what the
    ones before it leave; so the repeated resharing of the excess ends here in one pass.
    """
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("x_source").isNull(), "x_source")
    rows = sizes.withColumn("x_rank", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("x_rank") % len(weights) + 1).cast("int")).cast("double")
    rows = rows.withColumn("x_w", weight).withColumn("x_cap", F.col("x_size") * most)
    filling = everything.orderBy(F.col("x_cap") / F.col("x_w"), "x_rank")
    first = filling.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "x_left": F.sum("x_size").over(everything) * share - F.coalesce(F.sum("x_cap").over(first), F.lit(0.0)),
        "x_open": F.sum("x_w").over(everything) - F.coalesce(F.sum("x_w").over(first), F.lit(0.0)),
    }).withColumn("x_full", F.col("x_cap") * F.col("x_open") <= F.col("x_w") * F.col("x_left"))
    level = F.min(F.when(~F.col("x_full"), F.struct(F.col("x_cap") / F.col("x_w"), F.col("x_rank"), F.col("x_left") / F.col("x_open"))))
    rows = rows.withColumn("x_level", level.over(everything)["col3"])
    return rows.select("x_source", "x_rank", "x_size", F.when(F.col("x_full"), F.col("x_cap")).otherwise(F.col("x_w") * F.col("x_level")).alias("x_target"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", id: str = "doc_id", seed: int = 17, ranges: int = 1024, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken.

    Each source takes whole epochs of itself while its budget lasts, then rows in key order up to the exact word where
    the budget ends. Null or wordless texts have size 0 and nothing taken; null sources are one source, the last; rows
    with one id and size are interchangeable; an empty table gives no rows. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    size = F.regexp_count(body, F.lit(WORD)).cast("long")
    rows = scratch.save(docs.select(F.col(id).alias("x_id"), F.col(source).alias("x_source"), size.alias("x_n"), _key(seed, F.col(id), body).alias("x_key")))
    ranges = max(ranges, rows.count() // RANGE)
    sources = scratch.save(targets(rows.groupBy("x_source").agg(F.sum("x_n").alias("x_size")), share, most))
    rows = _with_source(rows, sources, sources.count()).withColumn("x_range", _range("x_key", ranges))
    rows = _before(rows, "x_rank", "x_range", "x_n", ["x_key", "x_n"])
    epochs = F.when(F.col("x_size") > 0, F.floor(F.floor("x_target") / F.col("x_size"))).otherwise(0)
    rest = F.floor("x_target") - epochs * F.col("x_size")
    part = F.least(F.col("x_n"), F.greatest(F.lit(0), rest - F.col("x_before")))
    return rows.select(
        F.col("x_id").alias("doc_id"), F.col("x_n").alias("size"), F.col("x_size").alias("source_size"),
        F.col("x_target").alias("target"), (epochs * F.col("x_n") + part).cast("long").alias("taken"),
    )


def apply_mix(docs: DataFrame, mixed: DataFrame, id: str = "doc_id") -> DataFrame:
    """docs with each row as often as the mix takes it, with all columns of docs, whatever their names.

    A row taken in part at a budget's end counts as a whole copy. Rows that hold no word have nothing to take and go. Of
    repeated ids every row follows the id's largest decision.
    """
    own, times, copy = (free_name(docs, x) for x in ("x_own", "x_times", "x_copy"))
    copies = F.ceil(F.col("taken") / F.col("size")).cast("int")
    take = mixed.filter("taken > 0").groupBy(F.col("doc_id").alias(own)).agg(F.max(copies).alias(times))
    hit = docs.join(take, docs[id].eqNullSafe(take[own]))
    return hit.withColumn(copy, F.explode(F.sequence(F.lit(1), times))).select(columns_of(docs))


def interleave(docs: DataFrame, shards: int = 24, text: str = "text", source: str = "source", id: str = "doc_id", seed: int = 29, ranges: int = 1024) -> DataFrame:
    """Stratified interleaving into shards whose row counts are at most one apart (law `rows`).

    Row r of a source's n rows in seeded order stands at (r + phase) / n, with a fixed phase in (0, 1) for each source;
    the rows sorted by that place are cut into equal runs, so each shard has every source's share within one row.
    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law). Null texts have size 8 and the
    CRC of nothing; null sources are one source; rows with one id and text are interchangeable; an empty table gives no
    rows. Equal texts are no constraint here: a group of copies may be larger than a shard.
    """
    scratch = Scratch(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = scratch.save(docs.select(
        F.col(id).alias("x_id"), F.col(source).alias("x_source"), (F.octet_length(body) + 8).cast("long").alias("x_bytes"), F.crc32(body.cast("binary")).alias("x_crc"),
        _key(seed, F.col(id), body).alias("x_key"),
    ))
    ranges = max(ranges, rows.count() // RANGE)
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("x_source").isNull(), "x_source")
    phase = (F.conv(F.substring(F.md5(F.coalesce(F.concat(F.lit("s"), "x_source"), F.lit("null")).cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / 2**32
    sources = scratch.save(rows.groupBy("x_source").agg(F.count("*").alias("x_of")).select("x_source", "x_of", phase.alias("x_phase"), F.row_number().over(by_name).alias("x_rank")))
    rows = _with_source(rows, sources, sources.count()).withColumn("x_one", F.lit(1)).withColumn("x_range", _range("x_key", ranges))
    rows = _before(rows, "x_rank", "x_range", "x_one", ["x_key", "x_crc", "x_bytes"])
    rows = rows.withColumn("x_place", (F.col("x_before") + F.col("x_phase")) / F.col("x_of"))
    rows = scratch.save(rows.select("x_id", "x_bytes", "x_crc", "x_rank", "x_key", "x_one", "x_place", F.least(F.lit(ranges - 1), F.floor(F.col("x_place") * ranges)).cast("int").alias("x_range"), F.lit(0).alias("x_all")))
    total = rows.count()
    rows = _before(rows, "x_all", "x_range", "x_one", ["x_place", "x_key", "x_rank", "x_crc", "x_bytes"])
    shard = F.expr(f"cast(x_before * {shards} div {max(total, 1)} as int)")
    return rows.withColumn("x_shard", shard).select(
        F.col("x_id").alias("doc_id"), F.col("x_bytes").alias("size"), F.col("x_crc").alias("text_crc32"), F.lit("rows").alias("law"),
        F.col("x_shard").alias("shard"),
        F.expr(f"x_before - (x_shard * cast({total} as bigint) + {shards - 1}) div {shards}").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
