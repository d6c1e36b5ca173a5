"""An extension: the registry kept up to date from a stream of index items, a micro-batch at a time."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.collect import last_wins, upsert

FIELDS = ["ano", "num_bte", "tipo", "familia", "titulo", "url", "ficheiro"]


def deduplicated(items: DataFrame, time: str = "seen_at", wait: str = "1 hour") -> DataFrame:
    """A stream without keys that were seen within the watermark."""
    return items.withWatermark(time, wait).dropDuplicatesWithinWatermark(["chave"])


def versions(base: str) -> tuple[Callable[[SparkSession], DataFrame | None], Callable[[DataFrame, int], None]]:
    """read, write of a registry kept as numbered Parquet versions; a version counts once its pointer row is committed."""

    def read(spark: SparkSession) -> DataFrame | None:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{base}/current")
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return None
        now = spark.read.schema("epoch long, path string").json(f"{base}/current").orderBy(F.desc("epoch")).first()
        return spark.read.parquet(now["path"]) if now else None

    def write(df: DataFrame, epoch: int) -> None:
        path = f"{base}/v-{epoch}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        df.sparkSession.createDataFrame([(epoch, path)], "epoch long, path string").coalesce(1).write.mode("append").json(f"{base}/current")

    return read, write


def keep_registry(items: DataFrame, base: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Starts a query that puts each batch's last item of a key over the registry; a repeated batch changes nothing.

    Items of one time are ordered by their fields, so a rerun agrees. Each version is a whole table: the registry is a
    catalogue's index, far smaller than its documents.
    """
    read, write = versions(base)

    def batch(df: DataFrame, epoch: int) -> None:
        latest = last_wins(df, ["chave"], ["seen_at", *FIELDS]).select("chave", *FIELDS)
        known = read(df.sparkSession)
        write(latest if known is None else upsert(known, latest, FIELDS), epoch)

    return items.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
