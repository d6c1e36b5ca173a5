"""Tables written to the shared folder to cut lineage; a lost executor rereads them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder on a local master, else a folder beside the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        local = spark.sparkContext.master.startswith("local")
        found = tempfile.mkdtemp(prefix="vellum-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_vellum"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Tables of this process that nobody has deleted yet.
KEPT: list[str] = []


def written(df: DataFrame) -> DataFrame:
    """df as a table of its own: computed once, with a plan that starts at its files. clear() deletes such tables."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    KEPT.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Deletes the tables that written() made in this process, once all results have been read. Returns how many."""
    jvm = spark.sparkContext._jvm
    n = len(KEPT)
    while KEPT:
        path = jvm.org.apache.hadoop.fs.Path(KEPT.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n
