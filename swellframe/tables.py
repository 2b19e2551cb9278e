"""Tables of the given folder, scratch tables in the shared folder, and the cloud, cube and series drawn from them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which the driver and all executors share. Only a local session may name
    none; it gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path for a table in the shared folder."""
    return f"{shared_dir(spark)}/swellframe/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame, kind: str = "cut") -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: later steps survive lost executors
    without computing it again."""
    path = scratch(df.sparkSession, kind)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the tables behind results of cut() that nothing needs any more."""
    for df in tables:
        path = getattr(df, "scratch_path", None)
        if path:
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def bounded(small: DataFrame, most: int = 100_000) -> DataFrame:
    """A table of short rows, marked for broadcast if it has at most `most` rows; beyond that joins shuffle."""
    return F.broadcast(small) if small.limit(most + 1).count() <= most else small


def dealt(df: DataFrame, *keys: str, rows: int = 500_000) -> DataFrame:
    """df in parts by keys, of about `rows` rows each, for groupings by keys that few rows share: what a task holds doesn't
    grow with the table."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, -(-df.count() // rows)), *keys)


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points: frame, pid, x, y, z from lineitem."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("frame"), F.col("l_orderkey").alias("pid"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_extendedprice") / 1000).alias("z"))


def cube(spark: SparkSession, sf_dir: str, rows: int = 48, cols: int = 32) -> DataFrame:
    """Elevation cube: t, i, j, z; cells that no line hits are missing."""
    x = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("t"), (F.col("l_partkey") % rows).cast("int").alias("i"), (F.col("l_suppkey") % cols).cast("int").alias("j"), F.col("l_extendedprice").alias("v"))
    return x.groupBy("t", "i", "j").agg((F.max("v") / 1000).alias("z"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time series: cell, t (ordinal in the cell by time), v."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("cell"), (F.row_number().over(w) - 1).alias("t"), F.col("value").alias("v"))
