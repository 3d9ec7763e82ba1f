"""Session helpers: table reading, lineage cuts in the shared folder, size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its counted rows times its row width stay under this.
BROADCAST_BYTES = 32 << 20
#: Tasks that share the rows of one key where they meet its one row.
SALTS = 8


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where it is unset (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    local = "file://" + tempfile.mkdtemp(prefix="ledgerline-")
    spark.conf.set("spark.checkpoint.dir", local)
    return local


_written: list[tuple[SparkSession, str]] = []


def shared_path(spark: SparkSession, hint: str) -> str:
    """A new path in the shared folder, deleted by release()."""
    path = os.path.join(shared_dir(spark), f"ledgerline-{hint}-{uuid.uuid4().hex}")
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, hint: str = "t", by: list[str] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Unlike ``checkpoint()`` this computes the plan once, keeps the columns apart
    and survives the loss of any executor. Columns ``by``, of few values, become folders, so that a filter on them reads no other rows.
    """
    spark = df.sparkSession
    path = shared_path(spark, hint)
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Delete the tables that materialize() wrote."""
    while _written:
        spark, path = _written.pop()
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:
            pass


atexit.register(release)


def small_or_plain(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Hint a broadcast only when the counted size is under BROADCAST_BYTES; else leave it to shuffle."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def spread(df: DataFrame, by: str) -> DataFrame:
    """Spread a table of fewer splits than cores before heavy work per row; with more splits nothing moves.

    A plan with a shuffle is spread by that already, and counting its splits would run it.
    """
    spark = df.sparkSession
    try:
        if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
            return df
        cores, splits = spark.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    except (AttributeError, PySparkException):  # a remote session doesn't tell; files tell at least whether there are few
        cores, splits = 32, len(df.inputFiles())
    return df.repartition(cores, by) if splits < cores else df


def per_key(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """join_on() of many rows a key with one row a key: ``right`` is repeated ``salts`` times, so a key with a third of the rows is met in as many tasks."""
    salt = F.pmod(F.xxhash64(*[c for c in left.columns]), F.lit(salts))
    many = right.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return join_on(left.withColumn("__salt", salt), many, [*keys, "__salt"], how).drop("__salt")


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join by columns of equal names where null equals null; the left side's key columns stay."""
    other = right
    for k in keys:
        other = other.withColumnRenamed(k, f"__on_{k}")
    met = F.lit(True)
    for k in keys:
        met = met & left[k].eqNullSafe(other[f"__on_{k}"])
    return left.join(other, met, how).drop(*[f"__on_{k}" for k in keys])
