"""Operation logs on storage: Parquet laid out for key lookups, checkpoints, archives, bulk ingest."""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.maintenance import LEVELS, bottom_drop, pick, retained, self_overlap, tombstoned
from ..operators.resolve import alive, newest
from ..schema import ID, LOG
from ..shared import materialize


def write_log(log: DataFrame, path: str, mode: str = "append", ranges: int | None = None, limit: int = 0) -> None:
    """Append to a log: a folder per dtype, files cut by key range and sorted by (key, sub, version descending).

    With ``limit`` bytes, once the folder has reached it, only deletes are let in; a batch with a put is refused whole.

    Sorted files give row groups narrow key bounds and the Parquet Bloom filter on ``key`` skips the rest,
    so a point or prefix read opens few row groups.
    """
    if limit > 0 and not within_quota(log.sparkSession, path, 1, limit) and not log.filter(~F.coalesce("deleted", F.lit(False))).isEmpty():
        raise ValueError("the log has reached its quota")
    cols = [f.name for f in LOG]
    parts = log.select(*cols)
    parts = parts.repartitionByRange(ranges, "dtype", "key", "sub", "version") if ranges else parts.repartitionByRange("dtype", "key", "sub", "version")
    (parts.sortWithinPartitions("dtype", "key", "sub", F.desc("version")).write.mode(mode).partitionBy("dtype")
     .option("parquet.bloom.filter.enabled#key", "true").option("compression", "zstd").parquet(path))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(path)


def compact(spark: SparkSession, path: str, to: str, horizon: int) -> None:
    """Write to ``to`` what a reader at or past ``horizon`` can still see."""
    write_log(retained(read_log(spark, path), ID, horizon), to, "errorifexists")


def checkpoint(log: DataFrame, root: str, name: str) -> str:
    """The resolved state, tombstones kept, under root/name; it is whole once Spark's commit marker is there."""
    write_log(newest(log), f"{root}/{name}", "errorifexists")
    return f"{root}/{name}"


def _list(spark: SparkSession, root: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    return sorted(x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS")))


def checkpoints(spark: SparkSession, root: str) -> list[str]:
    """Names of the whole checkpoints, in order."""
    return _list(spark, root)


def prune(spark: SparkSession, root: str, keep: int) -> list[str]:
    """Delete all but the ``keep`` greatest names; returns the deleted ones. keep < 1 deletes nothing."""
    gone = _list(spark, root)[:-keep] if keep > 0 else []
    for n in gone:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{n}")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return gone


def archive(log: DataFrame, path: str) -> None:
    """A log segment as gzip JSON lines, on any file system Spark knows (local, HDFS, S3)."""
    log.write.mode("errorifexists").option("compression", "gzip").json(path)


def read_archives(spark: SparkSession, *paths: str) -> DataFrame:
    """Archived segments as one log; records in several of them come once."""
    return spark.read.schema(LOG).json(list(paths)).distinct()


def ingest(files: DataFrame, log: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Bulk rows as new log rows, all at one version past the log's last, so that they win every read.

    ``tables`` (number, low, high), if given, are the bulk files' key ranges; ranges that meet are refused. Rows that
    point into a value log (``pointer``, where there is such a column) are refused too: their values are elsewhere.
    """
    if "pointer" in files.columns:
        if not files.filter("pointer").isEmpty():
            raise ValueError("ingested rows must hold their values")
        files = files.drop("pointer")
    if tables is not None and not self_overlap(tables, "low", "high", "number").isEmpty():
        raise ValueError("the ingested tables overlap each other")
    top = log.agg(F.max("version")).first()[0] or 0
    return files.withColumn("version", F.lit(top + 1).cast("bigint"))


class Levels:
    """A log kept as levels of tables: root/level=L/table=T, each a folder of Parquet sorted by key.

    Tables of level 0 may overlap; those of a deeper level don't, so a read meets at most one table a level. Folders are
    written whole before the old ones go, and a reader that meets both sees each row twice, which resolve() counts once.
    """

    def __init__(self, spark: SparkSession, root: str, table_rows: int = 1 << 20) -> None:
        self.spark, self.root, self.table_rows = spark, root, table_rows

    def _paths(self) -> list[tuple[int, str]]:
        out = []
        for lv in range(LEVELS):
            p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/level={lv}")
            fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
            if fs.exists(p):
                out += sorted((lv, x.getPath().toString()) for x in fs.listStatus(p) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS")))
        return out

    def read(self, *paths: str) -> DataFrame:
        paths = paths or [p for _, p in self._paths()]
        return self.spark.read.schema(LOG).parquet(*paths) if paths else self.spark.createDataFrame([], LOG)

    def tables(self, now: int = 0) -> DataFrame:
        """(level, table, low, high, rows, dead) from the tables' rows; key bounds and counts are what Parquet's footers know."""
        known = self._paths()
        if not known:
            return self.spark.createDataFrame([], "level int, table string, low string, high string, rows bigint, dead bigint")
        one = [self.read(p).agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum((~alive(now)).cast("bigint")), F.lit(0)).alias("dead")).select(F.lit(lv).alias("level"), F.lit(p).alias("table"), "low", "high", "rows", "dead") for lv, p in known]
        return reduce(DataFrame.unionByName, one)

    def add(self, rows: DataFrame, level: int = 0) -> str:
        """A new table, sorted; what a memtable's flush or an ingest writes."""
        path = f"{self.root}/level={level}/table={uuid.uuid4().hex}"
        rows.select(*[f.name for f in LOG]).orderBy("key", "sub", F.desc("version")).write.parquet(path)
        return path

    def ingest(self, rows: DataFrame) -> int:
        """Bulk rows as one table at the deepest level above the first that it meets, or the deepest of all; returns the level. Refused as in ingest()."""
        new = ingest(rows, self.read())
        low, high = new.agg(F.min("key"), F.max("key")).first()
        met = [r["level"] for r in self.tables().collect() if r["low"] is not None and low is not None and r["low"] <= high and low <= r["high"]]
        level = max(0, min(met, default=LEVELS) - 1)
        self.add(new, level)
        return level

    def compact(self, level: int, table: str | None = None, horizon: int = 0, now: int = 0, quiet: bool = False) -> int:
        """Merge a table, or all of the level, with the tables of the next level that it meets; returns how many tables took part.

        Kept is what a reader at ``horizon`` or later can see; expired puts become tombstones, and at the bottom of a ``quiet``
        store (no reader or collector is active) records that are only dead go. Other tables are not read.
        """
        known = self.tables().collect()
        mine = [r for r in known if r["level"] == level and r["low"] is not None and (table in (None, r["table"]) or level == 0)]
        if not mine or level >= LEVELS - 1:
            return 0
        low, high = min(r["low"] for r in mine), max(r["high"] for r in mine)
        below = [r for r in known if r["level"] == level + 1 and r["low"] is not None and r["low"] <= high and low <= r["high"]]
        kept = tombstoned(retained(self.read(*[r["table"] for r in mine + below]), ID, horizon), now)
        if quiet and level + 1 == LEVELS - 1:
            kept = bottom_drop(kept, ID, now)
        kept = materialize(kept, "merge")
        n = kept.count()
        if n:
            parts = max(1, -(-n // self.table_rows))
            cut = kept.repartitionByRange(parts, "key").sortWithinPartitions("key", "sub", F.desc("version"))
            # a table a key range: a key is never in two tables of a level
            cut = materialize(cut.withColumn("part", F.spark_partition_id()), "cut", ["part"])
            for r in cut.select("part").distinct().collect():
                self.add(cut.filter(F.col("part") == r["part"]), level + 1)
        for r in mine + below:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(r["table"])
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        return len(mine + below)

    def tick(self, base: int, horizon: int = 0, now: int = 0, quiet: bool = False) -> int:
        """Pick what is due and compact it; 0 if nothing is."""
        due = pick(self.tables(now), base, "table")
        return self.compact(due[0], due[1], horizon, now, quiet) if due else 0


#: First line of a snapshot's header.
MAGIC = "ledgerline-snapshot-1"


def snapshot(log: DataFrame, path: str) -> None:
    """The resolved state with a header of magic, rows and digest, written last."""
    spark = log.sparkSession
    newest(log).write.mode("errorifexists").parquet(f"{path}/rows")
    spark.createDataFrame([_header(spark.read.schema(LOG).parquet(f"{path}/rows"))], "magic string, n bigint, digest bigint").coalesce(1).write.json(f"{path}/header")


def _header(rows: DataFrame) -> tuple[str, int, int]:
    n, x = rows.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64(*[f.name for f in LOG])), F.lit(0))).first()
    return MAGIC, n, x


def restore(spark: SparkSession, path: str, to: str) -> None:
    """Replace the log at ``to`` by a snapshot; its header is held against its rows before anything is cleared."""
    try:
        head = tuple(spark.read.schema("magic string, n bigint, digest bigint").json(f"{path}/header").first())
        rows = spark.read.schema(LOG).parquet(f"{path}/rows")
        whole = head == _header(rows)
    except (TypeError, AnalysisException):
        whole = False
    if not whole:
        raise ValueError("not a whole snapshot")
    clear(spark, to)
    write_log(rows, to)


def clear(spark: SparkSession, path: str) -> None:
    """An empty log in place of what was there."""
    spark.createDataFrame([], LOG).write.mode("overwrite").partitionBy("dtype").parquet(path)


def within_quota(spark: SparkSession, path: str, more: int, limit: int) -> bool:
    """Whether a write of ``more`` bytes keeps the log's folder within ``limit`` bytes (0: no limit); deletes are always let through by callers."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    used = fs.getContentSummary(p).getLength() if fs.exists(p) else 0
    return limit <= 0 or used + more <= limit


def valid_name(name: str) -> bool:
    """Checkpoint names are plain, so that pruning by name stays inside the root."""
    return re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", name) is not None
