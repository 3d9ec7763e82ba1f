"""Structured Streaming: log ingest, replica apply, expiry timers, publish and subscribe."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.resolve import newest
from ..schema import LOG, SNAPSHOT
from ..shared import materialize, shared_dir
from ..sources.oplog import read_log


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A folder of log files as a stream; the file limit is the back pressure."""
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def ingest(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch to the log at ``path``: a batch is one folder, replaced if the batch is run again, so nothing is added twice."""

    def add(batch: DataFrame, number: int) -> None:
        batch.sortWithinPartitions("key", "sub", F.desc("version")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Parts of a replica's state by key; a batch rewrites those that it touches.
BUCKETS = 256


def replica(spark: SparkSession, root: str, upto: int | None = None) -> DataFrame:
    """A replica's state: of each bucket what the last batch (up to ``upto``) that touched it wrote."""
    at = _latest(spark, root, upto)
    return spark.read.schema(LOG).parquet(*[f"{root}/batch={n}/bucket={k}" for k, n in at.items()]).filter("version is not null") if at else spark.createDataFrame([], LOG)


def _latest(spark: SparkSession, root: str, upto: int | None) -> dict[int, int]:
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    out: dict[int, int] = {}
    if fs.exists(path(root)):
        for x in fs.listStatus(path(root)):
            n = int(x.getPath().getName().split("=")[1])
            if (upto is None or n <= upto) and fs.exists(path(x.getPath(), "_SUCCESS")):
                for y in fs.listStatus(x.getPath()):
                    if "=" in y.getPath().getName():
                        k = int(y.getPath().getName().split("=")[1])
                        out[k] = max(n, out.get(k, -1))
    return out


def replicate(stream: DataFrame, root: str, checkpoint: str, now: int) -> StreamingQuery:
    """Keep a replica's state: per batch the newest row per record of state and batch; expired puts become tombstones.

    Only buckets of keys that a batch touches are rewritten, beside their older copies, from those and the batch only, so a batch run again gives the same
    state; copies that two later ones replaced are deleted. A row of dtype SNAPSHOT tells that a snapshot begins: whatever has a version below its own is
    cleared in all buckets, before the rows after it count.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = materialize(batch, "batch")
        floor = batch.filter(F.col("dtype") == SNAPSHOT).agg(F.max("version")).first()[0]
        late = F.coalesce((F.col("expires_at") > 0) & (F.col("expires_at") <= now), F.lit(False))
        bucket = F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int")
        rows = batch.filter(~F.col("dtype").eqNullSafe(SNAPSHOT)).withColumn("deleted", F.col("deleted") | late).withColumn("bucket", bucket)
        held = _latest(spark, root, number - 1)
        touched = {r[0] for r in rows.select("bucket").distinct().collect()} | (set(held) if floor is not None else set())  # at most BUCKETS
        old = [f"{root}/batch={held[k]}/bucket={k}" for k in sorted(touched & set(held))]
        if old:
            rows = rows.unionByName(spark.read.schema(LOG).parquet(*old).withColumn("bucket", bucket))
        if floor is not None:
            rows = rows.filter(F.col("version") >= floor)
        state = newest(rows.select(*batch.columns)).withColumn("bucket", bucket)
        if floor is not None:  # a cleared bucket holds one empty row, which replica() leaves out
            state = state.unionByName(spark.createDataFrame([(*[None] * len(batch.columns), k) for k in sorted(touched)], state.schema))
        state.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/batch={number}")
        _drop_replaced(spark, root, number)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _drop_replaced(spark: SparkSession, root: str, number: int) -> None:
    """Delete the copies of buckets that batches up to ``number`` - 1 replaced; those of the last batch stay, for one that is run again."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    keep = _latest(spark, root, number - 1)
    for x in fs.listStatus(path(root)):
        n = int(x.getPath().getName().split("=")[1])
        if n < number:
            for y in fs.listStatus(x.getPath()):
                name = y.getPath().getName()
                if "=" in name and keep.get(int(name.split("=")[1])) != n:
                    fs.delete(y.getPath(), True)


def schedule(spark: SparkSession, task: Callable[[int], None], every: str, checkpoint: str) -> StreamingQuery:
    """Run ``task`` with the tick's number every so often ('10 seconds'): checkpoints, sweeps, compaction and collection. Stop the query to end it."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda _, number: task(number)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def expiry_timers(stream: DataFrame, now: str = "ts_s") -> DataFrame:
    """(dtype, key, sub, expired_at): a row when a record's expiry has passed in event time; a later write or delete cancels it.

    Needs the stream's event-time column ``at`` (TIMESTAMP) with a watermark. State is one row per record.
    """

    def on(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            version, due = state.get
            state.remove()
            yield pd.DataFrame({"dtype": [key[0]], "key": [key[1]], "sub": [key[2]], "expired_at": [due]})
            return
        best = state.get if state.exists else (-1, 0)
        for b in batches:
            for v, e, d in zip(b["version"], b["expires_at"], b["deleted"]):
                if v > best[0]:
                    best = (int(v), 0 if d else int(e))
        state.update(best)
        if best[1] > 0:
            state.setTimeoutTimestamp(max(best[1] * 1000, state.getCurrentWatermarkMs() + 1))

    return stream.groupBy("dtype", "key", "sub").applyInPandasWithState(on, "dtype string, key string, sub string, expired_at bigint", "version bigint, due bigint", "append", "EventTimeTimeout")


def deliver(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Stream of messages (channel, payload, t) x table of subscriptions (client, channel, since, until): one row per delivery.

    The rows are the result itself: every subscriber gets its copy.
    """
    s = subscriptions.select("client", F.col("channel").alias("__c"), "since", "until")
    held = (F.col("channel") == F.col("__c")) & (F.col("t") >= F.col("since")) & (F.col("until").isNull() | (F.col("t") < F.col("until")))
    return messages.join(s, held).select("client", "channel", "payload", "t")


def live_state(spark: SparkSession, path: str) -> DataFrame:
    """Batch view of an ingested log."""
    return newest(read_log(spark, path))


def checkpoint_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/stream-{name}"
