"""Publish and subscribe, replication and replay, over bounded tables.

Messages without time reach no one; a null channel is a channel; a subscription without end holds on; entries without key or number
change nothing; of entries of one number the first to arrive stands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import materialize
from .orphans import as_of
from .patches import is_put
from .scan import prefix_scan


def delivered(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """messages (channel, t, ...) with ``n``, how many subscriptions (channel, since, until) hold since <= t < until.

    Opens count +1 and closes -1 on the channel's timeline, of which a running sum at the
    message's time gives the number: no message meets a subscription.
    """
    opens = subscriptions.select("channel", F.col("since").alias("t"), F.lit(1).alias("d"))
    closes = subscriptions.filter("until is not null").select("channel", F.col("until").alias("t"), F.lit(-1).alias("d"))
    steps = opens.unionByName(closes).groupBy("channel", "t").agg(F.sum("d").alias("d"))
    counts = materialize(prefix_scan(steps, ["channel"], "t", {"n": F.col("d")}), "counts")
    refs = messages.withColumn("k", F.col("channel")).withColumn("us", F.col("t"))
    known = as_of(refs, counts.select(F.col("channel").alias("k"), F.col("t").alias("us"), F.struct("t", "n").alias("s")))
    return known.select(*messages.columns, F.coalesce("s.n", F.lit(0)).cast("bigint").alias("n"))


def backlog_decision(replicas: DataFrame, newest_seq: int, capacity: int) -> DataFrame:
    """replicas (.., last) with partial: resync from the backlog iff 0 < last <= newest and last + 1 is still in it; else a full snapshot."""
    oldest = max(1, newest_seq - capacity + 1)
    return replicas.withColumn("partial", (F.col("last") > 0) & (F.col("last") <= newest_seq) & (F.col("last") + 1 >= oldest))


def since(feed: DataFrame, last: int, capacity: int, seq: str = "seq") -> DataFrame:
    """Entries past ``last`` that the backlog of the last ``capacity`` numbers holds, each once (the first to arrive)."""
    top = feed.agg(F.max(seq)).first()[0] or 0
    held = feed.filter((F.col(seq) > max(last, top - capacity)))
    cols = [c for c in held.columns if c not in (seq, "pos")]
    return held.groupBy(seq).agg(F.min(F.struct("pos", *cols)).alias("r")).select(seq, "r.*")


def replica_state(feed: DataFrame, now: int) -> DataFrame:
    """(key, val, expires_at, seq): what a replica holds after the feed: per key the entry of the greatest seq, if a put that is not expired."""
    x = feed.filter(F.col("key").isNotNull() & F.col("seq").isNotNull() & is_put("op").isNotNull())
    last = x.groupBy("key").agg(F.max(F.struct("seq", (-F.col("pos")).alias("np"), is_put("op").alias("put"), "val", F.coalesce("expires_at", F.lit(0)).alias("expires_at"))).alias("r"))
    return last.filter(F.col("r.put") & ((F.col("r.expires_at") == 0) | (F.col("r.expires_at") > now))).select("key", "r.val", "r.expires_at", "r.seq")
