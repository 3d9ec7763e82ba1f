"""The canonical operation log and its constants.

One row is one write of one physical record: (dtype, key, sub) identify it, ``sub`` being a hash field,
set or sorted-set member, bit offset or list position ('' for strings). State as
of a version V at a time now: per record the row of the greatest version <= V,
gone if deleted or if expires_at > 0 and now >= expires_at.
"""

from __future__ import annotations

from pyspark.sql import types as T

#: 2024-01-28T00:00:00Z; queries never read the wall clock.
NOW = 1706400000
STRING, HASH, LIST, SET, ZSET, BITMAP, RAW = "s", "h", "l", "t", "z", "b", "raw"
#: dtype of a row that begins a snapshot in a replication feed.
SNAPSHOT = "snapshot"
ID = ["dtype", "key", "sub"]

LOG = T.StructType(
    [
        T.StructField("dtype", T.StringType()), T.StructField("key", T.StringType()), T.StructField("sub", T.StringType()),
        T.StructField("value", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("deleted", T.BooleanType()),
        T.StructField("expires_at", T.LongType()), T.StructField("version", T.LongType()), T.StructField("ts_s", T.LongType()),
    ]
)
