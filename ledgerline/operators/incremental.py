"""Processing only new or changed records, by a Merkle tree over key-range hashes.

Leaves are ranges of a record number; a leaf's digest covers the entries in it,
a node's digest its children's. All levels are saved with the output that they stand
for. A run hashes the current records once, descends from the root only where current and saved
digests differ, and reads entries of changed leaves only; output and new tree are published together
by one rename, so a run that dies before it leaves no trace and is repeated whole.
"""

from __future__ import annotations

import json
import math
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import join_on, materialize, small_or_plain

#: Numbers per leaf. Small ones keep a changed leaf from drawing many unchanged entries with it.
LEAF, FANOUT = 8, 512
#: Published outputs are rewritten as one after so many runs, so that a run reads few folders however many went before.
PARTS = 64


def _digest(h: Column) -> Column:
    """Order-free digest of a set of hashes, from xor, sum of mixed halves and count."""
    return F.xxhash64(F.coalesce(F.bit_xor(h), F.lit(0)), F.coalesce(F.sum(F.xxhash64(h).bitwiseAND(F.lit((1 << 30) - 1))), F.lit(0)), F.count(h))


def node_of(number: str, width: int) -> Column:
    return F.floor(F.col(number) / F.lit(width))


def leaves(entries: DataFrame, part: str, number: str, what: list[str], width: int = LEAF) -> DataFrame:
    """(part, node, d): digests of the leaves of ``width`` numbers, of distinct entries."""
    h = F.xxhash64(number, *[x for c in what for x in (F.col(c), F.col(c).isNull())])
    return entries.groupBy(F.col(part).alias("part"), node_of(number, width).alias("node")).agg(_digest(h).alias("d"))


def level_up(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    return nodes.groupBy("part", F.floor(F.col("node") / F.lit(fanout)).alias("node")).agg(_digest(F.xxhash64("node", "d")).alias("d"))


def grown(lowest: DataFrame, levels: int, fanout: int = FANOUT) -> DataFrame:
    """(part, node, d, level): a whole tree over its leaves (level 0); the levels above, a fanout-th at most, are written once each."""
    out, at = lowest.withColumn("level", F.lit(0)), lowest
    for i in range(1, levels + 1):
        at = materialize(level_up(at, fanout), "level")
        out = out.unionByName(at.withColumn("level", F.lit(i)))
    return out


def depth(last: int, fanout: int = FANOUT) -> int:
    """Levels above leaves up to number ``last``."""
    return max(1, math.ceil(math.log(max(2, last + 1), fanout)))


def changed_leaves(current: DataFrame, saved: DataFrame, levels: int, fanout: int = FANOUT) -> DataFrame:
    """(part, node) of the leaves in which two trees (part, node, d, level) differ, by descent from level ``levels``.

    A level's nodes are read only where their parents differ; a node of one tree only differs. A null part is a part.
    """
    inside = None
    for at in range(levels, -1, -1):
        both = current.filter(F.col("level") == at).select("part", "node", F.col("d").alias("a"), F.lit(None).cast("bigint").alias("b"))
        both = both.unionByName(saved.filter(F.col("level") == at).select("part", "node", F.lit(None).cast("bigint").alias("a"), F.col("d").alias("b")))
        if inside is not None:
            up = both.withColumn("up", F.floor(F.col("node") / F.lit(fanout)))
            both = join_on(up, inside.withColumnRenamed("node", "up"), ["part", "up"], "left_semi")
        inside = both.groupBy("part", "node").agg(F.max("a").alias("a"), F.max("b").alias("b")).filter(~F.col("a").eqNullSafe(F.col("b"))).select("part", "node")
    return inside


def speaking_runs(runs: DataFrame, feed: str = "feed", run: str = "run_id", attempt: str = "attempt", status: str = "status") -> DataFrame:
    """The successful runs: per (feed, run) the row with the greatest attempt, kept if its status is ok in any case.

    Of several rows with that attempt one that is ok stands, then the widest.
    """
    ok = F.coalesce(F.lower(F.trim(status)) == "ok", F.lit(False))
    last = runs.select(F.col(feed).alias("feed"), F.col(run).alias("run"), F.struct(F.col(attempt), ok.alias("ok"), "to_seq", (-F.col("from_seq")).alias("nf"), "started_at").alias("r"))
    return last.groupBy("feed", "run").agg(F.max("r").alias("r")).filter("r.ok").select("feed", (-F.col("r.nf")).alias("from_seq"), "r.to_seq", "r.started_at")


#: Numbers per range in which runs meet records.
REACH = 1024


def runs_by_range(runs: DataFrame, width: int = REACH) -> DataFrame:
    """Per (feed, range) the runs that reach into it, as one array, so a join with it adds no rows."""
    reach = F.sequence(F.floor((F.col("from_seq") + 1) / F.lit(width)), F.floor(F.col("to_seq") / F.lit(width)))
    one = runs.filter("to_seq > from_seq").select("feed", F.explode(reach).alias("range"), F.struct("from_seq", "to_seq", "started_at").alias("r"))
    return one.groupBy("feed", "range").agg(F.collect_list("r").alias("runs"))


def applied(records: DataFrame, runs: DataFrame, width: int = REACH) -> DataFrame:
    """The entries (feed, seq, key), each once, of which some record (.., arrived_at) was applied by a run; null arrivals were applied by none."""
    met = records.filter(F.col("seq").isNotNull() & F.col("arrived_at").isNotNull()).withColumn("range", F.floor(F.col("seq") / F.lit(width))).join(runs_by_range(runs, width), ["feed", "range"])
    done = F.exists("runs", lambda r: (r["from_seq"] < F.col("seq")) & (F.col("seq") <= r["to_seq"]) & (F.col("arrived_at") <= r["started_at"]))
    return met.filter(done).select("feed", "seq", "key").distinct()


def adopt(records: DataFrame, runs: DataFrame, root: str, width: int = LEAF) -> int:
    """Version 1 at ``root`` from a log of runs that saved no tree: what the runs applied, with its tree; take() goes on from it."""


    def tree(done: DataFrame) -> DataFrame:
        lowest = materialize(leaves(done, "feed", "seq", ["key"], width), "leaves")
        return grown(lowest, depth(lowest.agg(F.max("node")).first()[0] or 0))

    return publish(applied(records, runs), tree, root, 0)


def pending(records: DataFrame, runs: DataFrame, root: str, width: int = LEAF) -> DataFrame:
    """Entries (feed, seq, key) of which no record was applied by a run, each once: the output of the run after those of the log.

    Records (feed, seq, key, arrived_at) with null seq are no entries; a null key is a key; a null arrival was applied by no run.
    """
    adopt(records, runs, root, width)
    return published(records.sparkSession, root, "output", take(records, "feed", "seq", ["key"], root, width)).select("feed", "seq", "key")


def publish(output: DataFrame, tree: DataFrame | Callable[[DataFrame], DataFrame], root: str, base: int | None = None) -> int:
    """Write output and tree (or what it gives of the written output) side by side, then make both current by one rename; returns the version.

    ``base`` is the version that the run started from (by default the current one). A writer that dies before the rename leaves
    folders that nothing refers to. Of two writers with one base the second fails: the rename never replaces a marker. The marker names the folders of all outputs so far.
    """
    spark = output.sparkSession
    base = (current(spark, root) or 0) if base is None else base
    version = base + 1
    folder = f"{root}/v{version}-{uuid.uuid4().hex}"
    output.write.parquet(f"{folder}/output")
    if not isinstance(tree, DataFrame):
        tree = tree(spark.read.schema(output.schema).parquet(f"{folder}/output"))
    tree.write.partitionBy("level").parquet(f"{folder}/tree") if "level" in tree.columns else tree.write.parquet(f"{folder}/tree")
    parts = [*(_marker(spark, root, base)[2] if base else []), f"{folder}/output"]
    if len(parts) > PARTS:
        spark.read.schema(output.schema).parquet(*parts).write.parquet(f"{folder}/all")
        parts = [f"{folder}/all"]
    fs, path = _fs(spark, root)
    mine = path(f"{root}/tmp-{uuid.uuid4().hex}")
    made = fs.create(mine, False)
    made.write(bytearray("\n".join([folder, json.dumps({"output": output.schema.jsonValue(), "tree": tree.schema.jsonValue()}), *parts]).encode()))
    made.close()
    jvm = spark._jvm
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    never = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    never[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        files.rename(mine, path(f"{root}/commit-{version:012d}"), never)
    except Exception as x:
        fs.delete(mine, False)
        raise RuntimeError(f"version {version} was committed by another run") from x
    return version


def take(records: DataFrame, part: str, number: str, what: list[str], root: str, width: int = LEAF, fanout: int = FANOUT) -> int:
    """One run over ``records``: publishes those that no run published before, with the new tree; returns the version.

    Records are told apart by (part, number, what); repeated ones come once, one whose ``what`` changed
    comes again. Records are read once, for their distinct entries; of these, and of the entries that earlier runs published, only those in
    leaves whose digests differ are compared. A run that
    dies before its commit publishes nothing, and the next one takes the same records.
    """
    spark = records.sparkSession
    base = current(spark, root) or 0
    cols = [part, number, *what]
    once = materialize(records.filter(F.col(number).isNotNull()).select(*cols).distinct(), "entries")
    lowest = materialize(leaves(once, part, number, what, width), "leaves")
    levels = depth(lowest.agg(F.max("node")).first()[0] or 0, fanout)
    if not base:
        return publish(once, grown(lowest, levels, fanout), root, 0)
    saved = published(spark, root, "tree", base)
    top = saved.filter("level > 0").agg(F.max("level")).first()[0] or 0
    levels = max(levels, top)
    tree = grown(lowest, levels, fanout)
    if top < levels:  # the numbers outgrew the saved tree's root
        saved = grown(saved.filter("level = 0").drop("level"), levels, fanout)
    differ = materialize(changed_leaves(tree, saved, levels, fanout), "changed")
    n = differ.count()

    def inside(df: DataFrame) -> DataFrame:
        at = small_or_plain(differ.select(F.col("part").alias("__p"), F.col("node").alias("__n")), n, 40)
        return df.join(at, F.col(part).eqNullSafe(F.col("__p")) & (node_of(number, width) == F.col("__n")), "left_semi")

    _, schema, parts = _marker(spark, root, base)
    before = spark.read.schema(schema["output"]).parquet(*parts)
    # an entry's own number is part of the comparison, so a hot part or key is spread
    new = inside(once).select(*cols, F.lit(1).alias("side")).unionByName(inside(before.select(*cols)).withColumn("side", F.lit(0)))
    new = new.groupBy(*cols).agg(F.min("side").alias("side")).filter("side = 1").select(*cols)
    return publish(new, tree, root, base)


def _fs(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark._jsc.hadoopConfiguration()), path


def current(spark: SparkSession, root: str) -> int | None:
    """The last committed version, or None."""
    fs, path = _fs(spark, root)
    if not fs.exists(path(root)):
        return None
    found = [int(m[1]) for x in fs.listStatus(path(root)) if (m := re.fullmatch(r"commit-(\d+)", x.getPath().getName()))]
    return max(found, default=None)


def _marker(spark: SparkSession, root: str, version: int) -> tuple[str, dict[str, T.StructType], list[str]]:
    """A commit's folder, the schemas of its output and tree, and the folders of all outputs up to it."""
    folder, schemas, *parts = spark.read.text(f"{root}/commit-{version:012d}", wholetext=True).first()[0].split("\n")
    return folder, {k: T.StructType.fromJson(v) for k, v in json.loads(schemas).items()}, parts


def published(spark: SparkSession, root: str, what: str, version: int | None = None) -> DataFrame | None:
    """'output' or 'tree' of a committed version, by default the last; None before the first."""
    version = current(spark, root) if version is None else version
    if version is None:
        return None
    folder, schema, _ = _marker(spark, root, version)
    return spark.read.schema(schema[what]).parquet(f"{folder}/{what}")
