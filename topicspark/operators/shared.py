"""Helpers for work that must hold when one group owns a third of all rows."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 50_000
SALTS = 64
BUCKET_MS = 3_600_000
TASK_ROWS = 400_000  # rows that a task sorts where their number is known


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for reliable checkpoints: the cluster's, or in local mode a fresh one where none is named."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="topicspark-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the checkpoint folder, so that later plans start from files."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def salt() -> Column:
    """Spread of a topic's records: a run of consecutive offsets shares a salt, so a file holds few of them."""
    return F.pmod(F.xxhash64("partition", F.expr("offset div 65536")), F.lit(SALTS)).cast("int")


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` of about ``rows`` rows in tasks of about ``TASK_ROWS``, by ``keys``.

    Re-planning joins partitions by their bytes in the shuffle; those of short numbers and repeated texts grow many times
    when they are sorted.  So the number of tasks follows the rows instead.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    return df.repartition(tasks, *keys)


def join_by_topic(
    log: DataFrame, per_topic: DataFrame, how: str = "inner", stored: bool = False, spread: Column | None = None
) -> DataFrame:
    """Add the columns of a frame with one row per topic, ``stored`` if it is checkpointed already.

    Up to ``BROADCAST_ROWS`` topics the small side is broadcast and the log is not shuffled.  Beyond that the small
    side is repeated once per salt, and the log is spread over (topic, salt), so that no topic fills one task;
    rows that are no records name what to ``spread`` them by.
    """
    facts = per_topic if stored else checkpointed(per_topic)
    if facts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return log.join(F.broadcast(facts), "topic", how)
    by = salt() if spread is None else F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
    spread = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return log.withColumn("_salt", by).join(spread, ["topic", "_salt"], how).drop("_salt")


def _from_edge(log: DataFrame, block: Column, newest: bool, n: int) -> DataFrame:
    """Records in the outermost blocks of each topic that hold at least ``n`` together.

    Blocks are counted from two narrow columns; the records beyond them leave before anything is sorted.
    """
    counts = log.groupBy("topic", block.alias("_block")).agg(F.count("*").alias("_n"))
    inward = Window.partitionBy("topic").orderBy(F.desc("_block") if newest else F.asc("_block"))
    needed = counts.withColumn("_before", F.sum("_n").over(inward) - F.col("_n")).filter(F.col("_before") < n)
    edge = F.min("_block") if newest else F.max("_block")
    cut = join_by_topic(log.withColumn("_block", block), needed.groupBy("topic").agg(edge.alias("_edge")))
    inside = F.col("_block") >= F.col("_edge") if newest else F.col("_block") <= F.col("_edge")
    return cut.filter(inside).select(*log.columns)


def first_per_topic(log: DataFrame, order: Sequence[Column], n: int, block: Column, newest: bool = False) -> DataFrame:
    """First ``n`` records of each topic by ``order``; ``block`` is its leading part made coarse.

    Places (topic, partition, offset, timestamp) are ranked, not records, so no value is sorted or shuffled: within
    salted parts of a topic, then over what the parts keep.  Spark limits each window before its shuffle too, so a
    topic's last task sees at most ``n`` rows from each task of the first step.  It does so up to a set number of
    ranks; beyond that, whole blocks that cannot hold a result are cut off first.  The places are stored, and the log
    is read again for their records only, within their span of time: up to ``BROADCAST_ROWS`` places are broadcast.
    """
    place = ["topic", "partition", "offset"]
    places = log.select(*place, "timestamp")
    limited = int(log.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n > limited:
        places = _from_edge(places, block, newest, n)
    within = Window.partitionBy("topic", "_salt").orderBy(*order)
    over_all = Window.partitionBy("topic").orderBy(*order)
    parts = places.withColumn("_salt", salt()).withColumn("_rank", F.row_number().over(within)).filter(F.col("_rank") <= n)
    kept = checkpointed(
        parts.withColumn("_rank", F.row_number().over(over_all)).filter(F.col("_rank") <= n).select(*place, "timestamp")
    )
    facts = kept.agg(F.count("*"), F.count("timestamp"), F.min("timestamp"), F.max("timestamp")).first()
    if facts[0] and facts[0] == facts[1]:
        log = log.filter(F.col("timestamp").between(F.lit(facts[2]), F.lit(facts[3])))
    wanted = kept.select(*place)
    return log.join(F.broadcast(wanted) if facts[0] <= BROADCAST_ROWS else wanted, place, "left_semi")


def with_previous(
    df: DataFrame, group: Sequence[str], at_ms: str, order: Sequence[str], carry: Column, name: str,
    bucket_ms: int = BUCKET_MS,
) -> DataFrame:
    """Add ``carry`` of the preceding row of the same group, by ``order`` (whose first part is ``at_ms``).

    A group is cut into time buckets, each looked back within on its own.  Only the first row of each bucket, which
    also knows the bucket's last one, goes to the second step, where it looks back at the bucket before.
    """
    rows = df.withColumn("_bucket", F.expr(f"`{at_ms}` div {bucket_ms}")).withColumn("_carry", carry)
    bucket = Window.partitionBy(*group, "_bucket").orderBy(*order)
    whole = bucket.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    looked = rows.withColumn(name, F.lag("_carry").over(bucket)).withColumn("_last", F.last("_carry").over(whole))
    buckets = Window.partitionBy(*group).orderBy("_bucket")
    firsts = looked.filter(F.col(name).isNull()).withColumn(name, F.lag("_last").over(buckets))
    return looked.filter(F.col(name).isNotNull()).unionByName(firsts).drop("_bucket", "_carry", "_last")
