"""What the operators share: stored tables, size-checked joins, word patterns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicspark.operators.shared import checkpoint_root

BROADCAST_ROWS = 50_000
SALTS = 64
# White space of the contracts: space and the five ASCII controls from tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder not used before, below the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet below the shared folder and read back: later plans start from those files."""
    folder = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def stored_tidily(df: DataFrame, name: str) -> DataFrame:
    """``stored``; the shuffle files of the write go as soon as it has ended, since nothing reads them again."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        # The setting is read when a frame is made.
        return stored(df.select("*"), name)
    finally:
        conf.set(key, before)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def join_facts(rows: DataFrame, facts: DataFrame, key: str, spread: Column) -> DataFrame:
    """``rows`` with the columns of ``facts``, which has one row per key; a null key meets the null key.

    ``facts`` must be stored.  It is broadcast up to ``BROADCAST_ROWS`` rows; beyond that it is repeated per salt and
    ``rows`` are dealt over (key, salt) by ``spread``, so that no key fills a task.
    """
    facts = facts.withColumnRenamed(key, "_key")
    if facts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(facts), rows[key].eqNullSafe(facts["_key"])).drop("_key")
    facts = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_dealt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    same = salted[key].eqNullSafe(facts["_key"]) & (salted["_dealt"] == facts["_salt"])
    return salted.join(facts, same).drop("_key", "_salt", "_dealt")
