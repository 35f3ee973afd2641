"""A session with the settings the operators are written for."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession

# What the plans rely on: runtime re-planning with skew splitting, UTC, state on disk for streams, and streaming
# sessions merged before the shuffle.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def build_session(
    app: str = "topicspark", master: str | None = None, settings: Mapping[str, str] | None = None
) -> SparkSession:
    """Session with those settings; ``settings`` adds to or replaces them.

    On a cluster give ``spark.checkpoint.dir`` a shared folder, and leave the number of shuffle partitions high:
    re-planning joins small ones.
    """
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    for name, text in {**SETTINGS, **(settings or {})}.items():
        builder = builder.config(name, text)
    return builder.getOrCreate()
