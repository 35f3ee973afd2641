from __future__ import annotations

import os
import sys
from datetime import datetime, timedelta, timezone

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from topicspark.model import LOG_SCHEMA  # noqa: E402

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("topicspark-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "2")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_log(spark):
    """Topic log from (topic, partition, offset, milliseconds after the start, key, value) rows."""

    def make(rows):
        return spark.createDataFrame(
            [(t, p, o, START + timedelta(milliseconds=at), k, v) for t, p, o, at, k, v in rows], LOG_SCHEMA
        )

    return make


@pytest.fixture(scope="session")
def values_log(make_log):
    """Topic log of one topic's values, in order, in partition 0."""

    def make(*values, topic="t"):
        return make_log([(topic, 0, i, i, None, value) for i, value in enumerate(values)])

    return make


def rows_of(frame):
    return sorted((tuple(row) for row in frame.collect()), key=repr)
