"""The topic log: the one input shape every operator takes.

A row is one record as a broker hands it over.  The shape is that of Spark's Kafka source after casting
key and value to text, so the same operators run on a broker, on a Parquet copy of it, or on a stream.
"""

from __future__ import annotations

from pyspark.sql import types as T

LOG_SCHEMA = T.StructType(
    [
        T.StructField("topic", T.StringType(), False),
        T.StructField("partition", T.IntegerType(), False),
        T.StructField("offset", T.LongType(), False),
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("key", T.StringType(), True),
        T.StructField("value", T.StringType(), True),
    ]
)
LOG_COLUMNS = LOG_SCHEMA.fieldNames()

# Names of the two logs the explorer itself writes.
AUDIT_HISTORY_TOPIC = "internal.audit.history"
METRICS_CONFIG_TOPIC = "internal.metrics.config"

# Sizes of the samples that a preview or a history shows.
PREVIEW_SAMPLE = 20
HISTORY_CAP = 50
LATENESS = "5 seconds"

# Names of inferred column types and the Spark type of each.
COLUMN_TYPES = {
    "BIGINT": T.LongType(),
    "DOUBLE": T.DoubleType(),
    "BOOLEAN": T.BooleanType(),
    "STRING": T.StringType(),
}
