from topicspark.sources.topics import export, kafka_options, read_topic, write_log

__all__ = ["export", "kafka_options", "read_topic", "write_log"]
