from topicspark.streaming.duplicates import duplicates_stream
from topicspark.streaming.enrich import start_reference_join
from topicspark.streaming.latency import step_latency_stream
from topicspark.streaming.runs import read_bounded, run_available_now, start_insert, start_log_insert, start_refresh
from topicspark.streaming.views import MetricView, start_metric
from topicspark.streaming.windows import hop, session, tumble

__all__ = [
    "MetricView",
    "duplicates_stream",
    "hop",
    "read_bounded",
    "run_available_now",
    "session",
    "start_insert",
    "start_log_insert",
    "start_metric",
    "start_reference_join",
    "start_refresh",
    "step_latency_stream",
    "tumble",
]
