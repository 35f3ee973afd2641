"""topicspark: message topics as tables, on PySpark."""

from topicspark.functions import json_value, match_path, value_format, value_matches, xml_extract, xml_extract_all
from topicspark.model import LOG_COLUMNS, LOG_SCHEMA
from topicspark.operators import (
    audit_history,
    audit_report,
    compare_summary,
    compare_topics,
    detect_format,
    duplicate_keys,
    edge_counts,
    eval_metric,
    exact_counts,
    filter_topics,
    find_key_field,
    flow_audit,
    flow_steps,
    head_sample,
    infer_schema,
    join_as_of,
    latest_by_key,
    lineage_edges,
    lineage_nodes,
    metric_history,
    metric_registry,
    metric_state,
    metric_status,
    missing_records,
    poison_counts,
    preview,
    records_since,
    refresh_metrics,
    sample_messages,
    scan_values,
    schema_mismatch,
    schema_struct,
    step_latency,
    tail_offsets,
    tail_records,
    throughput,
    topic_audit,
    topic_descriptor,
    topic_state,
    topic_stats,
    topic_table,
    trace_all,
    trace_edges,
    trace_hits,
    trace_index,
    trace_nodes,
)
from topicspark.plans import dashboard, register_functions, run_sql, run_template, topic_detail
from topicspark.sources import export, kafka_options, read_topic, write_log
from topicspark.streaming import (
    MetricView,
    duplicates_stream,
    hop,
    read_bounded,
    run_available_now,
    session,
    start_insert,
    start_log_insert,
    start_metric,
    start_reference_join,
    start_refresh,
    step_latency_stream,
    tumble,
)

__all__ = [name for name in dir() if not name.startswith("_")]
