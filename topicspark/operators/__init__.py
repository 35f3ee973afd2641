from topicspark.operators.audit import (
    audit_history,
    audit_report,
    audit_topics,
    duplicate_keys,
    exact_counts,
    key_tallies,
    poison_counts,
    topic_audit,
    with_key_value,
)
from topicspark.operators.compare import (
    compare_summary,
    compare_topics,
    missing_records,
    schema_mismatch,
    throughput,
)
from topicspark.operators.enrich import join_as_of, valid_spans
from topicspark.operators.flows import flow_audit, flow_steps, step_latency
from topicspark.operators.lineage import lineage_edges, lineage_nodes
from topicspark.operators.metrics import (
    eval_metric,
    latest_by_key,
    metric_history,
    metric_registry,
    metric_state,
    metric_status,
    refresh_metrics,
)
from topicspark.operators.profile import scan_values
from topicspark.operators.scans import (
    filter_topics,
    head_sample,
    preview,
    records_since,
    sample_messages,
    tail_offsets,
    tail_records,
    topic_descriptor,
    topic_state,
    topic_stats,
)
from topicspark.operators.schema import detect_format, find_key_field, infer_schema, schema_struct, topic_profile, topic_table
from topicspark.operators.trace import edge_counts, trace_all, trace_edges, trace_hits, trace_nodes
from topicspark.operators.trace_blocks import trace_index

__all__ = [name for name in dir() if not name.startswith("_")]
