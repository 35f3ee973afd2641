from topicspark.plans.products import dashboard, topic_detail
from topicspark.plans.sql import register_functions, run_sql, run_template

__all__ = ["dashboard", "register_functions", "run_sql", "run_template", "topic_detail"]
