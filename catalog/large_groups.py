"""The forms for groups larger than a task, on tables that would fit one.

Each repeats a query with a low hot limit, so that it is numbered, blocked and
bracketed like a large table, and is held against the same SQL.
"""

from tablewright.plans.layout import HOT_ROWS_CONF

from .registry import QUERIES, SQL

LIMIT = "1500"
REPEATED = (
    "agg_all_functions", "add_index", "window_rank_whole_table", "window_whole_table", "window_null_partition", "window_running_median",
    "impute_forward", "impute_backward", "impute_linear", "impute_median", "profile_numeric", "boxplot", "describe_part", "running_spread_far_from_zero", "running_spread_at_a_billion",
    "top_k_per_group_deep",
)


def _with_low_limit(build):
    def run(spark, folder):
        before = spark.conf.get(HOT_ROWS_CONF, None)
        spark.conf.set(HOT_ROWS_CONF, LIMIT)
        try:
            return build(spark, folder)
        finally:
            spark.conf.unset(HOT_ROWS_CONF) if before is None else spark.conf.set(HOT_ROWS_CONF, before)

    return run


for _name in REPEATED:
    QUERIES[f"{_name}_large"] = _with_low_limit(QUERIES[_name])
    SQL[f"{_name}_large"] = SQL[_name]
