"""Table operators: functions that take and return DataFrames."""

from .aggregate import aggregate, describe
from .checks import contract_check, require_contract, schema_diff, schema_report
from .columns import (
    clean_text, conditional, date_parts, derive, merge, parse_dates, parse_dates_report, remove, remove_pattern,
    rename, rename_pattern, select, select_pattern,
)
from .impute import impute
from .joins import antijoin, join, join_key_report, lookup, semijoin, unmatched_values
from .profile import (
    boxplot, categorical_profile, categorical_profiles, contingency, histogram, mean_by, mean_over_time, numeric_profile, point_sample,
    profile, quality, temporal_counts, temporal_unit,
)
from .reshape import fold, pivot, split, spread, unroll
from .rows import (
    add_index, dedupe, filter_range, filter_rows, filter_value, keep_rows, promote_header, remove_rows,
    replace_errors, replace_nulls, replace_regex, replace_value, sample, slice_rows, sort, top_k,
)
from .sets import concat, union
from .types import infer_types, physical_schema, promote, types
from .window import window
