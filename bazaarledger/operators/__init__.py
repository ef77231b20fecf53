from .aggregates import (
    bucket_agg, collapse_max, customer_history, derive_metrics, largest_per_state, net_amount, pivot_max, spread_by_type, sum_exploded,
    sum_list,
)
from .explode import explode_keep_empty, explode_list, explode_or_default
from .intervals import join_valid_binned
from .joins import enrich, exists_any, join_valid, join_valid_by_day, reconcile, semi_filter
from .key_filter import KeyFilter
from .skew import enrich_hot, reconcile_hot

__all__ = [
    "KeyFilter", "bucket_agg", "collapse_max", "customer_history", "derive_metrics", "enrich", "enrich_hot", "exists_any",
    "explode_keep_empty", "explode_list", "explode_or_default", "join_valid", "join_valid_binned", "join_valid_by_day",
    "largest_per_state", "net_amount", "pivot_max", "reconcile", "reconcile_hot", "semi_filter", "spread_by_type", "sum_exploded",
    "sum_list",
]
