"""DataFrame operators the reports compose: distributed NTILE, shares of a
total, top-k with a deterministic tie-break, data-quality checks and the
reshape (pivot / reindex) steps."""

from mercata.operators.ntile import NtileSpec, SortKey, add_ntiles, asc, desc, global_ntile
from mercata.operators.quality import (
    coverage,
    distribution,
    duplicate_keys,
    key_audit,
    null_counts,
    profile,
    row_counts,
    unmatched,
    unmatched_count,
    violations,
)
from mercata.operators.reshape import pivot_values, reindex_on
from mercata.operators.shares import share_of_total
from mercata.operators.topk import top_k

__all__ = [
    "NtileSpec",
    "SortKey",
    "add_ntiles",
    "asc",
    "coverage",
    "desc",
    "distribution",
    "duplicate_keys",
    "global_ntile",
    "key_audit",
    "null_counts",
    "pivot_values",
    "profile",
    "reindex_on",
    "row_counts",
    "share_of_total",
    "top_k",
    "unmatched",
    "unmatched_count",
    "violations",
]
