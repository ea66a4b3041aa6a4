"""Generic relational operators built from DataFrame primitives."""

from starledger.operators.pairs import ordered_pair_counts
from starledger.operators.percentiles import cume_dist_by_value, cume_dist_cutoffs, cume_dist_cutoffs_many
from starledger.operators.quality import duplicate_keys, fill_missing, null_rows
from starledger.operators.ranking import top_n, top_n_per_group
from starledger.operators.shares import grand_total, with_group_total

__all__ = [
    "ordered_pair_counts",
    "cume_dist_by_value",
    "cume_dist_cutoffs",
    "cume_dist_cutoffs_many",
    "duplicate_keys",
    "fill_missing",
    "null_rows",
    "top_n",
    "top_n_per_group",
    "grand_total",
    "with_group_total",
]
