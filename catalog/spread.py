"""Queries again in the form that operators take beyond the one-task size, with the same SQL."""

from __future__ import annotations

from gridsmith.session import LIMITS

from .base import QUERIES, SQL, query

#: One-task size for these: every table of the larger scale factors is beyond it.
ROWS = 5_000
SPREAD = [
    "profile_lineitem", "outlier_counts", "cap_outliers_iqr", "scale_robust", "bins_quantile", "encode_label", "spearman_matrix", "kendall_tau",
    "chart_box", "chart_ecdf", "chart_ecdf_whole", "metric_roc", "metric_auc", "split_stratified", "folds_stratified", "folds_plain", "balance_oversample",
    "evaluation_sample", "dbscan_core", "dbscan_noise", "group_aggregates",
]


def _spread(name: str):
    def run(spark, sf):
        before, LIMITS.single_task_rows = LIMITS.single_task_rows, ROWS
        try:
            return QUERIES[name](spark, sf)
        finally:
            LIMITS.single_task_rows = before

    return run


for _name in SPREAD:
    query(f"{_name}_spread", SQL[_name])(_spread(_name))
