"""Plans of the row-level operators: what may meet in one task, what reaches the scan."""

import re

import pytest

from evenkeel.catalog import QUERIES

NAMES = [
    "balanced_class_profile", "random_oversampling", "random_undersampling", "weighted_sample",
    "stratified_folds", "nested_folds", "class_row_index", "label_sorted_range", "row_sample",
    "roc_auc", "top_lift", "ks_two_sample", "wasserstein_distance", "quantile_grid",
    "column_description", "covariance_matrix", "pooled_levels", "coded_levels", "smote",
    "tomek_links", "generator_sample", "generator_unconditional", "independent_marginals",
    "order_feature_recipe", "fidelity_report",
]


def plan_of(spark, folder, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("name", NAMES)
def test_only_aggregates_meet_in_one_task(spark, small, name):
    lines = plan_of(spark, small, name).split("\n")
    assert not any("CartesianProduct" in x or "NestedLoopJoin" in x for x in lines)
    for line, below in zip(lines, lines[1:]):
        if "Exchange SinglePartition" in line:
            assert "HashAggregate" in below, below


@pytest.mark.parametrize("name, columns", [
    ("covariance_matrix", {"l_quantity", "l_discount", "l_tax", "l_returnflag"}),
    ("roc_auc", {"event_type", "value"}),
    ("parquet_scan", {"doc_id", "lang", "source", "n_chars"}),
])
def test_scans_read_only_needed_columns(spark, small, name, columns):
    plan = plan_of(spark, small, name)
    for fields in re.findall(r"ReadSchema: struct<(.*?)>", plan):
        assert {f.split(":")[0] for f in fields.split(",")} <= columns


def test_filters_reach_the_scan(spark, small):
    assert "GreaterThan(n_chars,500)" in plan_of(spark, small, "parquet_scan")
