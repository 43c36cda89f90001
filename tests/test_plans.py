"""Physical plans are the ones meant: pruned scans, pushed filters, no row-wise products, no Python where none is needed."""

import re

import pytest

from cohortlens.plans import catalog

RELATIONAL = [
    "baseline_by_group", "stratified_head", "label_fallback", "crosstab", "paired_inner_delta", "semi_listed", "anti_listed", "inventory_full_outer", "paired_ids", "range_join_bands", "region_membership",
    "duplicate_counts", "value_counts", "confusion_dense", "per_class_prf", "point_metrics_wilson", "auc_rank", "roc_curve", "threshold_lock", "kruskal_three_groups", "domain_shift", "dft_power", "ptp_reject",
    "duplicate_clusters", "label_conflicts", "cohort_audit", "manifest_differences", "artifact_invariance", "text_profile", "phrase_flags", "phrase_hits", "number_parity", "impute_and_scale", "frozen_predict",
]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", RELATIONAL)
def test_no_python_and_no_product(spark, sf, name):
    text = plan(catalog.QUERIES[name](spark, sf))
    assert not re.search("Python|Pandas|ArrowEval|CartesianProduct", text)


@pytest.mark.parametrize("name,columns", [("label_fallback", {"c_mktsegment"}), ("auc_rank", {"doc_id", "n_chars", "quality"}), ("range_join_bands", {"l_quantity"}), ("kruskal_three_groups", {"l_returnflag", *catalog.MEASURES})])
def test_scans_read_only_what_is_used(spark, sf, name, columns):
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan(catalog.QUERIES[name](spark, sf)))
    assert read and {c.split(":")[0] for r in read for c in r.split(",")} == columns


def test_filters_reach_the_scan(spark, sf):
    assert "GreaterThan(o_totalprice,300000" in plan(catalog.QUERIES["semi_listed"](spark, sf))
    assert "EqualTo(o_orderstatus,F)" in plan(catalog.QUERIES["inventory_full_outer"](spark, sf))


def test_frozen_prediction_is_one_stage(spark, sf):
    assert "Exchange" not in plan(catalog.QUERIES["frozen_predict"](spark, sf))


def test_results_do_not_depend_on_partitions(spark, sf):
    held = spark.conf.get("spark.sql.shuffle.partitions")
    names = ("kruskal_fdr_by_hour", "roc_curve", "stratified_head", "top_edges", "bootstrap_intervals", "nested_cv")
    seen = {n: set() for n in names}
    try:
        for count in ("1", "4", "17"):
            spark.conf.set("spark.sql.shuffle.partitions", count)
            for n in names:
                seen[n].add(str(sorted(map(str, catalog.QUERIES[n](spark, sf).collect()))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert {n: len(v) for n, v in seen.items()} == dict.fromkeys(names, 1)
