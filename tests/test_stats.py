"""Statistics against plain numpy and known values."""

import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.functions import special
from cohortlens.operators import stats


def ranks(x):
    x = np.asarray(x, float)
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def test_average_ranks_at_any_slicing(spark):
    rng = np.random.default_rng(1)
    data = [("a", float(v)) for v in rng.integers(0, 40, 300)] + [("b", float(v)) for v in rng.normal(0, 1, 50)] + [("c", 5.0)] * 7
    df = spark.createDataFrame(data, "feature string, value double")
    for slices in (1, 5, 64):
        got = stats.average_ranks(df, ["feature"], slices=slices).toPandas()
        for name, part in got.groupby("feature"):
            assert np.allclose(sorted(part["rank"]), sorted(ranks([v for f, v in data if f == name]))), (name, slices)


def test_kruskal_drops_missing_and_small_groups(spark):
    rows = [("f", "a", 1.0), ("f", "a", 2.0), ("f", "b", 5.0), ("f", "b", float("nan")), ("f", "b", 6.0), ("f", "c", 3.0), ("g", "a", 1.0), ("g", "b", 2.0), ("h", "a", 1.0), ("h", "a", 1.0), ("h", "b", 1.0), ("h", "b", 1.0), ("f", None, 9.0)]
    got = {r["feature"]: r for r in stats.kruskal_wallis(spark.createDataFrame(rows, "feature string, label string, value double")).collect()}
    assert set(got) == {"f", "h"}
    assert got["f"]["statistic"] == pytest.approx(2.4) and got["f"]["p_value"] == pytest.approx(math.erfc(math.sqrt(1.2)))
    assert got["h"]["statistic"] is None


def test_mann_whitney_exact_and_normal(spark):
    a, b = [1.0, 2.0, 3.0], [4.0, 5.0, 6.0, 7.0]
    rows = [("f", "a", v) for v in a] + [("f", "b", v) for v in b]
    pairs = stats.label_pairs(spark.createDataFrame([("a",), ("b",)], "label string"))
    r = stats.mann_whitney(spark.createDataFrame(rows, "feature string, label string, value double"), pairs).first()
    assert (r["u"], r["rank_biserial"], r["median_left"], r["median_right"]) == (0.0, -1.0, 2.0, 5.5)
    assert r["p_value"] == pytest.approx(2 / math.comb(7, 3)) and r["q_value"] == pytest.approx(r["p_value"])
    counts = [sum(x < y for x in c for y in set(range(7)) - set(c)) for c in itertools.combinations(range(7), 3)]
    for u in range(13):
        want = min(1.0, 2 * np.mean([c >= max(u, 12 - u) for c in counts]))
        assert special.mannwhitney_exact(u, 3, 4) == pytest.approx(want)


def test_tails():
    assert special.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert special.chi2_tail(4.0, 2) == pytest.approx(math.exp(-2))
    assert special.chi2_tail(50.0, 4) == pytest.approx(math.exp(-25) * 26, rel=1e-9)
    assert special.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05)
    assert special.normal_two_sided(1.959963984540054) == pytest.approx(0.05)


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.5]
    got = {r["p_value"]: r["q_value"] for r in stats.benjamini_hochberg(spark.createDataFrame([(v,) for v in p], "p_value double")).collect()}
    s = sorted(p)
    want = {v: min(min(1.0, s[j] * len(s) / (j + 1)) for j in range(i, len(s))) for i, v in enumerate(s)}
    assert got == pytest.approx(want)


def test_cohens_d_and_ks(spark):
    rows = [("f", True, float(v)) for v in range(1, 6)] + [("f", False, float(v)) for v in range(2, 7)]
    r = stats.domain_shift(spark.createDataFrame(rows, "feature string, side boolean, value double"), F.col("side")).first()
    assert r["cohens_d"] == pytest.approx(1 / math.sqrt(2.5)) and r["ks"] == pytest.approx(0.2)


def test_spearman_and_chi_square(spark):
    rows = [(1.0, 2.0), (2.0, 1.0), (3.0, 4.0), (4.0, 3.0), (5.0, 5.0), (None, 1.0)]
    r = stats.spearman(spark.createDataFrame(rows, "x double, y double"), ["x"], ["y"]).first()
    assert r["rho"] == pytest.approx(0.8) and r["n"] == 5 and r["p_value"] == pytest.approx(special.t_two_sided(0.8 * math.sqrt(3 / 0.36), 3))
    cells = [("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 30 + [("b", "y")] * 5
    r = stats.chi_square(spark.createDataFrame(cells, "a string, b string"), "a", "b").first()
    table = np.array([[10, 20], [30, 5]])
    e = table.sum(1, keepdims=True) * table.sum(0) / table.sum()
    assert r["statistic"] == pytest.approx(((abs(table - e) - 0.5) ** 2 / e).sum()) and r["df"] == 1


def test_ols_hc3_by_hand(spark):
    rng = np.random.default_rng(3)
    z, w = rng.normal(size=40), rng.normal(size=40)
    y = 2 * z + rng.normal(size=40)
    df = spark.createDataFrame([(float(a), float(b), float(c), 1.0) for a, b, c in zip(z, w, y, strict=True)], "z double, w double, y double, flat double")
    got = stats.ols_hc3(df, ["z", "w"], ["y", "flat"], ["z"], {"z": {"z": 1.0}}).collect()
    assert [r["feature"] for r in got] == ["y"]
    x, t = np.c_[np.ones(40), z, w], (y - y.mean()) / y.std()
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ t
    e, h = t - x @ beta, np.einsum("ij,jk,ik->i", x, inv, x)
    v = inv @ (x.T * (e / (1 - h)) ** 2) @ x @ inv
    assert got[0]["estimate"] == pytest.approx(beta[1]) and got[0]["robust_se"] == pytest.approx(math.sqrt(v[1, 1]))
    assert got[0]["wald"] == pytest.approx(beta[1] ** 2 / v[1, 1])


def test_no_task_takes_all_rows_of_a_feature(spark):
    from cohortlens.operators import ml

    rows = [(float(i % 7), float(i % 5), "ab"[i % 2]) for i in range(40)]
    wide = spark.createDataFrame(rows, "y double, x double, label string")
    long = wide.selectExpr("'y' as feature", "label", "y as value")
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fitted = plan(stats.ols_hc3(wide, ["x"], ["y"], ["x"]))
        assert fitted.count("SortMergeJoin") == 1 and "BroadcastHashJoin" in fitted  # of one row for each feature
        scaler = spark.createDataFrame([("y", 3.0, 3.0, 2.0)], "feature string, median double, mean double, scale double")
        assert "SortMergeJoin" not in plan(ml.apply_scaler(long, scaler, ["feature"]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


READ_ONCE = {
    "mann_whitney": lambda long: stats.mann_whitney(long, stats.label_pairs(long.sparkSession.createDataFrame([("a",), ("b",)], "label string"))),
    "domain_shift": lambda long: stats.domain_shift(long, F.col("label") == "a"),
    "ks_statistic": lambda long: stats.ks_statistic(long, F.col("label") == "a", ["feature"]),
}


@pytest.mark.parametrize("name", sorted(READ_ONCE))
def test_rows_are_read_once(spark, name):
    read, n = spark.sparkContext.accumulator(0), 2000

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = spark.range(n).selectExpr("'f' as feature", "if(id % 3 = 0, 'a', 'b') as label", "cast(id % 700 as double) as value").mapInArrow(counted, "feature string, label string, value double")
    assert READ_ONCE[name](rows).count() == 1
    assert read.value == n


def test_slices_without_features(spark):
    rng = np.random.default_rng(2)
    v = rng.integers(0, 90, 400)
    counts = spark.createDataFrame([(float(x),) for x in v], "value double").groupBy("value").agg(F.count("*").alias("ties"))
    for slices in (None, 1, 7):
        got = stats.placed(stats.sliced(counts, [], slices=slices), []).collect()
        assert len(got) == len(set(v)) and all((r["before_ties"], r["ties"], r["total_ties"]) == ((v < r["value"]).sum(), (v == r["value"]).sum(), 400) for r in got)


def test_moments_from_counts(spark):
    rows = [("f", True, 1e9 + v) for v in (1.0, 2.0, 2.0, 4.0)] + [("f", False, float("inf")), ("g", True, 5.0), ("g", None, 7.0), ("g", True, float("nan"))]
    long = spark.createDataFrame(rows, "feature string, side boolean, value double")
    got = {r["feature"]: r for r in stats.domain_shift(long, F.col("side")).collect()}
    f, g = got["f"], got["g"]
    assert (f["n_a"], f["mean_a"], f["n_b"], f["mean_b"], f["sd_b"]) == (4, 1e9 + 2.25, 1, math.inf, None) and f["sd_a"] == pytest.approx(np.std([1, 2, 2, 4], ddof=1), rel=1e-9)
    assert (g["n_a"], g["mean_a"], g["sd_a"], g["n_b"], g["mean_b"], g["ks"]) == (1, 5.0, None, 0, None, None)


def test_kruskal_in_slices_without_lone_labels(spark, monkeypatch):
    monkeypatch.setattr(stats, "SLICE_ROWS", 3)
    monkeypatch.setattr(stats, "MOST_SLICES", 7)
    rng = np.random.default_rng(5)
    rows = [(f, lab, float(v)) for f in ("f", "g") for lab in "abc" for v in rng.integers(-30, 60, 90) / 4]
    rows += [("f", f"lone{i}", float(i)) for i in range(-5, 5)] + [("f", None, 3.0), (None, "a", 3.0), ("g", "a", float("nan")), ("g", "b", None)]
    df = spark.createDataFrame(rows, "feature string, label string, value double").repartition(5)
    assert {len(r["_cuts"]) for r in stats.slice_cuts(df, ["feature"], of=()).where("feature is not null").collect()} == {6}
    got = {r["feature"]: r for r in stats.kruskal_wallis(df).collect()}
    assert set(got) == {"f", "g"}
    for f, r in got.items():
        labels, values = zip(*((lab, v) for g, lab, v in rows if g == f and lab in tuple("abc") and v is not None and v == v))
        rk, n = ranks(values), len(values)
        h = 12 / (n * (n + 1)) * sum(rk[np.array(labels) == lab].sum() ** 2 / labels.count(lab) for lab in "abc") - 3 * (n + 1)
        h /= 1 - sum(c**3 - c for c in np.unique(values, return_counts=True)[1]) / (n**3 - n)
        assert (r["groups"], r["n"]) == (3, n) and r["statistic"] == pytest.approx(h, rel=1e-9)


def test_cuts_are_the_same_each_time_and_halving_counts_them(spark):
    counts = spark.range(3000).select(F.lit("f").alias("feature"), (F.col("id") * 0.5).alias("value"), F.lit(1).alias("ties"))
    one, other = (sorted(stats.slice_cuts(counts.repartition(n), ["feature"], slices=50).first()["_cuts"]) for n in (1, 7))
    assert one == other and len(one) == 49
    for r in stats.in_slices(counts, stats.slice_cuts(counts, ["feature"], slices=50), ["feature"]).collect():
        assert r["_slice"] == sum(c < r["value"] for c in one)


def test_no_join_deals_rows_by_feature_alone(spark, sf):
    from cohortlens.plans import catalog

    long = catalog.line_long(spark, sf, "l_returnflag")
    frames = {"kruskal": catalog.kruskal_three_groups(spark, sf), "quantiles": stats.quantiles(long, ["feature"], {"median": 0.5}), "ranks": stats.average_ranks(long, ["feature"])}
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too large to send
        plans = {name: df.select("*")._jdf.queryExecution().executedPlan().toString() for name, df in frames.items()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert not [name for name, text in plans.items() if re.search(r"SortMergeJoin \[feature#\d+(, l_returnflag#\d+)?\],", text)]
