"""Audits and gates: every planted fault is found and clean input passes."""

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import integrity, relational, textqa
from cohortlens.sources import artifacts

CH = ("a", "b")


def prints(spark, rows):
    df = spark.createDataFrame(rows, "id string, channel string, samples array<double>")
    return {r["id"]: r["signal_sha256"] for r in integrity.signal_fingerprints(df, ["id"], CH, 3).collect()}


def test_fingerprints_see_content_only(spark):
    x, y = [1.0, 2.0, 3.0], [4.0, 5.0, 6.0]
    got = prints(spark, [("1", "a", x), ("1", "b", y), ("2", "b", y), ("2", "a", x), ("3", "a", y), ("3", "b", x), ("4", "a", x), ("4", "b", [4.0, 5.0, 6.0000001]), ("5", "a", x), ("6", "a", x), ("6", "b", y[:2]), ("7", "a", x), ("7", "b", [float("nan"), 1.0, 2.0])])
    assert got["1"] == got["2"] and len({got["1"], got["3"], got["4"]}) == 3
    assert got["5"] is got["6"] is got["7"] is None


def test_clusters_conflicts_and_repeats(spark):
    df = spark.createDataFrame([("p10", "AD", "x"), ("p2", "AD", "x"), ("p3", "HC", "y"), ("p4", "AD", "y"), ("p5", "HC", None), ("p6", "HC", None)], "id string, grp string, sha string")
    got = {r["id"]: r for r in integrity.content_clusters(df, "id", "sha").collect()}
    assert got["p10"]["included"] and not got["p2"]["included"] and got["p2"]["exclusion_reason"] == "duplicate of p10"
    assert got["p5"]["included"] and got["p6"]["cluster_size"] == 1
    assert [r["labels"] for r in integrity.conflicting_clusters(df, "sha", "grp").collect()] == [["AD", "HC"]]
    assert integrity.repeated_clusters(df, df.where("sha = 'x'"), "id", "sha").count() == 1


def audit(spark, **changes):
    frames = {
        "features": spark.createDataFrame([("1", 0.5), ("2", 0.7)], "participant_id string, f double"), "baseline": spark.createDataFrame([("AD", 2)], "grp string, n long"),
        "statistics": spark.createDataFrame([("f", 0.01)], "feature string, q_value double"), "metrics": spark.createDataFrame([("m", 0.6, 0.6, 0.7)], "model string, accuracy double, balanced_accuracy double, auc_ovr double"),
        "predictions": spark.createDataFrame([("m", "1"), ("m", "2")], "model string, participant_id string"),
    } | changes
    return {r["name"]: r["status"] for r in integrity.run_audit(spark, **frames).collect()}


def test_run_audit_faults(spark):
    assert set(audit(spark).values()) == {"pass"}
    make = spark.createDataFrame
    faults = {
        "features:unique-participants": ("features", make([("1", 0.5), ("1", 0.7)], "participant_id string, f double"), "fail"), "features:finite-values": ("features", make([("1", 0.5), ("2", float("inf"))], "participant_id string, f double"), "warn"),
        "cohort:baseline-feature-consistency": ("baseline", make([("AD", 3)], "grp string, n long"), "fail"), "statistics:q-value-range": ("statistics", make([("f", 1.2)], "feature string, q_value double"), "fail"),
        "models:metric-range": ("metrics", make([("m", 0.6, 1.6, 0.7)], "model string, accuracy double, balanced_accuracy double, auc_ovr double"), "fail"), "models:out-of-fold-coverage": ("predictions", make([("m", "1")], "model string, participant_id string"), "fail"),
        "processing:failed-subjects": ("failures", make([("9", "boom")], "participant_id string, error string"), "warn"),
    }
    for name, (frame, df, status) in faults.items():
        assert audit(spark, **{frame: df})[name] == status, name


def test_cohort_audit_and_gate(spark):
    df = spark.createDataFrame([("AD",)] * 3 + [("XYZ",)], "label string")
    checks = integrity.cohort_audit(df, "label", {"AD": 3, "HC": 2})
    assert {r["name"]: r["status"] for r in checks.collect()} == {"cohort:AD": "pass", "cohort:HC": "fail", "cohort:XYZ": "warn", "cohort:total": "fail"}
    assert integrity.roll_up(checks).first()["status"] == "fail"
    with pytest.raises(integrity.GateError, match="cohort:HC"):
        integrity.require(checks)
    integrity.require(integrity.fact_gate(spark, {"n": 92}, {"n": 92}))


def test_id_audit_misses_what_content_audit_finds(spark):
    df = spark.createDataFrame([("p1", "s"), ("p2", "s")], "id string, sha string")
    assert relational.duplicates(df, ["id"]).first()["duplicates"] == 0
    assert integrity.content_clusters(df, "id", "sha").where("not included").count() == 1


def test_manifest_and_publish(spark, tmp_path):
    staging, out = tmp_path / "staging", tmp_path / "out"
    staging.mkdir()
    (staging / "a.csv").write_text("x\n")
    (staging / "b.json").write_text("{}")
    m = artifacts.scan_manifest(spark, str(staging))
    assert {r["path"] for r in m.collect()} == {"a.csv", "b.json"}
    assert artifacts.by_extension(m).count() == 2
    frozen = spark.createDataFrame(m.collect(), m.schema)
    assert integrity.manifest_differences(frozen, m).count() == 0
    wrong = frozen.withColumn("sha256", F.when(F.col("path") == "a.csv", "0").otherwise(F.col("sha256"))).unionByName(frozen.limit(1).withColumn("path", F.lit("c")))
    assert {r["problem"] for r in integrity.manifest_differences(wrong, m).collect()} == {"content", "missing"}
    out.mkdir()
    (out / "old").write_text("1")
    artifacts.publish(spark, str(staging), str(out))
    assert sorted(p.name for p in out.iterdir()) == ["a.csv", "b.json"] and not staging.exists()
    with pytest.raises(OSError):
        artifacts.publish(spark, str(tmp_path / "nothing"), str(out))
    assert (out / "a.csv").exists()
    with pytest.raises(ValueError):
        artifacts.write_json({"x": float("nan")}, str(tmp_path / "x.json"))


def test_gates_name_what_is_wrong(spark):
    from cohortlens.operators import relational

    df = spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (3, None, float("inf"))], "id int, label string, x double")
    with pytest.raises(ValueError, match="nope"):
        relational.project(df, ["id", "nope"])
    with pytest.raises(ValueError, match="None"):
        relational.allowed_labels(df, "label", ["a", "b"])
    with pytest.raises(ValueError, match="2 listed"):
        relational.only_listed(df, df.where("id < 3"), "id", expect=3)
    with pytest.raises(ValueError, match="disagree"):
        relational.paired_ids(df, df.withColumn("label", F.lit("a")), "id", "label", strict=True).count()
    with pytest.raises(ValueError, match="common"):
        relational.common_columns(df, spark.range(1).toDF("other"))
    with pytest.raises(integrity.GateError, match="a, b"):
        integrity.no_conflicts(df.withColumn("sha", F.lit("s")), "sha", "label")
    assert [r["id"] for r in relational.complete_rows(df, ["x"]).collect()] == [1] and relational.allowed_labels(df.where("id < 3"), "label", ["a", "b"]).count() == 2


def test_text_goes_out_in_any_encoding():
    import io

    raw = io.BytesIO()
    out = io.TextIOWrapper(raw, encoding="ascii")
    artifacts.say("ok \u00e9", out)
    out.flush()
    assert raw.getvalue() == b"ok \\xe9\n"


def test_heads_and_limits(spark):
    df = spark.createDataFrame([(i, "a" if i < 10 else "b") for i in range(13)], "id int, label string")
    got = [r["id"] for r in relational.stratified_head(df, 8, "label", ["id"]).orderBy("id").collect()]
    assert got == [0, 1, 2, 3, 4, 10, 11, 12]
    assert relational.stratified_head(df, 1, "label", ["id"]).count() == 1
    assert relational.stratified_head(df, 99, "label", ["id"]).count() == 13
    with pytest.raises(ValueError):
        relational.numeric_columns(df.select("label"))
    r = relational.padded_limits(spark.createDataFrame([("a", 2.0), ("a", 2.0), ("b", float("nan"))], "k string, v double"), ["k"], "v").orderBy("k").collect()
    assert (r[0]["low"], r[0]["high"], r[1]["low"], r[1]["high"]) == pytest.approx((1.998, 2.002, 0, 1))


def test_text_rules(spark):
    df = spark.createDataFrame([(1, "This is not proven. It is Proven (1.5).\n| a | b |\n|---|---|\n| 1 | 2 |"), (2, None)], "id int, text string")
    hits = textqa.phrase_hits(df, "id", ["proven"], window=8).orderBy("position").collect()
    assert [(h["position"], h["negated"]) for h in hits] == [(13, True), (27, False)]
    assert [r["cells"] for r in textqa.pipe_tables(df, "id").orderBy("line").collect()] == [["a", "b"], ["1", "2"]]
    p = {r["id"]: r for r in textqa.text_profile(df, "id").collect()}
    assert p[2]["n_words"] == 0 and p[1]["n_numbers"] == 3


def test_contract(tmp_path):
    (tmp_path / "configs").mkdir()
    path = tmp_path / "configs" / "c.yaml"
    path.write_text("paths:\n  out: results\n")
    c = artifacts.load_contract(str(path))
    assert artifacts.project_path(c, "results") == str(tmp_path.resolve() / "results") and artifacts.project_path(c, "/x") == "/x"
