"""A small study from its contract, end to end."""

import json

import numpy as np
import pytest

from cohortlens import cli
from cohortlens.operators.signal import CHANNELS
from cohortlens.plans import study

CONTRACT = """
project: {dataset_id: synthetic, task: rest}
paths: {participants: participants.tsv, recordings: recordings.parquet, output_dir: results}
participants: {label_column: Group, label_map: {A: AD, C: HC}}
preprocess: {rate: 64, low: 1, high: 30, reference: average, epoch_seconds: 2, reject: 20}
features: {bands: {theta: [4, 8], alpha: [8, 13]}, regions: {front: [Fp1, Fp2], back: [O1, O2]}, ratios: [[theta, alpha]], segment: 128}
connectivity: {proportional_threshold: 0.5}
models: {folds: 3, seed: 1, names: [logistic]}
"""


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    rng = np.random.default_rng(0)
    rows, people = [], ["participant_id\tGroup\tAge\tMMSE\tGender"]
    for i in range(14):
        group = "AC"[i % 2]
        people.append(f"sub-{i:02d}\t{group}\t{60 + i}\t{20 + i % 9}\t{'FM'[i % 2]}")
        t = np.arange(1024) / 64
        for c in ("Fp1", "Fp2", "O1", "O2"):
            x = np.sin(2 * np.pi * (6 if group == "A" else 10) * t + rng.uniform(0, 6)) + rng.normal(0, 0.5, len(t))
            if i == 13:
                x[:] = 1.0
            rows.append((f"sub-{i:02d}", c, x.tolist()))
    (root / "configs").mkdir()
    (root / "configs" / "c.yaml").write_text(CONTRACT)
    (root / "participants.tsv").write_text("\n".join(people) + "\n")
    spark.createDataFrame(rows, "participant_id string, channel string, samples array<double>").write.parquet(str(root / "recordings.parquet"))
    return root


def test_run_audit_verify(spark, project, capsys):
    config = str(project / "configs" / "c.yaml")
    assert cli.main(["plan", config]) == 0 and "validate models" in capsys.readouterr().out
    assert cli.main(["audit", config]) == 2
    assert cli.main(["run", config]) == 0
    out = project / "results"
    csv = lambda n: spark.read.option("header", "true").option("inferSchema", "true").csv(str(out / n))
    features = csv("features")
    assert features.count() == 13 and {"band_global__alpha", "ratio_region__theta_alpha__back", "n_epochs", "label"} <= set(features.columns)
    assert [r["participant_id"] for r in csv("failed_subjects").collect()] == ["sub-13"]
    top = csv("feature_statistics").first()
    assert top["q_value"] < 0.05 and csv("model_metrics").first()["balanced_accuracy"] > 0.9
    audit = json.loads((out / "audit.json").read_text())
    assert audit["summary"]["n_fail"] == 0 and audit["summary"]["n_warn"] == 1
    assert cli.main(["audit", config, "--strict"]) == 0 and cli.main(["verify", config]) == 0
    (out / "plan.md").write_text("changed")
    assert cli.main(["verify", config]) == 1
    logged = str(project / "logged")
    assert cli.main(["run", config, "--log", "--output-dir", logged]) == 0 and cli.main(["verify", config, "--output-dir", logged]) == 0
    assert cli.main(["audit", config, "--strict", "--output-dir", logged]) == 0 and len(capsys.readouterr().out.splitlines()) > 22
    assert cli.main(["audit", str(project / "nothing.yaml")]) == 2


def test_unknown_contract_key():
    with pytest.raises(ValueError, match="fdr_alpha"):
        study.check_contract({"models": {"fdr_alpha": 0.05}})


def test_harmonised_vector_and_failures(spark):
    rng = np.random.default_rng(1)
    rows = [(p, c, rng.normal(size=1024).tolist()) for p in ("a", "b") for c in CHANNELS if (p, c) != ("b", "Cz")]
    df = spark.createDataFrame(rows, "participant_id string, channel string, samples array<double>")
    long, failures = study.harmonised_features(df, 128.0)
    assert {r["participant_id"] for r in long.select("participant_id").distinct().collect()} == {"a"} and long.count() == 36
    assert [(r["participant_id"], r["error"]) for r in failures.collect()] == [("b", "1 channels missing")]
    total = {r["feature"]: r["value"] for r in long.collect()}
    assert sum(v for k, v in total.items() if k.startswith("relpow_global")) == pytest.approx(1)


def test_montage_confounds_and_figures(spark):
    df = spark.createDataFrame([("a", "Fz", "misc"), ("a", "X1", "misc"), ("b", "Fz", "eeg"), ("b", "Cz", "misc")], "participant_id string, channel string, kind string")
    assert sorted((r["participant_id"], r["channel"]) for r in study.only_montage(df).collect()) == [("a", "Fz"), ("b", "Fz")]
    t = spark.createDataFrame([("x", 1.0, "F"), ("x", 2.0, "M"), ("y", 5.0, "F"), ("y", 6.0, "F"), ("y", 7.0, "M")], "label string, Age double, Gender string").withColumnRenamed("Age", "years")
    got = {r["variable"]: r for r in study.confound_tests(t, "label", ["years"], "Gender").collect()}
    assert got["years"]["effect_size"] == pytest.approx(2 / 3) and got["Gender"]["test"] == "chi2"
    f = spark.createDataFrame([("x", "band_ch__alpha__Cz", 1.0), ("y", "band_ch__alpha__Cz", 3.0), ("x", "other", 9.0)], "label string, feature string, value double")
    assert {(r["label"], r["low"], r["high"]) for r in study.topography(f).collect()} == {("x", 1.0, 3.0), ("y", 1.0, 3.0)}
    e = spark.createDataFrame([("x", "alpha", "a", "b", 0.5), ("x", "alpha", "a", "c", 0.9)], "label string, band string, source string, target string, wpli double")
    assert [r["target"] for r in study.display_edges(e, "label", 1).collect()] == ["c"]


def test_vendor_files_in_chunks_give_the_epochs_of_whole_arrays(spark, tmp_path):
    """Filtered, referenced, cropped, cut and rejected alike; annotations from the files or from a table."""
    from pyspark.sql import functions as F

    from cohortlens.operators import signal
    from cohortlens.sources import recordings

    rng = np.random.default_rng(4)
    rows = [(f"sub-{i:02d}", c, (rng.normal(size=640 + 64 * i) * (1 if i else 3)).tolist()) for i in range(3) for c in ("Fp1", "O2")]
    whole = spark.createDataFrame(rows, "participant_id string, channel string, samples array<double>")
    chunks = signal.cut_chunks(whole, 64).withColumnRenamed("participant_id", "recording")
    recordings.write_recordings(chunks, str(tmp_path / "eeg"), 64.0, "vhdr").collect()
    (tmp_path / "eeg" / "sub-01.vhdr").write_text((tmp_path / "eeg" / "sub-01.vhdr").read_text().replace("DataFormat", "MarkerFile=sub-01.vmrk\nDataFormat"))
    (tmp_path / "eeg" / "sub-01.vmrk").write_text("Brain\n[Marker Infos]\nMk1=Comment,BAD move,65,64,0\n")
    spark.createDataFrame([("sub-01", 1.0, 1.0, "BAD move")], "participant_id string, onset double, duration double, description string").write.parquet(str(tmp_path / "notes.parquet"))
    settings = {"rate": 64, "low": 2, "high": 20, "notch": [12], "width": 4, "epoch_seconds": 1, "max_minutes": 0.1, "reject": 12, "reject_annotations": True}
    contract = {"_project_root": str(tmp_path), "paths": {"recordings": "eeg"}, "preprocess": settings}
    tabled = contract | {"paths": {"recordings": "eeg", "annotations": f"file://{tmp_path}/notes.parquet"}}
    assert study.is_vendor(str(tmp_path / "eeg")) and not study.is_vendor(str(tmp_path / "notes.parquet"))
    usable, failures = study.split_chunk_failures(study.read_chunks(spark, contract), 64.0)
    assert failures.count() == 0
    key = lambda df: {(r["participant_id"], r["channel"], r["epoch"]): r["samples"] for r in df.collect()}
    want = key(study.preprocess(whole, settings, study.read_annotations(spark, tabled)))
    for notes in (study.read_annotations(spark, contract), study.read_annotations(spark, tabled)):
        got = key(study.preprocess_chunks(usable, settings, notes))
        assert got.keys() == want.keys() and all(np.abs(np.subtract(got[k], want[k])).max() < 1e-5 for k in want)
    assert {e for p, _, e in want if p == "sub-01"} == {0, 2, 3, 4, 5} and len({k[0] for k in want}) >= 2
    slow = study.split_chunk_failures(study.read_chunks(spark, contract).withColumn("rate", F.when(F.col("participant_id") == "sub-02", 32.0).otherwise(F.col("rate"))), 64.0)[1]
    assert [r["error"] for r in slow.collect()] == ["Fp1: another sampling rate"]
