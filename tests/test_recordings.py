"""Recordings of vendor formats read by ranges, filters over chunks, annotated spans, overlaps."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import relational, signal
from cohortlens.sources import recordings as rec

CHUNKS = "recording string, channel string, chunk bigint, samples array<double>"


def rows_of(seed=0, lengths=(7, 1, 3), size=20, last=13):
    rng = np.random.default_rng(seed)
    return [(f"r{i}", c, k, rng.uniform(-90, 90, size if k < n - 1 else last).tolist()) for i, n in enumerate(lengths) for k in range(n) for c in ("Fp1", "Cz, left", "O2")]


@pytest.mark.parametrize("kind,step", [("edf", 200 / 65535), ("bdf", 200 / (2**24 - 1)), ("vhdr", 1e-5)])
def test_files_round_trip_by_ranges(spark, tmp_path, kind, step):
    rows = rows_of()
    written = rec.write_recordings(spark.createDataFrame(rows, CHUNKS), f"{tmp_path}/x", 10.0, kind, -100.0, 100.0).collect()
    assert sorted((r["recording"], r["chunks"]) for r in written) == [("r0", 7), ("r1", 1), ("r2", 3)]
    df = rec.read_recordings(spark, f"{tmp_path}/x", range_bytes=2 * 3 * 20 * 2, frames=20)
    assert df.rdd.getNumPartitions() > 4  # ranges, not files
    got = {(os.path.basename(r["path"]).split(".")[0], r["channel"], r["chunk"]): r for r in df.collect()}
    assert len(got) == len(rows) and all(r["error"] is None and r["rate"] == pytest.approx(10.0) for r in got.values())
    for recording, channel, chunk, samples in rows:
        back = np.array(got[recording, channel, chunk]["samples"])
        assert np.abs(back[: len(samples)] - samples).max() <= 0.51 * step
        assert len(back) == (len(samples) if kind == "vhdr" else max(20, len(samples)) if recording != "r1" else len(samples))
    some = rec.read_recordings(spark, f"file://{tmp_path}/x/r0.{kind}", ("O2",))
    assert {r["channel"] for r in some.collect()} == {"O2"}


def test_files_that_do_not_parse_are_rows(spark, tmp_path):
    whole = rec.edf_header(["a"], [4], 3, 1.0, -1, 1) + np.arange(12, dtype="<i2").tobytes()
    (tmp_path / "good.edf").write_bytes(whole)
    (tmp_path / "unknown_length.edf").write_bytes(whole[:236] + b"-1      " + whole[244:])
    (tmp_path / "short.edf").write_bytes(whole[:-3])
    (tmp_path / "empty.bdf").write_bytes(b"")
    (tmp_path / "text.edf").write_bytes(b"hello " * 100)
    (tmp_path / "gaps.edf").write_bytes(whole[:192] + b"EDF+D" + whole[197:])
    (tmp_path / "lost.vhdr").write_text("Brain Vision\n[Common Infos]\nDataFile=none.eeg\nNumberOfChannels=1\nSamplingInterval=1000\n[Channel Infos]\nCh1=a,,1\n")
    (tmp_path / "odd.vhdr").write_text("Brain Vision\n[Common Infos]\nDataFile=good.edf\nNumberOfChannels=0\n")
    got = {}
    for r in rec.read_recordings(spark, str(tmp_path)).collect():
        got.setdefault(os.path.basename(r["path"]), []).append(r)
    assert set(got) == set(os.listdir(tmp_path))
    assert [len(got[n]) for n in ("good.edf", "unknown_length.edf")] == [3, 3] and got["good.edf"][0]["samples"] is not None
    assert all(len(v) == 1 and v[0]["error"] and v[0]["samples"] is None for n, v in got.items() if n not in ("good.edf", "unknown_length.edf"))
    with pytest.raises(Exception, match="nowhere"):
        rec.read_recordings(spark, f"{tmp_path}/nowhere").count()


def test_annotations_of_both_kinds(spark, tmp_path):
    notes = [b"+0\x14\x14\x00+0.5\x151.25\x14BAD_move\x14blink\x14\x00", b"+1\x14\x14\x00", b"+2\x14\x14\x00+2.75\x14rest\x14\x00"]
    data = b"".join(np.arange(4, dtype="<i2").tobytes() + n.ljust(40, b"\x00") for n in notes)
    (tmp_path / "a.edf").write_bytes(rec.edf_header(["x", "EDF Annotations"], [4, 20], 3, 1.0, -1, 1, notes=True) + data)
    (tmp_path / "b.vhdr").write_text("Brain\n[Common Infos]\nDataFile=b.eeg\nMarkerFile=$b.vmrk\nNumberOfChannels=1\nSamplingInterval=10000\n[Binary Infos]\nBinaryFormat=INT_16\n[Channel Infos]\nCh1=a,,0.5,uV\n")
    (tmp_path / "b.eeg").write_bytes(np.arange(100, dtype="<i2").tobytes())
    (tmp_path / "b.vmrk").write_text("Brain\n[Marker Infos]\nMk1=New Segment,,1,1,0,2024\nMk2=Comment,bad\\1 part,11,50,0\nMk3=Stimulus,S  1,21,1,0\n")
    got = sorted((os.path.basename(r["path"]), r["onset"], r["duration"], r["description"]) for r in rec.read_notes(spark, str(tmp_path)).collect())
    assert got == [("a.edf", 0.5, 1.25, "BAD_move"), ("a.edf", 0.5, 1.25, "blink"), ("a.edf", 2.75, 0.0, "rest"), ("b.vhdr", 0.1, 0.5, "bad, part"), ("b.vhdr", 0.2, 0.01, "Stimulus/S  1")]
    values = rec.read_recordings(spark, f"{tmp_path}/b.vhdr").first()["samples"]
    assert values[:3] == [0.0, 0.5, 1.0] and {r["channel"] for r in rec.read_recordings(spark, f"{tmp_path}/a.edf").collect()} == {"x"}


@pytest.mark.parametrize("notch,length", [((), 60), ((12.0,), 60), ((8.0, 12.0), 100)])
def test_filtering_chunks_equals_filtering_whole_signals(spark, notch, length):
    rng = np.random.default_rng(1)
    rows = [(f"r{i}", c, rng.normal(size=n).tolist()) for i, n in enumerate((500, 60, 61, 30, 119, 121, 163, 200)) for c in "ab"]
    df = spark.createDataFrame(rows, "recording string, channel string, samples array<double>")
    whole = {(r["recording"], r["channel"]): r["samples"] for r in signal.filtered(df, 64.0, 2.0, 20.0, notch, width=4.0).collect()}
    cut = signal.cut_chunks(df, length)
    out = signal.filtered_chunks(cut, ["recording", "channel"], 64.0, 2.0, 20.0, notch, width=4.0)
    got = {}
    for r in out.orderBy("recording", "channel", "chunk").collect():
        got.setdefault((r["recording"], r["channel"]), []).extend(r["samples"])
    assert got.keys() == whole.keys()
    assert all(len(got[k]) == len(whole[k]) and np.abs(np.subtract(got[k], whole[k])).max() < 1e-12 for k in whole)
    with pytest.raises(Exception, match="fewer than"):
        signal.filtered_chunks(signal.cut_chunks(df, 10), ["recording", "channel"], 64.0, 2.0, 20.0, width=4.0).count()
    assert signal.filtered_chunks(cut.limit(0), ["recording", "channel"], 64.0, 2.0, 20.0, width=4.0).count() == 0


def test_crop_and_epochs_of_chunks_equal_those_of_whole_signals(spark):
    df = spark.createDataFrame([("r", list(map(float, range(n)))) for n in (100, 47)], "recording string, samples array<double>").withColumn("recording", F.size("samples").cast("string"))
    whole = signal.epochs(df.withColumn("samples", signal.crop(F.col("samples"), 10.0, 0.125)), 10)
    cut = signal.epochs_of_chunks(signal.crop_chunks(signal.cut_chunks(df, 20), 10.0, 0.125, 20), 20, 10)
    key = lambda d: sorted((r["recording"], r["epoch"], tuple(r["samples"])) for r in d.collect())
    assert key(whole) == key(cut) and len(key(cut)) == 11
    with pytest.raises(ValueError):
        signal.epochs_of_chunks(cut, 20, 7)


def test_overlaps_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    points = [(int(k), int(i), float(a), float(a + d)) for i, (k, a, d) in enumerate(zip(rng.integers(0, 3, 300), rng.uniform(-50, 900, 300).round(0), rng.choice([0, 1, 10, 200], 300), strict=True))]
    spans = [(int(k), float(a), float(a + d)) for k, a, d in zip(rng.integers(0, 4, 60), rng.uniform(-80, 900, 60).round(0), rng.choice([0, 5, 5, 40, 500, -3], 60), strict=True)]
    p = spark.createDataFrame([*points, (0, 300, None, 5.0), (None, 301, 1.0, 900.0), (0, 302, 9.0, 5.0)], "k int, id int, start double, stop double")
    s = spark.createDataFrame([*spans, (0, None, 3.0), (None, 0.0, 900.0)], "k int, start double, stop double")
    out = relational.overlapping(p, s, ["k"], 16.0)
    want = {i for k, i, a, b in points if any(k == q and a < y and b > x for q, x, y in spans if x <= y)}
    assert {r["id"] for r in out.collect()} == want and 0 < len(want) < 300
    plan = relational.overlapping(p, s, ["k"], 16.0)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_annotated_epochs_go(spark):
    df = spark.range(10).selectExpr("'p' as participant_id", "cast(id as int) as epoch", "'a' as channel").unionByName(spark.range(2).selectExpr("'q' as participant_id", "cast(id as int) as epoch", "'a' as channel"))
    notes = spark.createDataFrame([("p", 4.0, 4.0, "BAD move"), ("p", 13.0, 0.0, "bad point"), ("p", 20.0, 9.0, "good")], "participant_id string, onset double, duration double, description string")
    kept = signal.unannotated(df, notes, ["participant_id"], 4.0).where("participant_id = 'p'")
    assert sorted(r["epoch"] for r in kept.collect()) == [0, 2, 4, 5, 6, 7, 8, 9]
    assert signal.unannotated(df, notes, ["participant_id"], 4.0).where("participant_id = 'q'").count() == 2


def test_many_ranges_share_tasks_and_lose_no_chunk(spark, tmp_path, monkeypatch):
    rows = [("a", c, k, [float(k), 0.0]) for c in ("x", "y") for k in range(3000)]
    df = spark.createDataFrame(rows, "recording string, channel string, chunk long, samples array<double>")
    rec.write_recordings(df, f"{tmp_path}/many", 2.0, "vhdr").foreach(lambda _: None)
    read = rec.read_recordings(spark, f"{tmp_path}/many", range_bytes=16, frames=2)
    assert read.rdd.getNumPartitions() == rec.MOST_TASKS
    got = sorted((r["channel"], r["chunk"], r["samples"][0]) for r in read.collect())
    assert got == sorted((c, k, float(k)) for _, c, k, _ in rows)
    monkeypatch.setattr(rec, "TASK_BYTES", 32)
    assert [len(run) for run in rec.bundled(list(range(1001)), 16 * 1001)] == [1] + [2] * 500 and rec.bundled([], 0) == []


def test_recordings_are_dealt_apart_from_the_join_of_their_lengths(spark, tmp_path):
    """Else adaptive execution may read the join's exchange mapper by mapper, and several tasks write one recording."""
    df = spark.createDataFrame(rows_of(), CHUNKS)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = rec.write_recordings(df, f"{tmp_path}/x", 10.0, "edf")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and plan.index("REPARTITION_BY_COL") < plan.index("SortMergeJoin")
