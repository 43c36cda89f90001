"""Signal and connectivity identities."""

import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import connectivity, signal
from cohortlens.sources import archive, participants

RATE = 128.0


def sine(hz, n=1024, noise=0.05, seed=0):
    t = np.arange(n) / RATE
    return np.sin(2 * np.pi * hz * t) + noise * np.random.default_rng(seed).normal(size=n)


def recording(spark, signals, key="p"):
    return spark.createDataFrame([(key, c, list(map(float, x))) for c, x in signals.items()], "participant string, channel string, samples array<double>")


def test_alpha_sine_has_alpha_power_and_shares_sum_to_one(spark):
    df = recording(spark, {"O1": sine(10), "O2": sine(10, seed=1)})
    powers = signal.band_powers(signal.welch_psd(df, RATE), ["participant", "channel"])
    shares = signal.relative_power(powers, ["participant", "channel"]).toPandas()
    assert (shares[shares["band"] == "alpha"]["relative"] > 0.9).all()
    assert shares.groupby("channel")["relative"].sum().tolist() == pytest.approx([1, 1])


def test_harmonised_names():
    names = signal.harmonised_names()
    assert len(names) == len(set(names)) == 36


def test_welch_equals_plain_sums():
    x = np.random.default_rng(2).normal(size=70)
    f, p = signal.welch(x, 16.0, 32)
    w = signal.periodic_hann(32)
    want = np.zeros(17)
    for part in (x[:32], x[32:64]):
        y = (part - part.mean()) * w
        for k in range(17):
            s = sum(y[i] * np.exp(-2j * np.pi * k * i / 32) for i in range(32))
            want[k] += abs(s) ** 2 / (16.0 * (w**2).sum()) / 2 * (1 if k in (0, 16) else 2)
    assert np.allclose(p, want) and f[1] == 0.5


def test_epochs_drop_the_tail_and_loud_ones(spark):
    x = np.zeros(10)
    x[5] = 3
    df = recording(spark, {"a": x, "b": np.zeros(10)})
    e = signal.epochs(df, 4)
    assert e.count() == 4 and e.where("size(samples) <> 4").count() == 0
    kept = signal.keep_quiet(e, ["participant", "epoch"], 1.0)
    assert {r["epoch"] for r in kept.collect()} == {0}
    assert signal.keep_quiet(e, ["participant", "epoch"], 3.0).count() == 4


def test_average_reference_sums_to_zero(spark):
    df = recording(spark, {c: sine(5, 64, seed=i) for i, c in enumerate("abc")})
    total = np.sum([r["samples"] for r in signal.average_reference(df, ["participant"]).collect()], axis=0)
    assert np.allclose(total, 0)


def test_quality_faults(spark):
    names = ("a", "b")
    good = {"a": sine(3, 16), "b": sine(4, 16)}
    faults = {"ok": good, "missing": {"a": good["a"]}, "short": good | {"b": good["b"][:5]}, "nan": good | {"b": np.where(np.arange(16) == 3, np.nan, good["b"])}, "flat": good | {"b": np.ones(16)}}
    df = recording(spark, good, "none").limit(0)
    for name, signals in faults.items():
        df = df.unionByName(recording(spark, signals, name))
    got = {r["participant"]: r["status"] for r in signal.signal_quality(df, ["participant"], 16, names).collect()}
    assert got == {n: "ok" if n == "ok" else "failed" for n in faults}


def test_filter_keeps_the_band():
    taps = signal.bandpass_taps(RATE, 1, 20)
    inside, outside = signal.filter_signal(sine(10, noise=0), taps), signal.filter_signal(sine(40, noise=0), taps)
    mid = slice(300, 700)
    assert np.abs(inside[mid] - sine(10, noise=0)[mid]).max() < 0.02 and np.abs(outside[mid]).max() < 0.02


def test_quarter_lag_is_fully_connected(spark):
    rng = np.random.default_rng(5)
    rows = []
    for e in range(20):
        for k in range(5):
            z = complex(*rng.normal(size=2))
            for c, v in (("a", z), ("b", z * 1j)):
                rows.append(("p", e, c, k, v.real, v.imag))
    df = spark.createDataFrame(rows, "participant string, epoch int, channel string, bin int, re double, im double")
    r = connectivity.pair_metrics(df, ["participant"], []).first()
    assert (r["coherence"], r["pli"], r["wpli"]) == pytest.approx((1, 1, 1))


@pytest.mark.parametrize("together", [1, 3, 32])
def test_summed_cross_spectra_equal_the_join_of_spectra(spark, together):
    """Missing channels, epochs of other lengths, null samples and recordings of several runs."""
    rng = np.random.default_rng(8)
    rows = []
    for p in range(3):
        for e in range(1 + 4 * p):
            for c in "abcd":
                if rng.random() < 0.8:
                    n = 16 if e != 2 else 10
                    rows.append((p, "x" if p else None, e, c, None if rng.random() < 0.1 else rng.normal(size=n).tolist() if rng.random() < 0.95 else []))
    df = spark.createDataFrame(rows, "p int, session string, epoch int, channel string, samples array<double>").withColumn("session", F.coalesce("session", F.lit("0")))
    z = connectivity.epoch_spectra(df, ["p", "session", "epoch", "channel"]).where("bin between 1 and 7").withColumn("band", F.when(F.col("bin") < 4, "low").otherwise("high"))
    want = {tuple(r)[:5]: tuple(r)[5:] for r in connectivity.pair_metrics(z, ["p", "session"], ["band"]).collect()}
    out = connectivity.pair_connectivity(df, ["p", "session"], {"low": [1, 2, 3], "high": [4, 5, 6, 7]}, together=together)
    got = {tuple(r)[:5]: tuple(r)[5:] for r in out.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_unit_triangle_and_path(spark):
    nodes = spark.createDataFrame([("g", n) for n in "abcd"], "g string, node string")
    e = spark.createDataFrame([("g", "a", "b", 1.0), ("g", "b", "c", 1.0), ("g", "a", "c", 1.0)], "g string, source string, target string, value double")
    c = {r["node"]: r["clustering"] for r in connectivity.clustering(e, nodes, ["g"]).collect()}
    assert c == pytest.approx({"a": 1, "b": 1, "c": 1, "d": 0})
    assert connectivity.global_efficiency(e, nodes, ["g"]).first()["efficiency"] == pytest.approx(6 / 12)
    s = {r["node"]: r["strength"] for r in connectivity.node_strengths(e, nodes, ["g"]).collect()}
    assert s == pytest.approx({"a": 2 / 3, "b": 2 / 3, "c": 2 / 3, "d": 0})
    with pytest.raises(ValueError):
        connectivity.top_edges(e, ["g"], 0)


def test_archive_and_participants(spark, tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        for s, text in (("Paciente1", "1.0\n 2.50 \n\n3\n"), ("Paciente2", "1\nx\n"), ("Paciente3", "1\n2\n")):
            z.writestr(f"EEG_data/AD/Eyes_closed/{s}/Fp1.txt", text)
        z.writestr("EEG_data/AD/Eyes_open/Paciente1/Fp1.txt", "9\n")
        z.writestr("../evil.txt", "1")
        z.writestr("EEG_data/AD/Eyes_closed/Paciente1/F1.txt", "1")
    got = {r["participant_id"]: r for r in archive.read_archive(spark, str(path), "Eyes_closed", expected=3).collect()}
    assert got["AD_Paciente1"]["samples"] == [1.0, 2.5, 3.0] and got["AD_Paciente2"]["error"] and "2 samples" in got["AD_Paciente3"]["error"] and len(got) == 3
    names = archive.list_members(spark, str(path))
    assert names.count() == 5
    index = {r["subject"]: r for r in archive.index_members(names, "Eyes_closed", ("Fp1", "F1")).collect()}
    assert index["Paciente1"]["missing"] == [] and index["Paciente2"]["missing"] == ["F1"]
    tsv = tmp_path / "p.tsv"
    tsv.write_text("participant_id \tGroup\tAge\tMMSE\nsub-1\tA\t70\tn/a\nsub-2\tZ\tx\t20\n")
    p = {r["participant_id"]: r for r in participants.read_participants(spark, str(tsv), label_map={"A": "AD"}).collect()}
    assert (p["sub-1"]["label"], p["sub-2"]["label"], p["sub-1"]["MMSE"], p["sub-2"]["Age"]) == ("AD", "Z", None, None)


def test_dft_twin(spark):
    x = np.random.default_rng(8).normal(size=16)
    got = signal.dft_power(recording(spark, {"a": x}), ["channel"], 16).orderBy("bin").toPandas()["power"]
    assert np.allclose(got, np.abs(np.fft.rfft(x)) ** 2) and math.isfinite(got[0])


def test_stream_windows_equal_batch(spark, sf, tmp_path):
    from cohortlens.streaming.windows import run_available, windowed

    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    got = run_available(spark, sf, "events.parquet", schema, str(tmp_path / "out"), str(tmp_path / "state"))
    want = windowed(spark.read.parquet(f"{sf}/events.parquet"), late=None)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 < got.where(F.col("n") > 0).count()


def test_remote_listing_follows_pages_and_folders(spark):
    from cohortlens.sources import remote

    file = lambda n, size: {"attributes": {"kind": "file", "name": n, "size": size}, "links": {"download": f"d/{n}"}}
    folder = {"attributes": {"kind": "folder", "name": "sub"}, "relationships": {"files": {"links": {"related": {"href": "u2"}}}}}
    pages = {"u": {"data": [file("a.TXT", 3), folder], "links": {"next": "u1"}}, "u1": {"data": [file("b", 4)]}, "u2": {"data": [file("c.csv", None)], "links": {"next": "u"}}}
    got = {r["path"]: (r["size"], r["ext"], r["download"]) for r in remote.remote_manifest(spark, "u", pages.__getitem__).collect()}
    assert got == {"a.TXT": (3, ".txt", "d/a.TXT"), "b": (4, "", "d/b"), "sub/c.csv": (None, ".csv", "d/c.csv")}


def test_windows_are_what_their_last_batch_says_and_leave_the_state(spark, tmp_path):
    from cohortlens.streaming.windows import run_available

    rows = lambda days: spark.createDataFrame([(f"2024-01-0{d} 0{h}:30:00", "a", float(10 * d + h)) for d in days for h in range(3)], "ts string, event_type string, value double").selectExpr("cast(ts as timestamp) as ts", "event_type", "value")
    for i, days in enumerate(((1, 2), (2, 3), (6,), (1,))):  # the last ones are over a day late
        rows(days).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}.parquet"))
        spark.read.parquet(str(tmp_path / "in" / f"{i}.parquet")).coalesce(1).write.mode("append").parquet(str(tmp_path / "stream"))
        got = run_available(spark, str(tmp_path / "stream"), "*.parquet", "ts timestamp, event_type string, value double", str(tmp_path / "out"), str(tmp_path / "state"), files=1)
    n = {str(r["window_start"]): r["n"] for r in got.collect()}
    assert n == {f"2024-01-0{d} 0{h}:00:00": 2 if d == 2 else 1 for d in (1, 2, 3, 6) for h in range(3)}
