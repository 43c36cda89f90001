"""Signal processing on recordings held as arrays: (recording keys, channel, samples).

Kernels run on one channel or one recording's channels at a time, in Arrow batches; what joins and aggregates
can say is left to the planner. Transforms have a SQL twin (dft_power) that the tests hold the kernels against.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.scalar import safe_log10, safe_log_ratio
from cohortlens.operators.relational import bands_table, in_band, membership, overlapping

#: The 19 common channels in the order of fingerprints, their regions, and the band ratios.
CHANNELS = ("Fp1", "Fp2", "F3", "F4", "C3", "C4", "P3", "P4", "O1", "O2", "F7", "F8", "T3", "T4", "T5", "T6", "Fz", "Cz", "Pz")
REGIONS = {
    "frontal": ("Fp1", "Fp2", "F3", "F4", "F7", "F8", "Fz"), "temporal": ("T3", "T4", "T5", "T6"), "central": ("C3", "C4", "Cz"), "parietal": ("P3", "P4", "Pz"), "occipital": ("O1", "O2"),
}
RATIOS = (("theta", "alpha"), ("delta", "alpha"))


def average_reference(df: DataFrame, keys: list[str], samples: str = "samples") -> DataFrame:
    """Each sample minus the mean over the recording's channels at that instant; channels need equal lengths.

    A recording's channels are gathered as arrays, so no row is made for a sample.
    """
    others = [c for c in df.columns if c not in keys]
    rows = df.groupBy(*keys).agg(F.collect_list(F.struct(*others)).alias("_rows"))  # a montage's channels
    total = F.aggregate(F.slice("_rows", 2, F.size("_rows")), F.col("_rows")[0][samples], lambda sums, row: F.zip_with(sums, row[samples], lambda a, b: a + b))
    means = rows.withColumn("_mean", F.transform(total, lambda x: x / F.size("_rows")))
    out = means.select(*keys, "_mean", F.explode("_rows").alias("_row")).select(*keys, "_mean", "_row.*")
    return out.withColumn(samples, F.zip_with(F.col(samples), F.col("_mean"), lambda x, m: x - m)).select(*df.columns)


def crop(samples: Column, rate: float, minutes: float) -> Column:
    """The samples of the first minutes."""
    return F.slice(samples, 1, int(math.floor(minutes * 60 * rate)) or 1)


def epochs(df: DataFrame, length: int, samples: str = "samples") -> DataFrame:
    """One row for each whole, non-overlapping epoch of length samples: adds epoch (from 0); the rest is dropped."""
    count = F.floor(F.size(samples) / length).cast("int")
    numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return df.withColumn("epoch", F.explode(numbers)).withColumn(samples, F.slice(samples, F.col("epoch") * length + 1, F.lit(length)))


def peak_to_peak(samples: Column) -> Column:
    return F.array_max(samples) - F.array_min(samples)


def is_flat(samples: Column) -> Column:
    """Whether all samples are equal; comparing extremes is exact where a variance is not."""
    return F.array_max(samples) == F.array_min(samples)


def all_finite(samples: Column) -> Column:
    return F.forall(samples, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def keep_quiet(df: DataFrame, keys: list[str], limit: float, samples: str = "samples") -> DataFrame:
    """Epochs of which no channel's peak-to-peak range is over limit; keys name the epoch."""
    loud = df.groupBy(*keys).agg(F.max(peak_to_peak(F.col(samples))).alias("_r")).where(F.col("_r") <= limit).select(*keys)
    return df.join(loud, keys, "left_semi")


def signal_quality(df: DataFrame, keys: list[str], expected: int, channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """keys, has_all_channels, uniform_counts, all_finite, n_flat, status of each recording."""
    out = df.groupBy(*keys).agg(
        F.size(F.array_except(F.array(*map(F.lit, channels)), F.collect_set("channel"))).alias("n_missing"), F.min(F.size("samples")).alias("_low"), F.max(F.size("samples")).alias("_high"),
        F.min(all_finite(F.col("samples"))).alias("all_finite"), F.sum(is_flat(F.col("samples")).cast("long")).alias("n_flat"),
    )
    fine = (F.col("n_missing") == 0) & (F.col("_low") == expected) & (F.col("_high") == expected) & F.col("all_finite") & (F.col("n_flat") == 0)
    return out.select(*keys, (F.col("n_missing") == 0).alias("has_all_channels"), (F.col("_low") == F.col("_high")).alias("uniform_counts"), "all_finite", "n_flat", F.when(fine, "ok").otherwise("failed").alias("status"))


def dft_power(df: DataFrame, keys: list[str], size: int, samples: str = "samples") -> DataFrame:
    """keys, bin, power: |X|^2 of the discrete Fourier transform for bins 0 to size / 2, by plain sums.

    Only expressions of the engine: an array is walked once for each bin. Meant for short segments and as the
    kernels' twin.
    """
    turn = lambda k, i: 2 * math.pi * ((k * i) % size) / size
    bins = [F.struct(F.lit(k).alias("bin"), F.array(*(F.lit(math.cos(turn(k, i))) for i in range(size))).alias("c"), F.array(*(F.lit(math.sin(turn(k, i))) for i in range(size))).alias("s")) for k in range(size // 2 + 1)]
    table = df.sparkSession.range(1).select(F.explode(F.array(*bins)).alias("b")).select("b.*")
    dot = lambda w: F.aggregate(F.zip_with(F.col(samples), F.col(w), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return df.crossJoin(F.broadcast(table)).select(*keys, "bin", (F.pow(dot("c"), F.lit(2)) + F.pow(dot("s"), F.lit(2))).alias("power"))


def periodic_hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def symmetric_hann(n: int) -> np.ndarray:
    return np.ones(1) if n == 1 else 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1))


def welch(x: np.ndarray, rate: float, segment: int, window: str = "hann") -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and power density of a signal, or of each row of a matrix: whole segments without overlap, each less its
    mean, windowed, averaged."""
    n = max(2, min(segment, x.shape[-1]))
    parts = x[..., : x.shape[-1] // n * n].reshape(*x.shape[:-1], -1, n)
    w = periodic_hann(n) if window == "hann" else 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / n)
    power = np.abs(np.fft.rfft((parts - parts.mean(-1, keepdims=True)) * w, axis=-1)) ** 2 / (rate * (w**2).sum())
    power[..., 1 : None if n % 2 else -1] *= 2
    return np.fft.rfftfreq(n, 1 / rate), power.mean(-2)


def welch_psd(df: DataFrame, rate: float, segment: int = 256, window: str = "hann", samples: str = "samples") -> DataFrame:
    """Adds psd (array of power) and frequencies; null where there are fewer than two samples or one is null."""

    @F.pandas_udf("frequencies array<double>, psd array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in batches:
            lengths = column.map(len).to_numpy()
            frequencies, psd = np.empty(len(column), object), np.empty(len(column), object)
            for n in np.unique(lengths[lengths >= 2]):
                rows = np.flatnonzero(lengths == n)
                step = max(1, 4_000_000 // int(n))
                for k in range(0, len(rows), step):
                    some = rows[k : k + step]
                    f, power = welch(np.stack(column.iloc[some].tolist()).astype(float), rate, segment, window)
                    for i, p in zip(some, power, strict=True):
                        frequencies[i], psd[i] = f, p
            yield pd.DataFrame({"frequencies": frequencies, "psd": psd})

    whole = F.when(F.col(samples).isNotNull() & ~F.exists(samples, lambda x: x.isNull()), F.col(samples)).otherwise(F.array().cast("array<double>"))
    return df.withColumn("_w", run(whole)).select(*df.columns, "_w.frequencies", "_w.psd")


def resolution_segment(rate: float, resolution: float = 0.5) -> int:
    """The segment length of a frequency resolution; 2 at least."""
    return max(2, round(rate / resolution))


def band_powers(spectra: DataFrame, keys: list[str], bands: dict | None = None, how: str = "sum") -> DataFrame:
    """keys, band, power: the sum (0 without a bin) or mean (no row without a bin) of a spectrum's bins in each band."""
    points = spectra.select(*keys, F.explode(F.arrays_zip(F.col("frequencies").alias("frequency"), F.col("psd").alias("power"))).alias("p")).select(*keys, "p.frequency", "p.power")
    table = bands_table(spectra.sparkSession, bands) if bands else bands_table(spectra.sparkSession)
    inside = in_band(points, table).groupBy(*keys, "band").agg((F.sum if how == "sum" else F.avg)("power").alias("power"))
    if how != "sum":
        return inside
    every = spectra.select(*keys).distinct().crossJoin(F.broadcast(table.select("band")))
    return every.join(inside, [*keys, "band"], "left").withColumn("power", F.coalesce("power", F.lit(0.0)))


def relative_power(powers: DataFrame, keys: list[str]) -> DataFrame:
    """Adds relative: a band's power over that of all bands of the channel; null where the total is not positive."""
    totals = powers.groupBy(*keys).agg(F.sum("power").alias("_total"))
    return powers.join(totals, keys).withColumn("relative", F.col("power") / F.when(F.col("_total") > 0, F.col("_total"))).drop("_total")


def feature(*parts) -> Column:
    return F.concat_ws("__", *(F.lit(p) if isinstance(p, str) else p for p in parts))


def discovery_features(powers: DataFrame, keys: list[str], regions: dict[str, list[str]], ratios=RATIOS) -> DataFrame:
    """keys, feature, value from mean band powers by channel: logarithms by channel, their means over all channels
    and over each region's present ones, and differences of these means as ratios."""
    logs = powers.select(*keys, "channel", "band", safe_log10(F.col("power")).alias("value"))
    channel = logs.select(*keys, feature("band_ch", F.col("band"), F.col("channel")).alias("feature"), "value")
    world = logs.groupBy(*keys, "band").agg(F.avg("value").alias("value"))
    region = membership(logs, regions, "channel").groupBy(*keys, "band", "region").agg(F.avg("value").alias("value"))

    def differences(means: DataFrame, by: list[str], name) -> DataFrame:
        wide = means.groupBy(*by).agg(*(F.max(F.when(F.col("band") == b, F.col("value"))).alias(b) for b in sorted({x for r in ratios for x in r})))
        parts = [F.struct(name(a, b).alias("feature"), (F.col(a) - F.col(b)).alias("value")) for a, b in ratios]
        return wide.select(*keys, F.explode(F.array(*parts)).alias("s")).select(*keys, "s.*").where("value is not null")

    frames = [
        channel, world.select(*keys, feature("band_global", F.col("band")).alias("feature"), "value"), region.select(*keys, feature("band_region", F.col("band"), F.col("region")).alias("feature"), "value"),
        differences(world, keys, lambda a, b: F.lit(f"ratio_global__{a}_{b}")), differences(region, [*keys, "region"], lambda a, b: feature(f"ratio_region__{a}_{b}", F.col("region"))),
    ]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def archive_features(powers: DataFrame, keys: list[str], regions: dict[str, list[str]], ratios=RATIOS) -> DataFrame:
    """keys, feature, value from summed band powers by channel: relative powers by channel, globally and by region,
    and logarithms of ratios of mean powers (not differences of mean logarithms)."""
    shares = relative_power(powers, [*keys, "channel"])
    channel = shares.select(*keys, feature("relpow_ch", F.col("band"), F.col("channel")).alias("feature"), F.col("relative").alias("value"))
    world = shares.groupBy(*keys, "band").agg(F.avg("relative").alias("value"), F.avg("power").alias("power"))
    region = membership(shares, regions, "channel").groupBy(*keys, "band", "region").agg(F.avg("relative").alias("value"), F.avg("power").alias("power"))

    def logs(means: DataFrame, by: list[str], name) -> DataFrame:
        wide = means.groupBy(*by).agg(*(F.max(F.when(F.col("band") == b, F.col("power"))).alias(b) for b in sorted({x for r in ratios for x in r})))
        parts = [F.struct(name(a, b).alias("feature"), safe_log_ratio(F.col(a), F.col(b)).alias("value")) for a, b in ratios]
        return wide.select(*keys, F.explode(F.array(*parts)).alias("s")).select(*keys, "s.*")

    frames = [
        channel, world.select(*keys, feature("relpow_global", F.col("band")).alias("feature"), "value"), region.select(*keys, feature("relpow_region", F.col("band"), F.col("region")).alias("feature"), "value"),
        logs(world, keys, lambda a, b: F.lit(f"ratio_global__{a}_{b}")), logs(region, [*keys, "region"], lambda a, b: feature(f"ratio_region__{a}_{b}", F.col("region"))),
    ]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def harmonised_names(bands=("delta", "theta", "alpha", "beta"), regions=("frontal", "central", "parietal", "occipital", "temporal"), ratios=RATIOS) -> list[str]:
    """The names of the harmonised vector, 36 with the standard arguments."""
    names = [f"relpow_global__{b}" for b in bands] + [f"relpow_region__{b}__{r}" for b in bands for r in regions]
    return names + [f"ratio_global__{a}_{b}" for a, b in ratios] + [f"ratio_region__{a}_{b}__{r}" for a, b in ratios for r in regions]


def bandpass_taps(rate: float, low: float | None, high: float | None, width: float = 1.0) -> np.ndarray:
    """A windowed-sinc (Hamming) filter of odd length with a transition of width Hz."""
    n = int(math.ceil(3.3 * rate / width)) | 1
    t = np.arange(n) - n // 2
    w = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / (n - 1))
    cut = lambda f: 2 * f / rate * np.sinc(2 * f / rate * t)
    taps = (cut(high) if high else (t == 0).astype(float)) - (cut(low) if low else 0)
    return taps * w


def filter_signal(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Zero-phase along the last axis: the symmetric filter's delay is taken out; ends are mirrored."""
    half, size = len(taps) // 2, x.shape[-1]
    pad = np.pad(x, [(0, 0)] * (x.ndim - 1) + [(half, half)], mode="reflect" if size > half else "edge")
    return _convolved(pad, taps)[..., :size]


def _convolved(padded: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """What a filter makes of signals that have half its length more at both ends."""
    n = padded.shape[-1] + len(taps) - 1
    return np.fft.irfft(np.fft.rfft(padded, n, axis=-1) * np.fft.rfft(taps, n), n, axis=-1)[..., len(taps) - 1 : padded.shape[-1]]


def filter_chain(rate: float, low: float | None, high: float | None, notch: tuple[float, ...] = (), width: float = 1.0) -> list[np.ndarray]:
    """The taps of a band-pass and of notch filters of 2 Hz."""
    filters = [bandpass_taps(rate, low, high, width)]
    for f in notch:
        taps = -bandpass_taps(rate, f - 1, f + 1, width)
        taps[len(taps) // 2] += 1
        filters.append(taps)
    return filters


#: Samples that are transformed together.
TOGETHER = 2_000_000


def filtered(df: DataFrame, rate: float, low: float | None = 1.0, high: float | None = 45.0, notch: tuple[float, ...] = (), samples: str = "samples", width: float = 1.0) -> DataFrame:
    """Samples through a band-pass and, where listed, notch filters of 2 Hz; signals of equal length are filtered together."""
    filters = filter_chain(rate, low, high, notch, width)

    @F.pandas_udf("array<double>")
    def run(column: pd.Series) -> pd.Series:
        lengths, out = column.map(lambda x: 0 if x is None else len(x)).to_numpy(), column.to_numpy(copy=True)
        for n in np.unique(lengths[lengths > 0]):
            rows = np.flatnonzero(lengths == n)
            step = max(1, TOGETHER // int(n))
            for k in range(0, len(rows), step):
                y = np.stack(column.iloc[rows[k : k + step]].tolist()).astype(float)
                for taps in filters:
                    y = filter_signal(y, taps)
                for i, v in zip(rows[k : k + step], y, strict=True):
                    out[i] = v
        return pd.Series(out)

    return df.withColumn(samples, run(F.col(samples)))


# --- recordings in chunks ---------------------------------------------------------------------------------------


def cut_chunks(df: DataFrame, length: int, samples: str = "samples") -> DataFrame:
    """Arrays cut into rows of length samples, numbered by chunk from 0; the last one holds the rest."""
    count = F.ceil(F.size(samples) / length).cast("int")
    numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return df.withColumn("chunk", F.explode(numbers)).withColumn(samples, F.slice(samples, F.col("chunk") * length + 1, F.lit(length)))


def crop_chunks(df: DataFrame, rate: float, minutes: float, length: int, samples: str = "samples") -> DataFrame:
    """The first minutes of recordings in chunks of length samples."""
    left = F.lit(int(math.floor(minutes * 60 * rate)) or 1) - F.col("chunk") * length
    return df.where(left > 0).withColumn(samples, F.slice(samples, F.lit(1), F.least(left, F.lit(length)).cast("int")))


def epochs_of_chunks(df: DataFrame, length: int, size: int, samples: str = "samples") -> DataFrame:
    """Epochs of size samples of recordings in chunks of length samples, which has to be a multiple of size."""
    if length % size:
        raise ValueError(f"chunks of {length} samples do not hold whole epochs of {size}")
    return epochs(df, size, samples).withColumn("epoch", F.col("chunk") * (length // size) + F.col("epoch"))


def filtered_chunks(df: DataFrame, keys: list[str], rate: float, low: float | None = 1.0, high: float | None = 45.0, notch: tuple[float, ...] = (), samples: str = "samples", width: float = 1.0) -> DataFrame:
    """keys, chunk and samples of recordings in chunks, filtered as filtered() does whole ones; keys name a channel of a recording.

    Each chunk sends its ends to its neighbours, as many samples as the filters reach; no array holds a recording,
    and a long one is spread over tasks by its chunks. All chunks but a recording's last have to be as long as the
    filters reach (an error else); a recording of one chunk is filtered as a whole. A missing or null chunk ends a
    recording on both sides of it.
    """
    filters = filter_chain(rate, low, high, notch, width)
    taps = filters[0]
    for other in filters[1:]:
        taps = np.convolve(taps, other)
    reach = len(taps) // 2
    x = F.col(samples).cast("array<double>")
    piece = lambda to, part, values: F.struct(to.cast("long").alias("chunk"), F.lit(part).alias("part"), values.alias("x"))
    own = F.col("chunk")
    ends = F.array(piece(own, 0, x), piece(own + 1, -1, F.slice(x, F.greatest(F.size(x) - reach + 1, F.lit(1)), F.lit(reach))), piece(own - 1, 1, F.slice(x, 1, F.lit(reach))))
    pieces = df.where(F.col(samples).isNotNull()).select(*keys, F.explode(ends).alias("_p")).select(*keys, "_p.chunk", "_p.part", "_p.x")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    count = len(keys)

    def laid_out(left, here, right) -> np.ndarray:
        if left is not None and len(left) < reach or right is not None and len(here) < reach:
            raise ValueError(f"a chunk that is not the last one has fewer than {reach} samples")
        row = np.concatenate([v for v in (left, here, right) if v is not None])
        return np.pad(row, (reach - (0 if left is None else len(left)), reach - (0 if right is None else len(right))), mode="reflect")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, types = None, {}, None
        ready: list[tuple] = []

        def close() -> None:
            here = parts.get(0)
            if here is not None and len(here):
                alone = parts.get(-1) is None and parts.get(1) is None
                ready.append((key, len(here), here if alone else laid_out(parts.get(-1), here, parts.get(1)), alone))

        def flush() -> pa.RecordBatch:
            done: dict[int, np.ndarray] = {}
            alike: dict[tuple, list[int]] = {}
            for i, (_, _, row, alone) in enumerate(ready):
                alike.setdefault((alone, len(row)), []).append(i)
            for (alone, _), members in alike.items():
                y = np.stack([ready[i][2] for i in members])
                if alone:
                    for f in filters:
                        y = filter_signal(y, f)
                else:
                    y = _convolved(y, taps)
                done |= {i: v[: ready[i][1]] for i, v in zip(members, y, strict=True)}
            columns = [pa.array([r[0][c] for r in ready], types[c]) for c in range(count + 1)]
            out = pa.RecordBatch.from_arrays([*columns, pa.array([done[i] for i in range(len(ready))], pa.list_(pa.float64()))], names=[*keys, "chunk", samples])
            ready.clear()
            return out

        for batch in batches:
            types = types or [batch.schema.field(c).type for c in range(count + 1)]
            column = batch.column(count + 2)
            values, edges = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            held = 0
            for i, (*own, part) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(count + 2)), strict=True)):
                if own != key:
                    close()
                    if held > TOGETHER:
                        yield flush()
                        held = 0
                    key, parts = own, {}
                parts[part] = values[edges[i] : edges[i + 1]].astype(float)
                held += len(parts[part])
            if ready:
                yield flush()
        if key is not None:
            close()
            if ready:
                yield flush()

    dealt = pieces.repartition(*keys, "chunk").sortWithinPartitions(*keys, "chunk", "part")
    return dealt.mapInArrow(run, f"{kinds}, chunk bigint, `{samples}` array<double>")


# --- annotations ------------------------------------------------------------------------------------------------


def unannotated(df: DataFrame, annotations: DataFrame, keys: list[str], seconds: float, prefix: str = "bad", bucket: float = 60.0) -> DataFrame:
    """Epochs (keys, epoch, ...) of seconds that overlap no annotation (keys, onset, duration, description) whose
    description begins with prefix, in any case. Touching ends do not overlap; a recording without annotations keeps all."""
    spans = annotations.where(F.lower("description").startswith(prefix.lower())).select(*keys, F.col("onset").cast("double").alias("start"), (F.col("onset") + F.col("duration")).cast("double").alias("stop"))
    times = df.select(*keys, "epoch").distinct().withColumns({"start": F.col("epoch") * F.lit(float(seconds)), "stop": (F.col("epoch") + 1) * F.lit(float(seconds))})
    hit = overlapping(times, spans, keys, bucket)
    return df.join(hit.select(*keys, "epoch"), [*keys, "epoch"], "left_anti")
