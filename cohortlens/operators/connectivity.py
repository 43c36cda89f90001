"""Connectivity of channel pairs from epoch spectra, and graph metrics of thresholded networks.

Spectra are rows (keys, epoch, channel, bin, re, im); edges are rows (keys, source, target, value) with
source < target.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.signal import symmetric_hann

EPS = float(np.finfo(float).eps)


def epoch_spectra(df: DataFrame, keys: list[str], samples: str = "samples") -> DataFrame:
    """keys (recording, epoch, channel), bin, re, im: each epoch less its mean, by a symmetric Hann window."""

    @F.pandas_udf("array<struct<re:double,im:double>>")
    def run(column: pd.Series) -> pd.Series:
        def one(x):
            if x is None or len(x) == 0:
                return []
            y = np.asarray(x, float)
            z = np.fft.rfft((y - y.mean()) * symmetric_hann(len(y)))
            return [{"re": float(v.real), "im": float(v.imag)} for v in z]

        return column.map(one)

    return df.select(*keys, F.posexplode(run(F.col(samples))).alias("bin", "_z")).select(*keys, "bin", F.col("_z.re").alias("re"), F.col("_z.im").alias("im"))


def pair_metrics(spectra: DataFrame, keys: list[str], also: list[str]) -> DataFrame:
    """keys, also, source, target, coherence, pli, wpli over epochs, averaged over bins; all in [0, 1].

    From spectra that are rows already; pair_connectivity() is for samples and makes no row for a bin. also (such as the
    band) splits bins into sets. Pairs are of channels of one epoch and bin, so the join's groups have the size of a montage.
    """
    by = [*keys, "epoch", *also, "bin"]
    side = lambda name, a: spectra.select(*by, F.col("channel").alias(name), F.col("re").alias(f"re_{a}"), F.col("im").alias(f"im_{a}"))
    pairs = side("source", "s").join(side("target", "t"), by).where("source < target")
    re = F.col("re_s") * F.col("re_t") + F.col("im_s") * F.col("im_t")
    im = F.col("im_s") * F.col("re_t") - F.col("re_s") * F.col("im_t")
    power = lambda a: F.avg(F.col(f"re_{a}") * F.col(f"re_{a}") + F.col(f"im_{a}") * F.col(f"im_{a}"))
    each = pairs.groupBy(*keys, *also, "source", "target", "bin").agg(
        F.avg(re).alias("re"), F.avg(im).alias("im"), F.avg(F.abs(im)).alias("abs_im"), F.avg(F.signum(im)).alias("sign"), power("s").alias("ps"), power("t").alias("pt")
    )
    clip = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.avg(c)))
    return each.groupBy(*keys, *also, "source", "target").agg(
        clip((F.col("re") * F.col("re") + F.col("im") * F.col("im")) / F.greatest(F.col("ps") * F.col("pt"), F.lit(EPS))).alias("coherence"),
        clip(F.abs("sign")).alias("pli"), clip(F.abs("im") / F.greatest("abs_im", F.lit(EPS))).alias("wpli"),
    )


class CrossSpectra:
    """Sums over epochs that pair metrics follow from, for the pairs of some channels and some bins; sums can be added.

    For each pair and bin: the number of epochs, the sums of the cross spectrum's real and imaginary part, of the
    latter's modulus and sign, and of both powers. An epoch counts for the pairs of the channels that it has.
    """

    FIELDS = 7

    def __init__(self, bins: np.ndarray, names: tuple[str, ...] = (), sums: np.ndarray | None = None):
        self.bins, self.names = bins, names
        self.sums = np.zeros((self.FIELDS, len(names) * (len(names) - 1) // 2, len(bins))) if sums is None else sums

    def add_epochs(self, names: tuple[str, ...], x: np.ndarray) -> None:
        """x: epochs by channels (in the order of names, which is sorted) by samples."""
        z = np.fft.rfft((x - x.mean(-1, keepdims=True)) * symmetric_hann(x.shape[-1]), axis=-1)
        some = self.bins < z.shape[-1]
        z = z[..., self.bins[some]]
        i, j = np.triu_indices(len(names), 1)
        cross, power = z[:, i] * z[:, j].conj(), (z.real**2 + z.imag**2).sum(0)
        out = np.zeros((self.FIELDS, len(i), len(self.bins)))
        out[:, :, some] = np.stack([np.full(cross.shape[1:], float(len(x))), cross.real.sum(0), cross.imag.sum(0), np.abs(cross.imag).sum(0), np.sign(cross.imag).sum(0), power[i], power[j]])
        self.merge(names, out)

    def merge(self, names: tuple[str, ...], sums: np.ndarray) -> None:
        if names == self.names:
            self.sums = self.sums + sums
            return
        union = tuple(sorted({*self.names, *names}))
        out = np.zeros((self.FIELDS, len(union) * (len(union) - 1) // 2, len(self.bins)))
        for own, values in ((self.names, self.sums), (names, sums)):
            at = np.array([union.index(n) for n in own], int)
            i, j = np.triu_indices(len(own), 1)
            i, j = at[i], at[j]
            out[:, i * (2 * len(union) - i - 1) // 2 + j - i - 1] += values
        self.names, self.sums = union, out

    def metrics(self, sets: dict[str, list[int]]) -> list[tuple]:
        """(set, source, target, coherence, pli, wpli) for the pairs that have epochs with a bin of the set."""
        n = np.maximum(self.sums[0], 1)
        re, im, abs_im, sign, ps, pt = (self.sums[k] / n for k in range(1, self.FIELDS))
        each = np.stack([(re**2 + im**2) / np.maximum(ps * pt, EPS), np.abs(sign), np.abs(im) / np.maximum(abs_im, EPS)])
        out, pairs = [], list(zip(*np.triu_indices(len(self.names), 1), strict=True))
        for name, bins in sets.items():
            here = np.isin(self.bins, bins) & (self.sums[0] > 0)
            count = here.sum(1)
            mean = np.clip(np.where(here, each, 0).sum(-1) / np.maximum(count, 1), 0, 1)
            out += [(name, self.names[i], self.names[j], *mean[:, p].tolist()) for p, (i, j) in enumerate(pairs) if count[p]]
        return out


#: Epochs of a recording that are summed in one task before sums are exchanged.
EPOCHS_TOGETHER = 32


def pair_connectivity(df: DataFrame, keys: list[str], sets: dict[str, list[int]], name: str = "band", samples: str = "samples", together: int = EPOCHS_TOGETHER) -> DataFrame:
    """keys, name (of the set of bins), source, target, coherence, pli, wpli from epochs (keys, epoch, channel, samples).

    As pair_metrics(), without a row for a bin and without a join: runs of epochs are summed where their samples meet,
    and sums of a recording are added. A recording's epochs are spread over tasks by runs, so a long one is no single
    task's. Null or empty samples are absent channels. A channel that stands twice in an epoch counts once, as its last.
    """
    bins = np.array(sorted({b for v in sets.values() for b in v}), int)
    schema = df.select(*keys).schema
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    count = len(keys)

    def runs(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple]:
        """(key, columns of the run) for consecutive rows of equal first columns."""
        for batch in batches:
            own = list(zip(*(batch.column(c).to_pylist() for c in range(at)), strict=True))
            cuts = [0, *(i for i in range(1, len(own)) if own[i] != own[i - 1]), len(own)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    yield own[a], batch.slice(a, b - a)

    def emitted(rows: list[tuple], types: list, names: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, epochs, types = None, {}, None

        def finish():
            total, alike = CrossSpectra(bins), {}
            for channels in epochs.values():
                lengths = {len(v) for v in channels.values()}
                for size in lengths:
                    own = tuple(sorted(c for c, v in channels.items() if len(v) == size))
                    alike.setdefault((own, size), []).append([channels[c] for c in own])
            for (own, _), x in alike.items():
                total.add_epochs(own, np.array(x))
            return emitted([(*key, list(total.names), total.sums.tobytes())], [*types, pa.int64(), pa.list_(pa.string()), pa.binary()], [*keys, "_run", "names", "sums"])

        for own, part in runs(batches, count + 1):
            types = types or [part.schema.field(c).type for c in range(count)]
            if own != key:
                if epochs:
                    yield finish()
                key, epochs = own, {}
            column = part.column(count + 3)
            values, edges = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            for i, (epoch, channel) in enumerate(zip(part.column(count + 1).to_pylist(), part.column(count + 2).to_pylist(), strict=True)):
                if edges[i + 1] > edges[i]:
                    epochs.setdefault(epoch, {})[channel] = values[edges[i] : edges[i + 1]].astype(float)
        if epochs:
            yield finish()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, types = None, CrossSpectra(bins), None
        names = [*keys, name, "source", "target", "coherence", "pli", "wpli"]
        last = [pa.string()] * 3 + [pa.float64()] * 3
        for own, part in runs(batches, count):
            types = types or [part.schema.field(c).type for c in range(count)]
            if own != key:
                if key is not None:
                    yield emitted([(*key, *m) for m in total.metrics(sets)], [*types, *last], names)
                key, total = own, CrossSpectra(bins)
            for channels, blob in zip(part.column(count + 1).to_pylist(), part.column(count + 2).to_pylist(), strict=True):
                total.merge(tuple(channels), np.frombuffer(blob).reshape(CrossSpectra.FIELDS, -1, len(bins)))
        if key is not None:
            yield emitted([(*key, *m) for m in total.metrics(sets)], [*types, *last], names)

    rows = df.select(*keys, F.floor(F.col("epoch") / together).alias("_run"), "epoch", "channel", F.col(samples).cast("array<double>").alias("_x"))
    parts = rows.repartition(*keys, "_run").sortWithinPartitions(*keys, "_run", "epoch").mapInArrow(summed, f"{kinds}, _run bigint, names array<string>, sums binary")
    return parts.repartition(*keys).sortWithinPartitions(*keys, "_run").mapInArrow(merged, f"{kinds}, {name} string, source string, target string, coherence double, pli double, wpli double")


def band_bins(bands: dict[str, tuple[float, float]], rate: float, length: int) -> dict[str, list[int]]:
    """The bins of each half-open band, for epochs of length samples."""
    return {b: [k for k in range(length // 2 + 1) if lo <= k * rate / length < hi] for b, (lo, hi) in bands.items()}


def top_edges(edges: DataFrame, keys: list[str], share: float, value: str = "value") -> DataFrame:
    """The ceil(share * edges) largest edges of each graph, 1 at least, without null, non-finite or non-positive ones.

    At a tie the first by source and target. All edges count for the number to keep.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be in (0, 1]")
    order = Window.partitionBy(*keys).orderBy(F.col(value).desc_nulls_last(), "source", "target")
    ranked = edges.withColumn("_r", F.row_number().over(order)).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    kept = ranked.where(F.col("_r") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * F.lit(share) - 1e-12)))
    return kept.where((F.col(value) > 0) & (F.col(value) < float("inf"))).drop("_r", "_n")


def node_strengths(edges: DataFrame, nodes: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, node, strength: the sum of a node's edges over the number of other nodes; nodes has every (keys, node)."""
    ends = edges.select(*keys, F.explode(F.array("source", "target")).alias("node"), value).groupBy(*keys, "node").agg(F.sum(value).alias("_s"))
    sized = nodes.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    return sized.join(ends, [*keys, "node"], "left").select(*keys, "node", (F.coalesce("_s", F.lit(0.0)) / F.greatest(F.col("_n") - 1, F.lit(1))).alias("strength"))


def clustering(edges: DataFrame, nodes: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, node, clustering: the sum over triangles of the cube root of their three weights (each over the
    graph's largest), times 2, over d (d - 1); 0 for fewer than two neighbours."""
    scaled = edges.withColumn("_w", F.col(value) / F.max(value).over(Window.partitionBy(*keys)))
    e = lambda a, b, w: scaled.select(*keys, F.col("source").alias(a), F.col("target").alias(b), F.col("_w").alias(w))
    triangles = e("a", "b", "w1").join(e("b", "c", "w2"), [*keys, "b"]).join(e("a", "c", "w3"), [*keys, "a", "c"])
    part = F.pow(F.col("w1") * F.col("w2") * F.col("w3"), F.lit(1 / 3))
    sums = triangles.select(*keys, F.explode(F.array("a", "b", "c")).alias("node"), part.alias("_p")).groupBy(*keys, "node").agg(F.sum("_p").alias("_t"))
    degrees = edges.select(*keys, F.explode(F.array("source", "target")).alias("node")).groupBy(*keys, "node").agg(F.count("*").alias("_d"))
    out = nodes.join(sums, [*keys, "node"], "left").join(degrees, [*keys, "node"], "left")
    return out.select(*keys, "node", F.coalesce(2 * F.col("_t") / F.nullif(F.col("_d") * (F.col("_d") - 1), F.lit(0)), F.lit(0.0)).alias("clustering"))


def global_efficiency(edges: DataFrame, nodes: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, efficiency: the mean of 1 / shortest path over ordered node pairs, with lengths 1 / weight; unreachable
    pairs count 0, fewer than two nodes give null. A graph has the size of a montage and is one kernel call."""
    lists = nodes.groupBy(*keys).agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    links = edges.groupBy(*keys).agg(F.collect_list(F.struct("source", "target", F.col(value).cast("double").alias("w"))).alias("links"))

    @F.pandas_udf("double")
    def run(names: pd.Series, links: pd.Series) -> pd.Series:
        out = []
        for ns, ls in zip(names, links, strict=True):
            at = {n: i for i, n in enumerate(ns)}
            d = np.full((len(ns), len(ns)), np.inf)
            for link in [] if ls is None else ls:
                i, j = at[link["source"]], at[link["target"]]
                d[i, j] = d[j, i] = min(d[i, j], 1 / max(link["w"], EPS))
            np.fill_diagonal(d, 0)
            for k in range(len(ns)):
                d = np.minimum(d, d[:, k, None] + d[None, k])
            inverse = np.divide(1, d, out=np.zeros_like(d), where=(d > 0) & np.isfinite(d))
            out.append(inverse.sum() / (len(ns) * (len(ns) - 1)) if len(ns) > 1 else None)
        return pd.Series(out, dtype="float64")

    return lists.join(links, keys, "left").select(*keys, run("nodes", "links").alias("efficiency"))


def graph_features(edges: DataFrame, nodes: DataFrame, keys: list[str], share: float = 0.2, value: str = "value") -> DataFrame:
    """keys, clustering, global_efficiency, mean_strength of the thresholded graph, over all nodes."""
    kept = top_edges(edges, keys, share, value)
    a = clustering(kept, nodes, keys, value).groupBy(*keys).agg(F.avg("clustering").alias("clustering"))
    b = global_efficiency(kept, nodes, keys, value).withColumnRenamed("efficiency", "global_efficiency")
    c = node_strengths(kept, nodes, keys, value).groupBy(*keys).agg(F.avg("strength").alias("mean_strength"))
    return a.join(b, keys).join(c, keys)


def connectivity_features(edges: DataFrame, keys: list[str], metrics: tuple[str, ...] = ("coherence", "pli", "wpli")) -> DataFrame:
    """keys, feature, value: the mean of the upper triangle for each metric and band."""
    parts = [F.struct(F.lit(m).alias("m"), F.col(m).alias("value")) for m in metrics]
    long = edges.select(*keys, "band", F.explode(F.array(*parts)).alias("s")).select(*keys, "band", "s.*")
    return long.groupBy(*keys, "band", "m").agg(F.avg("value").alias("value")).select(*keys, F.concat_ws("__", F.lit("conn_global"), "m", "band").alias("feature"), "value")
