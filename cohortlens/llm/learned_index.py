"""Approximate nearest neighbours by learned partitions (operator 9).

A sample's neighbour graph is cut into parts of about equal size with few edges between them: principal
directions split it at their medians, then nodes move to the part that holds most of their neighbours as far as
parts have room. A small network with one hidden layer learns, from a vector, how its neighbours spread over the
parts. It places every vector in its most probable part and routes each query to several, whose vectors are
all compared with it.

The number of parts grows with the number of vectors: one for each LEAST_ROWS vectors, up to FAN. Where those
would hold more than PART_ROWS, each part is cut again in the same way, by a task of its own and from a sample of
its own vectors, and a query's parts are ranked by the product of both networks' probabilities. How many parts a
query visits is the least number that finds the wanted share of the true neighbours of held-out vectors, which
are searched among all vectors, so the share of parts visited falls as neighbours get closer.

Samples have at most SAMPLE vectors; every vector is indexed. Equal vectors are one, with the smallest ids
that any result can need. Parts are compared in bins of at most about BLOCK vectors: small parts share a bin, to
which a query is sent once, and a large part has several, so no part, however popular, is held at once.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import materialise, read

SAMPLE, HELD_OUT, NEIGHBOURS, HIDDEN, EPOCHS = 8192, 256, 16, 128, 8
#: Parts of a level at most, vectors of a part at least (unless there is one part), and from which on it is cut again.
FAN, LEAST_ROWS, PART_ROWS = 128, 32, 4096
TARGET_RECALL = 0.94
#: Vectors that a task holds at once, and queries that it compares with them at once.
BLOCK, CHUNK = 16_384, 128


def partition_graph(x: np.ndarray, near: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.1) -> np.ndarray:
    """A part for each row of x; near lists each row's neighbours."""
    label = np.zeros(len(x), np.int64)

    def split(rows: np.ndarray, low: int, high: int) -> None:
        if high - low < 2:
            label[rows] = low
            return
        mid = (low + high) // 2
        y = x[rows] - x[rows].mean(0)
        v = np.ones(x.shape[1]) + np.arange(x.shape[1]) % 3
        for _ in range(20):
            v = y.T @ (y @ v)
            v /= np.linalg.norm(v) or 1.0
        order = rows[np.argsort(y @ v, kind="stable")]
        at = len(rows) * (mid - low) // (high - low)
        split(order[:at], low, mid)
        split(order[at:], mid, high)

    split(np.arange(len(x)), 0, parts)
    room = int(np.ceil(slack * len(x) / parts))
    rows, cols = np.repeat(np.arange(len(x)), near.shape[1]), near.ravel()
    for _ in range(rounds):
        votes = np.zeros((len(x), parts), np.float32)
        np.add.at(votes, (rows, label[cols]), 1)
        np.add.at(votes, (cols, label[rows]), 1)
        wish = votes.argmax(1)
        gain = votes[np.arange(len(x)), wish] - votes[np.arange(len(x)), label]
        held = np.bincount(label, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if held[wish[i]] < room and held[label[i]] > 1:
                held[label[i]] -= 1
                label[i] = wish[i]
                held[label[i]] += 1
                moved += 1
        if not moved:
            break
    return label


class Router:
    """A network from a vector to the probabilities of the parts."""

    def __init__(self, mean, scale, w1, b1, w2, b2):
        self.mean, self.scale, self.w1, self.b1, self.w2, self.b2 = mean, scale, w1, b1, w2, b2

    @classmethod
    def fit(cls, x: np.ndarray, target: np.ndarray) -> Router:
        rng = np.random.default_rng(7)
        mean, scale = x.mean(0), x.std() or 1.0
        z = (x - mean) / scale
        d, parts = z.shape[1], target.shape[1]
        params = [rng.normal(0, (2 / d) ** 0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, parts)), np.zeros(parts)]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for epoch in range(EPOCHS):
            rate = 3e-3 * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
            order = rng.permutation(len(z))
            for a in range(0, len(order), 128):
                rows = order[a : a + 128]
                hidden = np.maximum(z[rows] @ params[0] + params[1], 0)
                slope = (_softmax(hidden @ params[2] + params[3]) - target[rows]) / len(rows)
                back = (slope @ params[2].T) * (hidden > 0)
                grads = [z[rows].T @ back, back.sum(0), hidden.T @ slope, slope.sum(0)]
                step += 1
                for p, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return cls(mean, scale, *params)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2


class OnePart:
    """The router where there is only one part."""

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.zeros((len(x), 1))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _nearest(queries: np.ndarray, x: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
    """The k rows of x with the largest inner products; own is the row of x that is the query itself."""
    out = []
    for a in range(0, len(queries), 512):
        s = queries[a : a + 512] @ x.T
        if own is not None:
            s[np.arange(len(s)), own[a : a + 512]] = -np.inf
        out.append(np.argpartition(-s, min(k, s.shape[1] - 1) - 1, axis=1)[:, :k])
    return np.concatenate(out)


def parts_for(count: int) -> tuple[int, int]:
    """How many parts that many vectors are cut into, and each of these again."""
    first = max(1, min(FAN, count // LEAST_ROWS))
    return first, max(1, min(FAN, -(-count // (first * PART_ROWS)))) if first == FAN else 1


def fit_router(x: np.ndarray, parts: int) -> Router | OnePart:
    """The router to a sample's parts; as many parts as the sample has neighbourhoods for."""
    parts = min(parts, len(x) // 4)
    if parts < 2:
        return OnePart()
    near = _nearest(x, x, min(NEIGHBOURS, len(x) - 1), np.arange(len(x)))
    label = partition_graph(x, near, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), near.shape[1]), label[near].ravel()), 1.0 / near.shape[1])
    return Router.fit(x, target)


class Index:
    """Units are parts, or parts of parts: number part * fan + the part in it."""

    def __init__(self, root: Router | OnePart, below: dict[int, Router | OnePart], fan: int = 1):
        self.root, self.below, self.fan = root, below, fan

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The logarithm of each unit's probability; -inf for units that do not exist."""
        first = np.log(_softmax(self.root.logits(x)) + 1e-300)
        if self.fan == 1:
            return first
        out = np.full((len(x), first.shape[1], self.fan), -np.inf)
        for p in range(first.shape[1]):
            inner = self.below[p].logits(x) if p in self.below else np.zeros((len(x), 1))
            out[:, p, : inner.shape[1]] = first[:, p : p + 1] + np.log(_softmax(inner) + 1e-300)
        return out.reshape(len(x), -1)

    def place(self, x: np.ndarray) -> np.ndarray:
        """The unit that holds each vector: the most probable one of its most probable part."""
        part = self.root.logits(x).argmax(1)
        out = part * self.fan
        if self.fan > 1:
            for p in np.unique(part):
                if p in self.below:
                    out[part == p] += self.below[int(p)].logits(x[part == p]).argmax(1)
        return out

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """All units of each vector, most probable first."""
        return np.argsort(-self.scores(x), axis=1, kind="stable")


def _fit_below(fan: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(pdf["vec"]), "<f8").reshape(len(pdf), -1)
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "router": [pickle.dumps(fit_router(x, fan))]})

    return run


def fit_index(distinct: DataFrame, count: int) -> tuple[Index, np.ndarray]:
    """An index for the distinct vectors (vec), and vectors held out of its first level's sample."""
    first, fan = parts_for(count)
    rows = distinct.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE).toPandas()["vec"].tolist()
    sample = np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), -1)
    held = min(HELD_OUT, len(sample) // 8)
    index = Index(fit_router(sample[held:], first), {}, 1)
    if fan > 1:
        placed = distinct.select("vec").mapInArrow(_place(index), "vec binary, unit bigint").withColumnRenamed("unit", "part")
        order = Window.partitionBy("part").orderBy(F.xxhash64("vec"), "vec")
        few = placed.withColumn("at", F.row_number().over(order)).where(F.col("at") <= SAMPLE).select("part", "vec")
        fitted = few.groupBy("part").applyInPandas(_fit_below(fan), "part bigint, router binary").collect()  # FAN rows at most
        index = Index(index.root, {r["part"]: pickle.loads(bytes(r["router"])) for r in fitted}, fan)
    return index, sample[:held]


def fit_probes(placed: DataFrame, index: Index, held: np.ndarray, k: int, recall: float) -> int:
    """The least number of units in which held-out vectors find this share of their k true neighbours among all."""
    ranked = index.ranked(held)
    if not len(held):
        return ranked.shape[1] if ranked.size else 1

    own = {row.astype("<f8").tobytes(): q for q, row in enumerate(held)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, unit = np.full((len(held), k), -np.inf), np.full((len(held), k), -1, np.int64)
        for batch in batches:
            if len(batch):
                inner = held @ _bytes(batch.column(0)).T
                for i, vec in enumerate(batch.column(0).to_pylist()):
                    if vec in own:
                        inner[own[vec], i] = -np.inf
                scores = np.concatenate([best, inner], axis=1)
                units = np.concatenate([unit, np.broadcast_to(batch.column(1).to_numpy(), (len(held), len(batch)))], axis=1)
                top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
                best, unit = np.take_along_axis(scores, top, 1), np.take_along_axis(units, top, 1)
        some = np.isfinite(best.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(x.ravel()[some]) for x in (np.repeat(np.arange(len(held)), k), best, unit)], names=["q", "score", "unit"])

    order = Window.partitionBy("q").orderBy(F.desc("score"), "unit")
    near = placed.select("vec", "unit").mapInArrow(run, "q bigint, score double, unit bigint").withColumn("at", F.row_number().over(order))
    found = near.where(F.col("at") <= k).select("q", "unit").toPandas()  # HELD_OUT * k rows
    position = np.empty_like(ranked)
    np.put_along_axis(position, ranked, np.arange(ranked.shape[1])[None, :].repeat(len(held), 0), 1)
    visits = np.sort(position[found["q"].to_numpy(), found["unit"].to_numpy()]) if len(found) else np.zeros(1, np.int64)
    return int(visits[min(len(visits) - 1, int(np.ceil(recall * len(visits))) - 1)]) + 1


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)


def _merge_equal(keep: int):
    """Per batch, one row for each vector with its smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, list[int]] = {}
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.setdefault(v, []).append(i)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array([sorted(v)[:keep] for v in found.values()], pa.list_(pa.int64()))], names=["vec", "ids"])

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as little-endian doubles."""
    for batch in batches:
        data = [np.array(v, "<f8").tobytes() for v in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["vec_id", "vec"])


def _place(index: Index):
    """The unit of each vector, beside its columns; vec is the last one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                units = index.place(_bytes(batch.column(batch.num_columns - 1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(units, pa.int64())], names=[*batch.schema.names, "unit"])

    return run


def pack_bins(sizes: dict[int, int], block: int) -> dict[int, tuple[int, int]]:
    """For each unit its first bin and the number of its bins: small units share one, large ones have several."""
    out, at, room = {}, -1, 0
    for unit, n in sorted(sizes.items()):
        blocks = -(-n // block)
        if blocks > 1:
            out[unit], room = (at + 1, blocks), 0
            at += blocks
            continue
        if n > room:
            at, room = at + 1, block
        out[unit], room = (at, 1), room - n
    return out


_QUERY = pa.schema([("bin", pa.int64()), ("kind", pa.int32()), ("unit", pa.int64()), ("key", pa.int64()), ("vec", pa.binary()), ("ids", pa.list_(pa.int64()))])
_QUERY_SPARK = "bin bigint, kind int, unit bigint, key bigint, vec binary, ids array<bigint>"


def _route(index: Index, probes: int, bins: dict[int, tuple[int, int]]):
    """A row for each bin that a query has to visit; ids are the units there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), CHUNK):
                part = batch.slice(a, CHUNK)
                rows: dict[str, list] = {n: [] for n in _QUERY.names}
                for key, vec, units in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), index.ranked(_bytes(part.column(1))).tolist(), strict=True):
                    there: dict[int, list[int]] = {}
                    for unit in [u for u in units if u in bins][:probes]:
                        first, blocks = bins[unit]
                        for b in range(first, first + blocks):
                            there.setdefault(b, []).append(unit)
                    for b, held in there.items():
                        for name, v in zip(rows, (b, 1, -1, key, vec, held), strict=True):
                            rows[name].append(v)
                yield pa.RecordBatch.from_pydict(rows, schema=_QUERY)

    return run


def _compare(k: int):
    """The k nearest in a bin's visited units for each query; a bin's vectors (kind 0) come before its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, vectors, ids, units, matrix, spans = None, [], [], [], None, {}
        for batch in batches:
            bin_, kind, unit, key, vec, own = (batch.column(c) for c in range(6))
            keys = list(zip(bin_.to_pylist(), kind.to_pylist(), strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if keys[a][0] != at:
                    at, vectors, ids, units, matrix = keys[a][0], [], [], [], None
                if keys[a][1] == 0:
                    vectors += vec.slice(a, b - a).to_pylist()
                    ids += own.slice(a, b - a).to_pylist()
                    units += unit.slice(a, b - a).to_pylist()
                    continue
                if not vectors:
                    continue
                if matrix is None:
                    matrix = np.frombuffer(b"".join(vectors), "<f8").reshape(len(vectors), -1)
                    edges = [0, *(np.flatnonzero(np.diff(units)) + 1).tolist(), len(units)]  # units come sorted
                    spans = {units[s]: slice(s, e) for s, e in zip(edges, edges[1:], strict=False)}
                for c in range(a, b, CHUNK):
                    n = min(CHUNK, b - c)
                    yield _best(key.slice(c, n).to_pylist(), _bytes(vec.slice(c, n)), own.slice(c, n).to_pylist(), matrix, spans, ids, k)

    return run


def _best(queries: list[int], x: np.ndarray, visits: list[list[int]], matrix: np.ndarray, spans: dict[int, slice], ids: list[list[int]], k: int) -> pa.RecordBatch:
    scores = np.full((len(x), len(matrix)), -np.inf)
    askers: dict[int, list[int]] = {}
    for row, units in enumerate(visits):
        for unit in units:
            if unit in spans:
                askers.setdefault(unit, []).append(row)
    for unit, rows in askers.items():
        scores[rows, spans[unit]] = x[rows] @ matrix[spans[unit]].T
    # One more than k: a query's own vector may be among them with no other id. Ties at the edge all stay.
    least = max(0, len(ids) - k - 1)
    edge = np.partition(scores, least, axis=1)[:, least]
    out: tuple[list, list, list] = ([], [], [])
    for q, row, low, vector in zip(queries, scores, edge, x, strict=True):
        rows = np.flatnonzero((row >= low - 1e-9 * abs(low)) if np.isfinite(low) else np.isfinite(row))
        exact = (matrix[rows] * vector).sum(1)
        found = sorted((-s, i) for s, r in zip(exact.tolist(), rows.tolist(), strict=True) for i in ids[r] if i != q)[:k]
        out[0].extend([q] * len(found))
        out[1].extend(i for _, i in found)
        out[2].extend(-s for s, _ in found)
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])


def search(vectors: DataFrame, every: int = 20, k: int = 20, recall: float = TARGET_RECALL, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each vec_id divisible by every, its k nearest others by inner product.

    Scores are double-precision inner products of the vectors as they are; ties go to smaller ids; with fewer
    than k others all are listed. Vectors that are null, zero, or hold null or non-finite components take no
    part, nor do rows with a null vec_id or those of another length than the most frequent one (the shorter at
    a tie). A repeated vec_id counts once, with its least vector. Very long vectors need memory for a bin of block
    of them. Other columns are not read; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    real = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull()
    )
    fine = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))) & F.exists("v", lambda e: e != 0)
    real = real.where(F.coalesce(fine, F.lit(False))).groupBy("vec_id").agg(F.min("v").alias("v"))
    real = materialise(real, "vectors")
    length = real.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if length is None:
        return spark.createDataFrame([], schema)
    packed = real.where(F.size("v") == length["n"]).mapInArrow(_pack, "vec_id bigint, vec binary")
    each = packed.mapInArrow(_merge_equal(k + 1), "vec binary, ids array<bigint>")
    distinct = each.groupBy("vec").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
    distinct = materialise(distinct, "distinct")
    index, held = fit_index(distinct, distinct.count())
    placed = materialise(distinct.select("ids", "vec").mapInArrow(_place(index), "ids array<bigint>, vec binary, unit bigint"), "placed")
    probes = fit_probes(placed, index, held, k, recall)
    sizes = {r["unit"]: r["count"] for r in placed.groupBy("unit").count().collect()}  # FAN * FAN rows at most
    while probes < len(sizes) and sum(sorted(sizes.values())[:probes]) <= k:
        probes += 1
    bins = pack_bins(sizes, block)
    where = spark.createDataFrame([(u, f, n) for u, (f, n) in bins.items()], "unit bigint, first bigint, blocks bigint")
    spread = placed.join(F.broadcast(where), "unit").select(
        (F.col("first") + F.pmod(F.xxhash64("vec"), "blocks")).alias("bin"), F.lit(0).alias("kind"), "unit", F.lit(None).cast("bigint").alias("key"), "vec", "ids"
    )
    asked = packed.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "vec").mapInArrow(_route(index, probes, bins), _QUERY_SPARK)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = spread.unionByName(asked).repartition(tasks, "bin").sortWithinPartitions("bin", "kind", "unit")
    found = both.select(*_QUERY.names).mapInArrow(_compare(k), "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"))
