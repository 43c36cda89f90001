"""Exact top-k search by integer inner products with a pivot-distance index (operator 11).

Each vector is keyed by its nearest pivot and its distance to it, and each pivot's vectors are cut by distance into
rings of about equal size, so a ring is an annulus about its pivot. For a query, its distances to the pivots bound
what a ring can hold: no vector of the ring is nearer to the query than the difference between the query's distance
and the ring's, which bounds the inner product from above. Rings are taken in the order of their bounds, in rounds
that widen; a query stops when the next bound is below the k-th score that it has. Bounds of rings not taken are
never above those of rings taken, so what is found is exact, ties included.

Pivots are fitted on at most SAMPLE vectors; there are at most PIVOTS times RINGS rings whatever the size of the
table, and their bounds travel with the code. Vectors of a ring are compared in bins of a bounded number, each with
a bounded number of queries, so a ring that holds a third of all vectors has as many bins as it needs. Equal vectors
are one, with the smallest ids that any result can need.

Where vectors have no clusters, distances to pivots are nearly alike and bounds exclude little: then all is compared,
in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import discard, materialise, read
from cohortlens.llm.learned_index import pack_bins

SCALE = 1024.0
#: Pivots at most, vectors that they are fitted on, rings of a pivot at most, vectors of a ring at least.
PIVOTS, SAMPLE, RINGS, RING_ROWS = 128, 4096, 64, 64
#: Vectors of a bin, for a table's number of vectors: 4 times its root, within these; queries that meet in a bin.
BLOCKS, QUERY_BLOCK, CHUNK = (512, 16_384), 65_536, 128
#: The share of rings that the first round visits, and how many times as far the next one goes.
FIRST, GROWTH = 1 / 64, 16
#: Up to here sums of products of whole doubles are exact; and the limits of a long.
EXACT, LONG = 2.0**53, 2**63 - 1


def _scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """floor(1024 x) as little-endian doubles, which hold these whole numbers exactly; vectors that leave the doubles go."""
    for batch in batches:
        with np.errstate(over="ignore"):
            rows = [(i, np.floor(np.array(v, np.float64) * SCALE) + 0.0) for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        rows = [(i, x) for i, x in rows if np.isfinite(x).all()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([x.astype("<f8").tobytes() for _, x in rows], pa.binary())], names=["vec_id", "vec"])


def _matrix(vectors: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), "<f8").reshape(len(vectors), width)


def fit_pivots(sample: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Centres of the sample's vectors: the farthest from those before to begin with, then means of the nearest."""
    count = max(1, min(count, len(sample)))
    chosen, near = [0], np.full(len(sample), np.inf)
    for _ in range(count - 1):
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(1))
        chosen.append(int(near.argmax()))
    pivots = sample[chosen].copy()
    for _ in range(rounds):
        label = distances(sample, pivots).argmin(1)
        for p in np.unique(label):
            pivots[p] = sample[label == p].mean(0)
    return pivots


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The distance of each row of x to each pivot, from differences, as bounds rest on them."""
    return np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in pivots], axis=1)


def _keyed(pivots: np.ndarray):
    """The nearest pivot, the distance to it and the square of the length for each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0).to_pylist(), pivots.shape[1])
            far = distances(x, pivots)
            pivot = far.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot), pa.array(far[np.arange(len(x)), pivot]), pa.array((x * x).sum(1))], names=["vec", "ids", "pivot", "dist", "square"])

    return run


class Rings:
    """What bounds need of each ring: its pivot, least and greatest distance, and greatest squared length."""

    def __init__(self, pivots: np.ndarray, unit: list[int], pivot: list[int], low: list[float], high: list[float], square: list[float]):
        self.pivots, self.unit, self.pivot = pivots, np.array(unit, np.int64), np.array(pivot, np.int64)
        self.low, self.high, self.square = np.array(low), np.array(high), np.array(square)

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """No vector of the ring has a larger inner product with the row of x; a little is added for rounding.

        With g the gap between the query's distance and the ring's, q.v = (q.q + v.v - |q - v|^2) / 2 and |q - v| >= g.
        As v lies within the ring's outer distance of the pivot p, also q.v <= q.p + |q| high.
        """
        far = distances(x, self.pivots)[:, self.pivot]
        gap = np.maximum(0.0, np.maximum(far - self.high, self.low - far))
        own = (x * x).sum(1)[:, None]
        apart = (own + self.square - gap * gap) / 2
        within = (x @ self.pivots.T)[:, self.pivot] + np.sqrt(own) * self.high
        return np.minimum(apart, within) + 1e-9 * (own + self.square + far * far) + 1e-6


_ROWS = pa.schema([("bin", pa.int64()), ("part", pa.int64()), ("kind", pa.int32()), ("unit", pa.int64()), ("dist", pa.float64()), ("key", pa.int64()), ("vec", pa.binary()), ("ids", pa.list_(pa.int64()))])
_ROWS_SPARK = "bin bigint, part bigint, kind int, unit bigint, dist double, key bigint, vec binary, ids array<bigint>"


def _route(rings: Rings, bins: dict[int, tuple[int, int]], start: int, stop: int, parts: int):
    """A row for each bin that a query (key, vec, least: the score to reach) visits among its rings start to stop; ids are the rings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), CHUNK):
                some = batch.slice(a, CHUNK)
                bound = rings.bounds(_matrix(some.column(1).to_pylist(), rings.pivots.shape[1]))
                order = np.argsort(-bound, axis=1, kind="stable")[:, start:stop]
                rows: dict[str, list] = {n: [] for n in _ROWS.names}
                for i, (key, vec, least) in enumerate(zip(*(some.column(c).to_pylist() for c in range(3)), strict=True)):
                    wanted = order[i] if least is None else order[i][bound[i][order[i]] >= least]
                    there: dict[int, list[int]] = {}
                    for unit in rings.unit[wanted].tolist():
                        first, blocks = bins[unit]
                        for b in range(first, first + blocks):
                            there.setdefault(b, []).append(unit)
                    for b, units in there.items():
                        for name, v in zip(rows, (b, key % parts, 1, -1, 0.0, key, vec, units), strict=True):
                            rows[name].append(v)
                yield pa.RecordBatch.from_pydict(rows, schema=_ROWS)

    return run


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exactly; beyond a long they are held at its ends."""
    if not len(x) or not len(y) or math.sqrt(float((x * x).sum(1).max())) * math.sqrt(float((y * y).sum(1).max())) < EXACT:
        return x @ y.T
    out = np.array([[int(v) for v in row] for row in x], object).reshape(x.shape) @ np.array([[int(v) for v in row] for row in y], object).reshape(y.shape).T
    return np.clip(out, -LONG - 1, LONG)


def _compare(k: int, width: int):
    """The k best in a bin's visited rings for each query; a bin's vectors (kind 0) come before its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, vectors, ids, units, matrix, spans = None, [], [], [], None, {}
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if keys[a][:2] != at:
                    at, vectors, ids, units, matrix = keys[a][:2], [], [], [], None
                unit, vec, own = (batch.column(c).slice(a, b - a).to_pylist() for c in (3, 6, 7))
                if keys[a][2] == 0:
                    vectors, ids, units = vectors + vec, ids + own, units + unit
                    continue
                if matrix is None:
                    matrix = _matrix(vectors, width)
                    edges = [0, *(np.flatnonzero(np.diff(units)) + 1).tolist(), len(units)] if units else [0]
                    spans = {units[s]: slice(s, e) for s, e in zip(edges, edges[1:], strict=False)}  # units come sorted
                key = batch.column(5).slice(a, b - a).to_pylist()
                for c in range(0, b - a, CHUNK):
                    yield _best(key[c : c + CHUNK], _matrix(vec[c : c + CHUNK], width), own[c : c + CHUNK], matrix, spans, ids, k)

    return run


def _best(queries: list[int], x: np.ndarray, visits: list[list[int]], matrix: np.ndarray, spans: dict[int, slice], ids: list[list[int]], k: int) -> pa.RecordBatch:
    asked: dict[tuple, list[int]] = {}
    for row, units in enumerate(visits):
        asked.setdefault(tuple(u for u in sorted(units) if u in spans), []).append(row)  # queries that visit the same rings are one product
    out: tuple[list, list, list] = ([], [], [])
    for units, rows in asked.items():
        if not units:
            continue
        cut = units and [spans[u] for u in units]
        where = np.concatenate([np.arange(s.start, s.stop) for s in cut])
        scores = products(x[rows], matrix[where])
        # One more than k: a query's own vector may be among them with no other id. Ties at the edge all stay.
        least = max(0, len(where) - k - 1)
        for row, line in zip(rows, scores, strict=True):
            edge = np.partition(line, least)[least]
            near = np.flatnonzero(line >= edge)
            found = sorted((-int(line[r]), i) for r in near.tolist() for i in ids[where[r]] if i != queries[row])[:k]
            out[0].extend([queries[row]] * len(found))
            out[1].extend(i for _, i in found)
            out[2].extend(-s for s, _ in found)
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], names=["query_id", "vec_id", "score"])


def _best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: for each vec_id divisible by every, the k others of the largest inner products.

    vectors has vec_id and embedding; products are of floor(1024 x) of each component x as double, and exact; one
    beyond a long is held at its end. Ties go to smaller ids; with fewer than k others all are listed. Vectors that are
    null or hold null or non-finite components take no part, nor do those with a component beyond the doubles once
    scaled, rows with a null vec_id, or vectors of another length than the most frequent one (the shorter at a tie). A
    repeated vec_id counts once, with its least vector. Very long vectors need memory for a bin of them. Other columns
    are not read; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    real = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    real = real.where(F.forall("v", lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) != float("inf")), F.lit(False)))).groupBy("vec_id").agg(F.min("v").alias("v"))
    real = materialise(real, "vectors")
    length = real.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    if length is None:
        return empty
    width = length["n"]
    packed = materialise(real.where(F.size("v") == width).mapInArrow(_scaled, "vec_id bigint, vec binary"), "scaled")
    few = packed.withColumn("at", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))).where(F.col("at") <= k + 1)  # also before the exchange
    distinct = materialise(few.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "distinct")
    count = distinct.count()
    sample = [bytes(r["vec"]) for r in distinct.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE).collect()]
    if not sample:
        return empty
    pivots = fit_pivots(_matrix(sample, width), min(PIVOTS, max(1, math.isqrt(count) // 2)))

    keyed = materialise(distinct.mapInArrow(_keyed(pivots), "vec binary, ids array<bigint>, pivot bigint, dist double, square double"), "keyed")
    cuts = max(1, min(RINGS, count // (len(pivots) * RING_ROWS)))
    if cuts > 1:
        edges = keyed.groupBy("pivot").agg(F.percentile_approx("dist", [i / cuts for i in range(1, cuts)], 10_000).alias("edges"))  # PIVOTS rows at most
        ringed = keyed.join(F.broadcast(edges), "pivot").withColumn("ring", F.size(F.filter("edges", lambda e: e < F.col("dist"))))
    else:
        ringed = keyed.withColumn("ring", F.lit(0))
    ringed = ringed.withColumn("unit", F.col("pivot") * RINGS + F.col("ring"))
    seen = ringed.groupBy("unit", "pivot").agg(F.min("dist").alias("low"), F.max("dist").alias("high"), F.max("square").alias("square"), F.count("*").alias("n")).orderBy("unit").collect()  # PIVOTS * RINGS rows at most
    rings = Rings(pivots, *([r[c] for r in seen] for c in ("unit", "pivot", "low", "high", "square")))
    bins = pack_bins({r["unit"]: r["n"] for r in seen}, max(BLOCKS[0], min(BLOCKS[1], 4 * math.isqrt(count))))
    where = spark.createDataFrame([(u, f, n) for u, (f, n) in bins.items()], "unit bigint, first bigint, blocks bigint")
    placed = ringed.select("unit", "dist", "vec", "ids").join(F.broadcast(where), "unit").select((F.col("first") + F.pmod(F.xxhash64("vec"), "blocks")).alias("bin"), "unit", "dist", "vec", "ids")
    placed = materialise(placed, "placed")

    queries = packed.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("key"), "vec")
    parts, tasks = max(1, -(-queries.count() // QUERY_BLOCK)), int(spark.conf.get("spark.sql.shuffle.partitions"))
    best = None
    start, stop = 0, max(1, math.ceil(FIRST * len(seen)))
    while start < len(seen):
        if best is None:
            open_ = queries.withColumn("least", F.lit(None).cast("bigint"))
        else:
            reached = best.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k).select(F.col("query_id").alias("key"), "least")
            open_ = queries.join(reached, "key", "left")
        asked = materialise(open_.select("key", "vec", "least").mapInArrow(_route(rings, bins, start, stop, parts), _ROWS_SPARK), "asked")
        meet = asked.select("bin", "part").distinct()
        held = placed.join(meet, "bin").select("bin", "part", F.lit(0).alias("kind"), "unit", "dist", F.lit(None).cast("bigint").alias("key"), "vec", "ids")
        both = held.unionByName(asked).repartition(tasks, "bin", "part").sortWithinPartitions("bin", "part", "kind", "unit", "dist")
        found = both.select(*_ROWS.names).mapInArrow(_compare(k, width), "query_id bigint, vec_id bigint, score bigint")
        old = best
        best = materialise(_best_of(found if old is None else found.unionByName(old.select("query_id", "vec_id", "score")), k), "best")
        discard(asked, *([old] if old is not None else []))
        start, stop = stop, stop * GROWTH
    return best.select("query_id", "rank", "vec_id", "score")


def op11_pivot_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"))


SQL = """
with fine as (
  select vec_id, min(embedding::double[]) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0 group by vec_id),
width as (select len(v) as n from fine group by len(v) order by count(*) desc, len(v) limit 1),
x as (select vec_id, list_transform(v, lambda e: floor(1024 * e)) as v from fine, width where len(v) = width.n),
scored as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from x q join x c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
select query_id, rank::integer as rank, vec_id, score from ranked where rank <= 10
"""
