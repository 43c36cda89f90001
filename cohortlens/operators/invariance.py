"""Whether a revision left results as they were: comparisons of artifacts, each a row of one verdict table.

A row names an artifact, the method it is compared by, the status and what differs. Methods: rows (exactly, repeats
counted, without the columns that may change), close (by keys, numbers within a tolerance), partition (clusters by
their members, whatever they are called), json (leaf by leaf, whatever the order and layout), bytes (manifests).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.scalar import is_finite

VERDICT = ("artifact", "method", "status", "detail")


def _row(counts: DataFrame, artifact: str, method: str, good: Column, *detail) -> DataFrame:
    text = F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in detail))
    return counts.select(F.lit(artifact).alias("artifact"), F.lit(method).alias("method"), F.when(good, "PASS").otherwise("FAIL").alias("status"), text.alias("detail"))


def _many(c: Column) -> Column:
    return F.coalesce(F.sum(c.cast("long")), F.lit(0))


def compare_rows(artifact: str, a: DataFrame, b: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """Rows of either side that the other one has fewer times; columns in drop do not matter, nor does their order.

    Rows are compared by their counts, so each side is grouped once and a row that is frequent is no task's burden.
    """
    columns = [c for c in a.columns if c not in drop]
    if sorted(columns) != sorted(c for c in b.columns if c not in drop):
        return a.sparkSession.createDataFrame([(artifact, "rows", "FAIL", "other columns")], ", ".join(f"{c} string" for c in VERDICT))
    both = a.select(*columns, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(b.select(*columns, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    counts = both.groupBy(*columns).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    sums = counts.agg(_many(F.greatest(F.col("_l") - F.col("_r"), F.lit(0))).alias("l"), _many(F.greatest(F.col("_r") - F.col("_l"), F.lit(0))).alias("r"), _many(F.col("_l")).alias("n"))
    return _row(sums, artifact, "rows", (F.col("l") == 0) & (F.col("r") == 0), "rows=", F.col("n"), ", only left=", F.col("l"), ", only right=", F.col("r"))


def compare_close(artifact: str, a: DataFrame, b: DataFrame, keys: list[str], numbers: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Numbers by keys: |a - b| <= tolerance * max(1, |a|, |b|). Two nulls are equal, and so are two NaNs and equal infinities."""
    side = lambda df, s: df.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.lit(True).alias(f"_{s}"), *(F.col(n).cast("double").alias(f"_{s}{i}") for i, n in enumerate(numbers)))
    left, right = side(a, "a"), side(b, "b")
    both = left.join(right, reduce(lambda x, y: x & y, (left[f"_k{i}"].eqNullSafe(right[f"_k{i}"]) for i in range(len(keys)))), "full_outer")
    met = F.col("_a").isNotNull() & F.col("_b").isNotNull()

    def off(i: int) -> Column:
        x, y = F.col(f"_a{i}"), F.col(f"_b{i}")
        near = is_finite(x) & is_finite(y) & (F.abs(x - y) <= F.lit(tolerance) * F.greatest(F.lit(1.0), F.abs(x), F.abs(y)))
        return met & ~(x.eqNullSafe(y) | F.coalesce(near, F.lit(False)))

    sums = both.agg(_many(met).alias("n"), _many(~met).alias("alone"), *(_many(off(i)).alias(f"o{i}") for i in range(len(numbers))))
    total = reduce(lambda x, y: x + y, (F.col(f"o{i}") for i in range(len(numbers))), F.lit(0))
    return _row(sums, artifact, "close", (F.col("alone") == 0) & (total == 0), "keys=", F.col("n"), ", unmatched=", F.col("alone"), *(p for i, n in enumerate(numbers) for p in (f", {n}=", F.col(f"o{i}"))))


def compare_partition(artifact: str, a: DataFrame, b: DataFrame, member: str, cluster: str) -> DataFrame:
    """Clusters by their members. Members whose cluster has another least member on the other side have moved.

    A cluster is named by its least member. Members meet once; what follows is done on pairs of clusters that share
    members, counted, so no cluster is gathered or sent to its members. A null cluster is one of its own for each member.
    """

    def named(df: DataFrame, s: str) -> DataFrame:
        rows = df.select(F.col(member).cast("string").alias("_m"), F.col(cluster).cast("string").alias(f"_c_{s}"))
        return rows.repartition("_m").distinct().withColumn(f"_in_{s}", F.lit(True))  # dealt as the join below wants them

    def least(rows: DataFrame, s: str) -> DataFrame:
        return rows.where(f"_c_{s} is not null").groupBy(f"_c_{s}").agg(F.min("_m").alias(f"_least_{s}"), F.count("*").alias(f"_size_{s}"))

    left, right = named(a, "a"), named(b, "b")
    own = [F.when(F.col(f"_in_{s}") & F.col(f"_c_{s}").isNull(), F.col("_m")).alias(f"_own_{s}") for s in "ab"]
    cells = left.join(right, "_m", "full_outer").groupBy("_in_a", "_in_b", "_c_a", "_c_b", *own).agg(F.count("*").alias("_k"))
    both = cells.join(least(left, "a"), "_c_a", "left").join(least(right, "b"), "_c_b", "left")
    both = both.withColumns({f"_{s}": F.coalesce(f"_least_{s}", f"_own_{s}") for s in "ab"} | {f"_size_{s}": F.coalesce(f"_size_{s}", F.lit(1)) for s in "ab"})
    met = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    same = (F.col("_a") == F.col("_b")) & (F.col("_size_a") == F.col("_size_b"))
    many = lambda c: F.coalesce(F.sum(F.when(c, F.col("_k"))), F.lit(0))
    sums = both.agg(many(met).alias("n"), many(~met).alias("alone"), many(met & ~F.coalesce(same, F.lit(False))).alias("moved"), F.countDistinct("_a").alias("ca"), F.countDistinct("_b").alias("cb"))
    return _row(sums, artifact, "partition", (F.col("alone") == 0) & (F.col("moved") == 0), "members=", F.col("n"), ", unmatched=", F.col("alone"), ", moved=", F.col("moved"), ", clusters=", F.col("ca"), "/", F.col("cb"))


def _leaves(value, path: str, ignore: tuple[str, ...]) -> Iterator[tuple[str, str]]:
    todo = [(value, path)]
    while todo:
        at, where = todo.pop()
        if isinstance(at, dict) and at:
            todo += [(v, f"{where}.{json.dumps(k)}") for k, v in at.items() if where or k not in ignore]
        elif isinstance(at, list) and at:
            todo += [(v, f"{where}[{i}]") for i, v in enumerate(at)]
        else:
            yield where or "$", json.dumps(at, sort_keys=True)


def _leaves_of(text: str | None, ignore: tuple[str, ...]) -> list[tuple[str, str]]:
    if text is None:
        return [("error", "null")]
    try:
        return list(_leaves(json.loads(text), "", ignore))
    except ValueError:
        return [("error", json.dumps(text))]


def json_leaves(df: DataFrame, key: str, column: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """key, path, value: the leaves of JSON texts; names in ignore are left out at the top.

    A path has names and positions; a value is JSON, numbers as doubles where they have a fraction or an exponent. An
    empty object or list is a leaf; a text that is no JSON is one with the path of an error, as is a null.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, list, list] = ([], [], [])
            for i, text in enumerate(batch.column(1).to_pylist()):
                for path, value in _leaves_of(text, ignore):
                    for out, v in zip(rows, (i, path, value), strict=True):
                        out.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())], names=[key, "path", "value"])

    return df.select(key, F.col(column).cast("string")).mapInArrow(run, f"`{key}` {kind}, path string, value string")


def _text_differences(pairs: DataFrame, key: str, ignore: tuple[str, ...]) -> DataFrame:
    """key, path, left, right of pairs of texts (_l, _r, and whether a side has one: _in_l, _in_r)."""
    kind = pairs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = json.JSONEncoder(sort_keys=True).encode

        def plain(text: str) -> str:
            value = json.loads(text)
            if ignore and isinstance(value, dict) and value:
                value = {k: v for k, v in value.items() if k not in ignore}
                if not value:
                    return ""  # no leaf, where an empty object is one
            return encode(value)

        def equal(x: str | None, y: str | None) -> bool:
            try:
                return x is not None and y is not None and plain(x) == plain(y)
            except (ValueError, RecursionError):
                return False

        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [])
            for i, (x, y, in_x, in_y) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(1, 5)), strict=True)):
                if in_x and in_y and equal(x, y):
                    continue
                left, right = dict(_leaves_of(x, ignore)) if in_x else {}, dict(_leaves_of(y, ignore)) if in_y else {}
                for path in left | right:
                    if left.get(path) != right.get(path):
                        for out, v in zip(rows, (i, path, left.get(path), right.get(path)), strict=True):
                            out.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[0], pa.int64())), *(pa.array(r, pa.string()) for r in rows[1:])], names=[key, "path", "left", "right"])

    return pairs.select(key, "_l", "_r", "_in_l", "_in_r").mapInArrow(run, f"`{key}` {kind}, path string, left string, right string")


def json_differences(a: DataFrame, b: DataFrame, key: str, column: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """key, path, left, right of leaves that only one side has or that have other values.

    Texts of a key meet as a whole, and only those that differ are taken apart. Where a key is repeated on a side, the
    leaves of all its texts meet, path by path.
    """
    keys = lambda df: df.select(key).where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key)
    repeated = keys(a).union(keys(b)).distinct()
    some = not repeated.isEmpty()
    side = lambda df, s: (df.join(repeated, key, "left_anti") if some else df).select(key, F.col(column).cast("string").alias(f"_{s}"), F.lit(True).alias(f"_in_{s}"))
    pairs = side(a, "l").join(side(b, "r"), key, "full_outer")
    out = _text_differences(pairs.where(F.col("_in_l").isNull() | F.col("_in_r").isNull() | ~F.col("_l").eqNullSafe(F.col("_r"))), key, ignore)
    if not some:
        return out
    left, right = (json_leaves(df.join(repeated, key, "left_semi"), key, column, ignore).withColumnRenamed("value", s) for df, s in ((a, "left"), (b, "right")))
    return out.unionByName(left.join(right, [key, "path"], "full_outer").where(~F.col("left").eqNullSafe(F.col("right"))))


def compare_json(artifact: str, a: DataFrame, b: DataFrame, key: str, column: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    out = json_differences(a, b, key, column, ignore)
    lone = lambda c: _many(F.col(c).isNull())
    sums = out.agg(F.countDistinct(key).alias("n"), lone("right").alias("l"), lone("left").alias("r"), _many(F.col("left").isNotNull() & F.col("right").isNotNull()).alias("x"))
    return _row(sums, artifact, "json", F.col("n") == 0, "texts=", F.col("n"), ", only left=", F.col("l"), ", only right=", F.col("r"), ", other values=", F.col("x"))


def compare_bytes(a: DataFrame, b: DataFrame) -> DataFrame:
    """A row for each path of two manifests (path, size_bytes, sha256)."""
    left, right = a.select(F.col("path"), F.upper("sha256").alias("_l")), b.select(F.col("path"), F.upper("sha256").alias("_r"))
    both = left.join(right, "path", "full_outer")
    said = F.concat(F.lit("left="), F.coalesce("_l", F.lit("missing")), F.lit(" right="), F.coalesce("_r", F.lit("missing")))
    return both.select(F.col("path").alias("artifact"), F.lit("bytes").alias("method"), F.when(F.coalesce(F.col("_l") == F.col("_r"), F.lit(False)), "PASS").otherwise("FAIL").alias("status"), said.alias("detail"))


def report(items: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, items)


def verdict(rows: DataFrame) -> DataFrame:
    """status, n_pass, n_fail of a report."""
    n = lambda s: _many(F.col("status") == s)
    return rows.agg(n("PASS").alias("n_pass"), n("FAIL").alias("n_fail")).select(F.when(F.col("n_fail") == 0, "PASS").otherwise("FAIL").alias("status"), "n_pass", "n_fail")
