"""Cohort tables: baselines, balanced heads, unpivots, reconciliations and small-dimension joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.functions.scalar import is_finite

#: Frequency bands in Hz, half open; the harmonised vector has all but gamma.
BANDS = {"delta": (1.0, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 13.0), "beta": (13.0, 30.0), "gamma": (30.0, 45.0)}
#: Columns that are no features.
METADATA = ("participant_id", "label", "Group", "Gender", "Age", "MMSE", "n_epochs")


def baseline(df: DataFrame, label: str, numbers: dict[str, str], counts: dict[str, Column] | None = None) -> DataFrame:
    """group, n, <name>_mean and <name>_sd (n - 1; both rounded half to even at 2 places) and counts by label."""
    aggs = [F.count("*").alias("n")]
    for name, column in numbers.items():
        value = F.col(column).cast("double")
        aggs += [F.bround(F.avg(value), 2).alias(f"{name}_mean"), F.bround(F.stddev_samp(value), 2).alias(f"{name}_sd")]
    aggs += [F.sum(F.coalesce(when.cast("long"), F.lit(0))).alias(name) for name, when in (counts or {}).items()]
    return df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("group")).agg(*aggs)


def stratified_head(df: DataFrame, n: int, label: str, order: list[str], top_up: bool = True) -> DataFrame:
    """At most n rows, as evenly over labels as there are rows: n // labels of each (1 at least), then the first
    of the rest in order. order has to be a total order, e.g. ending in an id.

    The number of labels comes from their own small aggregation; a row's place within its label from a window
    that Spark limits while it sorts.
    """
    if n <= 0:
        return df.limit(0)
    labels = df.select(label).distinct().agg(F.count("*").alias("_k"))
    quota = F.greatest(F.lit(1), F.floor(F.lit(n) / F.col("_k")))
    place = F.row_number().over(Window.partitionBy(label).orderBy(*order))
    ranked = df.withColumn("_place", place).where(F.col("_place") <= n).crossJoin(F.broadcast(labels)).withColumn("_first", F.col("_place") <= quota)
    picked = ranked if top_up else ranked.where("_first")
    # Rows of the quota come before those that top up, each in order; the order of the result is the table's.
    chosen = picked.orderBy(F.col("_first").desc(), *order).limit(n)
    return chosen.drop("_place", "_k", "_first")


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = METADATA) -> list[str]:
    """Names of numeric columns that are not excluded; an error if there are none."""
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double")
    out = [c for c, kind in df.dtypes if (kind in kinds or kind.startswith("decimal")) and c not in exclude]
    if not out:
        raise ValueError("no numeric feature columns")
    return out


def to_long(df: DataFrame, ids: list[str], features: list[str] | None = None) -> DataFrame:
    """ids, feature, value: one row for each feature column."""
    features = features or numeric_columns(df, (*METADATA, *ids))
    return df.select(*ids, *(F.col(f).cast("double").alias(f) for f in features)).unpivot(ids, features, "feature", "value")


def to_wide(long: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    """The reverse of to_long for listed features."""
    return long.groupBy(*ids).pivot("feature", features).agg(F.first("value", ignorenulls=True))


def paired_delta(left: DataFrame, right: DataFrame, keys: list[str], metrics: list[str], suffixes: tuple[str, str] = ("left", "right")) -> DataFrame:
    """Inner join on keys with each metric of both sides and its difference (right - left)."""
    a = left.select(*keys, *(F.col(m).alias(f"{m}_{suffixes[0]}") for m in metrics))
    b = right.select(*keys, *(F.col(m).alias(f"{m}_{suffixes[1]}") for m in metrics))
    return a.join(b, keys).withColumns({f"{m}_delta": F.col(f"{m}_{suffixes[1]}") - F.col(f"{m}_{suffixes[0]}") for m in metrics})


def only_listed(df: DataFrame, listed: DataFrame, key: str, expect: int | None = None) -> DataFrame:
    """Rows of df whose key is listed; an error if expect is given and they are not as many."""
    out = df.join(listed.select(key), key, "left_semi")
    if expect is not None and (n := out.count()) != expect:
        raise ValueError(f"{n} listed rows instead of {expect}")
    return out


def not_listed(df: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    return df.join(listed.select(key), key, "left_anti")


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, n_left, n_right and status (both, missing_left, missing_right, duplicated) of all keys of two tables.

    Duplicates are reported even where the sets of keys agree.
    """
    a = left.groupBy(key).agg(F.count("*").alias("n_left"))
    b = right.groupBy(key).agg(F.count("*").alias("n_right"))
    both = a.join(b, key, "full_outer").select(key, F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"))
    status = F.when(F.col("n_left") == 0, "missing_left").when(F.col("n_right") == 0, "missing_right").when(F.greatest("n_left", "n_right") > 1, "duplicated").otherwise("both")
    return both.withColumn("status", status)


def paired_ids(left: DataFrame, right: DataFrame, key: str, label: str, strict: bool = False) -> DataFrame:
    """Keys in both tables with the label of either side and whether they agree; strict: an error where they do not."""
    a, b = left.select(key, F.col(label).alias("label_left")), right.select(key, F.col(label).alias("label_right"))
    out = a.join(b, key).withColumn("agrees", F.col("label_left").eqNullSafe(F.col("label_right")))
    if strict and (bad := out.where(~F.col("agrees")).limit(20).collect()):
        raise ValueError(f"labels disagree for {[r[key] for r in bad]}")
    return out


#: Rows of a configured dimension at most: what is sent to every task is checked against it.
MOST_DIMENSION = 10_000


def dimension(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A frame of configured rows, marked to be sent to every task; an error beyond MOST_DIMENSION rows."""
    if len(rows) > MOST_DIMENSION:
        raise ValueError(f"a dimension of more than {MOST_DIMENSION} rows")
    return F.broadcast(spark.createDataFrame(rows, schema))


def bounded(frame: DataFrame, most: int = MOST_DIMENSION) -> DataFrame:
    """A frame marked to be sent to every task; a job that meets more than most rows of it fails.

    The check is an aggregate joined as one row, so that no row is read on the driver.
    """
    size = frame.agg(F.count("*").alias("_n")).select(F.when(F.col("_n") > most, F.raise_error(F.lit(f"a dimension of more than {most} rows"))).otherwise(F.lit(True)).alias("_fits"))
    return F.broadcast(frame.crossJoin(F.broadcast(size)).where("_fits").drop("_fits"))


def bands_table(spark: SparkSession, bands: dict[str, tuple[float, float]] = BANDS) -> DataFrame:
    return dimension(spark, [(b, float(lo), float(hi)) for b, (lo, hi) in bands.items()], "band string, low double, high double")


def in_band(points: DataFrame, bands: DataFrame, frequency: str = "frequency") -> DataFrame:
    """Range join of points with half-open bands, a configured dimension (bands_table)."""
    return points.join(F.broadcast(bands), (F.col(frequency) >= F.col("low")) & (F.col(frequency) < F.col("high")))


def overlapping(df: DataFrame, spans: DataFrame, keys: list[str], width: float, start: str = "start", stop: str = "stop") -> DataFrame:
    """Rows of df whose interval (start, stop) overlaps one of the spans with the same keys; ends that touch do not.

    Both sides are dealt to buckets of width, a long span to every bucket that it meets, so that rows meet by equal
    keys and bucket and neither side is sent to every task. Rows with a null or with stop before start meet nothing; an
    interval without length meets the spans that it lies inside of. Equal rows are one.
    """
    within = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width).cast("long"), F.floor(F.col(b) / width).cast("long")))
    rows = df.where(F.col(start) <= F.col(stop)).withColumn("_bucket", within(start, stop))
    pieces = spans.where(F.col(start) <= F.col(stop)).select(*keys, F.col(start).alias("_a"), F.col(stop).alias("_b")).distinct().withColumn("_bucket", within("_a", "_b"))
    same = [rows[k] == pieces[k] for k in [*keys, "_bucket"]]
    met = rows.join(pieces, [*same, rows[start] < pieces["_b"], rows[stop] > pieces["_a"]], "left_semi")
    return met.drop("_bucket").distinct()


def membership(df: DataFrame, groups: dict[str, list], key: str, name: str = "region") -> DataFrame:
    """Many-to-many join of key with the groups that list it."""
    kind = df.schema[key].dataType.simpleString()
    return df.join(dimension(df.sparkSession, [(g, m) for g, members in groups.items() for m in members], f"{name} string, {key} {kind}"), key)


def upper_pairs(df: DataFrame, by: list[str], item: str, value: str) -> DataFrame:
    """by, source, target and their values for source < target within by.

    Meant for groups of a bounded size, such as the channels of a recording.
    """
    a = df.select(*by, F.col(item).alias("source"), F.col(value).alias("value_source"))
    b = df.select(*by, F.col(item).alias("target"), F.col(value).alias("value_target"))
    return a.join(b, by).where("source < target")


def grid(**axes: DataFrame) -> DataFrame:
    """Cross product of small configured frames, such as models, folds and parameters; each has MOST_DIMENSION rows at most."""
    frames = list(axes.values())
    out = frames[0]
    for frame in frames[1:]:
        out = out.crossJoin(bounded(frame))
    return out


def best_of_group(df: DataFrame, by: list[str], score: str, name: str) -> DataFrame:
    """by, the name with the highest score (the first name at a tie) and that score."""
    top = F.max_by(F.col(name), F.struct(score, F.col("_rank")))
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(name).desc())))
    return ranked.groupBy(*by).agg(top.alias(name), F.max(score).alias(score))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """rows, distinct keys, and rows beyond the first of their key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.sum("n").alias("rows"), F.count("*").alias("distinct_keys"), F.sum(F.col("n") - 1).alias("duplicates"))


def overlap_of_tops(left: DataFrame, right: DataFrame, key: str, score: str, k: int = 20) -> DataFrame:
    """How many keys both tables have among their k smallest scores."""
    a, b = (t.orderBy(score, key).limit(k).select(key) for t in (left, right))
    return a.join(b, key).agg(F.count("*").alias("overlap"))


def padded_limits(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, low, high of finite values; widened where all are equal; 0 and 1 without any."""
    x = F.when(is_finite(F.col(value).cast("double")), F.col(value).cast("double"))
    lim = df.groupBy(*by).agg(F.min(x).alias("low"), F.max(x).alias("high"))
    pad = F.when(F.col("low") == F.col("high"), F.greatest(F.abs("low") * 1e-3, F.lit(1e-6))).otherwise(0.0)
    return lim.select(*by, F.coalesce(F.col("low") - pad, F.lit(0.0)).alias("low"), F.coalesce(F.col("high") + pad, F.lit(1.0)).alias("high"))


def common_columns(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both frames reduced to the columns that both have, in the left one's order; an error if there are none."""
    names = [c for c in left.columns if c in set(right.columns)]
    if not names:
        raise ValueError("no common columns")
    return left.select(*names), right.select(*names)


def ordered_distinct(df: DataFrame, key: str, order: str) -> DataFrame:
    """key and the least order it stands at (first): sorted by it, the distinct keys in the order they appear."""
    return df.groupBy(key).agg(F.min(order).alias("first"))


def project(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns in that order; an error that names those that are missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*names)


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without a null, NaN or infinite value in the columns."""
    kinds = dict(df.dtypes)
    keep = [is_finite(F.col(c).cast("double")) if kinds[c] in ("double", "float") else F.col(c).isNotNull() for c in columns]
    return df.where(F.coalesce(F.forall(F.array(*keep), lambda k: k), F.lit(False))) if keep else df


def split_by_count(df: DataFrame, column: str, least: int) -> tuple[DataFrame, DataFrame]:
    """Rows with at least that count, and the others; a null count is among the others."""
    enough = F.coalesce(F.col(column) >= least, F.lit(False))
    return df.where(enough), df.where(~enough)


def place_in(column: Column, listed: list) -> Column:
    """The place of a value in a list, to sort by; values that are not listed come after all others."""
    at = F.array_position(F.array(*map(F.lit, listed)), column)
    return F.when(at > 0, at).otherwise(len(listed) + 1).cast("int")


def pick(df: DataFrame, column: str, include: list[str] | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose value is in include (any, if that is None) and not in exclude; a null value is in neither."""
    keep = F.col(column).isNotNull() if include is None else F.col(column).isin(*include)
    return df.where(keep & ~F.col(column).isin(*exclude))


def allowed_labels(df: DataFrame, label: str, allowed: list[str]) -> DataFrame:
    """df; an error that names labels which are not allowed (at most 20)."""
    other = [r[label] for r in df.select(label).distinct().where(F.col(label).isNull() | ~F.col(label).isin(*allowed)).limit(20).collect()]
    if other:
        raise ValueError(f"labels that are not allowed: {other}")
    return df
