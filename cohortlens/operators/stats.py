"""Rank tests, effect sizes, false-discovery control and robust regression on long tables.

A long table has one row for each unit and feature: label, feature, value. Null and NaN values take no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.scalar import nan_to_null
from cohortlens.functions.special import chi2_sf, mannwhitney_p, t_sf2
from cohortlens.storage import written


def present(long: DataFrame, value: str = "value") -> DataFrame:
    """Rows with a value that is neither null nor NaN."""
    return long.withColumn(value, nan_to_null(F.col(value).cast("double"))).where(F.col(value).isNotNull())


#: Distinct values of a feature that a slice is to hold, and slices at most.
SLICE_ROWS, MOST_SLICES = 20_000, 256


def slice_cuts(counts: DataFrame, by: list[str], value: str = "value", of: tuple[str, ...] = ("ties",), slices: int | None = None) -> DataFrame:
    """by and _cuts, sorted values that cut a feature into slices: one value in SLICE_ROWS, thinned out evenly to
    MOST_SLICES slices, or as many slices as given; features without cuts are left out.

    A value's hash decides, so each computation gives the same cuts, whether values are counted already (in columns of)
    or not (of is empty). They are few enough to be sent to every task.
    """
    chance = F.xxhash64(*by, value)
    none = F.least(F.lit(0), F.lit(0), *of)  # no count is below 0; as it reads what is counted, the filter stays above the shuffle, which may so serve all uses of counts
    if slices is None:
        picked = counts.where((F.pmod(chance, F.lit(SLICE_ROWS)) == none) & F.col(value).isNotNull())
    else:
        picked = counts.where(F.col(value).isNotNull()).withColumn("_h", F.row_number().over(Window.partitionBy(*by).orderBy(chance, value))).where(F.col("_h") < slices)
    most = MOST_SLICES if slices is None else slices
    cuts = picked.groupBy(*by).agg(F.sort_array(F.collect_set(value)).alias("_cuts"))
    even = F.transform(F.sequence(F.lit(1), F.lit(max(1, most - 1))), lambda k: F.get("_cuts", F.floor(k * F.size("_cuts") / F.lit(most)).cast("int")))
    return cuts.withColumn("_cuts", F.when(F.size("_cuts") >= most, even).otherwise(F.col("_cuts")))


def in_slices(rows: DataFrame, cuts: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """rows with _slice, the number of cuts below the value, by halving."""
    steps = cuts.withColumn("_steps", F.expr("transform(sequence(length(bin(size(_cuts))) - 1, 0, -1), _k -> shiftleft(1, _k))"))
    met = rows.join(F.broadcast(steps), by, "left") if by else rows.crossJoin(F.broadcast(steps))  # one row
    below = F.expr(f"aggregate(_steps, 0, (_p, _s) -> if(_p + _s <= size(_cuts) and get(_cuts, _p + _s - 1) < `{value}`, _p + _s, _p))")
    return met.withColumn("_slice", F.coalesce(below, F.lit(0))).drop("_cuts", "_steps")


def cumulated(counts: DataFrame, by: list[str], value: str = "value", of: tuple[str, ...] = ("ties",), slices: int | None = None) -> DataFrame:
    """Adds before_<c> (the sum over smaller values) and total_<c> (that over all values) within by, for columns of.

    counts has one row for each by and value. Each feature's values are ordered in slices side by side, and no task
    holds a whole feature: as many slices as its number of values asks for, or as given. The cuts affect the work
    only: sums are exact.
    """
    return placed(in_slices(counts, slice_cuts(counts, by, value, of, slices), by, value), by, value, of)


def sliced(counts: DataFrame, by: list[str], value: str = "value", slices: int | None = None) -> DataFrame:
    """counts (one row for each by and value) with _slice, the number of its range in the order of by and value.

    Ranges are of about equal length, so no task holds a whole feature. They are written to the shared folder: what counts
    is made from is read once, and all that follows sees the same cuts, which a second sampling need not give.
    """
    order = [*by, value]
    ranges = counts.repartitionByRange(*order) if slices is None else counts.repartitionByRange(slices, *order)
    return written(ranges.withColumn("_slice", F.spark_partition_id()), "slices")


def placed(held: DataFrame, by: list[str], value: str = "value", of: tuple[str, ...] = ("ties",)) -> DataFrame:
    """What cumulated() adds, for counts that are in slices, by sliced() or in_slices()."""
    sums = held.groupBy(*by, "_slice").agg(*(F.sum(c).alias(f"_n_{c}") for c in of))
    every = Window.partitionBy(*by)
    offset = every.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    columns = [c for name in of for c in (F.coalesce(F.sum(f"_n_{name}").over(offset), F.lit(0)).alias(f"_b_{name}"), F.sum(f"_n_{name}").over(every).alias(f"total_{name}"))]
    sums = sums.select(*by, "_slice", *columns)
    inside = Window.partitionBy(*by, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rows = held.join(sums, [*by, "_slice"])
    return rows.withColumns({f"before_{c}": F.col(f"_b_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in of}).drop("_slice", *(f"_b_{c}" for c in of))


#: The average rank of a value, and the distance of two distribution functions at it, from cumulated counts.
RANK = "before_ties + (ties + 1) / 2D"
GAP = "abs((before_a + a) / nullif(total_a, 0) - (before_b + b) / nullif(total_b, 0))"


def average_ranks(long: DataFrame, by: list[str], value: str = "value", slices: int | None = None) -> DataFrame:
    """Adds rank (average rank of value within by), ties (rows with this value) and total (rows of by)."""
    ranked = cumulated(long.groupBy(*by, value).agg(F.count("*").alias("ties")), by, value, slices=slices)
    return long.join(ranked.select(*by, value, F.expr(RANK).alias("rank"), "ties", F.col("total_ties").alias("total")), [*by, value])


def quantile_of(c: str, probs: dict[str, float], value: str = "value") -> tuple[list[Column], list[Column]]:
    """Aggregates over cumulated rows, and the columns to select from them, for exact quantiles with linear
    interpolation of the rows that column c counts."""
    aggs, columns = [F.first(f"total_{c}").alias(f"_t_{c}")], []
    for name, p in probs.items():
        h = (F.col(f"total_{c}") - 1) * F.lit(p)
        for end, k in (("l", F.floor(h)), ("h", F.ceil(h))):
            aggs.append(F.max(F.when((F.col(f"before_{c}") <= k) & (k < F.col(f"before_{c}") + F.col(c)), F.col(value))).alias(f"_{end}_{name}"))
        share = (F.col(f"_t_{c}") - 1) * F.lit(p)
        columns.append((F.col(f"_l_{name}") + (F.col(f"_h_{name}") - F.col(f"_l_{name}")) * (share - F.floor(share))).alias(name))
    return aggs, columns


def quantiles(long: DataFrame, by: list[str], probs: dict[str, float], value: str = "value", slices: int | None = None) -> DataFrame:
    """by and one column for each named probability: exact quantiles with linear interpolation."""
    ranked = cumulated(long.groupBy(*by, value).agg(F.count("*").alias("ties")), by, value, slices=slices)
    aggs, columns = quantile_of("ties", probs, value)
    return ranked.groupBy(*by).agg(*aggs).select(*by, *columns)


def benjamini_hochberg(table: DataFrame, p: str = "p_value", by: list[str] | None = None) -> DataFrame:
    """Adds q_value: the least p * m / rank over this and larger p, at most 1, within by."""
    by = by or []
    group = Window.partitionBy(*by)
    ascending = group.orderBy(p)
    scaled = table.withColumn("_q", F.col(p) * F.count(p).over(group) / F.row_number().over(ascending))
    out = scaled.withColumn("q_value", F.least(F.lit(1.0), F.min("_q").over(group.orderBy(F.col(p).desc(), F.col("_q")).rowsBetween(Window.unboundedPreceding, 0))))
    return out.drop("_q")


def kruskal_wallis(long: DataFrame, label: str = "label", by: str = "feature", value: str = "value", tail=chi2_sf, fdr: bool = True) -> DataFrame:
    """feature, groups, n, statistic, p_value and q_value of the Kruskal-Wallis test over label groups.

    Groups with fewer than two values are left out, then features with fewer than two groups. All-equal values
    have a null statistic.
    """
    rows = present(long, value).where(F.col(label).isNotNull() & F.col(by).isNotNull())
    counts = rows.groupBy(by, value, label).agg(F.count("*").alias("_k"))
    lone = rows.groupBy(by, label).agg(F.count("*").alias("_n"), F.min(value).alias(value)).where("_n = 1")
    kept = counts.join(lone, [by, value, label], "left_anti")  # as counts are dealt: no feature or label meets in one task
    held = in_slices(kept, slice_cuts(rows, [by], value, ()), [by], value)
    inside = Window.partitionBy(by, "_slice").orderBy(value)
    ranked = held.withColumns({"_upto": F.sum("_k").over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)), "ties": F.sum("_k").over(inside.rangeBetween(Window.currentRow, Window.currentRow))})
    k, ties = F.col("_k"), F.col("ties")
    rank = F.col("_upto") - ties + (ties + 1) / 2
    # Ranks within slices; what lies before a slice is added to its sums.
    parts = ranked.groupBy(by, "_slice", F.col(label).alias("label")).agg(F.sum(rank * k).alias("r"), F.sum(k).alias("n"), F.sum((ties.cast("double") * ties - 1) * k).alias("tie"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(by).orderBy("_slice").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = parts.withColumn("r", F.col("r") + before * F.col("n")).groupBy(by, "label").agg(F.sum("r").alias("r"), F.sum("n").alias("n"), F.sum("tie").alias("tie"))
    total = groups.groupBy(by).agg(F.count("*").alias("groups"), F.sum("n").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("rr"), F.sum("tie").alias("tie")).where("groups >= 2")
    n = F.col("n").cast("double")
    correction = 1 - F.col("tie") / (n * n * n - n)
    h = (F.lit(12.0) / (n * (n + 1)) * F.col("rr") - 3 * (n + 1)) / F.when(correction > 0, correction)
    out = total.select(by, "groups", "n", h.alias("statistic")).withColumn("p_value", tail(F.col("statistic"), (F.col("groups") - 1).cast("double")))
    return benjamini_hochberg(out) if fdr else out


def mann_whitney(long: DataFrame, pairs: DataFrame, label: str = "label", by: str = "feature", value: str = "value") -> DataFrame:
    """Two-sided Mann-Whitney tests for label pairs (label_left, label_right).

    comparison, feature, n_left, n_right, median_left, median_right, u, rank_biserial, p_value, q_value (by
    comparison); both sides need two values. The rank-biserial effect is 2 U / (n m) - 1 for the left side.
    """
    rows = present(long, value).select(F.col(label).cast("string").alias("_label"), by, value)
    sides = pairs.select(F.concat_ws("_vs_", "label_left", "label_right").alias("comparison"), F.explode(F.array(F.struct(F.col("label_left").alias("l"), F.lit(True).alias("left")), F.struct(F.col("label_right").alias("l"), F.lit(False).alias("left")))).alias("s"))
    sides = sides.select("comparison", F.col("s.l").alias("_label"), "s.left")
    sided = rows.groupBy("_label", by, value).agg(F.count("*").alias("_k")).join(sides, "_label")  # rows are counted before they are multiplied
    left = F.col("left").cast("long") * F.col("_k")
    counts = sided.groupBy("comparison", by, value).agg(F.sum(left).alias("a"), F.sum(F.col("_k") - left).alias("b"), F.sum("_k").alias("ties"))
    held = sliced(counts, ["comparison", by], value)
    ranked = placed(held, ["comparison", by], value, ("ties", "a", "b"))
    (on_a, med_a), (on_b, med_b) = quantile_of("a", {"median_left": 0.5}, value), quantile_of("b", {"median_right": 0.5}, value)
    squares = F.sum((F.col("ties").cast("double") * F.col("ties") - 1) * F.col("ties")).alias("tie")
    out = ranked.groupBy("comparison", by).agg(F.sum("a").alias("n_left"), F.sum("b").alias("n_right"), F.sum(F.expr(RANK) * F.col("a")).alias("r"), squares, *on_a, *on_b).where("n_left >= 2 and n_right >= 2")
    out = out.select("comparison", by, "n_left", "n_right", *med_a, *med_b, "r", "tie")
    u = F.col("r") - F.col("n_left") * (F.col("n_left") + 1) / 2
    out = out.withColumn("u", u).withColumn("rank_biserial", 2 * F.col("u") / (F.col("n_left") * F.col("n_right")) - 1)
    out = out.withColumn("p_value", mannwhitney_p("u", "n_left", "n_right", "tie")).drop("r", "tie")
    return benjamini_hochberg(out, by=["comparison"])


def label_pairs(labels: DataFrame, label: str = "label") -> DataFrame:
    """All unordered pairs of the distinct labels: label_left < label_right."""
    one = labels.select(F.col(label).cast("string").alias("l")).where("l is not null").distinct()
    return one.select(F.col("l").alias("label_left")).join(one.select(F.col("l").alias("label_right")), F.col("label_left") < F.col("label_right"))


def spearman(wide: DataFrame, covariates: list[str], features: list[str]) -> DataFrame:
    """covariate, feature, n, rho, p_value, q_value (by covariate) over rows where both are present."""
    ids = wide.withColumn("_id", F.monotonically_increasing_id())
    stack = ids.select("_id", F.explode(F.array(*(F.struct(F.lit(c).alias("covariate"), F.lit(f).alias("feature"), F.col(c).cast("double").alias("x"), F.col(f).cast("double").alias("y")) for c in covariates for f in features))).alias("s"))
    rows = present(present(stack.select("s.*"), "x"), "y")
    ranked = average_ranks(rows, ["covariate", "feature"], "x").withColumnRenamed("rank", "rx").drop("ties", "total")
    ranked = average_ranks(ranked, ["covariate", "feature"], "y")
    out = ranked.groupBy("covariate", "feature").agg(F.count("*").alias("n"), F.corr("rx", "rank").alias("rho"))
    t = F.col("rho") * F.sqrt((F.col("n") - 2) / F.when(1 - F.col("rho") * F.col("rho") > 0, 1 - F.col("rho") * F.col("rho")))
    out = out.withColumn("p_value", F.when(F.abs("rho") >= 1, F.lit(0.0)).otherwise(t_sf2(t, (F.col("n") - 2).cast("double"))))
    return benjamini_hochberg(out, by=["covariate"])


def chi_square(table: DataFrame, a: str, b: str) -> DataFrame:
    """statistic, df, n, p_value, cramers_v, min_expected of the contingency table of a and b.

    Yates' correction is made for tables of two rows and columns only.
    """
    cells = table.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("o"))
    rows, cols = cells.groupBy(a).agg(F.sum("o").alias("ra")), cells.groupBy(b).agg(F.sum("o").alias("cb"))
    shape = rows.agg(F.count("*").alias("r"), F.sum("ra").alias("n"), F.min("ra").alias("low_r"), F.sum(1 / F.col("ra")).alias("ir"))
    shape = shape.crossJoin(cols.agg(F.count("*").alias("c"), F.min("cb").alias("low_c"), F.sum(1 / F.col("cb")).alias("ic")))  # one row each
    expected = F.col("ra") * F.col("cb") / F.col("n")
    met = cells.join(rows, a).join(cols, b).crossJoin(F.broadcast(shape))
    names = ("n", "r", "c", "low_r", "low_c", "ir", "ic")
    # Cells without rows are not made: each adds what is expected of it, and all that is expected is n.
    sums = met.agg(F.sum(F.pow(F.col("o") - expected, F.lit(2)) / expected).alias("present"), F.sum(expected).alias("covered"), F.max(F.abs(F.col("o") - expected)).alias("gap"), *(F.first(x).alias(x) for x in names)).where("n is not null")
    # In a table of two rows and columns all cells are as far from what is expected.
    yates = F.pow(F.col("gap") - F.least(F.lit(0.5), F.col("gap")), F.lit(2)) * F.col("n") * F.col("ir") * F.col("ic")
    statistic = F.when((F.col("r") == 2) & (F.col("c") == 2), yates).otherwise(F.col("present") + F.greatest(F.lit(0.0), F.col("n") - F.col("covered")))
    out = sums.select(statistic.alias("statistic"), "r", "c", "n", (F.col("low_r") * F.col("low_c") / F.col("n")).alias("min_expected"))
    df = (F.col("r") - 1) * (F.col("c") - 1)
    least = F.least("r", "c") - 1
    return out.select("statistic", df.cast("long").alias("df"), "n", F.when(df > 0, chi2_sf("statistic", df.cast("double"))).alias("p_value"), F.sqrt(F.col("statistic") / F.when(least > 0, F.col("n") * least)).alias("cramers_v"), "min_expected")


def ks_statistic(long: DataFrame, side: Column, by: list[str], value: str = "value") -> DataFrame:
    """by, n_a, n_b and ks: the largest distance of the two samples' distribution functions; side is true for a.

    Null where a sample is empty.
    """
    ranked = placed(_two_sides(present(long, value).withColumn("_a", side), by, value), by, value, ("a", "b"))
    return ranked.groupBy(*by).agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.max(F.expr(GAP)).alias("ks"))


def _two_sides(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Sliced counts of both sides; _a is true for a."""
    return sliced(rows.groupBy(*by, value).agg(F.count_if("_a").alias("a"), F.count_if(~F.col("_a")).alias("b")), by, value)


def counted_moments(counts: DataFrame, by: str, sides: tuple[str, ...], value: str = "value") -> DataFrame:
    """by and n, mean and sd (n - 1) of the rows that each column of sides counts at each value."""
    of = lambda c, x: F.sum(F.when(F.col(c) > 0, F.col(c) * x))
    n = lambda c: F.col(f"n_{c}")
    means = counts.groupBy(by).agg(*(F.sum(c).alias(f"n_{c}") for c in sides), *(of(c, F.col(value)).alias(f"mean_{c}") for c in sides))
    means = means.withColumns({f"mean_{c}": F.col(f"mean_{c}") / F.when(n(c) > 0, n(c)) for c in sides})
    gap = lambda c: F.col(value) - F.col(f"mean_{c}")
    spread = counts.join(means, by).groupBy(by).agg(*(of(c, gap(c) * gap(c)).alias(f"sd_{c}") for c in sides))
    out = means.join(spread, by).withColumns({f"sd_{c}": F.sqrt(F.col(f"sd_{c}") / F.when(n(c) > 1, n(c) - 1)) for c in sides})
    return out.select(by, *(f"{k}_{c}" for c in sides for k in ("n", "mean", "sd")))


def moments(value: Column, prefix: str) -> list[Column]:
    """n, mean and sd (n - 1) of a column."""
    return [F.count(value).alias(f"n_{prefix}"), F.avg(value).alias(f"mean_{prefix}"), F.stddev_samp(value).alias(f"sd_{prefix}")]


def cohens_d(n_a: Column, mean_a: Column, sd_a: Column, n_b: Column, mean_b: Column, sd_b: Column) -> Column:
    """(mean b - mean a) / pooled sd; null for fewer than three values or no spread."""
    va, vb = F.coalesce(sd_a * sd_a, F.lit(0.0)), F.coalesce(sd_b * sd_b, F.lit(0.0))
    pooled = F.sqrt(((n_a - 1) * va + (n_b - 1) * vb) / F.when(n_a + n_b > 2, n_a + n_b - 2))
    return F.when((n_a > 0) & (n_b > 0), (mean_b - mean_a) / F.when(pooled > 0, pooled))


def domain_shift(long: DataFrame, side: Column, by: str = "feature", value: str = "value") -> DataFrame:
    """Moments of both samples, Cohen's d and the KS statistic for each feature; side is true for the first one (a)."""
    counts = _two_sides(present(long, value).withColumn("_a", side), [by], value)
    out = counted_moments(counts, by, ("a", "b"), value)
    out = out.withColumn("cohens_d", cohens_d(*(F.col(c) for c in ("n_a", "mean_a", "sd_a", "n_b", "mean_b", "sd_b"))))
    aggs, columns = [], []
    for c in ("a", "b"):
        on, named = quantile_of(c, {f"_q1_{c}": 0.25, f"median_{c}": 0.5, f"_q3_{c}": 0.75}, value)
        aggs, columns = aggs + on, columns + named
    order = placed(counts, [by], value, ("a", "b")).groupBy(by).agg(F.max(F.expr(GAP)).alias("ks"), *aggs).select(by, "ks", *columns)
    order = order.select(by, "ks", "median_a", "median_b", (F.col("_q3_a") - F.col("_q1_a")).alias("iqr_a"), (F.col("_q3_b") - F.col("_q1_b")).alias("iqr_b"))
    return out.join(order, by)


def ols_hc3(wide: DataFrame, design: list[str], features: list[str], tested: list[str], contrasts: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """OLS of each z-scored feature on an intercept and design columns with HC3 covariance.

    feature, n, wald, df (len(tested)), p_value, partial_r2 of the tested columns against the model without
    them, one row for each contrast: contrast, estimate, robust_se, z, contrast_p. Rows with a null or NaN in a
    design column are left out. A constant feature, or one with a missing value, is skipped. All features
    share a design, so moments of the design are computed once and joined as one row; the rest is one
    aggregation by feature. Coefficients are solved in a kernel of design size on one row for each feature.
    """
    import numpy as np
    import pandas as pd

    names = ["_one", *design]
    k = len(names)
    keep = reduce(lambda a, c: a & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")), design, F.lit(True))
    base = wide.where(keep).select(F.lit(1.0).alias("_one"), *(F.col(c).cast("double").alias(c) for c in design), *(F.col(f).cast("double").alias(f) for f in features if f not in design))
    products = [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"x{i}_{j}") for i in range(k) for j in range(i, k)]
    gram = base.agg(F.count("*").alias("n"), *products).first()
    n = gram["n"]
    schema = "feature string, n bigint, wald double, df int, p_value double, partial_r2 double, contrast string, estimate double, robust_se double, z double, contrast_p double"
    if not n:
        return wide.sparkSession.createDataFrame([], schema)
    xtx = np.array([[gram[f"x{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
    inverse = np.linalg.pinv(xtx)
    leverage = sum((F.col(names[i]) * F.col(names[j]) * float(inverse[i, j]) for i in range(k) for j in range(k)), F.lit(0.0))
    long = base.withColumn("_h", leverage).select(*names, "_h", F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("y")) for f in features))).alias("s")).select(*names, "_h", "s.*")
    scale = long.groupBy("feature").agg(F.avg("y").alias("_m"), F.stddev_pop("y").alias("_s"), F.sum((F.col("y").isNull() | F.isnan("y")).cast("int")).alias("_gone")).where("_s > 0 and _gone = 0 and not isnan(_s)")
    long = long.join(F.broadcast(scale), "feature").withColumn("y", (F.col("y") - F.col("_m")) / F.col("_s"))
    fits = long.groupBy("feature").agg(*(F.sum(F.col(c) * F.col("y")).alias(f"b{i}") for i, c in enumerate(names)), F.sum(F.col("y") * F.col("y")).alias("yy"))
    beta = [sum((F.col(f"b{j}") * float(inverse[i, j]) for j in range(k)), F.lit(0.0)).alias(f"beta{i}") for i in range(k)]
    solved = fits.select("feature", "yy", *(f"b{i}" for i in range(k)), *beta)
    joined = long.join(F.broadcast(solved), "feature")  # a row for each feature: no task takes all rows of one
    error = F.col("y") - sum((F.col(f"beta{i}") * F.col(c) for i, c in enumerate(names)), F.lit(0.0))
    weight = F.pow(error / (1 - F.col("_h")), F.lit(2))
    meat = joined.groupBy("feature").agg(*(F.sum(weight * F.col(names[i]) * F.col(names[j])).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)), F.sum(error * error).alias("sse"))
    picked = [names.index(t) for t in tested]
    others = [i for i in range(k) if i not in picked]
    reduced = np.linalg.pinv(xtx[np.ix_(others, others)])
    wanted = {name: np.array([weights.get(c, 0.0) for c in names]) for name, weights in (contrasts or {}).items()} or {"all": np.zeros(k)}

    def solve(batches):
        from cohortlens.functions.special import chi2_tail, normal_two_sided

        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                b, beta = np.array([getattr(r, f"b{i}") for i in range(k)]), np.array([getattr(r, f"beta{i}") for i in range(k)])
                m = np.array([[getattr(r, f"m{min(i, j)}_{max(i, j)}") for j in range(k)] for i in range(k)])
                v = inverse @ m @ inverse
                part = beta[picked]
                wald = float(part @ np.linalg.pinv(v[np.ix_(picked, picked)]) @ part)
                rest = float(r.yy - b[others] @ reduced @ b[others])
                for name, c in wanted.items():
                    se = float(np.sqrt(max(0.0, c @ v @ c)))
                    z = float(c @ beta) / se if se > 0 else None
                    out.append((r.feature, n, wald, len(picked), chi2_tail(wald, len(picked)), (rest - r.sse) / rest if rest > 0 else None, name, float(c @ beta), se, z, normal_two_sided(z) if z is not None else None))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return solved.join(meat, "feature").mapInPandas(solve, schema)


__all__ = ["average_ranks", "benjamini_hochberg", "chi_square", "cohens_d", "counted_moments", "cumulated", "domain_shift", "in_slices", "kruskal_wallis", "ks_statistic", "label_pairs", "mann_whitney", "moments", "ols_hc3", "placed", "present", "quantiles", "slice_cuts", "sliced", "spearman"]
