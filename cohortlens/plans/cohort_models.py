"""Queries of fitted models: folds, cross-fitting, locked thresholds, pairs of classes, subsets, other conditions.

With one feature a logistic fit is Newton's method in two unknowns, which SQL can write out, so that the whole
procedure (folds, scaling on training rows, grid, threshold) has a SQL twin.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import glm, metrics, ml
from cohortlens.plans.catalog import query, r, rounded, table

GRID, NEWTON_STEPS = (0.1, 1.0, 10.0), 12
ORDER = "('0x' || substr(md5('42:' || {id}), 1, 15))::bigint"


def nested_sql(source: str, folds: int, inner: int, grid=GRID, other: str = "") -> str:
    """CTEs up to judged (f, g, c, id, y, p: held-out probabilities) and fitted (f, g, c, b0, b1, mean, sd) for source
    (id, y in 0 and 1, x; no nulls); f and g of -1 leave nothing out. inner is bounded by the smallest class."""
    steps = []
    for i in range(NEWTON_STEPS):
        steps.append(f"""
n{i + 1} as (
  select f, g, c, b0 - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) as b0, b1 - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) as b1
  from (select f, g, c, b0, b1, c * sum(w * (p - y)) + 1e-9 * b0 as g0, c * sum(w * (p - y) * z) + b1 as g1, c * sum(w * p * (1 - p)) + 1e-9 as h00, c * sum(w * p * (1 - p) * z) as h01, c * sum(w * p * (1 - p) * z * z) + 1 as h11
    from (select n{i}.*, t.y, t.z, t.w, 1 / (1 + exp(-(b0 + b1 * z))) as p from n{i} join scaled t using (f, g)) group by f, g, c, b0, b1))""")
    return f"""
src as ({source}),
ranked as (select *, row_number() over (partition by y order by {ORDER.format(id='id')}, id::varchar) - 1 as k, case when y = 1 then count(*) filter (y = 0) over () else 0 end as start from src),
fold as (select *, (start + k) % {folds} as outer_fold from ranked),
dealt as (
  select f, fold.*, case when outer_fold <> f then (case when y = 1 then count(*) filter (y = 0 and outer_fold <> f) over (partition by f) else 0 end
    + row_number() over (partition by f, y, outer_fold <> f order by k) - 1) % {inner} end as inner_fold from fold, range(0, {folds}) r(f)),
train as (
  select f, g, id, y, x from dealt, range(-1, {inner}) q(g) where outer_fold <> f and (g < 0 or inner_fold <> g)
  union all select -1, -1, id, y, x from fold),
shape as (select f, g, avg(x) as mean, case when stddev_pop(x) > 0 then stddev_pop(x) else 1 end as sd, count(*) as n, count(*) filter (y = 1) as n1 from train group by f, g),
scaled as (select f, g, y, (x - mean) / sd as z, n / 2.0 / case when y = 1 then n1 else n - n1 end as w from train join shape using (f, g)),
n0 as (select f, g, v.c, 0.0::double as b0, 0.0::double as b1 from shape, (values {', '.join(f'({c}::double)' for c in grid)}) v(c)),{','.join(steps)},
fitted as (select n{NEWTON_STEPS}.*, mean, sd from n{NEWTON_STEPS} join shape using (f, g)),
judged as (
  select f, g, c, id, y, 1 / (1 + exp(-(b0 + b1 * (x - mean) / sd))) as p from dealt join fitted using (f)
  where (g < 0 and outer_fold = f) or (outer_fold <> f and inner_fold = g)),
recall as (select f, g, c, (count(*) filter (y = 1 and p > 0.5) / count(*) filter (y = 1) + count(*) filter (y = 0 and p <= 0.5) / count(*) filter (y = 0)) / 2 as score from judged group by f, g, c),
inner_choice as (select f, c from (select f, c, row_number() over (partition by f order by round(avg(score), 12) desc, c) as k from recall where g >= 0 group by f, c) where k = 1){other}"""


THRESHOLD = """,
outer_choice as (select c from (select c, row_number() over (order by round(avg(score), 12) desc, c) as k from recall where g < 0 group by c) where k = 1),
pooled as (select f as whose, p, y from judged join inner_choice using (f, c) where g >= 0 union all select -1, p, y from judged join outer_choice using (c) where g < 0),
threshold as (select whose, t from (
  select whose, t, row_number() over (partition by whose order by round((count(*) filter (y = 1 and p + 1e-12 >= t) / count(*) filter (y = 1) + count(*) filter (y = 0 and p + 1e-12 < t) / count(*) filter (y = 0)) / 2, 12) desc, t) as k
  from pooled, (select i / 100.0 as t from range(1, 100) r(i)) group by whose, t) where k = 1)"""
LABELLED = "select doc_id as id, case when quality = 1 then 1 else 0 end as y, log10(1 + n_chars) as x from documents join labels using (doc_id)"


def labelled(spark, sf):
    """Labelled documents with one feature, the logarithm of their length."""
    d = table(spark, sf, "documents", "doc_id", "n_chars", "lang").join(table(spark, sf, "labels"), "doc_id")
    return d.withColumns({"x": F.log10(1 + F.col("n_chars")), "y": F.when(F.col("quality") == 1, "good").otherwise("bad")})


@query(f"select vec_id, label, (row_number() over (order by label::varchar, {ORDER.format(id='vec_id')}, vec_id) - 1) % 5 as fold from embeddings where label is not null")
def stratified_folds(spark, sf):
    """Five folds of every vector: rows in the order of label and a seeded digest, dealt round."""
    return glm.stratified_folds(table(spark, sf, "embeddings", "vec_id", "label"), "vec_id", "label", 5)


@query(
    f"with {nested_sql(LABELLED, 5, 5, other=THRESHOLD)} select j.id::varchar as participant_id, case when j.y = 1 then 'good' else 'bad' end as true_label, j.f::integer as fold, {r('j.p')} as prob, j.c as fold_C, t.t as fold_threshold, j.p >= t.t as pred_positive, "
    f"l.t as locked_threshold, m.c as locked_C, {r('m.b1')} as locked_coef, {r('m.b0')} as locked_intercept, {r('m.mean')} as locked_mean, {r('m.sd')} as locked_scale "
    "from judged j join inner_choice i on j.f = i.f and j.c = i.c and j.g = -1 join threshold t on t.whose = j.f join threshold l on l.whose = -1 join fitted m on m.f = -1 join outer_choice o on o.c = m.c"
)
def locked_threshold_documents(spark, sf):
    """Good documents against bad ones: C and threshold of each fold from its training rows, and the frozen model."""
    pred, frozen = ml.locked_model(labelled(spark, sf), "doc_id", "y", "good", ["x"])
    p = frozen["params"][0]
    more = {"threshold": frozen["threshold"], "C": frozen["C"], "coef": p["coef"], "intercept": frozen["intercept"], "mean": p["mean"], "scale": p["scale"]}
    return rounded(pred.withColumns({f"locked_{k}": F.lit(float(v)) for k, v in more.items()}))


def _pair_sql(a: str, b: str) -> str:
    source = f"select doc_id as id, case when lang = '{b}' then 1 else 0 end as y, log10(1 + n_chars) as x from documents where lang in ('{a}', '{b}')"
    return f"""(with {nested_sql(source, 5, 4)}, guess as (select y, p > 0.5 as up from judged join inner_choice using (f, c) where g = -1)
select '{a}_{b}' as comparison, count(*) as n, {r("avg(case when up = (y = 1) then 1.0 else 0 end)")} as accuracy,
  {r("(count(*) filter (y = 1 and up) / count(*) filter (y = 1) + count(*) filter (y = 0 and not up) / count(*) filter (y = 0)) / 2")} as balanced_accuracy from guess)"""


PAIRS = (("de", "en"), ("en", "fr"), ("de", "es"))


def scores(pred, by: list[str]):
    """n, accuracy and balanced accuracy of predictions."""
    right = pred.groupBy(*by, "true_label").agg(F.count("*").alias("n"), F.sum((F.col("true_label") == F.col("pred_label")).cast("long")).alias("hits"))
    return right.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum("hits") / F.sum("n")).alias("accuracy"), F.avg(F.col("hits") / F.col("n")).alias("balanced_accuracy"))


@query(" union all ".join(_pair_sql(a, b) for a, b in PAIRS))
def pairwise_models(spark, sf):
    """Nested cross-validation for pairs of languages by length, each with its own folds and choices."""
    d, out = table(spark, sf, "documents", "doc_id", "lang", "n_chars").withColumn("x", F.log10(1 + F.col("n_chars"))), None
    for a, b in PAIRS:
        pred = ml.nested_cv(d.where(F.col("lang").isin(a, b)), "doc_id", "lang", ["x"], {"logistic": {"C": GRID}}).withColumn("comparison", F.lit(f"{a}_{b}"))
        out = pred if out is None else out.unionByName(pred)
    return rounded(scores(out, ["comparison"]))


def _subset_sql(least: int) -> str:
    return f"""(with {nested_sql(LABELLED + f" where n_chars >= {least}", 5, 4)}, guess as (select y, p > 0.5 as up from judged join inner_choice using (f, c) where g = -1)
select {least} as least, count(*) as n, {r("avg(case when up = (y = 1) then 1.0 else 0 end)")} as accuracy,
  {r("(count(*) filter (y = 1 and up) / count(*) filter (y = 1) + count(*) filter (y = 0 and not up) / count(*) filter (y = 0)) / 2")} as balanced_accuracy from guess)"""


@query(" union all ".join(map(_subset_sql, (0, 200))))
def low_count_sensitivity(spark, sf):
    """The nested estimate with and without documents of few characters, which stand for participants with few epochs."""
    d, out = labelled(spark, sf), None
    for least in (0, 200):
        pred = ml.nested_cv(d.where(F.col("n_chars") >= least), "doc_id", "y", ["x"], {"logistic": {"C": GRID}}).withColumn("least", F.lit(least))
        out = pred if out is None else out.unionByName(pred)
    return rounded(scores(out, ["least"]))


@query(
    f"""with {nested_sql(LABELLED, 5, 4)}, other as (select doc_id as id, log10(1 + n_chars) + 0.1 * (doc_id % 5 - 2) as x from documents join labels using (doc_id) where doc_id % 3 <> 0),
own as (select j.id, j.f, j.y, j.p, m.b0, m.b1, m.mean, m.sd from judged j join inner_choice i on j.f = i.f and j.c = i.c and j.g = -1 join fitted m on m.f = j.f and m.g = -1 and m.c = j.c),
both_ as (select 'source' as condition, id, f, y, p from own union all select 'target', other.id, f, y, 1 / (1 + exp(-(b0 + b1 * (other.x - mean) / sd))) from own join other on other.id = own.id)
select condition, id::varchar as participant_id, f::integer as fold, case when y = 1 then 'good' else 'bad' end as true_label, {r('p')} as prob_good from both_"""
)
def cross_condition(spark, sf):
    """Models of the source condition, judged on held-out documents in it and, where they have one, in another condition."""
    d = labelled(spark, sf)
    target = d.where(F.col("doc_id") % 3 != 0).withColumn("x", F.col("x") + 0.1 * (F.col("doc_id") % 5 - 2))
    pred = ml.nested_cv(d, "doc_id", "y", ["x"], {"logistic": {"C": GRID}}, target=target)
    return rounded(pred.select("condition", "participant_id", "fold", "true_label", F.element_at("probs", F.lit("good")).alias("prob_good")))


@query()
def nested_logistic_vectors(spark, sf):
    """Ten classes by all components with one nuisance column taken out, every row of the table, in scans of it."""
    from cohortlens.plans.catalog import cohort

    c, features = cohort(spark, sf)
    return rounded(metrics.accuracy(ml.nested_cv(c, "vec_id", "label", features, {"logistic": {"C": GRID}}, nuisance=["age"]), ["model"]))
