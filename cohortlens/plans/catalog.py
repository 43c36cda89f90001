"""Queries of the engine's operators on the driver's tables, each with its DuckDB SQL where SQL can say it.

The tables stand in for cohort data: customers and labelled documents for participants, embeddings for signals
(64 samples, the label as group), line items and events for measured features. Doubles are rounded on both
sides alike; ties are broken by keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions import scalar, special
from cohortlens.operators import connectivity, integrity, metrics, ml, relational, signal, stats, textqa

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name; sql is its DuckDB twin."""

    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


def table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return df.select(*columns) if columns else df


def rounded(df: DataFrame, places: int = 6, skip: tuple[str, ...] = ()) -> DataFrame:
    """Doubles to places, without negative zeros."""
    return df.withColumns({c: F.round(F.col(c), places) + F.lit(0.0) for c, kind in df.dtypes if kind == "double" and c not in skip})


def r(x: str, places: int = 6) -> str:
    return f"round({x}, {places}) + 0.0"


# --- shared frames --------------------------------------------------------------------------------------------


def events_by_hour(spark, sf) -> DataFrame:
    """feature (hour of the day), label (event type), value."""
    e = table(spark, sf, "events", "ts", "event_type", "value")
    return e.select(F.hour("ts").alias("feature"), F.col("event_type").alias("label"), F.col("value").cast("double").alias("value"))


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def line_long(spark, sf, *ids: str) -> DataFrame:
    return relational.to_long(table(spark, sf, "lineitem", *ids, *MEASURES), list(ids), MEASURES)


LONG_SQL = "select * from (select {ids}, l_quantity, l_extendedprice, l_discount, l_tax from lineitem) unpivot (value for feature in (l_quantity, l_extendedprice, l_discount, l_tax))"


def scored(spark, sf) -> DataFrame:
    """Labelled documents: doc_id, quality, toxic, score (length in units of 20,000 characters, at most 1), true and predicted label."""
    d = table(spark, sf, "documents", "doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    s = F.least(F.lit(1.0), F.col("n_chars") / 5000.0)
    return d.select("doc_id", "n_chars", "toxic", "quality", s.alias("score"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("true_label"), F.when(s >= 0.25, "good").otherwise("bad").alias("pred_label"))


SCORED_SQL = "select doc_id, n_chars, toxic, quality, least(1.0, n_chars / 5000.0)::double as score, case when quality = 1 then 'good' else 'bad' end as true_label, case when n_chars / 5000.0 >= 0.25 then 'good' else 'bad' end as pred_label from documents join labels using (doc_id)"


def channels(spark, sf) -> DataFrame:
    """Embeddings as recordings: participant (vec_id div 4), channel (vec_id mod 4), samples, label."""
    e = table(spark, sf, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 4).cast("long").alias("participant"), F.concat(F.lit("ch"), (F.col("vec_id") % 4).cast("string")).alias("channel"), F.transform("embedding", lambda x: x.cast("double")).alias("samples"), "label", "vec_id")


CHANNELS_SQL = "select vec_id // 4 as participant, 'ch' || (vec_id % 4) as channel, embedding::double[] as samples, label, vec_id from embeddings"
RATE, HALF = 64.0, 16
#: Bands and regions for signals of 64 samples at 64 Hz.
BANDS = {"delta": (1.0, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 13.0), "beta": (13.0, 30.0)}
REGIONS = {"front": ["ch0", "ch1"], "back": ["ch2", "ch3", "ch9"], "mid": ["ch1", "ch2"]}
BANDS_SQL = "(values ('delta', 1.0, 4.0), ('theta', 4.0, 8.0), ('alpha', 8.0, 13.0), ('beta', 13.0, 30.0)) b(band, low, high)"
REGIONS_SQL = "(values ('front','ch0'),('front','ch1'),('back','ch2'),('back','ch3'),('back','ch9'),('mid','ch1'),('mid','ch2')) g(region, channel)"
#: |X|^2 of each recording's 33 bins, by sums.
DFT_SQL = f"""
points as (select vec_id, participant, channel, label, i - 1 as t, samples[i] as x from ({CHANNELS_SQL}), range(1, 65) r(i)),
dft as (select vec_id, participant, channel, label, k as bin, power(sum(x * cos(2 * pi() * ((k * t) % 64) / 64)), 2) + power(sum(x * sin(2 * pi() * ((k * t) % 64) / 64)), 2) as power
  from points, range(0, 33) f(k) group by all)"""
#: Welch power of one segment: less the mean, periodic Hann window, density, inner bins doubled.
WELCH_SQL = f"""
points as (select vec_id, participant, channel, label, i - 1 as t, samples[i] - list_avg(samples) as x from ({CHANNELS_SQL}), range(1, 65) r(i)),
psd as (select vec_id, participant, channel, label, k as bin, max(k)::double as frequency,
    (power(sum(x * (0.5 - 0.5 * cos(2 * pi() * t / 64)) * cos(2 * pi() * ((k * t) % 64) / 64)), 2) + power(sum(x * (0.5 - 0.5 * cos(2 * pi() * t / 64)) * sin(2 * pi() * ((k * t) % 64) / 64)), 2))
    / (64 * 24.0) * max(case when k in (0, 32) then 1 else 2 end) as power
  from points, range(0, 33) f(k) group by all),
sums as (select c.vec_id, c.participant, c.channel, b.band, coalesce(sum(power) filter (frequency >= low and frequency < high), 0) as power
  from ({CHANNELS_SQL}) c cross join {BANDS_SQL} left join psd on psd.vec_id = c.vec_id group by all)"""


def band_sums(spark, sf) -> DataFrame:
    spectra = signal.welch_psd(channels(spark, sf), RATE, 64)
    return signal.band_powers(spectra, ["vec_id", "participant", "channel"], BANDS)


# --- rank statistics ------------------------------------------------------------------------------------------

KRUSKAL = """
present as (select * from rows where value is not null and label is not null),
big as (select feature, label from present group by all having count(*) >= 2),
ranked as (select feature, label, rank() over (partition by feature order by value) + (count(*) over (partition by feature, value) - 1) / 2.0 as rk, count(*) over (partition by feature, value) as t
  from present join big using (feature, label)),
g as (select feature, label, sum(rk) as r, count(*) as n, sum(t::double * t - 1) as tie from ranked group by all),
h as (select feature, count(*) as groups, sum(n)::bigint as n, (12.0 / (sum(n) * (sum(n) + 1)) * sum(r * r / n) - 3 * (sum(n) + 1)) / (1 - sum(tie) / (power(sum(n), 3) - sum(n))) as statistic
  from g group by feature having count(*) >= 2)"""


@query(
    f"""with rows as (select hour(ts) as feature, event_type as label, value from events), {KRUSKAL},
p as (select *, exp(-statistic / 2) * (1 + statistic / 2) as p from h where groups = 5),
q as (select *, p * count(*) over () / row_number() over (order by p) as raw from p)
select feature, groups, n, {r('statistic')} as statistic, {r('p')} as p_value, {r('least(1.0, min(raw) over (order by p desc, raw rows unbounded preceding))')} as q_value from q"""
)
def kruskal_fdr_by_hour(spark, sf):
    """Kruskal-Wallis of event values over the five types for each hour, p by the general tail (the SQL has its closed form), and FDR."""
    out = stats.kruskal_wallis(events_by_hour(spark, sf), fdr=False).where("groups = 5")
    return rounded(stats.benjamini_hochberg(out))


@query(
    f"""with rows as ({LONG_SQL.format(ids='l_returnflag as label')}), {KRUSKAL}
select feature, groups, n, {r('statistic')} as statistic, {r('exp(-statistic / 2)')} as p_value from h"""
)
def kruskal_three_groups(spark, sf):
    long = line_long(spark, sf, "l_returnflag")
    return rounded(stats.kruskal_wallis(long, "l_returnflag", tail=lambda x, df: special.chi2_sf_even(x, 2), fdr=False))


@query(
    f"""with rows as ({LONG_SQL.format(ids='l_linestatus as label')}),
ranked as (select *, rank() over (partition by feature order by value) + (count(*) over (partition by feature, value) - 1) / 2.0 as rk from rows),
s as (select feature, min(label) as a, max(label) as b from rows group by feature)
select a || '_vs_' || b as comparison, feature, count(*) filter (label = a) as n_left, count(*) filter (label = b) as n_right, quantile_cont(value, 0.5) filter (label = a) as median_left,
  quantile_cont(value, 0.5) filter (label = b) as median_right, sum(rk) filter (label = a) - count(*) filter (label = a) * (count(*) filter (label = a) + 1) / 2.0 as u,
  {r('2 * (sum(rk) filter (label = a) - count(*) filter (label = a) * (count(*) filter (label = a) + 1) / 2.0) / (count(*) filter (label = a) * count(*) filter (label = b)) - 1')} as rank_biserial
from ranked join s using (feature) group by all"""
)
def mann_whitney_pairs(spark, sf):
    """U, medians and rank-biserial effects; p and q are checked by the tests."""
    long = line_long(spark, sf, "l_linestatus")
    pairs = stats.label_pairs(table(spark, sf, "lineitem", "l_linestatus"), "l_linestatus")
    return rounded(stats.mann_whitney(long, pairs, "l_linestatus").drop("p_value", "q_value"))


@query(
    f"""with t as (select l_returnflag as family, l_partkey % 997 as k, (avg(l_discount) * 9.7123456789 + 0.001)::double as p_value from lineitem group by all),
q as (select *, p_value * count(*) over (partition by family) / row_number() over (partition by family order by p_value, k) as raw from t)
select family, k, {r('p_value')} as p_value, {r('least(1.0, min(raw) over (partition by family order by p_value desc, raw rows unbounded preceding))')} as q_value from q"""
)
def bh_fdr(spark, sf):
    li = table(spark, sf, "lineitem", "l_returnflag", "l_partkey", "l_discount")
    t = li.groupBy(F.col("l_returnflag").alias("family"), (F.col("l_partkey") % 997).alias("k")).agg((F.avg("l_discount") * 9.7123456789 + 0.001).alias("p_value"))
    return rounded(stats.benjamini_hochberg(t, by=["family"]))


@query(
    f"""with x as (select c_acctbal, c_nationkey, length(c_name) as name_length, c_custkey % 100 as k from customer),
a as (select rank() over (order by c_acctbal) + (count(*) over (partition by c_acctbal) - 1) / 2.0 as ra, rank() over (order by c_nationkey) + (count(*) over (partition by c_nationkey) - 1) / 2.0 as rb, rank() over (order by k) + (count(*) over (partition by k) - 1) / 2.0 as rc from x)
select 'c_nationkey' as covariate, 'c_acctbal' as feature, count(*) as n, {r('corr(rb, ra)')} as rho from a
union all select 'c_nationkey', 'k', count(*), {r('corr(rb, rc)')} from a"""
)
def spearman_rho(spark, sf):
    c = table(spark, sf, "customer", "c_custkey", "c_acctbal", "c_nationkey").withColumn("k", F.col("c_custkey") % 100)
    return rounded(stats.spearman(c, ["c_nationkey"], ["c_acctbal", "k"]).drop("p_value", "q_value"))


@query(
    f"""with o as (select o_orderstatus as a, o_orderpriority as b, count(*) as n from orders group by all),
x as (select ra.a, cb.b, coalesce(o.n, 0) as n, ra.r * cb.c / t.n::double as e, t.n as total from (select a, sum(n) as r from o group by a) ra cross join (select b, sum(n) as c from o group by b) cb
  cross join (select sum(n) as n from o) t left join o on o.a = ra.a and o.b = cb.b)
select {r('sum(power(n - e, 2) / e)')} as statistic, ((count(distinct a) - 1) * (count(distinct b) - 1))::bigint as df, max(total)::bigint as n,
  {r('sqrt(sum(power(n - e, 2) / e) / (max(total) * (least(count(distinct a), count(distinct b)) - 1)))')} as cramers_v, {r('min(e)')} as min_expected from x"""
)
def chi2_cramers_v(spark, sf):
    return rounded(stats.chi_square(table(spark, sf, "orders", "o_orderstatus", "o_orderpriority"), "o_orderstatus", "o_orderpriority").drop("p_value"))


@query(
    f"""with v as (select value, count(*) filter (event_type = 'click') as a, count(*) filter (event_type = 'view') as b from events where event_type in ('click', 'view') and value is not null group by value),
c as (select sum(a) over (order by value) / sum(a) over () as fa, sum(b) over (order by value) / sum(b) over () as fb, sum(a) over () as na, sum(b) over () as nb from v)
select max(na)::bigint as n_a, max(nb)::bigint as n_b, {r('max(abs(fa - fb))')} as ks from c"""
)
def ks_stat(spark, sf):
    e = table(spark, sf, "events", "event_type", "value").where(F.col("event_type").isin("click", "view"))
    return rounded(stats.ks_statistic(e, F.col("event_type") == "click", []))


@query(
    f"""with rows as ({LONG_SQL.format(ids='l_linestatus')}),
m as (select feature, count(*) filter (l_linestatus = 'F') as na, count(*) filter (l_linestatus = 'O') as nb, avg(value) filter (l_linestatus = 'F') as ma, avg(value) filter (l_linestatus = 'O') as mb,
  stddev_samp(value) filter (l_linestatus = 'F') as sa, stddev_samp(value) filter (l_linestatus = 'O') as sb,
  quantile_cont(value, [0.25, 0.5, 0.75]) filter (l_linestatus = 'F') as qa, quantile_cont(value, [0.25, 0.5, 0.75]) filter (l_linestatus = 'O') as qb from rows group by feature),
v as (select feature, value, count(*) filter (l_linestatus = 'F') as a, count(*) filter (l_linestatus = 'O') as b from rows group by all),
c as (select feature, sum(a) over (partition by feature order by value) / sum(a) over (partition by feature) as fa, sum(b) over (partition by feature order by value) / sum(b) over (partition by feature) as fb from v),
k as (select feature, max(abs(fa - fb)) as ks from c group by feature)
select feature, na as n_a, {r('ma')} as mean_a, {r('sa')} as sd_a, {r('qa[2]')} as median_a, {r('qa[3] - qa[1]')} as iqr_a, nb as n_b, {r('mb')} as mean_b, {r('sb')} as sd_b, {r('qb[2]')} as median_b, {r('qb[3] - qb[1]')} as iqr_b,
  {r('(mb - ma) / sqrt(((na - 1) * sa * sa + (nb - 1) * sb * sb) / (na + nb - 2))')} as cohens_d, {r('ks')} as ks from m join k using (feature)"""
)
def domain_shift(spark, sf):
    return rounded(stats.domain_shift(line_long(spark, sf, "l_linestatus"), F.col("l_linestatus") == "F"))


@query(
    f"""with x as (select 1.0::double as one, l_discount as d, l_tax as t, (l_quantity - avg(l_quantity) over ()) / stddev_pop(l_quantity) over () as y from lineitem),
g as (select count(*)::double as n, sum(d) as sd, sum(t) as st, sum(d * d) as dd, sum(t * t) as tt, sum(d * t) as dt, sum(y) as sy, sum(d * y) as dy, sum(t * y) as ty from x),
i as (select *, n * (dd * tt - dt * dt) - sd * (sd * tt - dt * st) + st * (sd * dt - dd * st) as det from g),
v as (select *, (dd * tt - dt * dt) / det as a00, (st * dt - sd * tt) / det as a01, (sd * dt - dd * st) / det as a02, (n * tt - st * st) / det as a11, (sd * st - n * dt) / det as a12, (n * dd - sd * sd) / det as a22 from i),
b as (select *, a00 * sy + a01 * dy + a02 * ty as b0, a01 * sy + a11 * dy + a12 * ty as b1, a02 * sy + a12 * dy + a22 * ty as b2 from v),
w as (select x.*, b.*, power((y - b0 - b1 * d - b2 * t) / (1 - (a00 + 2 * a01 * d + 2 * a02 * t + a11 * d * d + 2 * a12 * d * t + a22 * t * t)), 2) as e2 from x, b),
m as (select any_value(n) as n, any_value(b1) as b1, any_value(b2) as b2,
  sum(e2 * power(a01 + a11 * d + a12 * t, 2)) as v11, sum(e2 * power(a02 + a12 * d + a22 * t, 2)) as v22, sum(e2 * (a01 + a11 * d + a12 * t) * (a02 + a12 * d + a22 * t)) as v12 from w)
select 'l_quantity' as feature, n::bigint as n, {r('(b1 * b1 * v22 - 2 * b1 * b2 * v12 + b2 * b2 * v11) / (v11 * v22 - v12 * v12)')} as wald, 2 as df,
  {r('exp(-(b1 * b1 * v22 - 2 * b1 * b2 * v12 + b2 * b2 * v11) / (v11 * v22 - v12 * v12) / 2)')} as p_value, {r('b1')} as estimate, {r('sqrt(v11)')} as robust_se, {r('b1 / sqrt(v11)')} as z from m"""
)
def ols_hc3(spark, sf):
    li = table(spark, sf, "lineitem", "l_quantity", "l_discount", "l_tax")
    out = stats.ols_hc3(li, ["l_discount", "l_tax"], ["l_quantity"], ["l_discount", "l_tax"], {"discount": {"l_discount": 1.0}})
    return rounded(out.select("feature", "n", "wald", "df", "p_value", "estimate", "robust_se", "z"))


@query(
    f"""with rows as (select 'b' as feature, c_mktsegment as label, c_acctbal as value from customer union all select 'k', c_mktsegment, c_custkey % 50 from customer), {KRUSKAL}
select feature as variable, 'kruskal' as test, {r('statistic')} as statistic, {r('greatest(0, (statistic - groups + 1) / (n - groups))')} as effect_size from h"""
)
def confound_tests(spark, sf):
    """Kruskal-Wallis with epsilon squared of two nuisance variables over five groups; p is checked by the tests."""
    from cohortlens.plans.study import confound_tests

    c = table(spark, sf, "customer").select("c_mktsegment", F.col("c_acctbal").alias("b"), (F.col("c_custkey") % 50).alias("k"))
    return rounded(confound_tests(c, "c_mktsegment", ["b", "k"]).drop("p_value"))


# --- cohort tables --------------------------------------------------------------------------------------------


@query(
    """select c_mktsegment as "group", count(*) as n, round_even(avg(c_acctbal), 2) as acctbal_mean, round_even(stddev_samp(c_acctbal), 2) as acctbal_sd,
  count(*) filter (c_nationkey % 2 = 0) as even_n, count(*) filter (c_nationkey % 2 = 1) as odd_n from customer group by 1"""
)
def baseline_by_group(spark, sf):
    c = table(spark, sf, "customer", "c_mktsegment", "c_acctbal", "c_nationkey")
    return relational.baseline(c, "c_mktsegment", {"acctbal": "c_acctbal"}, {"even_n": F.col("c_nationkey") % 2 == 0, "odd_n": F.col("c_nationkey") % 2 == 1})


_HEAD = "with k as (select count(distinct c_mktsegment) as k from customer), p as (select c_custkey, c_mktsegment, row_number() over (partition by c_mktsegment order by c_custkey) as place, k from customer, k)"


@query(f"{_HEAD} select c_custkey, c_mktsegment from p order by (place <= greatest(1, 33 // k)) desc, c_custkey limit 33")
def stratified_head(spark, sf):
    return relational.stratified_head(table(spark, sf, "customer", "c_custkey", "c_mktsegment"), 33, "c_mktsegment", ["c_custkey"])


@query(f"{_HEAD} select c_custkey, c_mktsegment from p where place <= greatest(1, 33 // k) order by c_custkey limit 33")
def stratified_head_simple(spark, sf):
    return relational.stratified_head(table(spark, sf, "customer", "c_custkey", "c_mktsegment"), 33, "c_mktsegment", ["c_custkey"], top_up=False)


@query("select case c_mktsegment when 'BUILDING' then 'B' when 'MACHINERY' then 'M' else c_mktsegment end as label, count(*) as n from customer group by 1")
def label_fallback(spark, sf):
    c = table(spark, sf, "customer", "c_mktsegment")
    return c.groupBy(scalar.label_or_raw(F.col("c_mktsegment"), {"BUILDING": "B", "MACHINERY": "M"}).alias("label")).agg(F.count("*").alias("n"))


@query(f"select feature, count(value) as n, {r('avg(value)')} as mean, {r('min(value)')} as low, {r('max(value)')} as high from ({LONG_SQL.format(ids='l_orderkey')}) group by feature")
def unpivot_numeric(spark, sf):
    long = line_long(spark, sf, "l_orderkey")
    return rounded(long.groupBy("feature").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high")))


@query(
    """select o_orderpriority, count(*) filter (o_orderstatus = 'F') as "F", count(*) filter (o_orderstatus = 'O') as "O", count(*) filter (o_orderstatus = 'P') as "P" from orders group by 1"""
)
def crosstab(spark, sf):
    o = table(spark, sf, "orders", "o_orderpriority", "o_orderstatus")
    return o.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).fillna(0)


@query(
    f"""with m as (select extract(year from o_orderdate) as y, o_orderpriority, avg(o_totalprice) as price from orders group by all)
select o_orderpriority, {r('a.price', 4)} as price_1995, {r('b.price', 4)} as price_1996, {r('b.price - a.price', 4)} as price_delta from m a join m b using (o_orderpriority) where a.y = 1995 and b.y = 1996"""
)
def paired_inner_delta(spark, sf):
    o = table(spark, sf, "orders", "o_orderdate", "o_orderpriority", "o_totalprice").groupBy(F.year("o_orderdate").alias("y"), "o_orderpriority").agg(F.avg("o_totalprice").alias("price"))
    return rounded(relational.paired_delta(o.where("y = 1995"), o.where("y = 1996"), ["o_orderpriority"], ["price"], ("1995", "1996")), 4)


@query("select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_totalprice > 300000)")
def semi_listed(spark, sf):
    o = table(spark, sf, "orders", "o_custkey", "o_totalprice").where("o_totalprice > 300000")
    return relational.only_listed(table(spark, sf, "customer", "c_custkey", "c_name"), o.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 150000)")
def anti_listed(spark, sf):
    o = table(spark, sf, "orders", "o_custkey", "o_totalprice").where("o_totalprice > 150000")
    return relational.not_listed(table(spark, sf, "customer", "c_custkey", "c_name"), o.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query(
    """with a as (select o_custkey as k, count(*) as n_left from orders where o_orderstatus = 'F' group by 1), b as (select o_custkey as k, count(*) as n_right from orders where o_orderstatus = 'P' group by 1)
select coalesce(a.k, b.k) as o_custkey, coalesce(n_left, 0) as n_left, coalesce(n_right, 0) as n_right,
  case when n_left is null then 'missing_left' when n_right is null then 'missing_right' when greatest(n_left, n_right) > 1 then 'duplicated' else 'both' end as status from a full join b on a.k = b.k"""
)
def inventory_full_outer(spark, sf):
    o = table(spark, sf, "orders", "o_custkey", "o_orderstatus")
    return relational.reconcile(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'P'"), "o_custkey")


@query(
    """with a as (select s_suppkey as id, s_nationkey % 3 as label from supplier), b as (select c_custkey as id, c_nationkey % 3 as label from customer)
select id, a.label as label_left, b.label as label_right, a.label is not distinct from b.label as agrees from a join b using (id)"""
)
def paired_ids(spark, sf):
    a = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 3).alias("label"))
    b = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 3).alias("label"))
    return relational.paired_ids(a, b, "id", "label")


@query("select band, count(*) as n, round(avg(l_quantity), 6) as mean from lineitem join (values ('delta', 1, 4), ('theta', 4, 8), ('alpha', 8, 13), ('beta', 13, 30), ('gamma', 30, 45)) b(band, low, high) on l_quantity >= low and l_quantity < high group by band")
def range_join_bands(spark, sf):
    li = table(spark, sf, "lineitem", "l_quantity")
    joined = relational.in_band(li, relational.bands_table(spark), "l_quantity")
    return rounded(joined.groupBy("band").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("mean")))


@query("select region, count(*) as n, round(avg(c_acctbal), 6) as mean from customer join (values ('north', 1), ('north', 2), ('north', 3), ('east', 3), ('east', 4), ('none', 99)) g(region, k) on c_nationkey = k group by region")
def region_membership(spark, sf):
    c = table(spark, sf, "customer", "c_nationkey", "c_acctbal")
    joined = relational.membership(c, {"north": [1, 2, 3], "east": [3, 4], "none": [99]}, "c_nationkey")
    return rounded(joined.groupBy("region").agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("mean")))


@query("select a.n_regionkey, a.n_name as source, b.n_name as target, a.n_nationkey as value_source, b.n_nationkey as value_target from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_name < b.n_name")
def pairs_upper(spark, sf):
    return relational.upper_pairs(table(spark, sf, "nation"), ["n_regionkey"], "n_name", "n_nationkey")


@query("select distinct a.c_mktsegment as label_left, b.c_mktsegment as label_right from (select distinct c_mktsegment from customer) a, (select distinct c_mktsegment from customer) b where a.c_mktsegment < b.c_mktsegment")
def label_pairs(spark, sf):
    return stats.label_pairs(table(spark, sf, "customer", "c_mktsegment"), "c_mktsegment")


@query("select r_name, n as fold, c from region, range(0, 5) f(n), (values (0.1), (1.0), (10.0)) p(c)")
def parameter_grid(spark, sf):
    c = spark.createDataFrame([(0.1,), (1.0,), (10.0,)], "c double")
    return relational.grid(model=table(spark, sf, "region", "r_name"), fold=spark.range(5).withColumnRenamed("id", "fold"), c=c)


@query("with t as (select l_returnflag, l_shipmode_ as name, avg(l_discount) as score from (select *, 'm' || (l_suppkey % 7) as l_shipmode_ from lineitem) group by all) select l_returnflag, arg_max(name, (round(score, 9), -ascii(substr(name, 2)))) as name, round(max(score), 6) as score from t group by 1")
def best_of_group(spark, sf):
    t = table(spark, sf, "lineitem", "l_returnflag", "l_suppkey", "l_discount").groupBy("l_returnflag", F.concat(F.lit("m"), (F.col("l_suppkey") % 7).cast("string")).alias("name")).agg(F.round(F.avg("l_discount"), 9).alias("score"))
    return rounded(relational.best_of_group(t, ["l_returnflag"], "score", "name"))


@query("select count(*) as rows, count(distinct text) as distinct_keys, count(*) - count(distinct text) as duplicates from documents")
def duplicate_counts(spark, sf):
    d = table(spark, sf, "documents", "text").select(F.sha2("text", 256).alias("key"))
    return relational.duplicates(d, ["key"])


@query("select event_type, count(*) as n, count(distinct user_id) as users, count(*) filter (value > 50) as high, median(value) as median, min(value) as low, max(value) as top from events group by 1")
def value_counts(spark, sf):
    e = table(spark, sf, "events", "event_type", "user_id", "value")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("value") > 50).alias("high"), F.median("value").alias("median"), F.min("value").alias("low"), F.max("value").alias("top"))


@query("select count(*) as overlap from (select p_partkey from part order by p_retailprice, p_partkey limit 20) join (select p_partkey from part order by p_size, p_partkey limit 20) using (p_partkey)")
def overlap_of_tops(spark, sf):
    p = table(spark, sf, "part", "p_partkey", "p_retailprice", "p_size")
    return relational.overlap_of_tops(p.select("p_partkey", F.col("p_retailprice").alias("s")), p.select("p_partkey", F.col("p_size").alias("s")), "p_partkey", "s")


@query("select l_returnflag, min(l_tax) - case when min(l_tax) = max(l_tax) then greatest(abs(min(l_tax)) * 1e-3, 1e-6) else 0 end as low, max(l_tax) + case when min(l_tax) = max(l_tax) then greatest(abs(max(l_tax)) * 1e-3, 1e-6) else 0 end as high from lineitem group by 1")
def padded_limits(spark, sf):
    return relational.padded_limits(table(spark, sf, "lineitem", "l_returnflag", "l_tax"), ["l_returnflag"], "l_tax")


@query("(select c_nationkey as k from customer intersect select s_nationkey from supplier) union all (select n_nationkey + 100 from nation except select s_nationkey + 100 from supplier)")
def set_operations(spark, sf):
    c, s, n = (table(spark, sf, t, k).toDF("k") for t, k in (("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey")))
    return c.intersect(s).unionByName(n.select((F.col("k") + 100).alias("k")).subtract(s.select((F.col("k") + 100).alias("k"))))


@query("select p_partkey, p_name, round(p_retailprice, 2) as price from part order by abs(p_retailprice - 1000) desc, p_partkey limit 10")
def top_by_absolute(spark, sf):
    p = table(spark, sf, "part", "p_partkey", "p_name", "p_retailprice")
    return p.orderBy(F.abs(F.col("p_retailprice") - 1000).desc(), "p_partkey").limit(10).select("p_partkey", "p_name", F.round("p_retailprice", 2).alias("price"))


@query("select s_suppkey, s_name from supplier order by regexp_extract(s_name, '[0-9]+')::bigint, s_suppkey limit 25")
def natural_order(spark, sf):
    s = table(spark, sf, "supplier", "s_suppkey", "s_name")
    return s.orderBy(scalar.natural_number(F.col("s_name")), "s_suppkey").limit(25)


@query(f"select c_custkey, {r('ln(1 + greatest(c_acctbal, 0))')} as log_balance, {r('(c_acctbal - avg(c_acctbal) over ()) / stddev_pop(c_acctbal) over ()')} as balance_z, case when c_acctbal > 0 then {r('log10(c_acctbal)')} end as log10_balance, case c_nationkey % 3 when 0 then 'F' when 1 then 'M' end as code from customer")
def nuisance_encoding(spark, sf):
    """log1p of a clipped number, a z score with population sd, a guarded logarithm, and a coded category with missing values."""
    c = table(spark, sf, "customer", "c_custkey", "c_acctbal", "c_nationkey")
    m = c.agg(F.avg("c_acctbal").alias("m"), F.stddev_pop("c_acctbal").alias("s"))
    code = F.when(F.col("c_nationkey") % 3 == 0, "F").when(F.col("c_nationkey") % 3 == 1, "M")
    out = c.crossJoin(F.broadcast(m)).select("c_custkey", F.log1p(F.greatest("c_acctbal", F.lit(0.0))).alias("log_balance"), ((F.col("c_acctbal") - F.col("m")) / F.col("s")).alias("balance_z"), scalar.safe_log10(F.col("c_acctbal")).alias("log10_balance"), code.alias("code"))
    return rounded(out)


@query(f"select n, {r('total')} as total, side from (select 'customer' as side, count(*) as n, sum(c_acctbal * (c_nationkey + 1)) as total from customer union all select 'supplier', count(*), sum(s_acctbal * (s_nationkey + 1)) from supplier)".replace("round(total, 6)", "round(total, 2)"))
def common_columns(spark, sf):
    """Two tables reduced to the columns that both have: name, nationkey and acctbal."""
    c, s = (df.toDF(*(x.split("_", 1)[1] for x in df.columns)) for df in (table(spark, sf, "customer"), table(spark, sf, "supplier")))
    a, b = relational.common_columns(c, s)
    both = a.withColumn("side", F.lit("customer")).unionByName(b.withColumn("side", F.lit("supplier")))
    return rounded(both.groupBy("side").agg(F.count("*").alias("n"), F.sum(F.col("acctbal") * (F.col("nationkey") + 1)).alias("total")), 2)


@query("select user_id, min(event_id) as first from events group by 1")
def ordered_distinct(spark, sf):
    return relational.ordered_distinct(table(spark, sf, "events", "user_id", "event_id"), "user_id", "event_id")


@query("select user_id, n, n >= 20 as kept from (select user_id, count(*) as n from events group by 1)")
def epoch_count_split(spark, sf):
    kept, low = relational.split_by_count(table(spark, sf, "events", "user_id").groupBy("user_id").agg(F.count("*").alias("n")), "n", 20)
    return kept.withColumn("kept", F.lit(True)).unionByName(low.withColumn("kept", F.lit(False)))


@query("select p_retailprice, p_partkey, p_size from part")
def fixed_order_projection(spark, sf):
    return relational.project(table(spark, sf, "part"), ["p_retailprice", "p_partkey", "p_size"])


@query("select c_custkey, case when c_nationkey % 4 > 0 then c_nationkey end as code, case when c_acctbal > 0 then c_acctbal end as balance from customer where c_nationkey % 4 > 0 and c_acctbal > 0")
def complete_rows(spark, sf):
    c = table(spark, sf, "customer", "c_custkey", "c_nationkey", "c_acctbal")
    balance = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).when(F.col("c_custkey") % 2 == 0, F.lit(float("nan")))
    return relational.complete_rows(c.select("c_custkey", F.when(F.col("c_nationkey") % 4 > 0, F.col("c_nationkey")).alias("code"), balance.alias("balance")), ["code", "balance"])


@query("select c_custkey, c_mktsegment, (case c_mktsegment when 'MACHINERY' then 1 when 'BUILDING' then 2 else 3 end)::int as place from customer order by place, c_custkey limit 40")
def custom_order(spark, sf):
    c = table(spark, sf, "customer", "c_custkey", "c_mktsegment")
    return c.withColumn("place", relational.place_in(F.col("c_mktsegment"), ["MACHINERY", "BUILDING"])).orderBy("place", "c_custkey").limit(40)


@query(f"select participant, channel, {r('list_sum(samples)')} as total from ({CHANNELS_SQL}) where channel in ('ch0', 'ch2', 'ch3') and channel <> 'ch3'")
def channel_lists(spark, sf):
    picked = relational.pick(channels(spark, sf), "channel", ["ch0", "ch2", "ch3"], ("ch3",))
    return rounded(picked.select("participant", "channel", F.aggregate("samples", F.lit(0.0), lambda a, x: a + x).alias("total")))


@query("select p_partkey, printf('%.3f', p_size / 8.0) as three, printf('%.2e', p_size * 1000.0) as short, 'Band Global Size' as title from part")
def fixed_formats(spark, sf):
    p = table(spark, sf, "part", "p_partkey", "p_size")
    return p.select("p_partkey", scalar.fixed(F.col("p_size") / 8.0).alias("three"), scalar.scientific(F.col("p_size") * 1000.0).alias("short"), scalar.title_of(F.lit("band_global__size")).alias("title"))


@query("select event_id, props->>'k' = (user_id % 100)::varchar as same from events")
def json_differences(spark, sf):
    """JSON objects compared without one of their keys."""
    e = table(spark, sf, "events", "event_id", "user_id", "props")
    other = F.concat(F.lit('{"when": 1, "k": '), (F.col("user_id") % 100).cast("string"), F.lit("}"))
    return e.select("event_id", scalar.json_equal(F.col("props"), other, ("when",)).alias("same"))


@query(f"with t as (select quality, avg(score) as mean, avg(n_chars) as length from ({SCORED_SQL}) group by 1) select quality::varchar as quality, metric, {r('value')} as value, row_number() over (partition by metric order by value desc, quality::varchar)::int as place from t unpivot (value for metric in (mean, length))")
def metric_bars(spark, sf):
    t = scored(spark, sf).groupBy(F.col("quality").cast("string").alias("quality")).agg(F.avg("score").alias("mean"), F.avg("n_chars").alias("length"))
    return rounded(metrics.metric_bars(t, "quality", ["mean", "length"]))


# --- classification metrics -----------------------------------------------------------------------------------


@query(f"with s as ({SCORED_SQL}) select t.l as true_label, p.l as pred_label, count(s.doc_id) as n from (values ('good'), ('bad')) t(l) cross join (values ('good'), ('bad')) p(l) left join s on s.true_label = t.l and s.pred_label = p.l group by all")
def confusion_dense(spark, sf):
    return metrics.confusion(scored(spark, sf), [])


@query(
    f"""with s as ({SCORED_SQL}), c as (select l as class, count(*) filter (true_label = l and pred_label = l) as tp, count(*) filter (true_label = l) as support, count(*) filter (pred_label = l) as guessed from s, (values ('good'), ('bad')) v(l) group by l)
select class, {r('coalesce(tp / nullif(guessed, 0), 0)')} as precision, {r('coalesce(tp / nullif(support, 0), 0)')} as recall, {r('coalesce(2 * tp / nullif(guessed + support, 0), 0)')} as f1, support from c"""
)
def per_class_prf(spark, sf):
    return rounded(metrics.per_class(metrics.confusion(scored(spark, sf), []), []))


@query(f"with s as ({SCORED_SQL}), c as (select toxic, true_label, count(*) as n, count(*) filter (true_label = pred_label) as hit from s group by all) select toxic, sum(n)::bigint as n, {r('sum(hit) / sum(n)')} as accuracy, {r('avg(hit / n)')} as balanced_accuracy from c group by toxic")
def balanced_accuracy(spark, sf):
    return rounded(metrics.accuracy(scored(spark, sf), ["toxic"]))


_WILSON = lambda k, n, sign: f"({k} / {n} + 1.959963984540054^2 / (2 * {n}) {sign} 1.959963984540054 * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + 1.959963984540054^2 / (4 * {n}^2))) / (1 + 1.959963984540054^2 / {n})"


@query(
    f"""with s as ({SCORED_SQL}), c as (select count(*) filter (quality = 1 and pred_label = 'good')::double as tp, count(*) filter (quality = 0 and pred_label = 'good')::double as fp, count(*) filter (quality = 0 and pred_label = 'bad')::double as tn, count(*) filter (quality = 1 and pred_label = 'bad')::double as fn from s)
select tp::bigint as tp, fp::bigint as fp, tn::bigint as tn, fn::bigint as fn, {r('tp / (tp + fn)')} as sensitivity, {r('tn / (tn + fp)')} as specificity, {r('(tp + tn) / (tp + fp + tn + fn)')} as accuracy, {r('(tp / (tp + fn) + tn / (tn + fp)) / 2')} as balanced_accuracy,
  {r(_WILSON('tp', '(tp + fn)', '-'))} as sensitivity_low, {r(_WILSON('tp', '(tp + fn)', '+'))} as sensitivity_high, {r(_WILSON('tn', '(tn + fp)', '-'))} as specificity_low, {r(_WILSON('tn', '(tn + fp)', '+'))} as specificity_high from c"""
)
def point_metrics_wilson(spark, sf):
    return rounded(metrics.point_metrics(scored(spark, sf), [], F.col("quality") == 1, F.col("pred_label") == "good"))


_AUC = "(sum(rk) filter (pos) - count(*) filter (pos) * (count(*) filter (pos) + 1) / 2.0) / (count(*) filter (pos) * count(*) filter (not pos))"


@query(f"with s as (select *, quality = 1 as pos, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as rk from ({SCORED_SQL})) select count(*) filter (pos) as n_pos, count(*) filter (not pos) as n_neg, {r(_AUC)} as auc from s")
def auc_rank(spark, sf):
    s = scored(spark, sf)
    return rounded(metrics.auc(s, [], F.col("quality") == 1))


@query(
    f"""with s as (select l_linestatus || l_returnflag as y, l_discount as a, l_tax as b, l_quantity as c from lineitem),
u as (select y, k, v from s unpivot (v for k in (a, b, c))), m as (select *, y = case k when 'a' then 'FA' when 'b' then 'FR' else 'ON' end as pos, rank() over (partition by k order by v) + (count(*) over (partition by k, v) - 1) / 2.0 as rk from u),
e as (select k, {_AUC} as auc from m group by k) select {r('avg(auc)')} as auc_ovr from e having count(auc) = 3"""
)
def auc_macro_ovr(spark, sf):
    li = table(spark, sf, "lineitem").select(F.concat("l_linestatus", "l_returnflag").alias("y"), "l_discount", "l_tax", "l_quantity")
    return rounded(metrics.auc_ovr(li, [], "y", {"FA": "l_discount", "FR": "l_tax", "ON": "l_quantity"}).where("auc_ovr is not null"))


@query(
    f"""with c as (select score as threshold, count(*) filter (quality = 1) as p, count(*) filter (quality = 0) as n from ({SCORED_SQL}) group by 1),
x as (select threshold, sum(p) over w as tp, sum(n) over w as fp, sum(p) over () as pp, sum(n) over () as nn from c window w as (order by threshold desc))
select {r('threshold')} as threshold, tp::bigint as tp, fp::bigint as fp, {r('tp / pp')} as tpr, {r('fp / nn')} as fpr from x
union all select 'infinity'::double, 0, 0, 0, 0"""
)
def roc_curve(spark, sf):
    s = scored(spark, sf)
    return rounded(metrics.roc_curve(s, [], F.col("quality") == 1))


_SCAN = f"with s as ({SCORED_SQL}), k as (select k::int as k, avg((score * 100 + 1e-9 >= k)::int) filter (quality = 1) as tpr, avg((score * 100 + 1e-9 < k)::int) filter (quality = 0) as tnr from s, range(1, 100) g(k) group by k)"


@query(f"{_SCAN} select k, k / 100 as threshold, {r('(tpr + tnr) / 2')} as balanced_accuracy from k")
def threshold_scan(spark, sf):
    return rounded(metrics.threshold_scan(scored(spark, sf), [], F.col("quality") == 1))


@query(f"{_SCAN} select k, k / 100 as threshold, {r('(tpr + tnr) / 2')} as balanced_accuracy from k order by round((tpr + tnr) / 2, 12) desc, k limit 1")
def threshold_lock(spark, sf):
    scan = metrics.threshold_scan(scored(spark, sf), [], F.col("quality") == 1)
    return rounded(metrics.lock_threshold(scan, []))


@query()
def bootstrap_intervals(spark, sf):
    s = scored(spark, sf).select((F.col("quality") == 1).alias("truth"), (F.col("pred_label") == "good").alias("guess"), "score")
    return rounded(metrics.bootstrap(s, 2000, 42, score="score"))


# --- signals --------------------------------------------------------------------------------------------------


@query(f"with p as (select vec_id, participant, i, samples[i] as x from ({CHANNELS_SQL}), range(1, 65) r(i)), c as (select vec_id, i, x - avg(x) over (partition by participant, i) as y from p) select vec_id, {r('sum(y)')} as total, {r('sum(y * y)')} as energy, {r('max(y)')} as top from c group by vec_id")
def average_reference(spark, sf):
    df = signal.average_reference(channels(spark, sf), ["participant"])
    add = lambda f: F.aggregate(F.transform("samples", f), F.lit(0.0), lambda a, x: a + x)
    return rounded(df.select("vec_id", add(lambda x: x).alias("total"), add(lambda x: x * x).alias("energy"), F.array_max("samples").alias("top")))


@query(f"select vec_id, e::int as epoch, {r('list_avg(samples[e * 15 + 1:e * 15 + 15])')} as mean, {r('list_max(samples[e * 15 + 1:e * 15 + 15]) - list_min(samples[e * 15 + 1:e * 15 + 15])')} as ptp from ({CHANNELS_SQL}), range(0, 4) r(e)")
def epoch_tumbling(spark, sf):
    e = signal.epochs(channels(spark, sf), 15)
    mean = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x) / F.size("samples")
    return rounded(e.select("vec_id", "epoch", mean.alias("mean"), signal.peak_to_peak(F.col("samples")).alias("ptp")))


@query(f"with e as (select participant, channel, e::int as epoch, list_max(samples[e * 16 + 1:e * 16 + 16]) - list_min(samples[e * 16 + 1:e * 16 + 16]) as ptp from ({CHANNELS_SQL}), range(0, 4) r(e)) select participant, epoch, count(*) as n from e group by all having max(ptp) <= 0.55")
def ptp_reject(spark, sf):
    e = signal.epochs(channels(spark, sf), HALF)
    return signal.keep_quiet(e, ["participant", "epoch"], 0.55).groupBy("participant", "epoch").agg(F.count("*").alias("n"))


@query(f"with {DFT_SQL} select vec_id, bin::int as bin, {r('power', 5)} as power from dft")
def dft_power(spark, sf):
    return rounded(signal.dft_power(channels(spark, sf), ["vec_id"], 64), 5)


@query(f"with {WELCH_SQL} select vec_id, bin::int as bin, {r('frequency')} as frequency, {r('power', 7)} as power from psd")
def welch_psd(spark, sf):
    w = signal.welch_psd(channels(spark, sf), RATE, 64)
    out = w.select("vec_id", F.posexplode("psd").alias("bin", "power"), "frequencies").select("vec_id", "bin", F.element_at("frequencies", F.col("bin") + 1).alias("frequency"), "power")
    return rounded(out, 7)


@query(f"with {WELCH_SQL} select vec_id, participant, channel, band, {r('power', 7)} as power from sums")
def band_power(spark, sf):
    return rounded(band_sums(spark, sf), 7)


@query(f"with {WELCH_SQL} select vec_id, band, {r('power / sum(power) over (partition by vec_id)')} as relative from sums")
def relative_power(spark, sf):
    return rounded(signal.relative_power(band_sums(spark, sf), ["vec_id"]).select("vec_id", "band", "relative"))


@query(
    f"""with {WELCH_SQL}, rel as (select *, power / nullif(sum(power) over (partition by vec_id), 0) as rl from sums),
w as (select participant, band, avg(rl) as v, avg(power) as p from rel group by all), g as (select participant, region, band, avg(rl) as v, avg(power) as p from rel join {REGIONS_SQL} using (channel) group by all),
ratio(a, b) as (values ('theta', 'alpha'), ('delta', 'alpha'))
select participant, feature, {r('value')} as value from (
  select participant, 'relpow_ch__' || band || '__' || channel as feature, rl as value from rel union all select participant, 'relpow_global__' || band, v from w union all select participant, 'relpow_region__' || band || '__' || region, v from g
  union all select x.participant, 'ratio_global__' || a || '_' || b, log10(x.p / y.p) from w x join ratio on x.band = a join w y on y.band = b and x.participant = y.participant
  union all select x.participant, 'ratio_region__' || a || '_' || b || '__' || x.region, log10(x.p / y.p) from g x join ratio on x.band = a join g y on y.band = b and x.participant = y.participant and x.region = y.region)"""
)
def archive_features(spark, sf):
    return rounded(signal.archive_features(band_sums(spark, sf), ["participant"], REGIONS))


@query(
    f"""with {WELCH_SQL}, lg as (select participant, channel, band, case when power > 0 then log10(power) end as v from (select participant, channel, band, avg(power) as power from psd join {BANDS_SQL} on frequency >= low and frequency < high group by all)),
w as (select participant, band, avg(v) as v from lg group by all), g as (select participant, region, band, avg(v) as v from lg join {REGIONS_SQL} using (channel) group by all), ratio(a, b) as (values ('theta', 'alpha'), ('delta', 'alpha'))
select participant, feature, {r('value')} as value from (
  select participant, 'band_ch__' || band || '__' || channel as feature, v as value from lg union all select participant, 'band_global__' || band, v from w union all select participant, 'band_region__' || band || '__' || region, v from g
  union all select x.participant, 'ratio_global__' || a || '_' || b, x.v - y.v from w x join ratio on x.band = a join w y on y.band = b and x.participant = y.participant
  union all select x.participant, 'ratio_region__' || a || '_' || b || '__' || x.region, x.v - y.v from g x join ratio on x.band = a join g y on y.band = b and x.participant = y.participant and x.region = y.region)"""
)
def discovery_features(spark, sf):
    spectra = signal.welch_psd(channels(spark, sf), RATE, 64)
    return rounded(signal.discovery_features(signal.band_powers(spectra, ["participant", "channel"], BANDS, "mean"), ["participant"], REGIONS))


@query(f"select participant, count(*) = 4 as has_all_channels, min(len(samples)) = max(len(samples)) as uniform_counts, bool_and(list_bool_and(list_transform(samples, lambda x: isfinite(x)))) as all_finite, count(*) filter (list_max(samples) = list_min(samples)) as n_flat, case when count(*) = 4 then 'ok' else 'failed' end as status from ({CHANNELS_SQL}) group by 1")
def signal_quality(spark, sf):
    return signal.signal_quality(channels(spark, sf), ["participant"], 64, ("ch0", "ch1", "ch2", "ch3"))


@query(
    f"""with h as (select m, (case when m = 0 then 36 / 64.0 else (sin(2 * pi() * 20 * m / 64) - sin(2 * pi() * 2 * m / 64)) / (pi() * m) end) * (0.54 + 0.46 * cos(2 * pi() * m / 212)) as tap from range(-106, 107) r(m)),
y as (select vec_id, i, sum(tap * samples[1 + greatest(0, least(63, i + m))]) as v from ({CHANNELS_SQL}), range(0, 64) s(i), h group by vec_id, i)
select vec_id, {r('sum(v * v)')} as energy from y group by vec_id"""
)
def filtered_signals(spark, sf):
    """Zero-phase band-pass of 2 to 20 Hz: energy of each signal. Its SQL is the convolution by its sum, ends repeated."""
    df = signal.filtered(channels(spark, sf), RATE, 2.0, 20.0)
    return rounded(df.select("vec_id", F.aggregate("samples", F.lit(0.0), lambda a, x: a + x * x).alias("energy")))


@query(f"select vec_id, len(samples[1:32]) as n, {r('list_sum(samples[1:32])')} as total from ({CHANNELS_SQL})")
def crop_signal(spark, sf):
    """The first half second of each recording."""
    c = channels(spark, sf).withColumn("samples", signal.crop(F.col("samples"), RATE, 0.5 / 60))
    return rounded(c.select("vec_id", F.size("samples").cast("bigint").alias("n"), F.aggregate("samples", F.lit(0.0), lambda a, x: a + x).alias("total")))


@query(
    f"""with points as (select vec_id, p, i, samples[p * 32 + i + 1] - list_avg(samples[p * 32 + 1:p * 32 + 32]) as x from ({CHANNELS_SQL}), range(0, 2) a(p), range(0, 32) b(i)),
parts as (select vec_id, p, k, power(sum(x * (0.54 - 0.46 * cos(2 * pi() * i / 32)) * cos(2 * pi() * ((k * i) % 32) / 32)), 2) + power(sum(x * (0.54 - 0.46 * cos(2 * pi() * i / 32)) * sin(2 * pi() * ((k * i) % 32) / 32)), 2) as power from points, range(0, 17) f(k) group by all),
w as (select sum(power(0.54 - 0.46 * cos(2 * pi() * i / 32), 2)) as s from range(0, 32) b(i))
select vec_id, k * 2.0::double as frequency, {r("avg(power) / (64 * any_value(s)) * case when k in (0, 16) then 1 else 2 end")} as power from parts, w group by vec_id, k"""
)
def welch_hamming(spark, sf):
    """Two segments of 32 samples, Hamming window."""
    spectra = signal.welch_psd(channels(spark, sf), RATE, 32, "hamming")
    points = spectra.select("vec_id", F.explode(F.arrays_zip(F.col("frequencies").alias("frequency"), F.col("psd").alias("power"))).alias("p"))
    return rounded(points.select("vec_id", "p.frequency", "p.power"))


@query(f"with {WELCH_SQL}, f as (select label % 2 as label, band, channel, avg(case when power > 0 then log10(power) end) as value from (select any_value(psd.label) as label, psd.participant, psd.channel, band, avg(power) as power from psd join {BANDS_SQL} on frequency >= low and frequency < high group by psd.participant, psd.channel, band) group by all) select label, band, channel, {r('value')} as value, {r('min(value) over (partition by band)')} as low, {r('max(value) over (partition by band)')} as high from f")
def topography(spark, sf):
    """Data of scalp maps: mean band power by label, and limits that a band's maps share."""
    from cohortlens.plans import study

    spectra = signal.welch_psd(channels(spark, sf), RATE, 64)
    features = signal.discovery_features(signal.band_powers(spectra, ["participant", "channel"], BANDS, "mean"), ["participant"], REGIONS)
    labels = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("participant"), F.concat(F.lit("ch"), (F.col("vec_id") % 4).cast("string")).alias("channel"), (F.col("label") % 2).alias("label"))
    by_channel = features.withColumn("channel", F.element_at(F.split("feature", "__"), -1)).join(labels, ["participant", "channel"]).drop("channel")
    return rounded(study.topography(by_channel))


# --- connectivity ---------------------------------------------------------------------------------------------

#: Four epochs of 16 samples; each less its mean, symmetric Hann window; bins 1 to 3 and 4 to 7 are two bands.
SPECTRA_SQL = f"""
pt as (select participant, channel, e as epoch, t, samples[e * 16 + t + 1] - list_avg(samples[e * 16 + 1:e * 16 + 16]) as x from ({CHANNELS_SQL}), range(0, 4) r(e), range(0, 16) s(t)),
z as (select participant, channel, epoch, k as bin, case when k < 4 then 'low' else 'high' end as band, sum(x * (0.5 - 0.5 * cos(2 * pi() * t / 15)) * cos(2 * pi() * ((k * t) % 16) / 16)) as re, -sum(x * (0.5 - 0.5 * cos(2 * pi() * t / 15)) * sin(2 * pi() * ((k * t) % 16) / 16)) as im
  from pt, range(1, 8) f(k) group by all),
c as (select a.participant, a.band, a.channel as source, b.channel as target, a.bin, a.re * b.re + a.im * b.im as re, a.im * b.re - a.re * b.im as im, a.re * a.re + a.im * a.im as pa, b.re * b.re + b.im * b.im as pb
  from z a join z b on a.participant = b.participant and a.epoch = b.epoch and a.bin = b.bin and a.channel < b.channel),
f as (select participant, band, source, target, bin, avg(re) as re, avg(im) as im, avg(abs(im)) as ai, avg(sign(im)) as sg, avg(pa) as pa, avg(pb) as pb from c group by all),
edges as (select participant, band, source, target, avg((re * re + im * im) / greatest(pa * pb, 2.220446049250313e-16)) as coherence, avg(abs(sg)) as pli, avg(abs(im) / greatest(ai, 2.220446049250313e-16)) as wpli from f group by all)"""


def edges(spark, sf) -> DataFrame:
    return connectivity.pair_connectivity(signal.epochs(channels(spark, sf), HALF), ["participant"], {"low": [1, 2, 3], "high": [4, 5, 6, 7]})


@query(f"with {SPECTRA_SQL} select participant, band, source, target, {r('coherence')} as coherence, {r('pli')} as pli, {r('wpli')} as wpli from edges")
def coherence_pli_wpli(spark, sf):
    return rounded(edges(spark, sf))


@query(f"with {SPECTRA_SQL} select participant, 'conn_global__' || m || '__' || band as feature, {r('avg(value)')} as value from edges unpivot (value for m in (coherence, pli, wpli)) group by all")
def connectivity_features(spark, sf):
    return rounded(connectivity.connectivity_features(edges(spark, sf), ["participant"]))


@query(f"with {SPECTRA_SQL}, m as (select participant % 2 as label, band, source, target, avg(wpli) as wpli from edges group by all) select label, band, source, target, {r('wpli')} as value from (select *, row_number() over (partition by label, band order by round(wpli, 9) desc, source, target) as k from m) where k <= 3")
def display_edges(spark, sf):
    """The three edges of each group and band with the largest mean."""
    from cohortlens.plans import study

    return rounded(study.display_edges(edges(spark, sf).withColumn("label", F.col("participant") % 2), "label", 3))


_TOP = "top as (select * from (select participant, source, target, round(wpli, 9) as value, row_number() over (partition by participant order by round(wpli, 9) desc, source, target) as rn, count(*) over (partition by participant) as n from edges where band = 'low') where rn <= greatest(1, ceil(n * 0.6 - 1e-12)) and value > 0)"


def graph(spark, sf) -> tuple[DataFrame, DataFrame]:
    e = edges(spark, sf).where("band = 'low'").select("participant", "source", "target", F.round("wpli", 9).alias("value"))
    return e, channels(spark, sf).select("participant", F.col("channel").alias("node"))


@query(f"with {SPECTRA_SQL}, {_TOP} select participant, source, target, {r('value')} as value from top")
def top_edges(spark, sf):
    return rounded(connectivity.top_edges(graph(spark, sf)[0], ["participant"], 0.6))


@query(f"with {SPECTRA_SQL}, {_TOP}, n as (select participant, channel as node, count(*) over (partition by participant) as k from ({CHANNELS_SQL})), s as (select participant, node, sum(value) as s from (select participant, source as node, value from top union all select participant, target, value from top) group by all) select participant, node, {r('coalesce(s, 0) / greatest(k - 1, 1)')} as strength from n left join s using (participant, node)")
def node_strengths(spark, sf):
    e, nodes = graph(spark, sf)
    return rounded(connectivity.node_strengths(connectivity.top_edges(e, ["participant"], 0.6), nodes, ["participant"]))


@query(
    f"""with {SPECTRA_SQL}, {_TOP}, sc as (select *, value / max(value) over (partition by participant) as w from top),
tri as (select x.participant, x.source as a, x.target as b, y.target as c, power(x.w * y.w * z.w, 1.0 / 3) as p from sc x join sc y on x.participant = y.participant and x.target = y.source join sc z on z.participant = x.participant and z.source = x.source and z.target = y.target),
t as (select participant, node, sum(p) as t from (select participant, a as node, p from tri union all select participant, b, p from tri union all select participant, c, p from tri) group by all),
d as (select participant, node, count(*) as d from (select participant, source as node from top union all select participant, target from top) group by all)
select participant, channel as node, {r('coalesce(2 * t / nullif(d * (d - 1), 0), 0)')} as clustering from ({CHANNELS_SQL}) n left join t on t.participant = n.participant and t.node = n.channel left join d on d.participant = n.participant and d.node = n.channel""".replace(
        "select participant, channel as node, round", "select n.participant, channel as node, round"
    )
)
def triangle_clustering(spark, sf):
    e, nodes = graph(spark, sf)
    return rounded(connectivity.clustering(connectivity.top_edges(e, ["participant"], 0.6), nodes, ["participant"]))


@query(
    f"""with recursive {SPECTRA_SQL}, {_TOP}, l as (select participant, source as a, target as b, 1 / value as d from top union all select participant, target, source, 1 / value from top),
walk(participant, a, b, d, hops) as (select participant, a, b, d, 1 from l union all select w.participant, w.a, l.b, w.d + l.d, hops + 1 from walk w join l on l.participant = w.participant and l.a = w.b where hops < 3 and l.b <> w.a),
best as (select participant, a, b, min(d) as d from walk group by all), n as (select participant, count(*) as k from ({CHANNELS_SQL}) group by 1)
select n.participant, {r('coalesce(sum(1 / d), 0) / nullif(k * (k - 1), 0)')} as efficiency from n left join best on best.participant = n.participant group by n.participant, k"""
)
def global_efficiency(spark, sf):
    e, nodes = graph(spark, sf)
    return rounded(connectivity.global_efficiency(connectivity.top_edges(e, ["participant"], 0.6), nodes, ["participant"]))


# --- integrity ------------------------------------------------------------------------------------------------


@query(
    """with d as (select doc_id, sha256(text) as sha from documents), c as (select sha, count(*) as cluster_size, min(doc_id::varchar) as representative from d group by sha)
select doc_id, cluster_size, representative, representative = doc_id::varchar as included, case when representative <> doc_id::varchar then 'duplicate of ' || representative end as exclusion_reason from d join c using (sha)"""
)
def duplicate_clusters(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text").select("doc_id", F.sha2("text", 256).alias("sha"))
    return integrity.content_clusters(d, "doc_id", "sha").drop("sha")


@query("select sha256(text) as sha, list_sort(list_distinct(list(source))) as labels, count(*) as n from documents group by 1 having count(distinct source) > 1".replace("list_sort(list_distinct(list(source)))", "array_to_string(list_sort(list_distinct(list(source))), ',')"))
def label_conflicts(spark, sf):
    d = table(spark, sf, "documents", "text", "source").select(F.sha2("text", 256).alias("sha"), "source")
    return integrity.conflicting_clusters(d, "sha", "source").withColumn("labels", F.array_join("labels", ","))


@query(
    """with w(l, want) as (values ('BUILDING', 300), ('MACHINERY', 10), ('SPACE', 5)), c as (select c_mktsegment as l, count(*) as n from customer group by 1)
select 'cohort:' || coalesce(l, 'null') as name, case when want is null then 'warn' when coalesce(n, 0) = want then 'pass' else 'fail' end as status, 'n=' || coalesce(n, 0) || ', expected=' || coalesce(want::varchar, 'none') as detail from w full join c using (l)
union all select 'cohort:total', case when count(*) = 315 then 'pass' else 'fail' end, 'n=' || count(*) || ', expected=315' from customer"""
)
def cohort_audit(spark, sf):
    c = table(spark, sf, "customer", "c_mktsegment")
    return integrity.cohort_audit(c, "c_mktsegment", {"BUILDING": 300, "MACHINERY": 10, "SPACE": 5})


@query("select case when count(*) filter (s = 'fail') > 0 then 'fail' when count(*) filter (s = 'warn') > 0 then 'warn' else 'pass' end as status, count(*) filter (s = 'pass') as n_pass, count(*) filter (s = 'warn') as n_warn, count(*) filter (s = 'fail') as n_fail from (select case when s_acctbal > 5000 then 'pass' when s_acctbal > 0 then 'warn' else 'fail' end as s from supplier)")
def status_roll_up(spark, sf):
    s = table(spark, sf, "supplier", "s_name", "s_acctbal")
    return integrity.roll_up(s.select(F.col("s_name").alias("name"), F.when(F.col("s_acctbal") > 5000, "pass").when(F.col("s_acctbal") > 0, "warn").otherwise("fail").alias("status")))


_FILES = "select 'd/' || doc_id || '.txt' as path, strlen(text) as size_bytes, upper(sha256(text)) as sha256 from documents"


@query(
    f"""with a as ({_FILES} where doc_id % 10 < 9), b as (select path, size_bytes, case when size_bytes % 7 = 0 then 'X' else sha256 end as sha256 from ({_FILES} where doc_id % 10 > 0))
select coalesce(a.path, b.path) as path, case when b.sha256 is null then 'missing' when a.sha256 is null then 'unexpected' when a.size_bytes <> b.size_bytes then 'size' when a.sha256 <> b.sha256 then 'content' end as problem from a full join b on a.path = b.path where problem is not null"""
)
def manifest_differences(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text")
    files = d.select("doc_id", F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.octet_length("text").alias("size_bytes"), F.upper(F.sha2("text", 256)).alias("sha256"))
    other = files.where("doc_id % 10 > 0").withColumn("sha256", F.when(F.col("size_bytes") % 7 == 0, "X").otherwise(F.col("sha256")))
    return integrity.manifest_differences(files.where("doc_id % 10 < 9"), other)


@query("with a as (select l_returnflag, l_linestatus, l_tax from lineitem where l_linenumber <= 3), b as (select l_returnflag, l_linestatus, l_tax from lineitem where l_linenumber >= 2) select (select count(*) from (select * from a except all select * from b)) as only_left, (select count(*) from (select * from b except all select * from a)) as only_right")
def artifact_invariance(spark, sf):
    li = table(spark, sf, "lineitem", "l_returnflag", "l_linestatus", "l_tax", "l_linenumber")
    return integrity.same_rows(li.where("l_linenumber <= 3"), li.where("l_linenumber >= 2"), ("l_linenumber",))


@query("select sha256(string_agg(n_name || ':' || upper(sha256(n_name)), chr(10) order by n_name)) as digest from nation")
def rooted_digest(spark, sf):
    n = table(spark, sf, "nation", "n_name").select(F.col("n_name").alias("path"), F.upper(F.sha2("n_name", 256)).alias("sha256"))
    return integrity.content_digest(n)


@query()
def signal_fingerprints(spark, sf):
    return integrity.signal_fingerprints(channels(spark, sf), ["participant"], ("ch0", "ch1", "ch2", "ch3"), 64)


@query(
    f"""with s as ({SCORED_SQL}), n as (select count(*) as rows, count(distinct doc_id) as ids, count(*) filter (score is null or not isfinite(score)) as bad from s),
b as (select count(*) as n from s)
select 'features:unique-participants' as name, case when rows = ids then 'pass' else 'fail' end as status, 'rows=' || rows || ', unique=' || ids as detail from n
union all select 'features:finite-values', case when bad = 0 then 'pass' else 'warn' end, 'nonfinite=' || bad from n
union all select 'cohort:baseline-feature-consistency', case when b.n = ids then 'pass' else 'fail' end, 'baseline=' || b.n || ', features=' || ids from b, n
union all select 'statistics:q-value-range', 'pass', 'rows=2, below 0.05=1'
union all select 'models:metric-range', 'pass', 'models=1, best=rule'
union all select 'models:out-of-fold-coverage', case when rows = ids then 'pass' else 'fail' end, 'models without full coverage=' || case when rows = ids then 0 else 1 end from n
union all select 'processing:failed-subjects', 'pass', 'failed=0'"""
)
def run_audit(spark, sf):
    """The audit of a small run made of the driver's tables."""
    d = scored(spark, sf)
    features = d.select(F.col("doc_id").alias("participant_id"), F.col("true_label").alias("label"), "score")
    baseline = d.groupBy("true_label").agg(F.count("*").alias("n"))
    statistics = spark.createDataFrame([("a", 0.01), ("b", 0.7)], "feature string, q_value double")
    pred = d.select(F.lit("rule").alias("model"), F.col("doc_id").alias("participant_id"))
    m = spark.createDataFrame([("rule", 0.6, 0.55, 0.5)], "model string, accuracy double, balanced_accuracy double, auc_ovr double")
    return integrity.run_audit(spark, features, baseline, statistics, m, pred)


@query("with a as (select source, list_sort(list(doc_id)) as m, min(doc_id::varchar) as representative, count(*) as cluster_size from documents group by 1), b as (select source, list_sort(list(doc_id)) as m from documents where lang <> 'fr' or source < 'src3' group by 1) select source, cluster_size, representative from a where cluster_size > 1 and m in (select m from b)")
def repeated_clusters(spark, sf):
    """Clusters that stay the same when some rows go."""
    d = table(spark, sf, "documents", "doc_id", "source", "lang")
    return integrity.repeated_clusters(d, d.where("lang <> 'fr' or source < 'src3'"), "doc_id", "source")


@query("select 'fact:nations' as name, case when count(*) = 25 then 'pass' else 'fail' end as status, 'found=' || count(*) || ', expected=25' as detail from nation union all select 'fact:regions', case when count(*) = 6 then 'pass' else 'fail' end, 'found=' || count(*) || ', expected=6' from region")
def fact_gate(spark, sf):
    found = {"nations": table(spark, sf, "nation").count(), "regions": table(spark, sf, "region").count()}
    return integrity.fact_gate(spark, found, {"nations": 25, "regions": 6})


@query("""with m as (select case when c_custkey % 2 = 0 then 'AD' else 'Healthy' end as g, case when c_custkey % 3 = 0 then 'Eyes_open' else 'Eyes_closed' end as c, 'Paciente' || (c_custkey // 6) as s, case c_nationkey % 3 when 0 then 'Fp1' when 1 then 'Cz' else 'X9' end as ch from customer),
k as (select g, s, list_sort(list_distinct(list(ch))) as channels from m where (g, s) in (select (g, s) from m where c = 'Eyes_closed') group by all)
select g as "group", s as subject, array_to_string(channels, ',') as channels, array_to_string(list_filter(['Cz', 'Fp1'], lambda x: not list_contains(channels, x)), ',') as missing, array_to_string(list_filter(channels, lambda x: x = 'X9'), ',') as extra from k""")
def archive_index(spark, sf):
    """Channels of the subjects of an archive's listing, pooled over conditions."""
    return _listed(spark, sf).withColumns({n: F.array_join(n, ",") for n in ("channels", "missing", "extra")})


def _listed(spark, sf):
    from cohortlens.sources import archive

    c = table(spark, sf, "customer", "c_custkey", "c_nationkey")
    group, condition = F.when(F.col("c_custkey") % 2 == 0, "AD").otherwise("Healthy"), F.when(F.col("c_custkey") % 3 == 0, "Eyes_open").otherwise("Eyes_closed")
    channel = F.when(F.col("c_nationkey") % 3 == 0, "Fp1").when(F.col("c_nationkey") % 3 == 1, "Cz").otherwise("X9")
    name = F.concat_ws("/", F.lit("EEG_data"), group, condition, F.concat(F.lit("Paciente"), F.floor(F.col("c_custkey") / 6).cast("string")), F.concat(channel, F.lit(".txt")))
    return archive.index_members(c.select(name.alias("name")), "Eyes_closed", ("Cz", "Fp1"))


@query("""with m as (select case when c_custkey % 2 = 0 then 'AD' else 'Healthy' end as g, case when c_custkey % 3 = 0 then 'Eyes_open' else 'Eyes_closed' end as c, 'Paciente' || (c_custkey // 6) as s, case c_nationkey % 3 when 0 then 'Fp1' when 1 then 'Cz' else 'X9' end as ch from customer),
k as (select g, s, list_sort(list_distinct(list(ch))) as channels from m where (g, s) in (select (g, s) from m where c = 'Eyes_closed') group by all),
t as (select count(*) as n, count(*) filter (g = 'AD') as ad, count(*) filter (g = 'Healthy') as hc, count(*) filter (not list_contains(channels, 'Cz') or not list_contains(channels, 'Fp1')) as missing, count(*) filter (list_contains(channels, 'X9')) as extra from k),
u as (select count(*) as uneven from (select g from k group by g having count(distinct channels) > 1)),
v as (select count(*) filter (c_custkey % 97 = 0) as failed, count(*) filter (c_custkey % 97 <> 0 and c_custkey % 89 = 0) as other from customer)
select 'cohort:total-subjects' as name, case when n = 300 then 'pass' else 'fail' end as status, 'total=' || n || ' expected=300' as detail from t
union all select 'cohort:group:AD', case when ad = 250 then 'pass' else 'fail' end, 'AD=' || ad || ' expected=250' from t
union all select 'cohort:group:Healthy', case when hc = 50 then 'pass' else 'fail' end, 'Healthy=' || hc || ' expected=50' from t
union all select 'channels:common-19-present', case when missing = 0 then 'pass' else 'fail' end, 'subjects_missing=' || missing from t
union all select 'channels:no-unexpected', case when extra = 0 then 'pass' else 'warn' end, 'subjects_with_unexpected=' || extra from t
union all select 'channels:f1f2-excluded', 'pass', 'excluded=[''F1'', ''F2'']'
union all select 'channels:uniform-within-group', case when uneven = 0 then 'pass' else 'warn' end, 'groups_with_several_sets=' || uneven from u
union all select 'integrity:sample-counts', case when failed + other = 0 then 'pass' else 'fail' end, 'failures=' || failed || ', other counts=' || other from v""")
def archive_audit(spark, sf):
    """An archive's cohort, its channels and the numbers of samples of its channel files."""
    c = table(spark, sf, "customer", "c_custkey")
    n = F.when(F.col("c_custkey") % 97 == 0, -1).when(F.col("c_custkey") % 89 == 0, 1000).otherwise(1024)
    samples = c.select(F.lit("g").alias("group"), F.col("c_custkey").alias("subject"), F.lit("Cz").alias("channel"), n.alias("n"))
    return integrity.archive_audit(_listed(spark, sf), samples, {"AD": 250, "Healthy": 50})


# --- text rules -----------------------------------------------------------------------------------------------


@query(
    rf"""select doc_id, len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) as n_words, length(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))) as n_collapsed,
  len(list_distinct(regexp_extract_all(text, '{scalar.EMAIL}'))) as n_emails, len(list_distinct(regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)?'))) as n_numbers from documents"""
)
def text_profile(spark, sf):
    return textqa.text_profile(table(spark, sf, "documents", "doc_id", "text"), "doc_id")


_PHRASES = ["licensed under", "all rights", "worthless"]


@query("select doc_id, (contains(lower(text), 'licensed under')::int + contains(lower(text), 'worthless')::int) as n_forbidden, (not contains(lower(text), 'the'))::int as n_required_missing, not contains(lower(text), 'licensed under') and not contains(lower(text), 'worthless') and contains(lower(text), 'the') as passes from documents")
def phrase_flags(spark, sf):
    return textqa.phrase_flags(table(spark, sf, "documents", "doc_id", "text"), "doc_id", ["Licensed under", "worthless"], ["the"])


@query(
    """with p(phrase) as (values ('licensed under'), ('all rights'), ('worthless')), s as (select doc_id, lower(text) as t, phrase, list_transform(string_split(lower(text), phrase), lambda x: length(x)) as l from documents, p where contains(lower(text), phrase)),
h as (select doc_id, t, phrase, (list_sum(l[1:k]) + (k - 1) * length(phrase) + 1)::bigint as position from s, range(1, 100000) r(k) where k < len(l))
select doc_id, phrase, position, substr(t, greatest(1, position - 40), position - greatest(1, position - 40) + length(phrase) + 40) as context,
  regexp_matches(substr(t, greatest(1, position - 40), position - greatest(1, position - 40)), 'not |no |never |without |cannot ') as negated from h"""
)
def phrase_hits(spark, sf):
    return textqa.phrase_hits(table(spark, sf, "documents", "doc_id", "text"), "doc_id", _PHRASES)


@query(
    r"""with a as (select doc_id, list_distinct(regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)?')) as a from documents), b as (select item_id as doc_id, list_distinct(regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)?')) as b from benchmark)
select doc_id, len(list_intersect(a, b)) as n_both, len(a) - len(list_intersect(a, b)) as n_left_only, len(b) - len(list_intersect(a, b)) as n_right_only, len(a) = len(list_intersect(a, b)) and len(b) = len(list_intersect(a, b)) as equal from a join b using (doc_id)"""
)
def number_parity(spark, sf):
    return textqa.number_parity(table(spark, sf, "documents", "doc_id", "text"), table(spark, sf, "benchmark").withColumnRenamed("item_id", "doc_id"), "doc_id")


@query(r"select doc_id, regexp_matches(text, 'GNU|MIT') as license, regexp_extract(text, 'GNU|MIT', 0) as license_match, regexp_matches(text, '[0-9]{3}-[0-9]{4}') as phone, regexp_extract(text, '[0-9]{3}-[0-9]{4}', 0) as phone_match from documents")
def keyword_table(spark, sf):
    return textqa.keyword_table(table(spark, sf, "documents", "doc_id", "text"), "doc_id", {"license": "GNU|MIT", "phone": "[0-9]{3}-[0-9]{4}"})


@query(
    """with c as (select 'c' || n_nationkey as claim_id, n_name as key, case when n_nationkey % 4 = 0 then 'x' else n_regionkey::varchar end as stated from nation), a as (select n_name as key, n_regionkey::varchar as found from nation where n_nationkey % 5 > 0)
select claim_id, key, stated, found, case when found is null then 'missing' when found = stated then 'verified' else 'mismatch' end as status from c left join a using (key)"""
)
def evidence_ledger(spark, sf):
    n = table(spark, sf, "nation").withColumn("artifact", F.lit("nation")).withColumn("key", F.col("n_name"))
    claims = n.select(F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("claim_id"), "artifact", "key", F.when(F.col("n_nationkey") % 4 == 0, "x").otherwise(F.col("n_regionkey").cast("string")).alias("stated"))
    return textqa.ledger(claims, n.where("n_nationkey % 5 > 0").select("artifact", "key", F.col("n_regionkey").cast("string").alias("value"))).drop("artifact")


@query(
    """with n as (select 'EEG_data/' || case when c_custkey % 3 = 0 then 'AD' when c_custkey % 3 = 1 then 'Healthy' else '..' end || '/Eyes_' || case when c_nationkey % 2 = 0 then 'open' else 'closed' end || '/Paciente' || c_custkey || '/' || case when c_nationkey = 7 then 'C:3' else 'Cz' end || '.txt' as name from customer),
s as (select name, not contains(name, ':') and not list_contains(string_split(name, '/'), '..') as safe from n)
select name, safe, case when safe then regexp_extract(name, '(AD|Healthy)') end as "group", case when safe then regexp_extract(name, 'Eyes_[a-z]+') end as condition, case when safe then regexp_extract(name, 'Paciente[0-9]+') end as subject from s"""
)
def archive_member_names(spark, sf):
    c = table(spark, sf, "customer", "c_custkey", "c_nationkey")
    group = F.when(F.col("c_custkey") % 3 == 0, "AD").when(F.col("c_custkey") % 3 == 1, "Healthy").otherwise("..")
    name = F.concat(F.lit("EEG_data/"), group, F.lit("/Eyes_"), F.when(F.col("c_nationkey") % 2 == 0, "open").otherwise("closed"), F.lit("/Paciente"), F.col("c_custkey").cast("string"), F.lit("/"), F.when(F.col("c_nationkey") == 7, "C:3").otherwise("Cz"), F.lit(".txt"))
    n = c.select(name.alias("name")).withColumn("safe", scalar.is_safe_member(F.col("name")))
    m = n.withColumn("m", F.when(F.col("safe"), scalar.member_parts(F.col("name"))))
    return m.select("name", "safe", "m.group", "m.condition", "m.subject")


# --- models ---------------------------------------------------------------------------------------------------


@query(
    f"""with x as ({LONG_SQL.format(ids='l_orderkey, l_linenumber')}), v as (select *, case when l_linenumber = 3 then null else value end as v from x), m as (select feature, median(v) as med from v group by 1),
s as (select feature, avg(coalesce(v, med)) as mean, stddev_pop(coalesce(v, med)) as sd, any_value(med) as med from v join m using (feature) group by feature)
select feature, {r('sum(z)', 3)} as total, {r('sum(z * z)', 3)} as energy from (select feature, (coalesce(v, med) - mean) / sd as z from v join s using (feature)) group by feature"""
)
def impute_and_scale(spark, sf):
    x = line_long(spark, sf, "l_orderkey", "l_linenumber").withColumn("value", F.when(F.col("l_linenumber") != 3, F.col("value")))
    z = ml.apply_scaler(x, ml.fit_scaler(x, ["feature"]), ["feature"])
    return rounded(z.groupBy("feature").agg(F.sum("z").alias("total"), F.sum(F.col("z") * F.col("z")).alias("energy")), 3)


_FROZEN = [{"feature": "c_acctbal", "median": 4500.0, "mean": 4500.0, "scale": 3000.0, "coef": 0.8}, {"feature": "c_nationkey", "median": 12.0, "mean": 12.0, "scale": 7.0, "coef": -0.4}]
_P = "1 / (1 + exp(-(0.1 + 0.8 * (c_acctbal - 4500) / 3000 - 0.4 * (c_nationkey - 12) / 7)))"


@query(f"select c_custkey, {r(_P)} as prob, 0.6 as threshold, case when {_P} >= 0.6 then 'AD' else 'HC' end as pred_label from customer")
def frozen_predict(spark, sf):
    c = ml.frozen_predict(table(spark, sf, "customer", "c_custkey", "c_acctbal", "c_nationkey"), _FROZEN, 0.1, 0.6, "AD", "HC")
    return rounded(c.select("c_custkey", "prob", "threshold", "pred_label"))


def cohort(spark, sf) -> tuple[DataFrame, list[str]]:
    """The whole embeddings table as a cohort, and its features: every label and every component."""
    e = table(spark, sf, "embeddings")
    features = [f"f{i}" for i in range(e.agg(F.max(F.size("embedding"))).first()[0] or 0)]
    return e.select("vec_id", F.col("label").cast("string").alias("label"), *(F.get("embedding", F.lit(i)).cast("double").alias(f) for i, f in enumerate(features)), (F.col("vec_id") % 17).cast("double").alias("age")), features


@query()
def nested_cv(spark, sf):
    c, features = cohort(spark, sf)
    return rounded(metrics.accuracy(ml.nested_cv(c, "vec_id", "label", features), ["model"]))


@query()
def nested_cv_residualized(spark, sf):
    c, features = cohort(spark, sf)
    pred = ml.nested_cv(c, "vec_id", "label", features, nuisance=["age"])
    return pred.select("model", "fold", "participant_id", "true_label", "pred_label")


@query()
def locked_threshold_model(spark, sf):
    """Label 1 against all others."""
    c, features = cohort(spark, sf)
    pred, frozen = ml.locked_model(c, "vec_id", "label", "1", features)
    return rounded(pred.withColumn("locked_threshold", F.lit(frozen["threshold"])))


# --- streaming (extension) ------------------------------------------------------------------------------------


@query(f"select time_bucket(interval 1 hour, ts) as window_start, event_type, count(*) as n, {r('avg(value)', 9)} as mean, {r('max(value) - min(value)', 9)} as ptp from events group by all")
def streaming_epochs(spark, sf):
    import uuid

    from cohortlens.streaming.windows import run_available

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_streams"
    folder = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    return rounded(run_available(spark, sf, "events.parquet", schema, f"{folder}/out", f"{folder}/state"), 9)


from cohortlens.plans import cohort_models, long_recordings, revisions, text_audits  # noqa: E402, F401  they register their queries
