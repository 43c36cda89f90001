"""Mixing sources to target weights by hierarchical budgeting (operator 4).

Sources hang below languages, languages below domains. Budgets go down this tree: each node's budget is shared
among its children by weight, where no child gets more than the leaves below it can take (a leaf with a weight can
take its documents' tokens times the epochs, one without takes nothing). What a child cannot take goes to its
siblings by their weights, so a shortage is made up for next to where it arises and reaches a higher level only if
all siblings are used up. Tokens that the division leaves over go to the largest remainders. A leaf's budget is
taken as a prefix of its tokens: its documents stand in a seeded order, a new one for each epoch, and are taken
until the budget is used; the last document gives a prefix of its own tokens.

A leaf may hold most rows, so it is never ordered as a whole: hashes deal its documents into slots, sums over
slots tell the one that holds the budget's end, and only that slot's documents are ordered. Rows that are equal in
doc_id, text, language and source are counted first and stand in the order as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import WORD, materialise, read

SEED, EPOCHS, PERCENT = 17, 2, 60
#: Weights are integers; a name that is not listed has DEFAULT. Domains are sources by number, modulo 3.
DEFAULT = 10
WEIGHTS = {
    "domain": {"d0": 20, "d1": 50, "d2": 30},
    "lang": {"en": 50, "de": 20, "fr": 20, "es": 10},
    "source": {"src1": 40, "src3": 20, "src4": 1},
}
LEVELS = ("domain", "lang", "source")
#: Documents of a leaf that a slot holds, as the power of their number.
SLOT_POWER = 0.5


def domain_of(source: Column) -> Column:
    """The domain of a source: by its number modulo 3; other when it has none."""
    number = F.regexp_extract(source, r"([0-9]{1,9})\z", 1)
    return F.when(number != "", F.concat(F.lit("d"), (number.cast("long") % 3).cast("string"))).otherwise("other")


def tokens_of(text: Column) -> Column:
    """Words of a text."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))), F.lit(0)).cast("long")


def _weight(level: str, weights: dict) -> Column:
    listed = weights.get(level) or {}
    if any(w < 0 or w != int(w) for w in listed.values()):
        raise ValueError("weights are integers of 0 or more")
    out = F.lit(DEFAULT)
    for name, w in listed.items():
        out = F.when(F.col(level) == name, F.lit(int(w))).otherwise(out)
    return out.cast("long")


def _share(nodes: DataFrame, parents: list[str]) -> DataFrame:
    """Adds take to nodes (name columns, weight, cap, and budget of their parent).

    In the order of cap over weight, a node is full if the share it would get of what is left is at least its
    cap; the others share the rest: whole tokens first, then one more for each of the largest remainders (at a
    tie the first by name). All numbers are integers.
    """
    rank = Window.partitionBy(*parents).orderBy((F.col("cap") / F.col("weight")).asc_nulls_last(), *LEVELS)
    before = rank.rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*parents)
    big = lambda c: c.cast("decimal(19,0)")
    out = (
        nodes.withColumn("weight", F.when((F.col("weight") > 0) & (F.col("cap") > 0), F.col("weight")))
        .withColumn("left_tokens", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(group) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("full", F.coalesce(F.col("weight").isNotNull() & (big(F.col("left_tokens")) * big(F.col("weight")) >= big(F.col("cap")) * big(F.col("left_weight"))), F.lit(False)))
        .withColumn("rest", F.greatest(F.lit(0), F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(group), F.lit(0))))
        .withColumn("rest_weight", F.sum(F.when(~F.col("full"), F.col("weight"))).over(group))
        .withColumn("open", ~F.col("full") & F.col("weight").isNotNull())
        .withColumn("product", F.when(F.col("open"), big(F.col("rest")) * big(F.col("weight"))))
        .withColumn("whole", F.expr("product div rest_weight"))
        .withColumn("part", F.expr("product % rest_weight"))
        .withColumn("spare", F.col("rest") - F.coalesce(F.sum("whole").over(group), F.lit(0)))
    )
    line = Window.partitionBy(*parents).orderBy(F.col("part").desc_nulls_last(), *LEVELS)
    more = F.when(F.row_number().over(line) <= F.col("spare"), 1).otherwise(0)
    take = F.when(F.col("weight").isNull(), 0).when(F.col("full"), F.col("cap")).otherwise(F.least("cap", F.col("whole") + more))
    return out.withColumn("take", take.cast("long")).drop("left_tokens", "left_weight", "full", "rest", "rest_weight", "open", "product", "whole", "part", "spare")


def leaf_budgets(leaves: DataFrame, weights: dict, percent: int, epochs: int) -> DataFrame:
    """domain, lang, source, docs, supply, take for each leaf (domain, lang, source, docs, supply).

    The whole budget is percent of all tokens, rounded down. A node's cap is what the leaves below it can take:
    nothing where a weight on the way down is 0.
    """
    whole = leaves.agg(F.coalesce(F.sum("supply"), F.lit(0)).alias("s")).select(F.expr(f"s * {int(percent)} div 100").cast("long").alias("budget"))
    able = lambda level, cap: F.when(_weight(level, weights) > 0, cap).otherwise(0).cast("long").alias("cap")
    caps = leaves.select("*", able("source", F.col("supply") * epochs))
    by_lang = caps.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).select("domain", "lang", able("lang", F.col("cap")))
    by_domain = by_lang.groupBy("domain").agg(F.sum("cap").alias("cap")).select("domain", able("domain", F.col("cap"))).crossJoin(F.broadcast(whole))  # one row
    none = [F.lit(None).cast("string").alias(n) for n in LEVELS]
    domains = _share(by_domain.select("domain", none[1], none[2], "cap", "budget", _weight("domain", weights).alias("weight")), ["budget"])
    langs = by_lang.join(domains.select("domain", F.col("take").alias("budget")), "domain")
    langs = _share(langs.select("domain", "lang", none[2], "cap", "budget", _weight("lang", weights).alias("weight")), ["domain"])
    sources = caps.join(langs.select("domain", "lang", F.col("take").alias("budget")), ["domain", "lang"])
    return _share(sources.withColumn("weight", _weight("source", weights)), ["domain", "lang"]).select(*LEVELS, "docs", "supply", "take")


#: What a row is ordered by and what has to be equal for rows to be one.
ROW = (*LEVELS, "doc_id", "row_hash", "n_tokens")


def _keyed(docs: DataFrame, also: tuple = ()) -> DataFrame:
    """The columns ROW of each row, and those named in also under their own names with an underscore before them."""
    text = F.col("text").cast("string")
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("none")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("none")).alias("source"),
        F.md5(F.coalesce(text, F.lit(""))).alias("row_hash"),
        tokens_of(text).alias("n_tokens"),
        *(F.col(f"`{c}`").alias(f"_{c}") for c in also),
    )
    return base.withColumn("domain", domain_of(F.col("source"))).select(*ROW, *(f"_{c}" for c in also))


def _wanted(counted: DataFrame, weights: dict, percent: int, epochs: int) -> DataFrame:
    """Per leaf: whole epochs that the budget covers, what it wants of the epoch after them, and its slots."""
    leaves = counted.groupBy(*LEVELS).agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("supply"))
    taken = leaf_budgets(materialise(leaves, "leaves"), weights, percent, epochs).where("take > 0")
    slots = F.ceil(F.pow("docs", F.lit(SLOT_POWER))).cast("long").alias("slots")
    return materialise(taken.select(*LEVELS, F.expr("take div supply").alias("whole"), F.expr("take % supply").alias("rest"), slots), "wanted")


def _last_epoch(counted: DataFrame, wanted: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """What the epoch that a budget ends in takes: rows of ROW, copies and epoch that it takes wholly, and those at its
    end, of which it takes the first fulls copies and part tokens of one more. Of these a leaf has one at most."""
    placed = counted.join(wanted.where("rest > 0"), list(LEVELS)).groupBy(*ROW, "whole", "rest", "slots").agg(F.count("*").alias("copies"))
    key = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "row_hash"))
    number = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    last = placed.withColumn("key", key).withColumn("slot", F.floor(number * F.col("slots") / F.lit(4294967296)).cast("long")).withColumn("held", F.col("copies") * F.col("n_tokens"))
    last = materialise(last, "last")
    sums = last.groupBy(*LEVELS, "slot").agg(F.sum("held").alias("tokens"))
    running = Window.partitionBy(*LEVELS).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = materialise(sums.withColumn("before", F.coalesce(F.sum("tokens").over(running), F.lit(0))), "slots")
    dealt = last.join(slots, [*LEVELS, "slot"]).where("before < rest").withColumn("epoch", F.col("whole").cast("int"))
    order = Window.partitionBy(*LEVELS, "slot").orderBy("key", F.col("doc_id").asc_nulls_first(), "row_hash").rowsBetween(Window.unboundedPreceding, -1)
    edge = dealt.where("before + tokens > rest").withColumn("start", F.col("before") + F.coalesce(F.sum("held").over(order), F.lit(0))).where("start < rest")
    whole = dealt.where("before + tokens <= rest").select(*ROW, "epoch").unionByName(edge.where("start + held <= rest").select(*ROW, "epoch"))
    cut = edge.where("start + held > rest").select(*ROW, "epoch", F.expr("(rest - start) div n_tokens").alias("fulls"), F.expr("(rest - start) % n_tokens").alias("part"))
    return whole, materialise(cut, "edge")


def _copies(cut: DataFrame) -> DataFrame:
    """A row with take_tokens for each copy that is taken of a row at a budget's end; numbers are made in two steps, so
    that none of the arrays is as long as the copies are many."""
    step = 1 << 16
    blocks = cut.where("fulls > 0").withColumn("_block", F.explode(F.expr(f"sequence(0L, fulls - 1, {step}L)")))
    each = blocks.withColumn("_copy", F.explode(F.expr(f"sequence(_block, least(_block + {step}L, fulls) - 1)"))).drop("_block", "_copy")
    return each.withColumn("take_tokens", F.col("n_tokens")).unionByName(cut.where("part > 0").withColumn("take_tokens", F.col("part"))).drop("fulls", "part")


def mix(docs: DataFrame, weights: dict = WEIGHTS, percent: int = PERCENT, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """domain, lang, source, epoch (from 0), doc_id, n_tokens, take_tokens of each document taken.

    Tokens are words. A document is taken once an epoch at most; take_tokens is less than n_tokens only for the last
    document of a leaf. A null language or source is named none. A null text or one without words has no tokens
    and is never taken; a very long text is one row like any other. Documents of a leaf and epoch are ordered by the
    MD5 of seed, epoch, doc_id (null as an empty string) and the text's MD5, then by doc_id and the text's MD5;
    equal rows are taken one after the other. Leaves whose names are not in the weights have DEFAULT; a weight of 0
    takes nothing. Other columns are not read; an empty table gives an empty result.
    """
    counted = materialise(_keyed(docs).where("n_tokens > 0"), "counted")
    wanted = _wanted(counted, weights, percent, epochs)
    whole, cut = _last_epoch(counted, wanted, seed)
    numbers = F.explode(F.expr("transform(sequence(0L, whole - 1), x -> int(x))")).alias("epoch")
    every = counted.join(wanted.where("whole > 0"), list(LEVELS)).select(*ROW, numbers)
    last = counted.alias("c").join(whole.alias("w"), F.expr(" and ".join(f"c.{c} <=> w.{c}" for c in ROW))).select(*(f"c.{c}" for c in ROW), "w.epoch")
    taken = every.unionByName(last).withColumn("take_tokens", F.col("n_tokens")).unionByName(_copies(cut).select(*ROW, "epoch", "take_tokens"))
    return taken.select(*LEVELS, "epoch", "doc_id", "n_tokens", "take_tokens")


def first_words(text: Column, count: Column) -> Column:
    """The text up to the end of its count-th word, white space as it stands."""
    pieces = F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*" + WORD + ")"), F.lit(1))
    return F.array_join(F.slice(pieces, 1, count.cast("int")), "")


def taken(docs: DataFrame, weights: dict = WEIGHTS, percent: int = PERCENT, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """The documents that mix() takes, with the columns of docs; a document taken in part ends after its last word taken.

    A row stands once for each epoch that takes it, rows with a null or repeated doc_id too. Of rows that are equal in
    doc_id, text, language and source, of which a budget's end takes some, any stands for the others. n_chars, where
    it is a column, follows the text. Extra columns are handed on; an empty table gives an empty result.
    """
    counted = materialise(_keyed(docs).where("n_tokens > 0"), "counted")
    wanted = _wanted(counted, weights, percent, epochs)
    whole, cut = _last_epoch(counted, wanted, seed)
    rows = _keyed(docs, tuple(docs.columns)).where("n_tokens > 0")
    held = [f"_{c}" for c in docs.columns]
    every = rows.join(wanted.where("whole > 0"), list(LEVELS)).select(*held, F.explode(F.expr("sequence(0L, whole - 1)"))).select(*held)
    same = F.expr(" and ".join(f"c.{c} <=> w.{c}" for c in ROW))
    last = rows.alias("c").join(whole.alias("w"), same).select(*(f"c.`{c}`" for c in held))
    one = rows.alias("c").join(cut.alias("w"), same).groupBy(*(F.col(f"w.{c}").alias(c) for c in (*ROW, "epoch", "fulls", "part"))).agg(F.first(F.struct(*(F.col(f"c.`{c}`") for c in held))).alias("row"))
    parts = _copies(one).select(*(F.col("row").getField(c).alias(c) for c in held), "take_tokens", "n_tokens")
    text = F.when(F.col("take_tokens") < F.col("n_tokens"), first_words(F.col("_text"), F.col("take_tokens"))).otherwise(F.col("_text"))
    parts = parts.withColumn("_text", text)
    if "n_chars" in docs.columns:
        parts = parts.withColumn("_n_chars", F.when(F.col("take_tokens") < F.col("n_tokens"), F.char_length("_text")).otherwise(F.col("_n_chars")).cast(docs.schema["n_chars"].dataType))
    out = every.unionByName(last).unionByName(parts.select(*held))
    return out.select(*(F.col(f"`_{c}`").alias(c) for c in docs.columns))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same budgets by another road: a level's shares come from filling up its tightest child again and again.

    Each round settles the children that would get at least what they can take of what is left; at most as many
    rounds as the widest level has children are needed.
    """

    def weight(level: str) -> str:
        listed = " ".join(f"when '{n}' then {w}" for n, w in WEIGHTS[level].items())
        return f"case {level} {listed} else {DEFAULT} end"

    def share(name: str, source: str) -> str:
        """source: parent, child, w, cap, budget. Gives parent, child, take."""
        return f"""
{name}_fill(round, parent, child, w, cap, budget, done) as (
  select 0, parent, child, w, cap, budget::hugeint, false from {source} where w > 0 and cap > 0
  union all
  select round + 1, parent, child, w, cap, budget, done or cap * open_w <= w * (budget - gone) from (
    select *, coalesce(sum(w) filter (not done) over (partition by parent), 0)::hugeint as open_w, coalesce(sum(cap) filter (done) over (partition by parent), 0)::hugeint as gone,
      bool_or(not done) over () as any_open from {name}_fill) where any_open and round < 100),
{name}_end as (select *, greatest(budget - coalesce(sum(cap) filter (done) over (partition by parent), 0), 0)::hugeint as rest, sum(w) filter (not done) over (partition by parent)::hugeint as open_w
  from {name}_fill where round = (select max(round) from {name}_fill)),
{name}_whole as (select *, case when not done then rest * w // open_w end as base, case when not done then rest * w % open_w end as part from {name}_end),
{name} as (select parent, child, (case when done then cap else base + case when row_number() over (partition by parent order by part desc nulls last, child) <= rest - sum(coalesce(base, 0)) over (partition by parent) then 1 else 0 end end)::bigint as take
  from {name}_whole)"""

    word = WORD.replace("'", "''")
    return f"""
with recursive base as (
  select doc_id, coalesce(lang, 'none') as lang, coalesce(source, 'none') as source, md5(coalesce(text, '')) as h, len(regexp_extract_all(coalesce(text, ''), '{word}'))::bigint as n_tokens from documents),
counted as (
  select *, case when regexp_matches(source, '[0-9]{{1,9}}\\z') then 'd' || (regexp_extract(source, '([0-9]{{1,9}})\\z', 1)::bigint % 3) else 'other' end as domain from base where n_tokens > 0),
leaf as (select domain, lang, source, sum(n_tokens)::bigint as supply, {weight('domain')} as dw, {weight('lang')} as lw, {weight('source')} as sw from counted group by domain, lang, source),
s_cap as (select *, case when sw > 0 then supply * {EPOCHS} else 0 end as cap from leaf),
l_cap as (select domain, lang, any_value(dw) as dw, any_value(lw) as lw, case when any_value(lw) > 0 then sum(cap) else 0 end as cap from s_cap group by domain, lang),
d_cap as (select domain, any_value(dw) as dw, case when any_value(dw) > 0 then sum(cap) else 0 end as cap from l_cap group by domain),
d_in as (select '' as parent, domain as child, dw as w, cap, (select (sum(supply) * {PERCENT} // 100) from leaf) as budget from d_cap),
{share('d', 'd_in')},
l_in as (select domain as parent, lang as child, lw as w, cap, take as budget from l_cap join d on domain = child),
{share('l', 'l_in')},
s_in as (select domain || chr(31) || lang as parent, source as child, sw as w, cap, take as budget from s_cap join l on domain = parent and lang = child),
{share('s', 's_in')},
wanted as (select domain, lang, source, take, supply from leaf join s on parent = domain || chr(31) || lang and child = source where take > 0),
epochs as (select unnest(range({EPOCHS})) as epoch),
lined as (
  select domain, lang, source, epoch::int as epoch, doc_id, n_tokens, take - epoch * supply as rest,
    coalesce(sum(n_tokens) over (partition by domain, lang, source, epoch order by md5('{SEED}-' || epoch || '-' || coalesce(doc_id::varchar, '') || '-' || h), doc_id nulls first, h rows between unbounded preceding and 1 preceding), 0) as start
  from counted join wanted using (domain, lang, source), epochs where take > epoch * supply)
select domain, lang, source, epoch, doc_id, n_tokens, least(n_tokens, rest - start)::bigint as take_tokens from lined where start < rest
"""


SQL = _sql()
