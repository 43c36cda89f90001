"""Filter interaction audit (operator 13).

Filters that look at one document, and one that finds copies, give each document a failure flag for each filter.
SQL CUBE over the flags and the part counts every combination of selected flags at once; its rows whose selected
flags are all false are the survivors of that subset of filters, whatever the order they are applied in. A step of
an order goes from one subset to the next one, so all orders' steps are joins of pairs of subsets.

Documents are counted before they are cubed: rows that are alike in everything that matters are one row with a
count, which is also how groups of copies of any size are dealt with, and what CUBE multiplies is at most 2 to the
number of filters for each part.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import materialise, read

#: Between words; a word is what the pattern WORD of common.py finds.
SPACE = r"[\x20\x09-\x0D]+"
#: The place of the filter that finds copies: a document fails if one of a smaller doc_id has its text.
COPY = "copy"
#: The contract's failure conditions, of a text and its words.
FILTERS: dict[str, Callable[[Column, Column], Column] | str] = {
    "A": lambda text, words: F.size(words) < 100,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
    "C": lambda text, words: 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 10 * F.length(text),
    "D": lambda text, words: text.rlike("[#$%&*|]"),
    "E": COPY,
}
#: Orders stand in the plan as literals, so their number is bounded.
MOST_FILTERS = 6
MEASURES = ("n", "good", "toxic")


def cells(docs: DataFrame, labels: DataFrame, filters=FILTERS, part: str = "lang") -> DataFrame:
    """part, a flag for each filter, and how many documents have them: n, of which good and toxic by labels."""
    own = [name for name, f in filters.items() if f != COPY]
    base = docs.select(
        F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text")
    )
    split = base.withColumn("_words", F.array_remove(F.split("_text", SPACE), ""))
    # From here on rows have a digest in place of the text.
    flagged = split.select("_id", "part", F.sha2("_text", 256).alias("_key"), *(filters[name](F.col("_text"), F.col("_words")).alias(name) for name in own))
    rows = flagged.groupBy("_id", "part", "_key", *own).agg(F.count("*").alias("n"))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(*(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(f"_{c}") for c in ("quality", "toxic")))
    told = rows.join(known, "_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("_quality", "_toxic")})
    # Copies: of each text the rows of its smallest doc_id, and all others; rows without a doc_id are before and after none.
    alike = told.groupBy("_key", "part", *own, "_quality", "_toxic", F.col("_id").isNull().alias("_lone")).agg(F.min(F.struct("_id", "n")).alias("_first"), F.sum("n").alias("n"))
    least = alike.withColumn("_least", F.min(F.when(~F.col("_lone"), F.col("_first._id"))).over(Window.partitionBy("_key")))
    firsts = F.when(F.col("_lone"), F.col("n")).when(F.col("_first._id") == F.col("_least"), F.col("_first.n")).otherwise(0)
    halves = F.array(F.struct(F.lit(False).alias("copy"), firsts.alias("n")), F.struct(F.lit(True).alias("copy"), (F.col("n") - firsts).alias("n")))
    both = least.select("part", *own, "_quality", "_toxic", F.explode(halves).alias("_half")).where("_half.n > 0")
    flags = [F.col("_half.copy").alias(name) if filters[name] == COPY else F.col(name) for name in filters]
    counted = both.select("part", *flags, "_quality", "_toxic", F.col("_half.n").alias("n"))
    amount = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return counted.groupBy("part", *filters).agg(F.sum("n").alias("n"), amount("_quality").alias("good"), amount("_toxic").alias("toxic"))


def survivors(counted: DataFrame, names: list[str]) -> DataFrame:
    """part, mask (bit i: filter i is selected), and n, good, toxic: documents that fail none of the selected filters.

    Every mask is there for every part, with zeros where nothing survives.
    """
    cube = counted.cube(*names, "part").agg(*(F.sum(m).alias(m) for m in MEASURES), F.grouping("part").alias("_whole"), *(F.grouping(n).alias(f"_{n}") for n in names))
    mask = sum(((1 - F.col(f"_{n}")) * (1 << i) for i, n in enumerate(names)), F.lit(0))
    passed = F.lit(True)
    for n in names:
        passed = passed & ~F.coalesce(F.col(n), F.lit(False))
    rows = cube.where("_whole = 0").select("part", mask.cast("int").alias("mask"), *(F.when(passed, F.col(m)).otherwise(0).alias(m) for m in MEASURES))
    return rows.groupBy("part", "mask").agg(*(F.sum(m).alias(m) for m in MEASURES))


def audit(docs: DataFrame, labels: DataFrame, filters=FILTERS, part: str = "lang") -> DataFrame:
    """A row for each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    docs has doc_id, text and the column part (null: the empty string); labels has doc_id, quality and toxic. A null
    text is an empty one; very long texts are taken whole. Rows count, so equal rows count each; rows of one doc_id
    and text are no copies of each other, and rows without a doc_id neither are copies nor have any. A doc_id that
    labels names more than once is good or toxic if one of its rows says so; labels of other documents do not matter.
    Other columns are not read, whatever their names; an empty table gives an empty result.
    """
    names = list(filters)
    if not 0 < len(names) <= MOST_FILTERS or len(set("".join(names))) != len("".join(names)) or any(len(n) != 1 for n in names):
        raise ValueError(f"1 to {MOST_FILTERS} filters, each named by one letter")
    spark, full, count = docs.sparkSession, (1 << len(names)) - 1, len(names)
    left = materialise(survivors(cells(docs, labels, filters, part), names), "survivors")  # a row for each part and subset: texts are read once
    # Pairs of subsets: before, and after one filter more; weight is the number of orders in which they follow each other.
    pairs = []
    for i, name in enumerate(names):
        for size in range(count):
            for chosen in combinations([j for j in range(count) if j != i], size):
                before = sum(1 << j for j in chosen)
                pairs.append(f"('{name}', {before}, {before | 1 << i}, {math.factorial(size) * math.factorial(count - 1 - size)}L, {full & ~(1 << i)})")
    pair = spark.sql(f"SELECT * FROM VALUES {', '.join(pairs)} AS t(letter, before, after, weight, others)")
    first = pair.join(left.select("part", F.col("mask").alias("before"), *(F.col(m).alias(f"{m}_before") for m in MEASURES)), "before")
    both = first.join(left.select("part", F.col("mask").alias("after"), *MEASURES), ["part", "after"])
    lost = both.select("part", "letter", "before", "weight", "others", F.col("n").alias("kept"), *((F.col(f"{m}_before") - F.col(m)).alias(f"{m}_lost") for m in MEASURES))
    mine = Window.partitionBy("part", "letter")
    edges = lost.select(
        "part", "letter", "before", "kept", F.col("n_lost").alias("removed"),
        (F.sum(F.when(F.col("before") == 0, F.col("n_lost"))).over(mine) - F.col("n_lost")).alias("redundant"),
        F.sum(F.when(F.col("before") == F.col("others"), F.col("n_lost"))).over(mine).alias("unique_fails"),
        "good_lost", "toxic_lost", F.sum(F.col("weight") * F.col("n_lost")).over(mine).alias("shapley"),
    )
    steps = []
    for order in permutations(range(count)):
        steps += [f"('{''.join(names[j] for j in order)}', {k + 1}, '{names[i]}', {sum(1 << j for j in order[:k])})" for k, i in enumerate(order)]
    step = spark.sql(f"SELECT * FROM VALUES {', '.join(steps)} AS t(filter_order, step, letter, before)")
    return edges.join(step, ["letter", "before"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: By another road: each document's first failing filter of each order.
SQL = r"""
with recursive t as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words from t),
least as (select text, min(doc_id) as least from t group by text),
label as (select doc_id, coalesce(bool_or(quality = 1), false) as good, coalesce(bool_or(toxic = 1), false) as toxic from labels group by doc_id),
f as (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic, len(words) < 100 as fa, 100 * len(list_distinct(words)) < 80 * len(words) as fb,
    100 * length(regexp_replace(w.text, '[^A-Z]+', '', 'g')) > 10 * length(w.text) as fc, regexp_matches(w.text, '[#$%&*|]') as fd, coalesce(w.doc_id > least, false) as fe
  from w join least on w.text = least.text left join label on w.doc_id = label.doc_id),
kind as (
  select part, good, toxic, case when fa then 'A' else '' end || case when fb then 'B' else '' end || case when fc then 'C' else '' end || case when fd then 'D' else '' end || case when fe then 'E' else '' end as fails,
    count(*) as n from f group by all),
orders(o) as (select '' union all select o || x from orders, (values ('A'), ('B'), ('C'), ('D'), ('E')) v(x) where not contains(o, x)),
step as (select o as filter_order, s as step, substr(o, s, 1) as letter from orders, range(1, 6) r(s) where length(o) = 5),
met as (
  select part, good, toxic, fails, n, filter_order, step, letter, contains(fails, letter) as fails_it,
    coalesce((select min(i) from range(1, 6) r(i) where contains(fails, substr(filter_order, i, 1))), 9) as gone from kind, step),
counted as (
  select part, filter_order, step, any_value(letter) as letter, sum(case when gone > step then n else 0 end) as kept, sum(case when gone = step then n else 0 end) as removed,
    sum(case when fails_it and gone < step then n else 0 end) as redundant, sum(case when fails = letter then n else 0 end) as unique_fails,
    sum(case when gone = step and good then n else 0 end) as good_lost, sum(case when gone = step and toxic then n else 0 end) as toxic_lost
  from met group by part, filter_order, step)
select part, filter_order, step::integer as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails, good_lost::bigint as good_lost,
  toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, letter))::bigint as shapley from counted
"""
