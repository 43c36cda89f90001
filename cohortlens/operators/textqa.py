"""Content rules over texts: phrases with negation, required parts, numbers and keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.scalar import collapsed, emails, numeric_tokens, word_count

NEGATIONS = ("not ", "no ", "never ", "without ", "cannot ")


def text_profile(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, n_words, n_collapsed (characters with white space collapsed), emails, n_numbers."""
    t = F.coalesce(F.col(text), F.lit(""))
    return df.select(key, word_count(t).alias("n_words"), F.char_length(collapsed(t)).alias("n_collapsed"), F.size(emails(t)).alias("n_emails"), F.size(numeric_tokens(t)).alias("n_numbers"))


def phrase_hits(df: DataFrame, key: str, phrases: list[str], text: str = "text", window: int = 40, negations: tuple[str, ...] = NEGATIONS) -> DataFrame:
    """key, phrase, position (from 1), context (window characters on either side), negated: every occurrence.

    Case does not matter. A hit is negated if a cue stands in the context before it.
    """
    lowered = df.select(key, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    rules = F.explode(F.array(*(F.lit(p.lower()) for p in phrases)))
    parts = lowered.select(key, "_t", rules.alias("phrase")).where(F.contains("_t", "phrase"))
    # Occurrences by the pieces between them: the k-th ends where k pieces and k phrases have passed.
    pieces = F.transform(F.split("_t", F.concat(F.lit(r"\Q"), F.col("phrase"), F.lit(r"\E"))), F.length)
    ends = F.expr("transform(sequence(1, size(_p) - 1), k -> aggregate(slice(_p, 1, k), 0, (a, x) -> a + x) + (k - 1) * length(phrase) + 1)")
    spots = parts.withColumn("_p", pieces).select(key, "_t", "phrase", F.explode(ends).alias("position"))
    start = F.greatest(F.lit(1), F.col("position") - window)
    context = F.substr("_t", start, F.col("position") - start + F.length("phrase") + window)
    before = F.substr("_t", start, F.col("position") - start)
    cue = F.lit(False)
    for n in negations:
        cue = cue | F.contains(before, F.lit(n))
    return spots.select(key, "phrase", "position", context.alias("context"), cue.alias("negated"))


def phrase_flags(df: DataFrame, key: str, forbidden: list[str], required: list[str], text: str = "text") -> DataFrame:
    """key, n_forbidden, n_required_missing, passes: phrases found and not found, whatever their case."""
    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    count = lambda rules, hit: sum((F.when(t.contains(p.lower()), hit).otherwise(1 - hit) for p in rules), F.lit(0))
    out = df.select(key, count(forbidden, 1).alias("n_forbidden"), count(required, 0).alias("n_required_missing"))
    return out.withColumn("passes", (F.col("n_forbidden") == 0) & (F.col("n_required_missing") == 0))


def number_parity(left: DataFrame, right: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, n_both, n_left_only, n_right_only, equal: the numbers of two versions of a text."""
    a = left.select(key, numeric_tokens(F.coalesce(F.col(text), F.lit(""))).alias("a"))
    b = right.select(key, numeric_tokens(F.coalesce(F.col(text), F.lit(""))).alias("b"))
    both = a.join(b, key).select(key, F.size(F.array_intersect("a", "b")).alias("n_both"), F.size(F.array_except("a", "b")).alias("n_left_only"), F.size(F.array_except("b", "a")).alias("n_right_only"))
    return both.withColumn("equal", (F.col("n_left_only") == 0) & (F.col("n_right_only") == 0))


def keyword_table(df: DataFrame, key: str, keywords: dict[str, str], text: str = "text") -> DataFrame:
    """key, a flag for each named pattern and <name>_match, its first match (empty without one)."""
    t = F.coalesce(F.col(text), F.lit(""))
    columns = []
    for name, pattern in keywords.items():
        columns += [t.rlike(pattern).alias(name), F.regexp_extract(t, pattern, 0).alias(f"{name}_match")]
    return df.select(key, *columns)


def pipe_tables(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, line, cells: rows of pipe tables in a text; separator rows are left out."""
    lines = df.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line", "_l")).withColumn("_l", F.trim("_l")).where("_l like '|%|' and length(_l) > 1")
    cells = F.transform(F.split(F.expr("substring(_l, 2, length(_l) - 2)"), r"\|"), lambda c: F.trim(c))
    return lines.select(key, "line", cells.alias("cells")).where(~F.forall("cells", lambda c: c.rlike(r"^:?-+:?$")))


def ledger(claims: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Claims (claim_id, artifact, key, stated) with the found value and status: verified, mismatch or missing."""
    joined = claims.join(artifacts.select("artifact", "key", F.col("value").alias("found")), ["artifact", "key"], "left")
    return joined.withColumn("status", F.when(F.col("found").isNull(), "missing").when(F.col("found") == F.col("stated"), "verified").otherwise("mismatch"))
