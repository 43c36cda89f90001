"""Audits of texts by whole tables of rules: phrases in one pass, sections and their lengths, citations and references."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.scalar import emails, word_count
from cohortlens.operators.textqa import NEGATIONS

#: Phrases that one automaton holds at most; it is built in each worker from a list that travels with the code.
MOST_RULES = 100_000
#: Hits that a worker holds at most before it sends them.
SENT_HITS = 20_000
#: Numbers in brackets, separated by commas; not part of a longer number.
CITATION = r"(?<![0-9])\[(\s*[0-9]+\s*(?:,\s*[0-9]+\s*)*)\](?![0-9])"
HEADING = r"^#+\s+(.*?)\s*$"
_AUTOMATA: dict = {}


def _automaton(phrases: tuple[str, ...]):
    if phrases not in _AUTOMATA:
        import ahocorasick

        out = ahocorasick.Automaton()
        for p in phrases:
            out.add_word(p, p)
        out.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[phrases] = out
    return _AUTOMATA[phrases]


def rule_hits(df: DataFrame, key: str, rules: DataFrame, text: str = "text", window: int = 40, cues: tuple[str, ...] = NEGATIONS, both_sides: bool = False) -> DataFrame:
    """key, phrase, position (from 1), context, negated: the occurrences of all phrases of rules (phrase), in one pass.

    Case does not matter. Occurrences of one phrase do not overlap (the first ones count), those of different phrases
    may. A hit is negated if a cue stands in the window of characters before it, or on either side. Rows with a null
    text have none; null and empty phrases are none; the number of phrases is bounded, that of hits is not.
    """
    held = rules.select(F.lower(F.col("phrase").cast("string")).alias("phrase")).where("phrase <> ''").distinct().orderBy("phrase").limit(MOST_RULES + 1).collect()
    phrases = tuple(r["phrase"] for r in held)
    if len(phrases) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} phrases")
    kind = df.schema[key].dataType.simpleString()
    names = [key, "phrase", "position", "context", "negated"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(phrases)

        def sent(batch: pa.RecordBatch, rows: tuple[list, ...]) -> pa.RecordBatch:
            keys = batch.column(0).take(pa.array(rows[0], pa.int64()))
            return pa.RecordBatch.from_arrays([keys, pa.array(rows[1], pa.string()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.string()), pa.array(rows[4], pa.bool_())], names=names)

        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for i in range(len(batch)):
                own, ends = batch.column(1)[i].as_py(), {}
                for last, phrase in automaton.iter(own):
                    start = last - len(phrase) + 1
                    if start < ends.get(phrase, 0):
                        continue
                    ends[phrase] = last + 1
                    low = max(0, start - window)
                    before = own[low : last + 1 + window] if both_sides else own[low:start]
                    for column, v in zip(rows, (i, phrase, start + 1, own[low : last + 1 + window], any(c in before for c in cues)), strict=True):
                        column.append(v)
                    if len(rows[0]) == SENT_HITS:
                        yield sent(batch, rows)
                        rows = ([], [], [], [], [])
            yield sent(batch, rows)

    schema = f"`{key}` {kind}, phrase string, position bigint, context string, negated boolean"
    if not phrases:
        return df.sparkSession.createDataFrame([], schema)
    return df.where(F.col(text).isNotNull()).select(key, F.lower(F.col(text)).alias("_t")).mapInArrow(run, schema)


def sections(df: DataFrame, key: str, text: str = "text", heading: str = HEADING) -> DataFrame:
    """key, section (from 0), title (empty for what comes before the first heading), n_lines and n_words of each section.

    A heading is a line that the pattern fits; its first group is the title. A text without lines has no section but
    the one before any heading.
    """
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    rows = df.select(key, F.aggregate(lines, F.array().cast("array<struct<title:string,lines:int,words:int>>"), lambda done, line: _put(done, line, heading)).alias("_s"))
    out = rows.select(key, F.posexplode("_s").alias("section", "_x"))
    return out.select(key, "section", F.col("_x.title").alias("title"), F.col("_x.lines").alias("n_lines"), F.col("_x.words").alias("n_words"))


def _put(done, line, heading: str):
    """Sections with one line more: a heading begins one, any other line counts for the last one."""
    new = lambda title, n, words: F.struct(title.alias("title"), n.alias("lines"), words.alias("words"))
    fits, words = line.rlike(heading), F.size(F.filter(F.split(line, r"\s+"), lambda w: w != ""))
    last = F.element_at(done, -1)
    grown = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(new(last["title"], last["lines"] + 1, last["words"] + words)))
    first = F.array(new(F.lit(""), F.lit(1), words))
    begun = F.concat(done, F.array(new(F.regexp_extract(line, heading, 1), F.lit(0), F.lit(0))))
    return F.when(fits, begun).when(F.size(done) == 0, first).otherwise(grown)


def cited(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, number and n for each number that a text cites in brackets."""
    groups = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(CITATION), F.lit(1))
    numbers = df.select(key, F.explode(groups).alias("_g")).select(key, F.explode(F.split("_g", ",")).alias("_n"))
    return numbers.select(key, F.trim("_n").cast("long").alias("number")).where("number is not null").groupBy(key, "number").agg(F.count("*").alias("n"))


def citation_problems(df: DataFrame, references: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, number, problem: cited numbers without a reference (key, number), and references that are never cited."""
    held = references.select(key, F.col("number").cast("long").alias("number")).distinct().withColumn("_held", F.lit(True))
    both = cited(df, key, text).join(held, [key, "number"], "full_outer")
    problem = F.when(F.col("_held").isNull(), "no reference").when(F.col("n").isNull(), "never cited")
    return both.select(key, "number", problem.alias("problem")).where("problem is not null")


def content_audit(df: DataFrame, key: str, forbidden: DataFrame, required: list[str], limits: dict[str, tuple[int, int]], references: DataFrame | None = None, known_emails: tuple[str, ...] = (), text: str = "text", window: int = 200, cues: tuple[str, ...] = NEGATIONS) -> DataFrame:
    """key, name, status, detail: checks of each text. limits bounds the words of a section of that title; the title
    with an empty name stands for the whole text."""
    base = df.select(key, F.coalesce(F.col(text), F.lit("")).alias(text))
    hits = rule_hits(base, key, forbidden, text, window, cues, both_sides=True).where("not negated").groupBy(key).agg(F.countDistinct("phrase").alias("_hits"), F.min("phrase").alias("_first"))
    lengths = [F.max(F.when(F.col("title") == title, F.col("n_words"))).alias(f"_w{i}") for i, title in enumerate(limits)]
    sized = sections(base, key, text).groupBy(key).agg(*lengths) if limits else base.select(key)
    wrong = citation_problems(base, references, key, text).groupBy(key).agg(F.sum((F.col("problem") == "no reference").cast("long")).alias("_lost"), F.sum((F.col("problem") == "never cited").cast("long")).alias("_idle")) if references is not None else base.select(key, F.lit(0).alias("_lost"), F.lit(0).alias("_idle"))
    missing = sum((F.when(F.contains(F.lower(text), F.lit(p.lower())), 0).otherwise(1) for p in required), F.lit(0))
    strange = F.size(F.array_except(F.array_distinct(emails(F.col(text))), F.array(*map(F.lit, known_emails)).cast("array<string>")))
    rows = base.withColumns({"_missing": missing, "_strange": strange, "_words": word_count(F.col(text))}).join(hits, key, "left").join(sized, key, "left").join(wrong, key, "left")
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    one = lambda name, good, detail: F.struct(F.lit(name).alias("name"), F.when(good, "pass").otherwise("fail").alias("status"), detail.alias("detail"))
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("none")) for p in parts))
    checks = [
        one("phrases:forbidden", number("_hits") == 0, said("found=", number("_hits"), ", first=", F.col("_first"))), one("phrases:required", F.col("_missing") == 0, said("missing=", F.col("_missing"))),
        one("citations:without-reference", number("_lost") == 0, said("numbers=", number("_lost"))), one("citations:never-cited", number("_idle") == 0, said("numbers=", number("_idle"))),
        one("emails:known", F.col("_strange") == 0, said("unknown=", F.col("_strange"))),
    ]
    for i, (title, (low, high)) in enumerate(limits.items()):
        words = F.col("_words") if title == "" else F.col(f"_w{i}")
        checks.append(one(f"words:{title or 'all'}", F.coalesce(words.between(low, high), F.lit(False)), said("words=", words, f", from {low} to {high}")))
    return rows.select(key, F.explode(F.array(*checks)).alias("_c")).select(key, "_c.*")
