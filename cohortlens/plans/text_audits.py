"""Queries of rules over texts: a table of phrases in one pass, sections, citations, paragraphs of documents in files."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens import storage
from cohortlens.operators import contentaudit
from cohortlens.plans.catalog import query, table
from cohortlens.sources import wordfiles

RULES_SQL = "select distinct w[i] || ' ' || w[i + 1] as phrase from (select string_split(replace(lower(text), chr(10), ' '), ' ') as w from benchmark), range(1, 2000) r(i) where i < len(w) and w[i] <> '' and w[i + 1] <> ''"


def rules(spark, sf):
    """All pairs of words that follow each other in a benchmark item."""
    w = table(spark, sf, "benchmark", "text").select(F.split(F.replace(F.lower("text"), F.lit("\n"), F.lit(" ")), " ").alias("w"))
    pairs = w.select(F.explode(F.arrays_zip(F.expr("slice(w, 1, size(w) - 1)").alias("a"), F.expr("slice(w, 2, size(w) - 1)").alias("b"))).alias("p")).where("p.a <> '' and p.b <> ''")
    return pairs.select(F.concat_ws(" ", "p.a", "p.b").alias("phrase")).distinct()


@query(
    f"""with r as ({RULES_SQL}), d as (select doc_id, lower(text) as t from documents where text is not null),
h as (select doc_id, phrase, t, strpos(t, phrase) as p from d join r on contains(t, phrase))
select doc_id, phrase, (length(t) - length(replace(t, phrase, ''))) // length(phrase) as n, p as first_position,
  regexp_matches(substr(t, greatest(1, p - 40), p - greatest(1, p - 40)), 'not |no |never |without |cannot ') as first_negated from h"""
)
def rule_table_hits(spark, sf):
    """How often each of over a thousand phrases stands in each document, where first, and whether that one is negated."""
    hits = contentaudit.rule_hits(table(spark, sf, "documents", "doc_id", "text"), "doc_id", rules(spark, sf))
    return hits.groupBy("doc_id", "phrase").agg(F.count("*").alias("n"), F.min("position").alias("first_position"), F.min_by("negated", "position").alias("first_negated"))


@query(r"""with l as (select doc_id, i, lines[i] as line, regexp_full_match(lines[i], '\S+') as head from (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents), range(1, 100000) r(i) where i <= len(lines)),
s as (select *, sum(head::int) over (partition by doc_id order by i) as k from l),
g as (select doc_id, k, max(case when head then line else '' end) as title, count(*) filter (not head) as n_lines, sum(case when head then 0 else len(list_filter(regexp_split_to_array(line, '\s+'), lambda w: w <> '')) end) as n_words from s group by doc_id, k)
select doc_id, (row_number() over (partition by doc_id order by k) - 1)::integer as section, title, n_lines::integer as n_lines, n_words::integer as n_words from g""")
def section_lengths(spark, sf):
    """Sections of documents, where lines of one word are headings."""
    return contentaudit.sections(table(spark, sf, "documents", "doc_id", "text"), "doc_id", heading=r"^(\S+)\z")


@query("""with c as (select distinct o_orderkey, n from (select o_orderkey, unnest([o_custkey % 9, o_orderkey % 7, 3]) as n from orders)), r as (select o_orderkey, n from orders, range(0, 10) v(n) where n <= o_orderkey % 10)
select o_orderkey, n as number, case when r.n is null then 'no reference' else 'never cited' end as problem from c full join r using (o_orderkey, n) where r.n is null or c.n is null""".replace("select o_orderkey, n as number", "select coalesce(c.o_orderkey, r.o_orderkey) as o_orderkey, coalesce(c.n, r.n) as number").replace("using (o_orderkey, n)", "on c.o_orderkey = r.o_orderkey and c.n = r.n"))
def citation_integrity(spark, sf):
    """Numbers cited in a sentence about each order, against its list of references."""
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey")
    number = lambda c: c.cast("string")
    texts = o.select("o_orderkey", F.concat(F.lit("as in ["), number(F.col("o_custkey") % 9), F.lit(", "), number(F.col("o_orderkey") % 7), F.lit("], [3 ] and not 1[8] or [9]9 or [a]")).alias("text"))
    held = o.select("o_orderkey", F.explode(F.sequence(F.lit(0), (F.col("o_orderkey") % 10).cast("int"))).alias("number"))
    return contentaudit.citation_problems(texts, held, "o_orderkey")


@query("select doc_id, i - 1 as position, case when i = 1 then 'header' when i = 2 then 'cell' else 'paragraph' end as kind, parts[i] as text from (select doc_id, list_concat([source, lang], string_split(regexp_replace(text, '[\\x00-\\x08\\x0B-\\x1F]', ' ', 'g'), chr(10))) as parts from documents where text is not null and source is not null and lang is not null), range(1, 100000) r(i) where i <= len(parts) and parts[i] <> ''")
def word_file_texts(spark, sf):
    """Documents written as word-processor files and read back as rows: a header, a table cell and paragraphs."""
    d = table(spark, sf, "documents", "doc_id", "text", "lang", "source").where("text is not null and source is not null and lang is not null")
    folder = storage.shared_dir(spark, "word-files")
    lines = F.split(F.regexp_replace("text", r"[\x00-\x08\x0B-\x1F]", " "), "\n")
    wordfiles.write_documents(d.select(F.col("doc_id").cast("string").alias("name"), F.array("source").alias("headers"), F.array("lang").alias("cells"), lines.alias("paragraphs")), folder).foreach(lambda _: None)
    read = wordfiles.read_documents(spark, folder)
    place = F.when(F.col("kind") == "header", 0).when(F.col("kind") == "cell", 1).otherwise(F.col("position") + 2)
    return read.select(F.regexp_extract("path", r"([0-9]+)\.docx$", 1).cast("long").alias("doc_id"), place.cast("long").alias("position"), "kind", "text").where("text <> ''")
