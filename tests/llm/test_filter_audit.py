"""The filter audit against brute force over all orders, and against its SQL."""

import re
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import filter_audit

LONG = " ".join(f"w{i}" for i in range(20_000))
FINE = " ".join(f"w{i}" for i in range(120))
ROWS = [
    (1, FINE, "en"), (2, FINE, "de"), (3, FINE + " #", "en"), (4, "short", "en"), (5, None, None), (6, "", "en"), (7, "a " * 200, "de"), (8, "ABC " * 150, "de"), (9, LONG, "en"), (10, LONG, None),
    (2, FINE, "de"), (2, "short", "en"), (None, FINE, "en"), (None, "short", ""), (None, None, "en"), (11, "\x0b\x0c x\x85y ", "fr"), (12, FINE.upper(), "en"), (13, "É" * 5 + "A", "en"), (1, FINE, "fr"), (0, LONG[:-1] + "9", "fr"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (3, None, None), (4, 1, 1), (7, 1, 1), (9, 1, 0), (99, 1, 1), (None, 1, 1), (12, 0, 1)]


def brute(rows, labels):
    known = {}
    for i, q, t in labels:
        if i is not None:
            good, toxic = known.get(i, (False, False))
            known[i] = (good or q == 1, toxic or t == 1)
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    docs = []
    for i, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and i > first[text]}
        docs.append((lang or "", {f for f, v in fails.items() if v}, *known.get(i, (False, False))))
    out = {}
    for part in {d[0] for d in docs}:
        mine, gone = [d for d in docs if d[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                cut = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                gone[f] += len(cut)
                out[part, "".join(order), k + 1] = [len(left), len(cut), sum(f in d[1] for d in mine) - len(cut), sum(d[1] == {f} for d in mine), sum(d[2] for d in cut), sum(d[3] for d in cut)]
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                out[part, "".join(order), k + 1].append(gone[f])
    return out


def frames(spark, rows=ROWS, labels=LABELS):
    docs = spark.createDataFrame([(*r, 7, True, "x") for r in rows], "doc_id bigint, text string, lang string, n bigint, A boolean, part string")
    return docs, spark.createDataFrame([(*r, "y") for r in labels], "doc_id bigint, quality int, toxic int, text string")


def as_dict(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in df.collect()}


def test_every_order_equals_brute_force(spark):
    docs, labels = frames(spark)
    got = as_dict(filter_audit.audit(docs, labels))
    assert got == brute(ROWS, LABELS)
    assert len(got) == 4 * 600


def test_sql_equals_brute_force(spark):
    docs, labels = frames(spark)
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    con.register("labels", labels.toPandas().astype({"doc_id": "Int64"}))
    rows = con.sql(filter_audit.SQL).df().to_dict("records")
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in rows} == brute(ROWS, LABELS)


def test_empty_tables(spark):
    docs, labels = frames(spark)
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert as_dict(filter_audit.audit(docs, labels.limit(0))) == brute(ROWS, [])


def test_copies_are_counted_before_they_are_cubed(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, FINE).otherwise(F.concat(F.lit(FINE), F.lit(" "), F.col("id").cast("string"))).alias("text"), F.lit("en").alias("lang"))
    labels = frames(spark)[1]
    counted = filter_audit.cells(docs, labels)
    assert counted.count() <= 32
    got = as_dict(filter_audit.audit(docs, labels))
    assert got["en", "ABCDE", 5][:4] == [20_001, 9_999, 0, 9_999]


def test_other_filters_and_names_that_clash_are_told(spark):
    docs, labels = frames(spark)
    got = as_dict(filter_audit.audit(docs, labels, {"S": lambda text, words: F.length(text) < 10, "Z": filter_audit.COPY}))
    assert {k[1] for k in got} == {"SZ", "ZS"} and got["en", "SZ", 1][1] == sum(len(t or "") < 10 for _, t, lang in ROWS if lang == "en")
    with pytest.raises(ValueError):
        filter_audit.audit(docs, labels, {"AB": filter_audit.COPY})
