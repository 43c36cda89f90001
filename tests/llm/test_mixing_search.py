"""Mixing against SQL and its rules, search against brute force, the pipeline as a whole."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import learned_index, mixing, registry

ROWS = [(i, "w " * (i % 9) + "é", ["en", "de", None][i % 3], f"src{i % 7}" if i % 11 else None) for i in range(300)] + [(5, "w", "en", "src1"), (None, "w w w", "en", "src1"), (7, None, "en", "src1"), (8, " \n", "en", "x"), (9, "w " * 4000, "fr", "other")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, lang string, source string, n_tokens int")


def test_mixing_equals_sql(spark):
    df = frame(spark)
    con = duckdb.connect()
    con.register("documents", df.drop("n_tokens").toPandas().astype({"doc_id": "Int64"}))
    want = con.sql(mixing.SQL).fetchall()
    names = ("domain", "lang", "source", "epoch", "doc_id", "n_tokens", "take_tokens")
    columns = [d[0] for d in con.sql(mixing.SQL).description]
    got = mixing.mix(df).select(*names).collect()
    assert sorted(map(str, (tuple(dict(zip(columns, w, strict=True))[n] for n in names) for w in want))) == sorted(str(tuple(r)) for r in got)
    assert mixing.mix(df.limit(0)).count() == 0


def test_shortage_goes_to_siblings_first(spark):
    rows = []
    for domain, lang, source, docs in (("a", "en", "src0", 1), ("a", "en", "src3", 50), ("a", "de", "src6", 50), ("b", "en", "src1", 50)):
        rows += [(len(rows), "w " * 10, lang, source) for _ in range(docs)]
    weights = {"domain": {"d0": 1, "d1": 1}, "lang": {"en": 1, "de": 1}, "source": {"src0": 1, "src3": 1}}
    got = {(r["source"]): r["t"] for r in mixing.mix(frame(spark, rows), weights, percent=40, epochs=1).groupBy("source").agg(F.sum("take_tokens").alias("t")).collect()}
    # 604 tokens: 302 for each domain, 151 for each language of d0; src0 has 10 and src3 takes its 65 or 66.
    assert got["src0"] == 10 and got["src1"] == 302 and got["src6"] == 151 and got["src3"] == 141


def test_weights_of_zero_take_nothing_and_pass_their_share_on(spark):
    rows = [(i, "w " * 10, "en", "src0") for i in range(50)] + [(50 + i, "w " * 10, "de", "src3") for i in range(50)]
    got = mixing.mix(frame(spark, rows), {"source": {"src0": 0, "src3": 1}}, percent=60, epochs=2).groupBy("source").agg(F.sum("take_tokens").alias("t")).collect()
    assert [(r["source"], r["t"]) for r in got] == [("src3", 600)]
    none = mixing.mix(frame(spark, rows), {"lang": {"en": 0, "de": 0}}, percent=60)
    assert none.count() == 0


def plain_budget(children, budget):
    """children: name -> (weight, cap); tokens are handed out one by one to whoever is furthest below its share."""
    take = dict.fromkeys(children, 0)
    for _ in range(budget):
        open_ = [n for n, (w, cap) in children.items() if w > 0 and take[n] < cap]
        if not open_:
            break
        best = min(open_, key=lambda n: ((take[n] + 1) / children[n][0], n))
        take[best] += 1
    return take


@pytest.mark.parametrize("seed", range(2))
def test_budgets_are_near_what_single_tokens_would_give(spark, seed):
    rng = np.random.default_rng(seed)
    rows, weights = [], {"domain": {"d0": 3, "d1": 5}, "lang": {"en": 2, "de": 7, "fr": 0}, "source": {f"src{i}": int(rng.integers(0, 6)) for i in range(6)}}
    for _ in range(60):
        rows.append((len(rows), "w " * int(rng.integers(1, 9)), ["en", "de", "fr"][rng.integers(3)], f"src{rng.integers(6)}"))
    total = sum(len(r[1].split()) for r in rows)
    got = mixing.mix(frame(spark, rows), weights, percent=70, epochs=1).toPandas()
    supply = {}
    for _, text, lang, source in rows:
        key = (f"d{int(source[3:]) % 3}", lang, source)
        supply[key] = supply.get(key, 0) + len(text.split())
    w = lambda level, n: weights[level].get(n, mixing.DEFAULT)
    cap = {k: v if all(w(lv, n) > 0 for lv, n in zip(mixing.LEVELS, k, strict=True)) else 0 for k, v in supply.items()}
    assert got["take_tokens"].sum() == min(total * 70 // 100, sum(cap.values()))
    below = lambda i, p: {k[i]: (w(mixing.LEVELS[i], k[i]), sum(v for q, v in cap.items() if q[: i + 1] == k[: i + 1])) for k in cap if k[:i] == p}
    seen = got.groupby(list(mixing.LEVELS))["take_tokens"].sum().to_dict()
    for i, p in [(0, ()), *((1, (d,)) for d in {k[0] for k in cap}), *((2, k) for k in {k[:2] for k in cap})]:
        mine = {n: sum(v for k, v in seen.items() if k[:i] == p and k[i] == n) for n in below(i, p)}
        want = plain_budget(below(i, p), sum(mine.values()))
        assert all(abs(mine[n] - want[n]) <= 1 for n in want), (i, p, mine, want)


def test_epochs_and_prefix(spark):
    rows = [(i, "w " * 7, "en", "src0") for i in range(40)]
    got = mixing.mix(frame(spark, rows), {}, percent=165, epochs=2).toPandas()
    assert got["take_tokens"].sum() == 462 and (got["epoch"] == 0).sum() == 40 and (got["take_tokens"] < 7).sum() <= 1
    out = mixing.taken(frame(spark, rows), weights={}, percent=165, epochs=2)
    assert out.columns == frame(spark).columns and out.count() == len(got)


def test_taken_keeps_null_and_repeated_ids_and_lines(spark):
    rows = [(None, f"a\n b\tc{i}", "en", "src0") for i in range(6)] + [(5, "x y z", "en", "src0"), (5, "x y\nw", "en", "src0")] + [(7, " q\n\nr  s ", "en", "src0")] * 9 + [(8, "", "en", "src0"), (9, None, None, None)]
    for percent in (40, 150):
        got = [r["text"] for r in mixing.taken(frame(spark, rows), weights={}, percent=percent, epochs=2).collect()]
        words = sum(len((r[1] or "").split()) for r in rows)
        assert sum(len(t.split()) for t in got) == words * percent // 100
        whole = [r[1] for r in rows]
        assert sum(t not in whole for t in got) <= 1 and all(any(w and w.startswith(t) for w in whole) for t in got)
        assert len(got) == mixing.mix(frame(spark, rows), {}, percent, 2).count()
    assert mixing.taken(frame(spark, rows).limit(0)).count() == 0
    text = "x\n" * 200_000
    one = mixing.taken(frame(spark, [(1, text, "en", "src0")]), weights={}, percent=50, epochs=1).first()
    assert one["text"] == text[:199_999]


def recall_of(got, x, every=20, k=20):
    hits = []
    for q in range(0, len(x), every):
        part = got[got["query_id"] == q]
        s = x @ x[q]
        assert len(part) == min(k, len(x) - 1) and np.allclose(part["score"], s[part["vec_id"]], rtol=0, atol=1e-12)
        s[q] = -np.inf
        hits.append(len(set(np.argsort(-s, kind="stable")[:k]) & set(part["vec_id"])) / k)
    return np.mean(hits)


def clustered(n, d=16):
    rng = np.random.default_rng(0)
    return (rng.normal(size=(n, d)) + 3 * rng.normal(size=(20, d))[rng.integers(0, 20, n)]).astype(np.float32).astype(float)


# One level of parts; several bins of a part; parts of parts; 128 parts.
@pytest.mark.parametrize("fan,rows,block,n", [(4, 100_000, 500, 3000), (8, 60, 300, 3000), (128, 4096, 700, 5000)])
def test_search_recall(spark, monkeypatch, fan, rows, block, n):
    monkeypatch.setattr(learned_index, "FAN", fan)
    monkeypatch.setattr(learned_index, "PART_ROWS", rows)
    x = clustered(n)
    df = spark.createDataFrame([(i, list(map(float, v)), "q") for i, v in enumerate(x)], "vec_id bigint, embedding array<float>, part string")
    got = learned_index.search(df, block=block).toPandas()
    assert got["query_id"].nunique() == n // 20 and recall_of(got, x) >= 0.9
    again = learned_index.search(df, block=block).toPandas()
    assert got.sort_values(["query_id", "rank"]).reset_index(drop=True).equals(again.sort_values(["query_id", "rank"]).reset_index(drop=True))


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_search_recall_on_the_tables(spark, monkeypatch, sf_dir):
    seen = []
    plain = learned_index.fit_probes
    monkeypatch.setattr(learned_index, "fit_probes", lambda *a: seen.append((plain(*a), a[1].scores(a[2]).shape[1])) or seen[-1][0])
    x = np.array(duckdb.sql(f"select embedding from '{sf_dir}/embeddings.parquet' order by vec_id").df()["embedding"].tolist(), float)
    got = learned_index.op9_learned_partitions(spark, sf_dir).toPandas()
    assert recall_of(got, x) >= 0.9 and 1 <= seen[0][0] < seen[0][1], seen  # routed: some parts are not visited


def test_parts_grow_with_the_rows_and_a_query_visits_fewer_of_them(spark, monkeypatch):
    assert [learned_index.parts_for(n) for n in (0, 63, 64, 3000, 10**6, 10**9)] == [(1, 1), (1, 1), (2, 1), (93, 1), (128, 2), (128, 128)]
    shares = []
    plain = learned_index.fit_probes
    monkeypatch.setattr(learned_index, "fit_probes", lambda *a: shares.append(plain(*a) / a[1].scores(a[2]).shape[1]) or int(round(shares[-1] * a[1].scores(a[2]).shape[1])))
    for n in (500, 4000):
        x = clustered(n)
        learned_index.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>"))
    assert shares[1] < shares[0]


def test_bins_hold_every_unit():
    bins = learned_index.pack_bins({1: 3, 2: 4, 5: 25, 7: 1, 8: 10}, 10)
    assert bins == {1: (0, 1), 2: (0, 1), 5: (1, 3), 7: (4, 1), 8: (5, 1)}


def test_search_edges(spark):
    rows = [(1, [1.0, 0.0], "x"), (20, [1.0, 0.0], "x"), (40, None, "y"), (60, [0.0, 0.0], ""), (80, [1.0, None], ""), (100, [float("nan"), 1.0], ""), (120, [float("inf"), 1.0], ""), (None, [1.0, 1.0], ""), (0, [0.0, 1.0], ""), (3, [0.0, 1.0, 2.0], ""), (20, [1.0, 0.0], "x")]
    rows += [(200 + i, [1.0, 0.0], "") for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, rank string")
    got = learned_index.search(df).orderBy("query_id", "rank").collect()
    assert {r["query_id"] for r in got} == {0, 20, 200, 220, 240}
    assert [r["vec_id"] for r in got if r["query_id"] == 20] == [1, *range(200, 219)]
    assert [r["vec_id"] for r in got if r["query_id"] == 200] == [1, 20, *range(201, 219)]
    few = learned_index.search(df.where("vec_id in (0, 1, 20)")).collect()
    assert len(few) == 4
    assert learned_index.search(df.limit(0)).count() == 0 and learned_index.search(df.where("vec_id = 40")).count() == 0


def test_graph_parts_are_balanced():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 8))
    near = learned_index._nearest(x, x, 10, np.arange(800))
    label = learned_index.partition_graph(x, near, 8)
    counts = np.bincount(label, minlength=8)
    assert counts.max() <= np.ceil(1.1 * 100) and counts.min() > 0
    start = learned_index.partition_graph(x, near, 8, rounds=0)
    assert (label[near] == label[:, None]).mean() >= (start[near] == start[:, None]).mean()


def test_registered_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES if n.startswith("op")) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_pipeline(spark, sf, tmp_path):
    """Each stage against what its operator says of its own input, and the last against a round trip."""
    import hashlib

    import corpus_pipeline as p
    from cohortlens.llm import gam, lsh_forest, suffix_dedup

    assert [n for n, _ in p.STAGES] == ["quality", "near_duplicates", "repeats", "mixing", "tokens"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = [docs]
    for k, (_, stage) in enumerate(p.STAGES):
        stage(spark, held[-1], sf).write.parquet(str(tmp_path / str(k)))
        held.append(spark.read.parquet(str(tmp_path / str(k))))
    assert all(sorted(h.columns) == sorted(docs.columns) for h in held[:-1])
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = {r["doc_id"] for r in gam.score(docs, gam.fit_gam(docs, labels)).collect() if r["score"] >= 0.3}
    ids = [{r["doc_id"] for r in h.select("doc_id").collect()} for h in held]
    assert ids[1] == good and ids[2] == {r["doc_id"] for r in lsh_forest.jaccard_join(held[1]).where("doc_id = class_id").collect()}
    kept = {r["doc_id"]: bytes(r["kept"]).decode("utf-8", "ignore") for r in suffix_dedup.remove_repeats(held[2]).collect()}
    assert {r["doc_id"]: r["text"] for r in held[3].collect()} == kept and ids[4] <= ids[3]
    texts = {}
    for r in held[4].collect():
        texts.setdefault(r["doc_id"], set()).add(hashlib.sha256(r["text"].encode()).hexdigest())
    for r in held[5].collect():
        assert r["decoded_sha256"] in texts[r["doc_id"]] and len(r["ids"]) == 4 * r["n_tokens"]


ODD = [(1, None, "en", "src1", None, "x"), (None, "some words of a row without an id " * 3, None, None, 5, None), (2, "", "de", "src2", 0, "x"), (3, "a b c d e f g h", "en", "src1", 15, "x"), (3, "a b c d e f g h", "en", "src1", 15, "x"), (3, "another text of this id, " * 4, "en", "src1", 100, "x"), (4, "long word " * 30_000, "en", "src1", 300_000, "x"), (5, "tie one two", "en", "src1", 11, "x"), (6, "tie one two", "en", "src1", 11, "x")]


def test_each_stage_takes_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing extra columns, and no rows at all, stage by stage."""
    import corpus_pipeline as p

    odd = spark.createDataFrame(ODD, "doc_id bigint, text string, lang string, source string, n_chars bigint, label string").withColumn("key", F.lit(1)).withColumn("marks", F.lit("m")).withColumn("score", F.lit(0.5)).withColumn("row", F.lit(1))
    odd.limit(0).select("doc_id", F.lit(1).alias("quality")).write.parquet(str(tmp_path / "labels.parquet"))
    rows = lambda df: sorted((str(r["doc_id"]), r["text"] or "") for r in df.collect())
    everything = rows(odd)
    for docs in (odd, odd.limit(0)):
        for name, stage in p.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
            got = rows(out)
            if not docs.limit(1).count():
                assert got == []
            elif name == "quality":
                assert got == everything  # a model without labels rejects nothing
            elif name == "near_duplicates":
                assert got == sorted(x for x in set(everything) if x[0] not in ("6", "2"))  # 1 and 2 are equal (empty), 5 and 6 too
            elif name == "repeats":
                assert len(got) == len(everything) and ("None", ODD[1][1]) in got
            else:
                assert {x[0] for x in got} <= {x[0] for x in everything} and sum(len(x[1].split()) for x in got) == sum(len(x[1].split()) for x in everything) * 60 // 100
        assert p.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()
