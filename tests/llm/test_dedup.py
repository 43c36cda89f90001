"""Near duplicates, repeated passages and components against brute force."""

import hashlib
import random

import numpy as np
import pytest

from cohortlens.llm import lsh_forest, suffix_dedup
from cohortlens.llm.components import connected_components


def plain_repeats(rows, window=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - window + 1 if d is not None else 0):
            first[b[i : i + window]] = min(d, first.get(b[i : i + window], d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + window, bool)
        for i in range(len(b) - window + 1 if d is not None else 0):
            if first[b[i : i + window]] < d:
                gone[i : i + window] = True
        gone = gone[: len(b)]
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])[: len(b)]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def passages(seed, n=120):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdefgh éü") for _ in range(rng.choice([60, 300, 1500]))) for _ in range(10)]
    rows = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            b = rng.choice(base)
            i = rng.randrange(len(b))
            parts += [b[i : i + rng.choice([30, 45, 49, 50, 51, 60, 200])], "".join(rng.choice("xyz") for _ in range(rng.randint(0, 30)))]
        rows.append((rng.choice([None, *range(140)]), "".join(parts)))
    return rows + [(500, "ab" * 3000), (501, "ab" * 2500), (502, "a" * 900), (503, "a" * 49), (504, "a" * 50), (505, None), (505, ""), (506, rows[3][1]), (506, rows[4][1]), (506, rows[4][1]), (-3, "nt " * 200 + base[0]), (7, base[1]), (7, base[1]), (1000, base[1] * 2)]


@pytest.mark.parametrize("hot", [1000, 3, 1])
def test_repeats_equal_brute_force(spark, hot):
    rows = passages(5)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, kept int")
    got = suffix_dedup.remove_repeats(df, hot=hot).selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256)").collect()
    assert sorted(map(tuple, got), key=str) == plain_repeats(rows)
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_repeats_on_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    out = suffix_dedup.remove_repeats(df, carry=("lang",))
    got = out.selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256)").collect()
    assert sorted(map(tuple, got), key=str) == plain_repeats(rows)
    assert out.selectExpr("doc_id", "carried.lang").exceptAll(df.select("doc_id", "lang")).count() == 0


def test_prefix_doubling_ranks():
    rng = np.random.default_rng(1)
    data = np.frombuffer(bytes(rng.integers(97, 99, 600).tolist() + [97] * 200), np.uint8)
    positions = np.arange(len(data) - 49)
    alive, rank = suffix_dedup.window_ranks(data, positions)
    strings = [data[p : p + 50].tobytes() for p in positions]
    assert set(alive.tolist()) == {i for i, s in enumerate(strings) if strings.count(s) > 1}
    by = {}
    for p, r in zip(alive.tolist(), rank.tolist(), strict=True):
        assert by.setdefault(int(r), strings[p]) == strings[p]
    assert len(set(by.values())) == len(by)


def test_runs_cover_each_window_once():
    rng = random.Random(2)
    parts = ["".join(rng.choice("abc") for _ in range(n)).encode() for n in (0, 49, 50, 51, 400)]
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    first, length, text, _ = suffix_dedup.find_runs(np.frombuffer(b"".join(parts), np.uint8), starts)
    seen = sorted((int(t), int(f - starts[t]) + i) for f, n, t in zip(first, length, text, strict=True) for i in range(n))
    assert seen == [(t, i) for t, p in enumerate(parts) for i in range(len(p) - 49)]


def shingle_set(text):
    w = (text or "").encode().split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def plain_join(rows):
    texts = {}
    for d, t in rows:
        if d is not None:
            texts[t or ""] = min(d, texts.get(t or "", d))
    reps = list(texts.items())
    sets = [shingle_set(t) for t, _ in reps]
    links = {d: set() for _, d in reps}
    for i in range(len(reps)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both):
                links[reps[i][1]].add(reps[j][1])
                links[reps[j][1]].add(reps[i][1])
    part = {d: d for d in links}
    for _ in links:
        part = {d: min([part[d], *(part[x] for x in links[d])]) for d in links}
    return sorted(((d, None, None, 0) if d is None else (d, texts[t or ""], part[texts[t or ""]], len(links[texts[t or ""]])) for d, t in rows), key=str)


def near_copies(seed, many=90):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    common = [word() for _ in range(40)]
    rows = []
    for size in (1, 2, 5, many):
        base = [word() for _ in range(120)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    rows += [" ".join(common + [word() for _ in range(20)]) for _ in range(40)]
    rows += ["", None, "one", "one", "one two three four", "one two three four five", rows[3], " ".join(rows[3].split())]
    rng.shuffle(rows)
    out = [(i * 3, t) for i, t in enumerate(rows)]
    return [*out, (None, rows[0]), out[5], out[5]]


@pytest.mark.parametrize("few,block", [(24, 512), (3, 16)])
def test_join_equals_brute_force(spark, monkeypatch, few, block):
    monkeypatch.setattr(lsh_forest, "FEW", few)
    monkeypatch.setattr(lsh_forest, "BLOCK_TEXTS", block)
    monkeypatch.setattr(lsh_forest, "SMALL_BLOCK", block)
    monkeypatch.setattr(lsh_forest, "NODE_BLOCK", block)
    rows = near_copies(7)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, label string")
    assert sorted(map(tuple, lsh_forest.jaccard_join(df).collect()), key=str) == plain_join(rows)


def test_links_count_once_beside_an_empty_block(spark, monkeypatch):
    monkeypatch.setattr(lsh_forest, "BLOCK_SHINGLES", 60)
    # Two or three near copies make two blocks; in some of the groups all of them fall in one.
    rows = [(4 * g + k, " ".join([*(f"g{g}w{x}" for x in range(40)), f"end{k}"])) for g in range(16) for k in range(2 + g % 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, lsh_forest.jaccard_join(df).collect()), key=str) == plain_join(rows)


def test_join_edges(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert lsh_forest.jaccard_join(df).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f", "en"), (2, "a b c d e f", "en"), (2, "a b c d e f", "en"), (None, "a b c d e f", None)], "doc_id bigint, text string, lang string")
    assert sorted(str(r["doc_id"]) for r in lsh_forest.one_of_each(docs).collect()) == ["1", "None"]
    docs = spark.createDataFrame([(1, "a b c d e f"), (3, "a b c d e f"), (3, "u v w x y z"), (3, "q r s t u v"), (3, "q r s t u v")], "doc_id bigint, text string")
    assert sorted(tuple(r) for r in lsh_forest.one_of_each(docs).collect()) == [(1, "a b c d e f"), (3, "q r s t u v"), (3, "u v w x y z")]


def test_prefixes_are_shortened_until_the_target():
    need, lost = lsh_forest.least_company(0.8, 32, 0.9999)
    rng = np.random.default_rng(0)
    assert need == 3 and 0 < lost <= 2.5e-5 and lsh_forest.least_company(0.8, 4, 0.9999) == (0, 0.0)
    depth, trees = lsh_forest.shortened(0.8, 32, 8, 1e-4 - lost)
    miss = lambda d, n: (1 - 0.8**d) ** n * (1 - 0.8 ** (d + 1)) ** (32 - n)
    assert depth == 6 and miss(depth, trees) <= 1e-4 - lost < miss(depth, trees - 1)
    assert lsh_forest.shortened(0.8, 32, 8, 0.9) == (7, 1) and lsh_forest.shortened(0.1, 4, 8, 1e-9) == (4, 4)
    same = rng.random((400_000, 32, 8)) < 0.8  # labels of pairs at the threshold
    prefix = np.cumprod(same, axis=2).sum(2)
    found = (prefix[:, :trees] >= depth).any(1) | (prefix[:, trees:] > depth).any(1)
    assert ((prefix >= 4).sum(1) >= need)[found].mean() > 0.9999 and found.mean() > 0.9998
    assert lsh_forest.loss_by_sketch(0.8) < 1e-5


def test_recall_of_the_forest_on_the_tables(spark):
    """All pairs at the threshold of the middle table meet in a node: links are those of an inverted list."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, lsh_forest.jaccard_join(docs).collect()), key=str) == plain_join(rows)


def test_links_of_counts_every_width():
    rng = np.random.default_rng(0)
    base = np.arange(300, dtype=np.uint64)
    sets = [np.unique(np.where(rng.random(300) < 0.08, rng.integers(1000, 9000, 300).astype(np.uint64), base)) for _ in range(150)]
    got = lsh_forest.links_of(sets, (8, 10))
    for i in range(0, 150, 7):
        for j in range(150):
            both = len(np.intersect1d(sets[i], sets[j]))
            assert got[i, j] == (i != j and 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both))


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(5, 5), (300, None), (100, 101)]
    want = {}
    for a, b in edges:
        if b is not None and a != b:
            want.setdefault(a, a), want.setdefault(b, b)
    for _ in range(200):
        for a, b in edges:
            if b is not None and a != b:
                want[a] = want[b] = min(want[a], want[b])
    got = connected_components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert {r["node"]: r["component"] for r in got.collect()} == want and got.count() == len(want)
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
