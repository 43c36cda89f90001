"""The prefix trie against brute force, with long conversations, ties, nulls and many copies."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from cohortlens.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, node string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            text = text or ""
            own[c].append(((turn is not None, turn or 0), role or "", hashlib.sha256(text.encode()).hexdigest(), text))
    own = {c: [(t[1], t[3]) for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - int(np.fmod(c, 5)), [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, convs in members.items():
        cost = (len(convs) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += cost
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(built[c]) == len(node))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


def rows_of(seed, convs=60, longest=12, words=3):
    rng = np.random.default_rng(seed)
    rows = []
    for c in rng.choice(3 * convs, convs, replace=False):
        n = int(rng.integers(1, longest))
        for t in range(n):
            turn = None if rng.random() < 0.1 else int(rng.integers(0, n))
            rows.append((int(c), turn, [None, "user", "", "u"][rng.integers(4)], [None, "", "é", "word " * int(rng.integers(1, words))][rng.integers(4)], 3, "x"))
    return rows


def got(spark, rows, **kw):
    return sorted(str(tuple(r[c] for c in COLUMNS)) for r in prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), **kw).collect())


@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force_with_ties_and_nulls(spark, seed):
    rows = rows_of(seed) + [(None, 1, "user", "x", 3, "x"), (-7, 0, "user", "y", 3, "x"), (-5, 0, "user", "y", 3, "x")]
    rows += rows[:30]  # repeated rows are turns each
    assert got(spark, rows) == brute(rows)


def test_long_conversations_are_chained_in_blocks_and_split_over_tasks(spark):
    """A conversation with more than a third of all rows; blocks of 4 turns need three levels."""
    rows = [(c, t, "user", f"t{t % 7} " * (1 + t % 3), 3, "x") for c, n in ((10, 90), (11, 90), (12, 64), (13, 65), (20, 16), (24, 17), (25, 5), (26, 1)) for t in range(n - (c == 11))]
    rows += [(c, 90, "user", "end", 3, "x") for c in (10, 11)]
    want = brute(rows)
    assert got(spark, rows, block=4) == want
    assert got(spark, rows) == want


def test_many_copies_and_very_long_texts(spark):
    rows = [(c, t, "user", f"same {t}", 3, "x") for c in range(400) for t in range(3)] + [(c, 0, "user", "long " * 50_000, 3, "x") for c in range(400, 404)]
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("piece", [1, 40, 1 << 16])
def test_member_digests_do_not_depend_on_pieces(spark, piece):
    ends = spark.createDataFrame([(bytearray([n]), i) for n in range(3) for i in range(-20, 300, n + 1)], "node binary, conv_id bigint")
    want = {bytes([n]): hashlib.sha256(",".join(map(str, range(-20, 300, n + 1))).encode()).hexdigest() for n in range(3)}
    assert {bytes(r["node"]): r["ends_sha256"] for r in prefix_trie.id_digests(ends, piece).collect()} == want


def test_empty_table_and_turnless_conversations(spark):
    assert got(spark, []) == []
    short = [c for c in range(1, 60) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0][:3]  # no first conversation, and own turns skipped
    rows = [(c, 0, "user", "x", 3, "x") for c in short]
    assert got(spark, rows) == brute(rows)
    assert len(brute(rows)) == 1


def test_sql_equals_brute_force(spark):
    rows = rows_of(5) + [(-7, 0, "user", "y", 3, "x"), (10**12, 0, "user", "y", 3, "x")]
    con = duckdb.connect()
    con.register("conversations", spark.createDataFrame(rows, SCHEMA).toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    names = [d[0] for d in con.sql(prefix_trie.SQL).description]
    assert sorted(str(tuple(r[names.index(c)] for c in COLUMNS)) for r in con.sql(prefix_trie.SQL).fetchall()) == brute(rows)
