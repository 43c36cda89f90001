"""Comparisons of artifacts: each verdict with something that differs and something that does not."""

import json

from cohortlens.operators import invariance as inv


def one(df):
    r = df.first()
    return r["status"], r["detail"]


def test_rows_and_numbers(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (1, 1.0, "x"), (2, None, None)], "k int, v double, note string")
    assert one(inv.compare_rows("t", a, a.selectExpr("'y' as note", "v", "k"), ("note",))) == ("PASS", "rows=3, only left=0, only right=0")
    assert one(inv.compare_rows("t", a, a.distinct())) == ("FAIL", "rows=3, only left=1, only right=0")
    assert one(inv.compare_rows("t", a, a.drop("v")))[0] == "FAIL"
    n = spark.createDataFrame([(1, 1.0, float("nan")), (2, None, float("inf")), (None, 1e9, 0.0)], "k int, v double, w double")
    near = spark.createDataFrame([(1, 1.0 + 1e-12, float("nan")), (2, None, float("inf")), (None, 1e9 + 1e-3, 0.0)], "k int, v double, w double")
    far = spark.createDataFrame([(1, 1.1, 1.0), (2, 0.0, float("-inf")), (3, 1.0, 1.0)], "k int, v double, w double")
    assert one(inv.compare_close("t", n, near, ["k"], ["v", "w"])) == ("PASS", "keys=3, unmatched=0, v=0, w=0")
    assert one(inv.compare_close("t", n, far, ["k"], ["v", "w"])) == ("FAIL", "keys=2, unmatched=2, v=2, w=2")


def test_partitions_by_members(spark):
    a = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(10)] + [(10, None), (11, None)], "m int, c string")
    assert one(inv.compare_partition("t", a, a.selectExpr("m", "case when c = 'a' then 'z' else c end as c"), "m", "c")) == ("PASS", "members=12, unmatched=0, moved=0, clusters=4/4")
    moved = a.selectExpr("m", "case when m = 9 then 'a' else c end as c").where("m <> 11")
    assert one(inv.compare_partition("t", a, moved, "m", "c")) == ("FAIL", "members=11, unmatched=1, moved=10, clusters=4/3")


def test_json_leaf_by_leaf(spark):
    deep = json.loads("[" * 200 + "1" + "]" * 200)
    texts = ['{"a": [1, {"b": null}], "t": 1, "e": {}}', "no json", None, json.dumps({"d": deep, "s": "é.x"})]
    others = ['{"e":{}, "t": 2,"a":[1,{"b":null}]}', "no json", None, json.dumps({"s": "é.x", "d": deep})]
    frame = lambda rows: spark.createDataFrame(list(enumerate(rows)), "k int, j string")
    assert one(inv.compare_json("t", frame(texts), frame(others), "k", "j", ("t",)))[0] == "PASS"
    found = inv.json_differences(frame(texts), frame(['{"a": [1, {"b": 0}, 3], "t": {"t": 1}, "e": []}', "other", "null", others[3]]), "k", "j", ("t",)).collect()
    assert sorted(map(tuple, found), key=str) == sorted([(0, '."a"[1]."b"', "null", "0"), (0, '."a"[2]', None, "3"), (0, '."e"', "{}", "[]"), (1, "error", '"no json"', '"other"'), (2, "error", "null", None), (2, "$", None, "null")], key=str)


def test_bytes_and_the_verdict(spark):
    a = spark.createDataFrame([("x", 1, "aa"), ("y", 1, "bb"), ("z", 1, "cc")], "path string, size_bytes int, sha256 string")
    b = spark.createDataFrame([("x", 1, "AA"), ("y", 1, "b0")], "path string, size_bytes int, sha256 string")
    rows = inv.report([inv.compare_bytes(a, b), inv.compare_rows("r", a, a)])
    assert {(r["artifact"], r["status"]) for r in rows.collect()} == {("x", "PASS"), ("y", "FAIL"), ("z", "FAIL"), ("r", "PASS")}
    assert tuple(inv.verdict(rows).first()) == ("FAIL", 2, 2) and tuple(inv.verdict(rows.limit(0)).first()) == ("PASS", 0, 0)


def test_texts_meet_as_a_whole_and_repeated_keys_leaf_by_leaf(spark):
    frame = lambda rows: spark.createDataFrame(rows, "k int, j string")
    a = frame([(1, '{"x": 1, "t": 1}'), (2, '{"x": 1}'), (2, '{"y": 2}'), (3, '{"t": 1}'), (4, "[1.0]"), (None, "1"), (5, None), (6, '{"x": [1, true]}')])
    b = frame([(1, '{"t": 2, "x": 1}'), (2, '{"x": 1, "y": 3}'), (3, "{}"), (4, "[1]"), (None, "1"), (6, '{"x": [1, 1]}')])
    found = inv.json_differences(a, b, "k", "j", ("t",))
    want = [(2, '."y"', "2", "3"), (3, "$", None, "{}"), (4, "[0]", "1.0", "1"), (None, "$", "1", None), (None, "$", None, "1"), (5, "error", "null", None), (6, '."x"[1]', "true", "1")]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    once = inv.json_differences(a.where("k <> 2"), b.where("k <> 2"), "k", "j")
    before = once._jdf.queryExecution().optimizedPlan().toString()
    assert "path" not in before.split("MapInArrow")[1].split("\n", 1)[1]  # nothing is joined or shuffled leaf by leaf


def test_members_meet_once(spark):
    a = spark.createDataFrame([(1, "p"), (2, "p"), (3, None), (4, "q"), (4, "r"), (5, "q"), (5, "q"), (7, None)], "m int, c string")
    b = spark.createDataFrame([(1, "z"), (2, "z"), (3, None), (4, "y"), (5, "y"), (6, "x"), (7, "w")], "m int, c string")
    df = inv.compare_partition("t", a, b, "m", "c")
    assert one(df) == ("FAIL", "members=7, unmatched=1, moved=1, clusters=4/5")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joins = inv.compare_partition("t", a, b, "m", "c")._jdf.queryExecution().optimizedPlan().toString()
        assert "Join LeftOuter" in joins.split("Join FullOuter")[0] and "Join LeftOuter" not in joins.split("Join FullOuter")[1]  # clusters are joined to counts, not to members
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
