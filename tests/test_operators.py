"""Order-dependent operators against plain specifications, and the traps of the survey."""

import random

from pyspark.sql import functions as F

from trajspark.functions import text as T
from trajspark.operators import analytics, graph, steps, store, training


def test_pair_count_equals_greedy_scan(spark):
    random.seed(3)
    rows, want = [], {}
    for c in range(40):
        roles = [random.choice(["user", "assistant", "tool_call", "tool_response"]) for _ in range(random.randrange(1, 12))]
        rows += [(c, i, r, "x") for i, r in enumerate(roles)]
        n = i = 0
        while i < len(roles) - 1:
            if roles[i : i + 2] == ["tool_call", "tool_response"]:
                n, i = n + 1, i + 2
            else:
                i += 1
        want[c] = n
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {r.conv_id: r.pairs for r in steps.pair_count(df, "tool_call", "tool_response").collect()} == want


def test_prefix_breaks_and_null_is_invalid(spark):
    df = spark.createDataFrame([(1, 0, True), (1, 1, None), (1, 2, True), (2, 0, True), (2, 1, True)], "conv_id long, turn long, ok boolean")
    got = steps.valid_prefix(df, F.col("ok")).select("conv_id", "turn").collect()
    assert sorted(map(tuple, got)) == [(1, 0), (2, 0), (2, 1)]


def test_history_is_what_came_before(spark):
    df = spark.createDataFrame([(1, i, r, str(i)) for i, r in enumerate(["user", "assistant", "user", "assistant", "assistant", "user"])], "conv_id long, turn long, role string, text string")
    got = {r.turn: r.history for r in training.supervised(df).collect()}
    assert got == {1: [], 3: [["0", "1"]]}


def test_split_cuts_at_floor(spark):
    df = spark.range(11).withColumnRenamed("id", "conv_id")
    assert training.split(df, 0.9).where("part = 'train'").count() == 9
    assert training.split(df, 0.9, seed=5).where("part = 'train'").count() == 9
    assert training.split(df.limit(0), 0.9).count() == 0


def test_aggregate_keeps_nulls_in_push_and_counts_missing_as_zero(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "b", None), (3, "a", None)], "_id long, k string, v double")
    got = {r._id: (r.s, r.a, r.p, r.f) for r in store.aggregate(df, [{"$group": {"_id": "$k", "s": {"$sum": "$v"}, "a": {"$avg": "$v"}, "p": {"$push": "$v"}, "f": {"$first": "$v"}}}]).collect()}
    assert got == {"a": (2.0, 1.0, [2.0, None], 2.0), "b": (0.0, 0.0, [None], None)}
    assert store.aggregate(df.limit(0), [{"$count": "n"}]).first().n == 0


def test_find_skips_before_projection_and_matches_null(spark):
    df = spark.createDataFrame([(i, None if i % 2 else i) for i in range(10)], "_id long, v long")
    assert [r._id for r in store.find(df, {"v": None}, limit=2, skip=1, include=["v"]).collect()] == [3, 5]


def test_floor_quantiles(spark):
    random.seed(1)
    data = {k: [random.randrange(100) for _ in range(n)] for k, n in (("a", 1), ("b", 4), ("c", 7))}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, v long")
    got = {r.k: (r.q1, r.q2, r.q3) for r in store.floor_quantiles(df, "k", "v").collect()}
    assert got == {k: tuple(sorted(v)[len(v) * q // 4] for q in (1, 2, 3)) for k, v in data.items()}


def test_merge_is_greedy_and_not_transitive(spark):
    random.seed(7)
    pairs = sorted({tuple(sorted(random.sample(range(30), 2))) for _ in range(45)})
    absorbed, want = set(), {}
    for i in range(30):
        if i not in absorbed:
            for a, b in pairs:
                if a == i and b not in absorbed:
                    absorbed.add(b)
                    want[b] = i
    got = graph.merged(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.id: r.representative for r in got} == want


def test_replay_folds_in_order(spark):
    df = spark.createDataFrame([(1, 1, "set", "x", 2.0), (1, 2, "add", "x", 3.0), (1, 3, "delete", "x", 0.0), (1, 4, "delete", "x", 0.0)], "c long, o long, op string, item string, value double")
    assert [(r.response, r.total) for r in store.replay(df, "c", "o").orderBy("o").collect()] == [("created", 2.0), ("updated", 5.0), ("deleted", 0.0), ("missing", 0.0)]


def test_weighted_and_empty(spark):
    df = spark.createDataFrame([(1, 3), (4, 2), (9, 1)], "value long, n long")
    assert tuple(analytics.weighted(df).first()) == (20 / 6, 2.5)
    assert tuple(analytics.weighted(df.limit(0)).first()) == (0.0, 0.0)


def test_text_functions(spark):
    df = spark.createDataFrame([("so {\"a\": 1} end",), ("none",), ("<think>t</think> rest",)], "t string")
    got = df.select(T.salvage_json(F.col("t")), *T.split_think(F.col("t"))).collect()
    assert got[0][0] == '{"a": 1}' and got[1][0] == "none" and (got[2][1], got[2][2]) == ("t", "rest")
