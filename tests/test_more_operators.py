"""Catalog, trace, path and knowledge-graph operators against plain specifications."""

import fnmatch
import math
import random

import pytest
from pyspark.sql import functions as F

from trajspark.functions import text as T
from trajspark.operators import catalog, graph, knowledge, paths, traces


def test_admission_needs_calls_and_all_servers(spark):
    df = spark.createDataFrame([(1, ["c"], ["a"], {"a": "x"}), (2, ["c"], ["a", "b"], {"a": "x"}), (3, [], ["a"], {"a": "x"}), (4, ["c"], [], {"a": "x"}), (5, None, None, None), (6, ["c"], ["a"], None)], "i int, calls array<string>, servers array<string>, s map<string,string>")
    got = {r.i: r.ok for r in df.select("i", catalog.admitted(F.col("calls"), F.col("servers"), F.col("s")).alias("ok")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: False, 6: False}


def test_visible_tools(spark):
    df = spark.createDataFrame([("s-find", "s"), ("s-load_scenario", "s"), ("t-find", "t")], "tool string, server string")
    assert [r.tool for r in catalog.visible_tools(df, ["s"]).collect()] == ["s-find"]
    assert catalog.visible_tools(df).count() == 3


def test_weighted_pairs_with_zero_parts(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(3)], [rng.gauss(0, 1) for _ in range(3)]) for i in range(25)] + [(25, [1.0, 0.0, 0.0], [0.0, 0.0, 0.0])]

    def cos(a, b):
        n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b)) / n if n else 0.0

    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and 0.6 * cos(a[1], b[1]) + 0.4 * cos(a[2], b[2]) > 0.5}
    df = spark.createDataFrame(rows, "id long, n array<double>, d array<double>")
    assert {(r.a, r.b) for r in graph.weighted_pairs(df, "id", "n", "d", 0.5).collect()} == want


def test_log_shapes(spark):
    df = spark.createDataFrame([("1", '[{"user": "a"}, {"assistant": ["b", "c"]}]'), ("02", '{"system": "d"}'), ("x", "[1]"), ("3", '"no"'), ("4", None), (None, "[1]")], "key string, messages string")
    out = traces.normalised_turns(df)
    field, text = traces.shown_message(F.col("message"))
    got = sorted((r.turn, r.position, r.f, r.t) for r in out.select("turn", "position", field.alias("f"), text.alias("t")).collect())
    assert got == [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "system", "d")]


def test_log_merge_appends(spark):
    a, b = (spark.createDataFrame(r, "key string, items array<int>") for r in ([("p", [1]), ("q", [2])], [("p", [3, 1]), ("r", [4])]))
    assert {r.key: r["items"] for r in traces.merged_log(a, b).collect()} == {"p": [1, 3, 1], "q": [2], "r": [4]}


def test_labels_need_the_role_and_kept_steps_pull_answers(spark):
    steps = spark.createDataFrame([(1, i, r) for i, r in enumerate(["user", "tool_call", "tool_response", "assistant", "user"])], "conv_id long, idx long, role string")
    labels = spark.createDataFrame([(1, 1, "tool_call", "HIDE"), (1, 3, "user", "REMOVE")], "conv_id long, idx long, role string, type string")
    assert {r.idx: r.type for r in traces.classified(steps, labels).collect()} == {0: None, 1: "HIDE", 2: None, 3: None, 4: None}
    chosen = spark.createDataFrame([(1, 1)], "conv_id long, idx long")
    assert sorted(r.idx for r in traces.kept_steps(steps, chosen).collect()) == [0, 1, 2]


@pytest.mark.parametrize("glob", ["*.py", "/a/*", "/a/**/b.py", "**/c?.txt", "/a/[x].py"])
def test_globs(spark, glob):
    names = ["x.py", "/a/x", "/a/b.py", "/a/q/r/b.py", "/z/c1.txt", "/z/c12.txt", "/a/[x].py", "/a/x.py"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    got = {r.p for r in df.where(paths.matches(F.col("p"), glob)).collect()}
    want = {"*.py": {"x.py"}, "/a/*": {"/a/x", "/a/b.py", "/a/[x].py", "/a/x.py"}, "/a/**/b.py": {"/a/b.py", "/a/q/r/b.py"}, "**/c?.txt": {"/z/c1.txt"}, "/a/[x].py": {"/a/[x].py"}}
    assert got == want[glob] and got <= {n for n in names if fnmatch.fnmatch(n, glob.replace("[", "[[]").replace("**/", "*"))}


def test_trees_and_diffs(spark):
    df = spark.createDataFrame([("/a/x", 1), ("/a/b/y", 2), ("/z", 4)], "path string, size long")
    assert {r.folder: (r.n, r["size"]) for r in paths.tree_sizes(df).collect()} == {"/": (3, 7), "/a": (2, 3), "/a/b": (1, 2)}
    assert {(r.name, r.kind, r["size"]) for r in paths.listing(df, "/a").collect()} == {("x", "file", 1), ("b", "folder", 2)}
    two = spark.createDataFrame([("f", "a\nb", "a\nc"), ("g", None, ""), ("h", "s", "s")], "path string, old string, new string")
    got = {r.path: r["diff"] for r in paths.unified_diff(two, "old", "new").collect()}
    assert got == {"f": "--- a/f\n+++ b/f\n@@ -1,2 +1,2 @@\n a\n-b\n+c", "g": "", "h": ""}


def test_knowledge_graph(spark):
    e = spark.createDataFrame([("A", "k", ["x"]), ("B", "k", None), ("C", "odd", ["Find me"])], "name string, kind string, observations array<string>")
    r = spark.createDataFrame([("A", "B", "r"), ("B", "C", "r"), ("A", "A", "r")], "source string, target string, kind string")
    more = spark.createDataFrame([("A", "x", 0), ("A", "y", 1), ("A", "y", 2), ("B", "z", 0), ("no", "q", 0)], "name string, observation string, ord int")
    assert {x.name: x.observations for x in knowledge.add_observations(e, more).collect()} == {"A": ["x", "y", "y"], "B": ["z"], "C": ["Find me"]}
    assert knowledge.add_entities(e, e.limit(2).unionByName(spark.createDataFrame([("D", "k", ["1"])], e.schema))).count() == 4
    assert knowledge.add_relations(r, r.limit(1)).count() == 3
    hits, rel = knowledge.search_nodes(e, r, "FIND")
    assert [x.name for x in hits.collect()] == ["C"] and [(x.source, x.target) for x in rel.collect()] == [("B", "C")]
    _, inner = knowledge.open_nodes(e, r, ["A", "B"])
    assert {(x.source, x.target) for x in inner.collect()} == {("A", "B"), ("A", "A")}
    left, kept = knowledge.delete_entities(e, r, spark.createDataFrame([("B",)], "name string"))
    assert left.count() == 2 and [(x.source, x.target) for x in kept.collect()] == [("A", "A")]


def test_scalars(spark):
    df = spark.createDataFrame([(3.0, "Mon, 01 Jan 2024 10:00:00 +0000", "x <a> in <b> y", "s-t"), (0.0, "never", "none", "st")], "v double, d string, t string, n string")
    got = df.select(T.arithmetic("2 ** v - 6 / v + sqrt(4)", ("v",)).alias("r"), T.mail_date(F.col("d")).cast("string").alias("d"), T.section(F.col("t"), "<a>", "<b>").alias("s"), T.is_client_tool(F.col("n")).alias("ok")).collect()
    assert tuple(got[0]) == (8.0, "2024-01-01 10:00:00", "in", True) and tuple(got[1]) == (None, None, None, False)
    for bad in ("__import__('os')", "v.real", "[1]", "unknown", "sqrt(x=1)"):
        with pytest.raises(ValueError):
            T.arithmetic(bad, ("v",))
