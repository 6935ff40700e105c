"""Turns, training rows, sampling, viewers against plain specifications."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trajspark.functions import text as T
from trajspark.functions.draws import RANGE, draw
from trajspark.operators import analytics, graph, registry, sampling, store, turns, views

STEP = "conv long, node long, idx long, role string, text string, type string, think string, think_present boolean"


def chains(seed=1, n=60):
    """Conversations as {conv: [(decision, [(role, text, type, think, present)])]}."""
    r, out = random.Random(seed), {}
    for c in range(n):
        nodes = []
        for _ in range(r.randrange(0, 5)):
            steps = []
            for i in range(r.randrange(0, 8)):
                role = r.choice((["user", "tool_response"], ["assistant", "tool_call"])[i % 2]) if r.random() < 0.95 else r.choice(["user", "assistant"])
                steps.append((role, f" t{r.randrange(99)}" + r.choice(["", "", " Error", " error", " Fail\n"]), r.choice([None, None, "KEEP", "HIDE", "REMOVE"]), r.choice([None, "hm"]), r.random() < 0.5))
            nodes.append((r.choice([True, True, True, False, None]), steps))
        out[c] = nodes
    return out


def tables(spark, data):
    steps = [(c, n, i, *s) for c, nodes in data.items() for n, (_, ss) in enumerate(nodes) for i, s in enumerate(ss)]
    return spark.createDataFrame(steps, STEP), spark.createDataFrame([(c, n, d) for c, nodes in data.items() for n, (d, _) in enumerate(nodes)], "conv long, node long, decision boolean")


def pairs(roles, a, b):
    n = i = 0
    while i < len(roles) - 1:
        hit = roles[i] == a and roles[i + 1] == b
        n, i = n + hit, i + 1 + hit
    return n


def test_six_distributions(spark):
    data = chains()
    want = {k: Counter() for k in ("steps_per_turn", "tool_calls_per_turn", "user_interactions_per_turn", "steps_per_conversation")}
    for nodes in data.values():
        total = 0
        for decision, steps in nodes:
            if not decision or not steps:
                break
            roles = [s[0] for s in steps]
            calls, talks = pairs(roles, "tool_call", "tool_response"), pairs(roles, "assistant", "user")
            total += calls + talks
            for k, v in (("steps", calls + talks), ("tool_calls", calls), ("user_interactions", talks)):
                want[f"{k}_per_turn"][v] += 1
        if total:
            want["steps_per_conversation"][total] += 1
    flat = {(f"{k}_distribution", str(v)): n for k, c in want.items() for v, n in c.items()}
    flat |= {("turn_distribution", str(v)): n for v, n in want["steps_per_conversation"].items()} | {("mcp_server_distribution", "s"): 2}
    servers = spark.createDataFrame([(1, "s"), (1, "s"), (2, "s")], "conv long, server string")
    assert {(r.metric, r.value): r.n for r in turns.chain_stats(*tables(spark, data), servers).collect()} == flat


@pytest.mark.parametrize("think", [True, False])
def test_training_rows(spark, think):
    data = chains(2, 400)
    want = {}
    for c, nodes in data.items():
        history = []
        for n, (decision, steps) in enumerate(nodes):
            if not decision or not steps:
                break
            if any((s[0] in ("user", "tool_response")) != (i % 2 == 0) for i, s in enumerate(steps)):
                break
            if not any(s[0] == "tool_call" for s in steps):
                continue
            for i in range(0, len(steps) - 1, 2):
                (_, said, *_), (role, text, kind, thought, present) = steps[i], steps[i + 1]
                if kind == "REMOVE":
                    continue
                failed = role == "tool_call" and i + 2 < len(steps) and steps[i + 2][0] == "tool_response" and any(x in steps[i + 2][1] for x in ("Fail", "Error"))
                if not failed and kind in (None, "KEEP"):
                    want[c, n, i] = (said.strip(), (f"<think>{thought}</think>\n\n" if think and present else "") + text, [list(h) for h in history])
                history.append([said, text])
    got = {(r.conv, r.node, r.idx): (r.instruction, r.output, r.history) for r in turns.training_rows(*tables(spark, data), think).collect()}
    assert got == want and len(want) > 40


def test_averages_divide_by_what_is_listed(spark):
    steps, _ = tables(spark, {1: [(True, [("user", "a", None, None, False), ("assistant", "b", None, None, False)])], 2: [(None, [("user", "a", None, None, False)])]})
    metrics = turns.turn_metrics(steps, ("user", "assistant"))
    row = turns.analysis_summary(metrics, spark.range(4)).first()
    assert (row.total_conversations, row.total_steps, row.avg_steps_per_conversation, row.avg_steps_per_turn, row.avg_turns_per_conversation) == (4, 3, 0.75, 1.5, 0.25)
    assert turns.analysis_summary(metrics.limit(0), spark.range(0)).first().avg_steps_per_turn == 0.0


def test_step_text(spark):
    df = spark.createDataFrame([("tool_call", None, [('a"b', '{"x": 1}'), ("c", "[]")], None), ("tool_response", None, None, ["r", "s"]), ("user", "hi", None, None), ("user", None, None, None)], "role string, text string, calls array<struct<name: string, arguments: string>>, responses array<string>")
    got = [r[0] for r in df.select(turns.step_text(*map(F.col, df.columns))).collect()]
    assert got == ['<tool_call>\n{"name": "a\\"b", "arguments": {"x": 1}}\n</tool_call>\n<tool_call>\n{"name": "c", "arguments": []}\n</tool_call>\n', "<tool_response>\nr\n</tool_response>\n<tool_response>\ns\n</tool_response>\n", "hi", None]
    with pytest.raises(Exception, match="no such role"):
        spark.createDataFrame([("odd", "t", None, None)], df.schema).select(turns.step_text(*map(F.col, df.columns))).collect()


def test_rendered_conversation(spark):
    steps, _ = tables(spark, {1: [(True, [("user", "a", None, None, False), ("tool_call", "c", None, None, False)])]})
    asked = spark.createDataFrame([(1, 0, []), (1, 1, ["s-x", "s-y"]), (1, 2, ["z"])], "conv long, node long, tools array<string>")
    assert turns.rendered_conversation(steps, asked, 1).first().conversation == "[Turn 1] (Previous)\n- User: a\n- Tool Call: c\n\n[Turn 2] (Current)\n- Target Tool Name 1: s-x\n- Target Tool Name 2: s-y"
    assert turns.rendered_conversation(steps, asked, 0, False).first().conversation == "[Turn 1] (Current)\n- User: a\n- Tool Call: c"


def test_split_turns_follow_the_open_turn(spark):
    df = spark.createDataFrame([(c, p, "x") for c in range(80) for p in range(14)], "chain long, pos long, tool string")
    rows = sampling.split_turns(df, most=4, seed=3).orderBy("chain", "pos").collect()
    drawn = {(r.chain, r.pos): r.d for r in df.select("chain", "pos", draw(F.lit(3), F.col("chain"), F.col("pos")).alias("d")).collect()}
    lengths = Counter()
    for c in range(80):
        turn = length = 0
        for r in (x for x in rows if x.chain == c):
            length += 1
            assert (r.turn, r.tool) == (turn, "x")
            if length >= 4 or drawn[c, r.pos] / RANGE < length / 4:
                lengths[length] += 1
                turn, length = turn + 1, 0
    assert set(lengths) == {1, 2, 3, 4}


def test_draws_are_spread(spark):
    d = [r.d / RANGE for r in spark.range(4000).select(draw(F.lit(5), F.col("id")).alias("d")).collect()]
    assert abs(sum(d) / len(d) - 0.5) < 0.03 and all(abs(sum(k / 4 <= x < (k + 1) / 4 for x in d) / len(d) - 0.25) < 0.04 for k in range(4))


def graph_of(spark):
    r = random.Random(2)
    edges = sorted({(a, r.randrange(30)) for a in range(30) for _ in range(3) if a % 7} - {(a, a) for a in range(30)})
    return edges, spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(n, f"s{n % 5}") for n in range(30)], "node long, server string")


def test_chains_walk_edges_or_stay_at_the_server(spark):
    edges, e, tools = graph_of(spark)
    seeds = spark.createDataFrame([(s, s % 30) for s in range(40)], "seed long, start long")
    rows = sampling.sample_chain(e, tools, seeds, 6).collect()
    for s in range(40):
        at = [r.node for r in sorted(rows, key=lambda r: r.step) if r.seed == s]
        assert len(at) == 6 and at[0] == s % 30
        for i in range(5):
            open_ = {b for a, b in edges if a == at[i]} - set(at[: i + 1])
            assert at[i + 1] in open_ if open_ else at[i + 1] % 5 == at[i] % 5
    assert sorted(rows) == sorted(sampling.sample_chain(e.repartition(5), tools, seeds, 6).collect())
    # another strategy: all successors, breadth first
    def all_(step, front, edges):
        return front.join(edges.selectExpr("src node", "dst"), "node").select("seed", "dst")
    wide = sampling.sample_chain(e, tools, seeds, 5, all_).collect()
    assert len(wide) == 200 and {r.node for r in wide if r.seed == 1 and r.step == 1} == {min(b for a, b in edges if a == 1)}


def test_topology_chains_keep_the_rules(spark):
    edges, e, tools = graph_of(spark)
    inputs = spark.createDataFrame([(n, f"p{(n * 7 + k) % 11}", k == 0, k == 2) for n in range(30) for k in range(3)], "node long, param string, required boolean, user_provided boolean")
    gives = spark.createDataFrame([(n, f"p{n % 11}") for n in range(30)], "node long, param string")
    seeds = spark.createDataFrame([(s, s % 30) for s in range(25)], "seed long, start long")
    rows = sampling.topology_sample(e, inputs, gives, tools, seeds, max_nodes=5, servers=2, optional=1.0, valid=1.0).collect()
    need = {n: f"p{n * 7 % 11}" for n in range(30)}
    priors = 0
    for s in range(25):
        at = [r.node for r in sorted(rows, key=lambda r: r.step) if r.seed == s]
        assert s % 30 in at and len(at) >= 5
        first = at[: at.index(s % 30)]
        priors += len(first)
        # the required input of the start is filled before it, if another tool gives it
        assert any(f"p{x % 11}" == need[s % 30] and x != s % 30 for x in first) or s % 30 in {x for x in range(30) if f"p{x % 11}" == need[s % 30]} or not first
    assert priors > 10
    assert sorted(rows) == sorted(sampling.topology_sample(e.repartition(3), inputs, gives, tools, seeds, max_nodes=5, servers=2, optional=1.0, valid=1.0).collect())


def test_links_and_redirects(spark):
    out = spark.createDataFrame([("a", "o1", [1.0, 0.0]), ("b", "o2", [0.0, 2.0]), ("c", "o3", [0.0, 0.0])], "tool string, param string, v array<double>")
    inp = spark.createDataFrame([("a", "i1", [2.0, 0.0]), ("b", "i2", [3.0, 0.1]), ("c", "i3", [0.0, 1.0])], "tool string, param string, v array<double>")
    got = {(r.src, r.dst, r.edge_type) for r in graph.similarity_links(out, inp, 0.9).collect()}
    assert got == {("a", "b", "tool_to_tool"), ("o1", "i2", "parameter_to_parameter"), ("b", "c", "tool_to_tool"), ("o2", "i3", "parameter_to_parameter")}
    edges = spark.createDataFrame([("x", "p1", "k1"), ("x", "p2", "k2"), ("p2", "y", "k3"), ("p1", "p2", "k4")], "src string, dst string, kind string")
    merged = spark.createDataFrame([("p2", "p1")], "id string, representative string")
    assert {tuple(r) for r in graph.redirected(edges, merged).collect()} == {("x", "p1", "k2"), ("p1", "y", "k3")}


def test_views(spark):
    index = spark.createDataFrame([(f"c{k}", k // 2, "data" + str(k % 2)) for k in range(9)], "id string, modified long, folder string")
    page = views.listed(views.in_folders(index, ["All"]), 2, 4).collect()
    assert [r.id for r in page] == ["c5", "c2", "c3", "c0"] and (page[0].total, page[0].total_pages) == (9, 3)
    assert views.in_folders(index, []).count() == views.in_folders(index, None).count() == 0 and views.in_folders(index, ["data1"]).count() == 4
    items = spark.createDataFrame([("c8", 0, "user"), ("c8", 1, "solver"), ("c1", 0, "user")], "conv string, node long, agent string")
    assert views.shown(items, index).count() == 2 and views.shown(items, index, "c1").count() == 1 and views.shown(items, index, "gone", "user").count() == 1
    assert views.traces(items, at="no number").count() == 0 and views.traces(items, "c8", at="1").first().agent == "solver"
    assert tuple(views.conversation(items, "c8").first()) == ("c8", [0, 1], ["solver", "user"], 2) and views.conversation(items, "x").count() == 0
    assert views.one_turn(items, "c8", 1).count() == 1
    shown = views.samples(spark.createDataFrame([(1, "<think>a</think>\n\nb"), (2, "c")], "k long, output string"), 1, 10, "k").collect()
    assert [(r.think, r.answer, r.total) for r in shown] == [("a", "b", 2), (None, "c", 2)]


def test_errors(spark):
    rows = spark.createDataFrame([("s1", "Load Scenario Error", "l", "x"), ("s1", "E", "l", "MULTIPLE"), ("s2", "E", "l", "a single one"), ("s2", "E", "m", None)], "scenario string, type string, location string, details string")
    assert {r.severity: r.n for r in analytics.severity_summary(rows).collect()} == {"critical": 1, "high": 1, "medium": 1, "low": 1}
    assert {(r.type, r.location): (r.n, r.scenarios) for r in analytics.errors(rows).collect()} == {("Load Scenario Error", "l"): (1, "s1"), ("E", "l"): (2, "s1,s2"), ("E", "m"): (1, "s2")}
    assert {r.severity: r.n for r in analytics.severity_summary(rows.limit(0)).collect()} == dict.fromkeys(("critical", "high", "medium", "low"), 0)


def test_structured_text(spark):
    said = ["plan </think> <a>1</a><a>[2]</a><b>x y</b> rest <c>open", "plain", "<a><b>in</b></a>", " <a>1 < 2"]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in said], "t string").select(T.structured(F.col("t"))).collect()]
    assert got[0] == {"think": "plan", "non_think": "<a>1</a><a>[2]</a><b>x y</b> rest <c>open", "a": "[1,[2]]", "b": '["x y"]', "c": '["open"]'}
    assert got[1] == {"non_think": "plain"} and got[2] == {"non_think": "<a><b>in</b></a>", "a": '["<b>in</b>"]'} and got[3] == {"non_think": "<a>1 < 2"}


def test_text_and_maps(spark):
    df = spark.createDataFrame([("it's o'neill 3rd", {"a": 1, "b": None}, {"b": 2})], "t string, m map<string,int>, n map<string,int>")
    row = df.select(T.title(F.col("t")).alias("t"), T.merged_map(F.col("m"), F.col("n")).alias("m"), T.at_key(F.col("m"), F.lit("b"), F.lit(7)).alias("b"), T.at_key(F.col("m"), F.lit("z"), F.lit(7)).alias("z")).first()
    assert (row.t, row.m, row.b, row.z) == ("it's o'neill 3rd".title(), {"a": 1, "b": 2}, None, 7)


def test_store_additions(spark):
    df = spark.createDataFrame([(k, f"n{k}") for k in range(250)], "id long, name string")
    with pytest.raises(Exception, match="no row for key 999"):
        store.lookup(df, "id", 999).collect()
    assert store.lookup(df, "id", 999, "empty").count() == 0 and store.lookup(df, "id", 999, "default", {"name": "?"}).first().name == "?"
    last = store.page_by_token(df, "200", None, None, "id").collect()
    assert len(last) == 50 and last[0].offset is None and store.page_by_number(df, "-3", 5, "id").first().next_cursor == "5"
    assert [r.id for r in store.page(df, 3, 100, "id").collect()] == list(range(200, 250)) and [r.id for r in store.keyset_page(df, 248, 5, "id").collect()] == [249] and store.keyset_page(df, 9999, 2, "id").first().id == 0
    cells = spark.createDataFrame([(i, [f"{c}{i}" for c in "ABCD"]) for i in range(5)], "row int, cells array<string>")
    assert [r["cells"] for r in store.a1_range(cells, "B2:C3").collect()] == [["B1", "C1"], ["B2", "C2"]] and store.a1_range(cells, "AA1:B2").count() == 5
    with pytest.raises(Exception, match="closed"):
        store.guarded_update(df, F.col("id") == 3, F.col("name") == "x", {"name": F.lit("y")}, "closed").collect()
    rows, n = store.insert_documents(spark.createDataFrame([("a", 0)], "_id string, _ord long"), spark.createDataFrame([(None, 1), ("b", 2), (None, 3)], "_id string, _ord long"), 7)
    assert {r._id: r._ord for r in rows.collect()} == {"a": 0, "b": 2, "gen_7": 1, "gen_8": 3} and n == 9
    hours = spark.createDataFrame([("a", "2024-01-01 00:00:00", "2024-01-01 06:00:00"), ("a", "x", "2024-01-01 06:00:00"), ("b", "x", "y")], "k string, s string, e string")
    assert {r.k: r.hours for r in store.mean_hours(hours, ["k"], F.col("s"), F.col("e")).collect()} == {"a": 6.0, "b": 0.0}
    sites = spark.createDataFrame([("p", 0.0, 0.0), ("a", 0.0, 2.0)], "city string, lat double, lon double")
    assert store.nearest(spark.createDataFrame([(0.0, 1.0)], "x double, y double"), F.col("x"), F.col("y"), sites, "city").first().nearest == "a"
    r = random.Random(8)
    pts, cs = ([(k, r.uniform(-9, 9), r.uniform(-9, 9)) for k in range(n)] for n in (200, 40))
    near = store.within(spark.createDataFrame(pts, "p long, lat double, lon double"), spark.createDataFrame(cs, "c long, c_lat double, c_lon double"), 1.5)
    assert {(x.p, x.c) for x in near.collect()} == {(p, c) for p, a, b in pts for c, d, e in cs if ((a - d) ** 2 + (b - e) ** 2) ** 0.5 < 1.5}


def test_floor_quantiles_of_many(spark):
    r = random.Random(4)
    data = {k: [round(r.gauss(0, 9), 1) for _ in range(n)] for k, n in (("a", 5000), ("b", 777), ("c", 2))}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs] + [("d", None)], "k string, v double")
    got = {x.k: (x.q1, x.q2, x.q3) for x in store.floor_quantiles(df, "k", "v").collect()}
    assert got == {k: tuple(sorted(v)[len(v) * q // 4] for q in (1, 2, 3)) for k, v in data.items()}


def test_named_tools(spark):
    state = {"entities": spark.createDataFrame([("A", "k", ["likes tea"])], "name string, kind string, observations array<string>"), "relations": spark.createDataFrame([], "source string, target string, kind string"), "history": spark.createDataFrame([], "expression string, result double"), "saved_locations": spark.createDataFrame([], "alias string, latitude double, longitude double, name string, _ord long"), "documents": spark.createDataFrame([("d.c", "x", 0, 1)], "key string, _id string, _ord long, v int")}
    calls = [("MemoryKnowledgeGraph-create_entities", {"entities": [{"name": "B", "entityType": "k"}, {"name": "A", "entityType": "z"}]}), ("MemoryKnowledgeGraph-create_relations", {"relations": [{"from": "A", "to": "B", "relationType": "r"}, {"from": "A", "to": "no", "relationType": "r"}]}), ("MemoryKnowledgeGraph-search_nodes", {"query": "TEA"}), ("Calculator-calculate", {"expression": "math.sqrt(16) + 1"}), ("Weather-save_location", {"alias": "h", "latitude": 1, "longitude": 2, "name": "Home"}), ("Weather-get_saved_location", {"alias": "h"}), ("Weather-remove_saved_location", {"alias": "h"}), ("MongoDBServer-insert_one", {"database": "d", "collection": "c", "document": {"v": 5}}), ("MongoDBServer-find", {"database": "d", "collection": "c", "sort": {"v": -1}}), ("no-tool", {}), ("Calculator-calculate", {"odd": 1})]
    after, said = registry.replay(state, [{"name": n, "arguments": a} for n, a in calls])
    assert after["entities"].count() == 2 and after["relations"].count() == 1 and after["saved_locations"].count() == 0
    assert said[2][1].first().name == "A" and said[3][1].first().result == 5.0 and said[5][1].first().name == "Home"
    assert [(r._id, r.v) for r in said[8][1].collect()] == [("gen_1", 5), ("x", 1)]
    assert "no tool" in said[9][0] and "unknown arguments ['odd'], missing ['expression']" in said[10][0].replace("missing ones", "missing")
    assert len(registry.names()) > 45 and registry.names(["Calculator"]) == ["Calculator-calculate"]


def test_tools_by_rule(spark):
    schema = lambda *a: {"type": "object", "properties": {x: {"type": "string"} for x in a}, "required": list(a)}
    metadata = [{"class_name": "Shop", "tools": [{"name": "list_items", "input_schema": schema()}, {"name": "get_item_details", "input_schema": schema("item_id")}, {"name": "delete_item", "input_schema": schema("item_id")}, {"name": "search_items", "input_schema": schema("query")}, {"name": "get_two", "input_schema": schema("item_id", "x")}, {"name": "pay", "input_schema": None}]}]
    tools = registry.by_rule(metadata, {"items": "item_id", "users": "user_id"})
    assert set(tools) == {"Shop-list_items", "Shop-get_item_details", "Shop-delete_item", "Shop-search_items"}
    for name, f in tools.items():
        registry.tool(name)(f)
    state = {"items": spark.createDataFrame([("i1", "Red cup", 0), ("i2", "blue 50% cup", 1), (None, "x", 2)], "item_id string, title string, _ord long"), "users": None}
    run = lambda name, **a: registry.call(name, state, a)
    assert [r.item_id for r in run("Shop-list_items")[1].collect()] == ["i1", "i2", None]
    assert [r.title for r in run("Shop-get_item_details", item_id="i2")[1].collect()] == ["blue 50% cup"]
    assert [r.item_id for r in run("Shop-search_items", query="50%")[1].collect()] == ["i2"]
    after, gone = run("Shop-delete_item", item_id="i1")
    assert gone.count() == 1 and [r.item_id for r in after["items"].orderBy("_ord").collect()] == ["i2", None] and state["items"].count() == 3
    for name in tools:
        del registry.TOOLS[name]
    assert len(registry.current_datetime(spark).first().now) == 19
