"""Readers and writers: round trips and broken inputs."""

import json

import pytest
from pyspark.sql import functions as F

from trajspark.operators import checkpoints
from trajspark.sources import files, recorded
from trajspark.streaming import metrics

CHAIN = {"seed": 4, "scenario": "s", "user_tools": [{"name": "u-x", "description": "d"}], "nodes": [{"decision": True, "query": "q", "mcp_servers": ["a"], "pass_k_decision": {"0": True}, "steps": [{"role": "user", "content": "hi"}, {"role": "tool_call", "content": [{"name": "a-f", "arguments": {"k": 1}}], "think": "t", "type": "HIDE"}, {"role": "tool_response", "content": ["ok", "Error"]}]}, {"decision": False, "steps": []}]}


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_chains(spark, tmp_path):
    write(tmp_path / "a" / "1.json", json.dumps(CHAIN, indent=2))
    write(tmp_path / "a" / "2.json", "{broken")
    write(tmp_path / "a" / "3.txt", "{}")
    write(tmp_path / "b" / "0.json", json.dumps({**CHAIN, "seed": 9}))
    good, bad = files.scan_chains(spark, [str(tmp_path / x) for x in ("a", "b", "missing")])
    assert [r.seed for r in good.collect()] == [4, 9] and bad.count() == 1
    assert [r.seed for r in files.scan_chains(spark, [str(tmp_path / x) for x in ("a", "b")], max_num=1)[0].collect()] == [4]
    assert files.scan_chains(spark, [str(tmp_path / "missing")])[0].count() == 0
    steps = files.steps_of(good, "seed").where("conv = 4").orderBy("idx").collect()
    assert [(s.role, s.text, s.responses, s.think, s.type) for s in steps] == [("user", "hi", None, None, None), ("tool_call", None, None, "t", "HIDE"), ("tool_response", None, ["ok", "Error"], None, None)]
    assert [(c.name, c.arguments) for c in steps[1].calls] == [("a-f", '{"k":1}')]
    assert [(t.node, t.decision, t.mcp_servers) for t in files.turns_of(good, "seed").where("conv = 9").orderBy("node").collect()] == [(0, True, ["a"]), (1, False, None)]
    text = spark.createDataFrame([("k", json.dumps(CHAIN)), ("l", "no")], "key string, doc string")
    assert {r.key: r.seed for r in files.chains_of(text, "doc").collect()} == {"k": 4, "l": None}
    files.save_chains(good.withColumn("name", F.concat(F.lit("c"), "seed")).drop("_file"), str(tmp_path / "out"), "name")
    again = spark.read.schema(files.CHAIN).json(str(tmp_path / "out"))
    assert sorted(r.seed for r in again.collect()) == [4, 9] and files.steps_of(again, "seed").count() == 6


def test_arrays_and_samples(spark, tmp_path):
    rows = spark.createDataFrame([(f"i{k}", "", f"o{k}", "s", [["a", "b"]] * k) for k in range(5)], files.SAMPLE)
    files.write_json_array(rows, str(tmp_path / "x"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "x").glob("part-*")))
    assert [r["output"] for r in json.loads(text)] == [f"o{k}" for k in range(5)]
    assert sorted(map(tuple, files.read_samples(spark, str(tmp_path / "x")).collect())) == sorted(map(tuple, rows.collect()))
    files.write_json_array(rows, str(tmp_path / "y"), seed=3, key="instruction")
    mixed = [r.instruction for r in files.read_samples(spark, str(tmp_path / "y")).collect()]
    assert sorted(mixed) == [f"i{k}" for k in range(5)]
    files.write_json_array(rows.limit(0), str(tmp_path / "z"))
    assert json.loads("".join(p.read_text() for p in (tmp_path / "z").glob("part-*"))) == []
    assert files.read_samples(spark, str(tmp_path / "missing")).count() == 0
    write(tmp_path / "broken.json", "[{")
    assert files.read_samples(spark, str(tmp_path / "broken.json")).count() == 0
    scenarios = spark.createDataFrame([("b", "simple"), ("a", "complex")], "scenario_id string, complexity_level string")
    files.save_scenarios(scenarios, str(tmp_path / "sc"))
    assert [(r.scenario_id, r.complexity_level) for r in files.load_scenarios(spark, str(tmp_path / "sc")).collect()] == [("a", "complex"), ("b", "simple")]
    with pytest.raises(Exception):  # noqa: B017
        files.load_scenarios(spark, str(tmp_path / "broken.json")).collect()


def test_logs_and_usage(spark, tmp_path):
    use = [{"timestamp": "t", "model": "m", "prompt_tokens": 1, "completion_tokens": 2, "total_tokens": 3, "agent_name": a} for a in ("x", "x", "y")]
    for u in use:
        files.append_lines(spark.createDataFrame([tuple(u.values())], files.USAGE), str(tmp_path / "usage"))
    assert {r.agent: (r.prompt_tokens, r.completion_tokens, r.calls) for r in files.token_usage(spark, str(tmp_path / "usage")).collect()} == {"x": (2, 4, 2), "y": (1, 2, 1)}
    rows = lambda *x: spark.createDataFrame(list(x), "key string, items array<string>")
    at = str(tmp_path / "log")
    files.dump_log(spark, rows(("1", ["a"]), ("2", ["b"])), at)
    files.dump_log(spark, rows(("2", ["c"]), ("3", ["d"])), at)
    read = lambda: {r.key: r["items"] for r in spark.read.schema("key string, items array<string>").json(at).collect()}
    assert read() == {"1": ["a"], "2": ["c"], "3": ["d"]}
    files.dump_log(spark, rows(("9", ["z"])), at, overwrite=True)
    assert read() == {"9": ["z"]}
    docs = lambda *x: spark.createDataFrame(list(x), "key string, doc string")
    got = files.merged_documents(docs(("a", '{"x": 1, "y": 2}'), ("b", "[1]"), ("c", "5"), ("d", "[]"), ("e", "{}")), docs(("a", '{"y": 3}'), ("b", '{"n": 1}'), ("c", "{}"), ("d", "{}"), ("f", "{}")))
    assert {r.key: json.loads(r.doc) for r in got.collect()} == {"a": {"x": 1, "y": 3}, "b": [1, {"n": 1}], "c": [5, {}], "d": [{}], "e": {}, "f": {}}
    write(tmp_path / "logs" / "q" / "one.json", "{}")
    write(tmp_path / "logs" / "two.json", "[]")
    write(tmp_path / "logs" / "no.txt", "")
    assert {r.path.rsplit("/", 1)[1] for r in files.scan_logs(spark, str(tmp_path / "logs")).collect()} == {"one.json", "two.json"}
    for d in ("log_b", "log_a", "data"):
        (tmp_path / "base" / d).mkdir(parents=True)
    assert files.directories(spark, str(tmp_path / "base"), "log") == ["log_a", "log_b"] and files.directories(spark, str(tmp_path / "none"), "log") == []


def test_registry_and_metadata(spark, tmp_path):
    at = str(tmp_path / "servers.json")
    new = spark.createDataFrame([("S", "p.py", False)], "server string, tool_path string, stateless boolean")
    for before in (None, "", "{broken", '{"other": 1}'):
        if before is not None:
            write(tmp_path / "servers.json", before)
        files.update_registry(spark, at, new)
        assert [tuple(r) for r in files.read_registry(spark, at).collect()] == [("S", "p.py", False)], before
        (tmp_path / "servers.json").rename(tmp_path / f"old{hash(before)}")
    write(tmp_path / "servers.json", json.dumps({"mcpServers": {"S": {"tool_path": "old", "stateless": True}, "T": {"tool_path": "t", "stateless": True}}}, indent=2))
    files.update_registry(spark, at, new)
    assert {tuple(r) for r in files.read_registry(spark, at).collect()} == {("S", "p.py", False), ("T", "t", True)}
    meta = spark.createDataFrame([("A", "d", ["t"]), ("B", "", ["t"]), ("C", "d", []), (None, "d", ["t"])], "class_name string, description string, tools array<string>")
    assert files.write_metadata(meta, str(tmp_path / "meta")).count() == 3 and spark.read.json(str(tmp_path / "meta")).count() == 1
    files.save_graph({"nodes": meta, "edges": new}, str(tmp_path / "graph"))
    assert {k: v.count() for k, v in files.load_graph(spark, str(tmp_path / "graph")).items()} == {"nodes": 4, "edges": 1}


def test_states(spark):
    rows = spark.createDataFrame([(1, '{"a": {"x": 1}, "n": 2}'), (2, "{"), (3, '{"n": -1}'), (4, None)], "id int, s string")
    good, bad = files.load_state(rows, "s", "a map<string, int>, n int", "n >= 0")
    assert [(r.id, r.a, r.n) for r in good.collect()] == [(1, {"x": 1}, 2)] and sorted(r.id for r in bad.collect()) == [2, 3, 4]
    assert json.loads(files.save_state(good, ["a", "n"]).first().state) == {"a": {"x": 1}, "n": 2}


def test_recorded_pages(spark, tmp_path):
    pages = [{"url": "u", "query": "q", "body": {"items": [1, 2], "nextPageToken": "n"}}, {"url": "u", "query": "q", "page_token": "n", "body": {"items": [{"a": 3}], "nextPageToken": "lost"}}, {"url": "u", "query": "r", "body": {"items": []}}, {"url": "u", "query": "loop", "body": {"items": [9], "nextPageToken": "x"}}, {"url": "u", "query": "loop", "page_token": "x", "body": {"items": [8], "nextPageToken": "x"}}, {"url": "u", "query": "bad", "status": 500, "body": {}}]
    write(tmp_path / "rec" / "all.jsonl", "\n".join(map(json.dumps, pages)))
    recorded.register(spark)
    df = spark.read.format("recorded_http").option("path", str(tmp_path / "rec")).option("requests", json.dumps([["u", q] for q in ("q", "r", "loop", "bad", "none")])).load()
    got = sorted((r.query, r.page, r.position, r.item, r.error) for r in df.collect() if r.error is None)
    assert got == [("loop", 0, 0, "9", None), ("loop", 1, 1, "8", None), ("q", 0, 0, "1", None), ("q", 0, 1, "2", None), ("q", 1, 2, '{"a": 3}', None)]
    assert {(r.query, r.page): r.error for r in df.where("error is not null").collect()} == {("q", 2): "no response recorded for page 'lost'", ("bad", 0): "status 500", ("none", 0): "no response recorded for page ''"}


def result(spark, passed, success=True, initial=None, revisions=()):
    report = f"'final', cast(struct(2, {int(passed) + 1}, {int(not passed)}, {str(passed).lower()}, array()) as {checkpoints.REPORT})"
    code = "null" if initial is None else f"'{initial}'"
    revs = ", ".join(f"struct({n} as revision_number, array('s{n}') as failed_scenario_ids, parse_json('{{}}') as aggregated_errors, '{c}' as revised_code, cast(null as {checkpoints.REPORT}) as validation_report)" for n, c in revisions)
    none = f"cast(array() as array<struct<revision_number: int, failed_scenario_ids: array<string>, aggregated_errors: variant, revised_code: string, validation_report: {checkpoints.REPORT}>>)"
    return spark.sql(f"""select 'T' class_name, 'm.json' metadata_path, 'validate_scenarios' state, parse_json('{{"k": 1}}') schema, 'last' tool_code, {code} initial_tool_code,
      cast(array(struct('s1', 'simple', 'd', 'e', parse_json('{{}}'))) as array<struct<scenario_id: string, complexity_level: string, description: string, expected_behavior: string, scenario_data: variant>>) scenarios,
      cast(null as {checkpoints.REPORT}) initial, named_struct({report}).final as final, {f'array({revs})' if revs else none} revisions, {len(revisions)} total_revisions, map('tool', 'p.py') saved_paths, {str(success).lower()} success, cast(null as string) error_message, 0D total_time""")


@pytest.mark.parametrize(("passed", "state"), [(True, "completed"), (False, "failed")])
def test_final_state_follows_the_validation(spark, passed, state):
    """A result that was a success before is none if its final validation fails."""
    done = checkpoints.finalized(result(spark, passed), F.lit(12.5))
    row = checkpoints.checkpoint_of(done, F.lit("now")).first()
    assert (row.metadata.state, row.statistics.success, row.statistics.total_time) == (state, passed, 12.5)


def test_checkpoints_round_trip(spark, tmp_path):
    revisions = [(1, "v0"), (2, "v1"), (3, "v1"), (4, "v2")]
    saved = checkpoints.checkpoint_of(result(spark, True, initial="v0", revisions=revisions), F.lit("now"))
    assert [(v.version, v.code, v.revision_number) for v in saved.first().tool_code_history] == [(0, "v0", 1), (1, "v1", 3), (2, "v2", 4)]
    at = str(tmp_path / "checkpoints")
    checkpoints.save_checkpoints(saved, at)
    checkpoints.save_checkpoints(saved.withColumn("metadata", F.col("metadata").withField("class_name", F.lit("U"))), at)
    checkpoints.save_checkpoints(saved.withColumn("metadata", F.col("metadata").withField("state", F.lit("failed"))), at)
    write(tmp_path / "checkpoints" / "odd" / "x.txt", "{broken")
    loaded, broken = checkpoints.load_checkpoints(spark, at)
    assert sorted((r.metadata.class_name, r.metadata.state) for r in loaded.collect()) == [("T", "failed"), ("U", "validate_scenarios")] and broken.count() == 1
    back = checkpoints.result_of(loaded).where("class_name = 'U'").first()
    assert (back.tool_code, back.initial_tool_code, back.state, back.total_revisions, back.final.all_passed, back.saved_paths) == ("v2", "v0", "validate_scenarios", 4, True, {"tool": "p.py"})
    assert [r.revised_code for r in back.revisions] == ["v1", "v2", "", ""]  # a version's number stands for the revision's
    assert checkpoints.load_checkpoints(spark, str(tmp_path / "none"))[0].count() == 0
    without = checkpoints.checkpoint_of(result(spark, True), F.lit("now")).first()
    assert [(v.version, v.code) for v in without.tool_code_history] == [(0, "last")]


def test_resuming(spark):
    rows = spark.createDataFrame([(s,) for s in (*checkpoints.STATES, None)], "s string")
    got = {r.s: (r.a, r.b) for r in rows.select("s", checkpoints.resume_stage(F.col("s"), F.lit(True)).alias("a"), checkpoints.resume_stage(F.col("s"), F.lit(False)).alias("b")).collect()}
    assert got == {"idle": ("scenarios", "start"), "schema_design": ("scenarios", "start"), None: ("scenarios", "start"), **{s: ("scenarios",) * 2 for s in ("tool_gen", "scenario_gen")}, **{s: ("validation",) * 2 for s in ("validate_scenarios", "revise", "failed")}, "completed": ("done", "done")}


def test_streamed_counts(spark, tmp_path):
    write(tmp_path / "in" / "a.json", "\n".join(json.dumps({"at": f"2024-01-01 {h:02}:30:00", "kind": k}) for h, k in ((0, "x"), (0, "x"), (1, "y"), (9, "x"))))
    stream = metrics.windowed_counts(metrics.log_stream(spark, str(tmp_path / "in"), "at timestamp, kind string"), "at", "kind")
    run = stream.writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted((r.kind, r.n) for r in spark.table("counted").collect()) == [("x", 1), ("x", 2), ("y", 1)]
