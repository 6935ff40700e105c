"""More queries on the driver's tables: graphs of parameters, stores, viewers, checkpoints, logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analytics, checkpoints, graph, paths, registry, store, views
from ..sources import files
from .queries import NEXT, STEPS, derived_steps, next_edges, query

VECTORS = "select vec_id, cast(embedding as double[]) as e, label from embeddings"


@query(f"""with v as ({VECTORS}), p as (select 'o' || a.vec_id as src, 'i' || b.vec_id as dst, 't' || (a.vec_id % 40) as x, 't' || (b.vec_id % 40) as y from v a join v b on a.vec_id % 2 = 0 and b.vec_id % 2 = 1 where list_cosine_similarity(a.e, b.e) > 0.3 and a.vec_id % 40 <> b.vec_id % 40)
select src, dst, 'parameter_to_parameter' as edge_type from p union select x, y, 'tool_to_tool' from p""")
def similarity_links(t):
    side = lambda mark, odd: t.embeddings.where(F.col("vec_id") % 2 == odd).select(F.concat(F.lit("t"), F.col("vec_id") % 40).alias("tool"), F.concat(F.lit(mark), "vec_id").alias("param"), F.col("embedding").alias("v"))
    return graph.similarity_links(side("o", 0), side("i", 1), 0.3)


@query(f"with v as ({VECTORS}), c as (select * from v where vec_id in (select min(vec_id) from v group by label)) select cast(c.vec_id as varchar) as a, cast(v.vec_id as varchar) as b, round(list_cosine_similarity(c.e, v.e), 5) + 0 as cosine from c, v")
def cosine_matrix(t):
    first = t.embeddings.groupBy("label").agg(F.min("vec_id").alias("vec_id")).select("vec_id")
    rows = t.embeddings.selectExpr("vec_id id", "embedding v")
    some = rows.join(first.selectExpr("vec_id id"), "id", "left_semi")
    return graph.similar_between(some, rows, None).withColumn("cosine", F.round("cosine", 5) + 0)


@query(f"""with r as (select s_suppkey as id, s_suppkey - 1 as rep from supplier where s_suppkey % 3 = 0), e as (select src, dst, (src + dst) % 5 as kind from ({NEXT})),
m as (select coalesce(a.rep, src) as f, coalesce(b.rep, dst) as t, src, dst, kind from e left join r a on a.id = src left join r b on b.id = dst)
select f as src, t as dst, arg_max(kind, (dst, src)) as kind from m where f <> t group by f, t""")
def merge_redirect(t):
    edges = next_edges(t).withColumn("kind", (F.col("src") + F.col("dst")) % 5)
    return graph.redirected(edges, t.supplier.where("s_suppkey % 3 = 0").selectExpr("s_suppkey id", "s_suppkey - 1 representative"))


@query(f"""with s as (select s_nationkey as server, s_suppkey as tool from supplier), e as (select src, dst from ({NEXT}) where src % 2 = 0),
p as (select a.server, a.tool as src, b.tool as dst from s a join s b on b.server = a.server and b.tool > a.tool union all select s_nationkey, s_suppkey, -1 from supplier where s_nationkey % 7 = 3),
g as (select distinct src, dst from p where server not in (select server from p where dst = -1))
select src, dst, 'old' as edge_type from e union all select src, dst, 'tool_to_tool' from g where not exists (select 1 from e where e.src = g.src and e.dst = g.dst)""")
def proposed_edges(t):
    tools = t.supplier.selectExpr("s_nationkey server", "s_suppkey tool")
    after = F.explode(F.transform(F.filter("all", lambda x: x > F.col("src")), lambda x: x))
    lists = tools.groupBy("server").agg(F.collect_list("tool").alias("all"))  # a server's own tools: a short list
    good = tools.withColumnRenamed("tool", "src").join(lists, "server").select("server", "src", after.alias("dst"))
    odd = tools.where("server % 7 = 3").selectExpr("server", "tool src", "cast(-1 as bigint) dst")
    edges = next_edges(t).where("src % 2 = 0").withColumn("edge_type", F.lit("old"))
    return graph.admitted_edges(good.unionByName(odd), tools, edges)


@query("select cast(s_suppkey as varchar) as id, 'tool' as node_type from supplier union select 'in' || p_partkey, 'parameter' from part")
def graph_nodes(t):
    return graph.build_nodes(t.supplier.selectExpr("s_suppkey tool"), t.part.selectExpr("concat('in', p_partkey) param_id"))


#: Parts as inputs of their suppliers' tools: required, optional, provided by users or by what a supplier sells much of.
NEEDS = "select distinct l_suppkey as tool, l_partkey % 50 as param, l_partkey % 3 = 0 as required, case when l_partkey % 5 = 0 then true when l_partkey % 5 < 3 then false end as user_provided from lineitem"


def needs(t):
    k = F.col("l_partkey")
    return t.lineitem.select(F.col("l_suppkey").alias("tool"), (k % 50).alias("param"), (k % 3 == 0).alias("required"), F.when(k % 5 == 0, True).when(k % 5 < 3, False).alias("user_provided")).distinct()


@query(f"with n as ({NEEDS}), g as (select distinct l_partkey % 50 as param from lineitem where l_quantity > 49.5 and l_partkey % 50 < 45), c as (select tool, bool_and(coalesce(user_provided, false) or param in (select param from g)) as ok from n where required group by tool) select s_suppkey as tool, coalesce(ok, true) as valid from supplier left join c on c.tool = s_suppkey")
def validate_tool(t):
    given = t.lineitem.where("l_quantity > 49.5 and l_partkey % 50 < 45").select((F.col("l_partkey") % 50).alias("param"))
    return graph.valid_tools(needs(t).where("required"), given, t.supplier.selectExpr("s_suppkey tool"))


@query(f"with n as ({NEEDS}) select tool, param, required, case when coalesce(user_provided, false) or param in (select l_partkey % 50 from lineitem where l_quantity > 49.5 and l_partkey % 50 < 25) then user_provided else true end as user_provided from n")
def orphan_patch(t):
    inputs = needs(t)
    given = t.lineitem.where("l_quantity > 49.5 and l_partkey % 50 < 25").select((F.col("l_partkey") % 50).alias("param"))
    return graph.patched(inputs, graph.orphans(inputs, given, F.col("user_provided"), "param"), "param")


@query("""with c as (select l_orderkey as chain, l_linenumber as pos, l_suppkey % 6 as tool from lineitem), g as (select * from (values (0, 1), (1, 2), (2, 3)) v(tool, param)), n as (select * from (values (3, 1), (4, 2)) v(tool, param)),
f as (select c.chain, g.param, min(c.pos) as at from c join g using (tool) group by all), a as (select c.chain, bool_and(coalesce(f.at < c.pos, false)) as ok from c join n using (tool) left join f on f.chain = c.chain and f.param = n.param group by c.chain)
select distinct c.chain, coalesce(a.ok, true) as valid from c left join a using (chain)""")
def optional_and_user_inputs(t):
    calls = t.lineitem.select(F.col("l_orderkey").alias("chain"), F.col("l_linenumber").alias("pos"), (F.col("l_suppkey") % 6).alias("tool"))
    gives = t.spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "tool long, param int")
    asks = t.spark.createDataFrame([(3, 1, True, None), (4, 2, True, False), (5, 3, False, None), (0, 9, True, True), (1, 9, None, None)], "tool long, param int, required boolean, user_provided boolean")
    return graph.valid_chains(calls, asks, gives)


@query("select 42 as c_custkey, c_name, c_acctbal from customer where c_custkey = 42 union all select -5, 'nobody', 0.0")
def lookup_policies(t):
    c = t.customer.select("c_custkey", "c_name", "c_acctbal")
    found = store.lookup(c, "c_custkey", 42)
    return found.unionByName(store.lookup(c, "c_custkey", -5, "empty")).unionByName(store.lookup(c, "c_custkey", -5, "default", {"c_name": "nobody", "c_acctbal": 0.0}))


@query("select 'number' as kind, c_custkey, '40' as next from (select * from customer order by c_custkey limit 20 offset 20) union all select 'token', c_custkey, '100' from (select * from customer order by c_custkey limit 100) union all select 'odd', c_custkey, '3' from (select * from customer order by c_custkey limit 3)")
def cursor_pages(t):
    c = t.customer.select("c_custkey")
    number, odd = (store.page_by_number(c, cursor, size, "c_custkey").withColumnRenamed("next_cursor", "next") for cursor, size in (("20", 20), ("soon", 3)))
    token = store.page_by_token(c, None, 500, 130, "c_custkey").withColumnRenamed("offset", "next")
    kind = lambda df, k: df.select(F.lit(k).alias("kind"), "c_custkey", "next")
    return kind(number, "number").unionByName(kind(token, "token")).unionByName(kind(odd, "odd"))


@query("with d as (select o_orderkey, case when o_orderkey % 4 <> 0 then strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') end as due from orders) select o_orderkey, due from d where due is null or (due >= '1995-06-01' and due <= '1996-03-31T00')")
def due_range(t):
    due = F.when(F.col("o_orderkey") % 4 != 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return t.orders.select("o_orderkey", due.alias("due")).where(store.due_between(F.col("due"), "1995-06-01", "1996-03-31T00"))


@query("select o_orderpriority as _id, round(avg(case when o_orderkey % 9 = 0 then 0 else o_totalprice end), 4) as mean, count(*) as n from (select * from orders where o_orderstatus = 'F' order by o_totalprice desc, o_orderkey limit 300 offset 5) group by o_orderpriority")
def document_pipeline(t):
    rows = t.orders.withColumn("price", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice")))
    stages = [{"$match": {"o_orderstatus": "F"}}, {"$sort": {"o_totalprice": -1}}, {"$skip": 5}, {"$limit": 300}, {"$project": {"o_orderpriority": 1, "price": 1}}, {"$unknown": {}}, {"$group": {"_id": "$o_orderpriority", "mean": {"$avg": "$price"}, "n": {"$sum": 1}}}]
    return store.aggregate(rows, stages, "o_orderkey").select("_id", F.round("mean", 4).alias("mean"), F.col("n").cast("long").alias("n"))


@query()
def file_versions(t):
    old, new = F.concat_ws("\n", "p_name", "p_brand", "p_type"), F.concat_ws("\n", "p_name", "p_type", F.when(F.col("p_size") > 25, F.col("p_brand")))
    return paths.unified_diff(t.part.select("p_partkey", F.concat(F.lit("f"), "p_partkey").alias("path"), old.alias("old"), new.alias("new")), "old", "new").select("p_partkey", "diff")


@query("with l as (select n_regionkey, list(case when n_nationkey % 4 = 0 then n_nationkey + 100 else n_nationkey end order by n_name desc) as ids from nation group by n_regionkey), p as (select n_regionkey as region, unnest(ids) as n_nationkey, generate_subscripts(ids, 1) - 1 as position from l) select region, position, n_nationkey, n_name from p join nation using (n_nationkey)")
def entities_by_list(t):
    id_ = F.when(F.col("n_nationkey") % 4 == 0, F.col("n_nationkey") + 100).otherwise(F.col("n_nationkey"))
    lists = t.nation.groupBy(F.col("n_regionkey").alias("region")).agg(F.transform(F.sort_array(F.collect_list(F.struct("n_name", id_.alias("i"))), False), lambda x: x["i"]).alias("ids"))
    return store.entities(lists, "region", "ids", t.nation.select("n_nationkey", "n_name"), "n_nationkey").withColumn("position", F.col("position").cast("long"))


@query("select o_orderkey, case when o_orderstatus = 'O' and o_orderkey % 50 = 7 then 'somewhere' else o_orderpriority end as address from orders")
def guarded_update(t):
    o = t.orders.select("o_orderkey", "o_orderstatus", F.col("o_orderpriority").alias("address"))
    wanted = (F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 50 == 7)
    return store.guarded_update(o, wanted, F.col("o_orderstatus") == "O", {"address": F.lit("somewhere")}, "the order is not open").select("o_orderkey", "address")


@query("select 'gen_' || (4 + row_number() over (order by s_suppkey)) as id, s_name from supplier where s_suppkey % 3 = 0 union all select cast(s_suppkey as varchar), s_name from supplier where s_suppkey % 3 <> 0 union all select cast(c_custkey as varchar), c_name from customer")
def insert_with_ids(t):
    old = t.customer.select(F.col("c_custkey").cast("string").alias("_id"), F.col("c_name").alias("s_name"), F.col("c_custkey").alias("_ord"))
    new = t.supplier.select(F.when(F.col("s_suppkey") % 3 != 0, F.col("s_suppkey").cast("string")).alias("_id"), "s_name", F.col("s_suppkey").alias("_ord"))
    return store.insert_documents(old, new, 5)[0].select(F.col("_id").alias("id"), "s_name")


@query("select doc_id, quality = 1 as passed from labels where quality = 1 union all select doc_id, false from labels where quality <> 1")
def failed_and_passed(t):
    rows = t.labels.withColumn("ok", F.when(F.col("quality") == 1, True))
    return analytics.scenarios(rows, "ok").select("doc_id", F.lit(True).alias("passed")).unionByName(analytics.failed_ids(rows, "ok", "doc_id").withColumn("passed", F.lit(False)))


@query("select event_id from events where event_id % 3 <> 0 and event_id % 5 <> 0")
def nan_filter(t):
    v = F.when(F.col("event_id") % 3 != 0, F.when(F.col("event_id") % 5 == 0, float("nan")).otherwise(F.col("event_id").cast("double")))
    return analytics.known(t.events.select("event_id", v.alias("v")), "v").select("event_id")


@query("select p_brand as server, coalesce(string_agg(p_name, ', ' order by p_partkey) filter (p_size > 25), '') as providable, coalesce(string_agg(p_name, ', ' order by p_partkey) filter (p_size <= 25), '') as others from part group by p_brand")
def names_by_provided(t):
    params = t.part.select(F.col("p_brand").alias("server"), F.col("p_name").alias("name"), F.when(F.col("p_size") > 25, True).when(F.col("p_size") > 10, False).alias("user_provided"), F.col("p_partkey").alias("ord"))
    return analytics.by_provided(params, "server")


@query("""select event_id, case event_id % 3 when 0 then 'hm ' || event_type end as think, '[' || case event_id % 3 when 2 then props else '"' || event_type || '"' end || ',"x <y"]' as a, case when event_id % 3 = 1 then '["open end"]' end as b from events""")
def structured_output(t):
    k = F.col("event_id") % 3
    inner = F.when(k == 2, F.col("props")).otherwise(F.col("event_type"))
    said = F.concat(F.when(k == 0, F.concat(F.lit(" hm "), "event_type", F.lit(" </think> "))).otherwise(F.lit("")), F.lit("see <a>"), inner, F.lit("</a> and <a>x <y</a>"), F.when(k == 1, F.lit(" <b>open end")).otherwise(F.lit("")))
    m = t.events.select("event_id", T.structured(said).alias("m"))
    return m.select("event_id", *(F.try_element_at("m", F.lit(x)).alias(x) for x in ("think", "a", "b")))


@query("select p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') as title, base64(encode(p_brand)) as coded, starts_with(p_type, 'E') as starts, coalesce(case when p_size % 2 = 0 then p_size end, -1) as size, case when p_size % 3 = 0 then p_brand else p_type end as merged from part")
def string_and_map_functions(t):
    size = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("size"), F.col("p_size"))).otherwise(F.create_map(F.lit("none"), F.lit(0)))
    b = F.when(F.col("p_size") % 3 == 0, F.create_map(F.lit("v"), F.col("p_brand"))).otherwise(F.create_map(F.lit("w"), F.lit("other")))
    merged = T.merged_map(F.create_map(F.lit("v"), F.col("p_type")), b)
    return t.part.select("p_partkey", T.title(F.col("p_name")).alias("title"), F.base64(F.encode("p_brand", "UTF-8")).alias("coded"), F.startswith("p_type", F.lit("E")).alias("starts"), T.at_key(size, F.lit("size"), F.lit(-1)).alias("size"), F.try_element_at(merged, F.lit("v")).alias("merged"))


# ---- viewers


INDEX = "select conv_id as id, count(*) as modified, 'data' || (conv_id % 3) as folder from conversations group by conv_id"


def index(t):
    return t.conversations.groupBy(F.col("conv_id").alias("id")).agg(F.count("*").alias("modified")).withColumn("folder", F.concat(F.lit("data"), F.col("id") % 3))


@query(f"with i as (select * from ({INDEX}) where folder in ('data0', 'data2') order by modified desc, id limit 100) select *, 2 as page, 7 as per_page, (select count(*) from i) as total, (select cast(ceil(count(*) / 7) as bigint) from i) as total_pages from (select * from i order by modified desc, id limit 7 offset 7)")
def conversation_list(t):
    return views.listed(views.in_folders(index(t), ["data0", "data2"]), 2, 7)


@query("select conv_id as conv, string_agg(distinct role, ',' order by role) as roles, count(*) as n_items from conversations where conv_id = 3 group by conv_id")
def conversation_detail(t):
    items = t.conversations.selectExpr("conv_id conv", "turn node", "role agent")
    return views.conversation(items, 3).select("conv", F.array_join("agent_roles", ",").alias("roles"), "n_items")


@query(f"select conv, node, idx, role from ({STEPS}) where conv = 3 and node = 0")
def conversation_turn(t):
    return views.one_turn(derived_steps(t), 3, 0).select("conv", "node", "idx", "role")


@query(f"select conv, node, idx from ({STEPS}) where conv = (select id from ({INDEX}) order by modified desc, id limit 1) and role = 'user' and node = 0")
def trace_page(t):
    items = derived_steps(t).withColumnRenamed("role", "agent")
    return views.shown(items, index(t), "no such", "user", "0").select("conv", "node", "idx")


@query(f"with s as ({STEPS}) select conv, node, idx, case when idx % 2 = 0 then 'so ' || role end as think, 'out ' || idx as answer, (select count(*) from s) as total from (select *, conv * 100 + node * 10 + idx as k from s order by k limit 15 offset 30)")
def sample_page(t):
    output = F.when(F.col("idx") % 2 == 0, F.concat(F.lit("<think>so "), "role", F.lit("</think>\n\nout "), "idx")).otherwise(F.concat(F.lit("out "), "idx"))
    rows = derived_steps(t).select("conv", "node", "idx", output.alias("output"), (F.col("conv") * 100 + F.col("node") * 10 + F.col("idx")).alias("k"))
    return views.samples(rows, 3, 15, "k").select("conv", "node", "idx", "think", "answer", "total")


# ---- checkpoints, states, logs


@query("""with o as (select o_custkey, o_orderkey, o_orderstatus as code, coalesce(lag(o_orderstatus) over (partition by o_custkey order by o_orderkey), 'F') as before, row_number() over (partition by o_custkey order by o_orderkey) as nr from orders),
h as (select o_custkey, 1 + count(*) filter (code <> before) as versions, arg_max(code, nr) as code, max(nr) as last from o group by o_custkey)
select c_custkey, case when c_acctbal > 0 then 'completed' else 'failed' end as state, c_acctbal > 0 as success, coalesce(versions, 1) as versions, coalesce(code, 'F') as code, last as named_by, case when c_acctbal > 0 then 'done' else 'validation' end as stage from customer left join h on o_custkey = c_custkey""")
def checkpoint_history(t):
    nr = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    revision = F.struct("nr", F.array().cast("array<string>").alias("failed_scenario_ids"), F.parse_json(F.lit("{}")).alias("aggregated_errors"), F.col("o_orderstatus").alias("revised_code"), F.lit(None).cast(checkpoints.REPORT).alias("validation_report"))
    revisions = t.orders.withColumn("nr", nr).groupBy("o_custkey").agg(F.collect_list(revision).alias("r"))
    revisions = revisions.select("o_custkey", F.transform(F.array_sort("r", lambda a, b: a["nr"] - b["nr"]), lambda r: F.struct(r["nr"].alias("revision_number"), *(r[c].alias(c) for c in ("failed_scenario_ids", "aggregated_errors", "revised_code", "validation_report")))).alias("revisions"))
    report = F.struct(F.lit(2).alias("total_scenarios"), F.lit(1).alias("passed_scenarios"), F.lit(1).alias("failed_scenarios"), (F.col("c_acctbal") > 0).alias("all_passed"), F.array().cast(f"array<{checkpoints.RESULT}>").alias("scenario_results"))
    blank = lambda kind: F.lit(None).cast(kind)
    results = t.customer.join(revisions, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.col("c_custkey").cast("string").alias("class_name"), F.lit("m.json").alias("metadata_path"), F.lit("revise").alias("state"), F.parse_json(F.lit("{}")).alias("schema"), F.lit("F").alias("tool_code"), blank("string").alias("initial_tool_code"),
        F.array().cast("array<struct<scenario_id: string, complexity_level: string, description: string, expected_behavior: string, scenario_data: variant>>").alias("scenarios"), blank(checkpoints.REPORT).alias("initial"), report.alias("final"), "revisions",
        F.lit(0).alias("total_revisions"), blank("map<string, string>").alias("saved_paths"), F.lit(True).alias("success"), blank("string").alias("error_message"), F.lit(0.0).alias("total_time"))
    saved = checkpoints.checkpoint_of(checkpoints.finalized(results, F.lit(3.5)), F.lit("2024-01-01T00:00:00"))
    last = F.element_at("tool_code_history", -1)
    return saved.select(F.col("metadata.class_name").cast("long").alias("c_custkey"), "metadata.state", "statistics.success", F.size("tool_code_history").cast("long").alias("versions"), last["code"].alias("code"), last["revision_number"].cast("long").alias("named_by"), checkpoints.resume_stage(F.col("metadata.state"), F.lit(True)).alias("stage"))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k, true as good from events where event_id % 10 < 8 and cast(json_extract(props, '$.k') as bigint) >= 2 union all select event_id, null, false from events where not (event_id % 10 < 8 and cast(json_extract(props, '$.k') as bigint) >= 2)")
def state_load(t):
    text = F.when(F.col("event_id") % 10 == 8, "{broken").when(F.col("event_id") % 10 == 9, '{"k": "word"}').otherwise(F.col("props"))
    good, bad = files.load_state(t.events.select("event_id", text.alias("state")), "state", "k bigint", "k >= 2")
    again, none = files.load_state(files.save_state(good, ["k"]), "state", "k bigint")  # what is saved loads again
    return again.withColumn("good", F.lit(True)).unionByName(bad.unionByName(none).select("event_id", F.lit(None).cast("bigint").alias("k"), F.lit(False).alias("good")))


@query("""select event_id, case event_id % 4 when 0 then '{"k":1,"n":2}' when 1 then '[3,{"n":2}]' when 2 then '["s",{"n":2}]' else '{"n":2}' end as doc from events""")
def log_documents(t):
    k = F.col("event_id") % 4
    old = t.events.where(k < 3).select(F.col("event_id").alias("key"), F.when(k == 0, '{"k":1,"n":9}').when(k == 1, "[3]").otherwise('"s"').alias("doc"))
    new = t.events.select(F.col("event_id").alias("key"), F.lit('{"n":2}').alias("doc"))
    return files.merged_documents(old, new).select(F.col("key").alias("event_id"), "doc")


@query("select o_orderkey as _id, o_totalprice from (select * from orders where o_orderstatus = 'F' order by o_totalprice desc, o_orderkey limit 10) union all select -1, (select cast(count(*) as double) from orders where o_orderstatus = 'F')")
def named_tools(t):
    state = {"documents": t.orders.selectExpr("'db.orders' as key", "o_orderkey as _id", "o_orderkey as _ord", "o_orderstatus", "o_totalprice")}
    _, found = registry.call("MongoDBServer-find", state, {"database": "db", "collection": "orders", "filter": {"o_orderstatus": "F"}, "sort": {"o_totalprice": -1}, "projection": {"o_totalprice": 1, "_id": 1}})
    _, many = registry.call("MongoDBServer-aggregate", state, '{"database": "db", "collection": "orders", "pipeline": [{"$match": {"o_orderstatus": "F"}}, {"$count": "count"}]}')
    return found.select("_id", "o_totalprice").unionByName(many.select(F.lit(-1).cast("long").alias("_id"), F.col("count").cast("double").alias("o_totalprice")))


@query("select doc_id, n from (select doc_id, sum(length(line)) as n from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) group by doc_id) where doc_id is not null")
def line_lengths(t):
    return t.documents.where("doc_id is not null").select("doc_id", F.aggregate(F.split("text", "\n"), F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("n"))
