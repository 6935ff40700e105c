"""Queries on the driver's tables, each beside SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.draws import draw, draw_sql
from ..operators import analytics, catalog, graph, knowledge, paths, sampling, steps, store, traces, training, turns, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """Tables by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def cents(c: str | F.Column) -> F.Column:
    """Money as whole cents, so that sums do not depend on their order."""
    return F.round(F.col(c) * 100 if isinstance(c, str) else c * 100).cast("long")


PAIRS = "select conv_id, role, lead(role) over (partition by conv_id order by turn) as nxt from conversations"


@query(f"select conv_id, count(*) filter (role = 'user' and nxt = 'assistant') as asked, count(*) filter (role = 'assistant' and nxt = 'user') as followed from ({PAIRS}) group by conv_id")
def pair_count(t):
    return steps.pair_counts(t.conversations, {"asked": ("user", "assistant"), "followed": ("assistant", "user")})


@query(f"with p as (select conv_id, count(*) filter (role = 'user' and nxt = 'assistant') as v from ({PAIRS}) group by conv_id) select 'asked' as metric, v as value, count(*) as n from p where v > 0 group by v")
def pair_distribution(t):
    return analytics.distribution(steps.pair_count(t.conversations, "user", "assistant", name="asked"), "asked")


@query(f"with p as (select count(*) filter (role = 'user' and nxt = 'assistant') as v from ({PAIRS}) group by conv_id) select avg(v) as mean, quantile_cont(v, 0.5) as median from p where v > 0")
def weighted_mean_median(t):
    return analytics.weighted(analytics.distribution(steps.pair_count(t.conversations, "user", "assistant", name="asked"), "asked"))


IDX = "select *, row_number() over (partition by conv_id order by turn) - 1 as idx from conversations"
ALT = "case when idx % 2 = 0 then role in ('user', 'tool_response') else role in ('assistant', 'tool_call') end"


@query(f"select conv_id, turn, role from (select *, min(case when {ALT} then 1 else 0 end) over (partition by conv_id order by idx) as ok from ({IDX})) where ok = 1")
def prefix_until_invalid(t):
    rows = steps.numbered(t.conversations)
    return steps.valid_prefix(rows, steps.alternates(F.col("idx"), F.col("role")), order="idx").select("conv_id", "turn", "role")


@query(f"select conv_id, bool_and({ALT}) as valid, count(*) as n_steps from ({IDX}) group by conv_id")
def validate_alternation(t):
    rows = steps.numbered(t.conversations)
    return rows.groupBy("conv_id").agg(F.every(steps.alternates(F.col("idx"), F.col("role"))).alias("valid"), F.count("*").alias("n_steps"))


@query("select conv_id, turn from conversations where conv_id in (select conv_id from conversations group by conv_id having count(*) filter (role = 'assistant') >= 2)")
def filter_min_valid_turns(t):
    return steps.keep_conversations(t.conversations, F.col("role") == "assistant").select("conv_id", "turn")


#: The conversations as turns of four steps, with calls and responses, types and thoughts spread over them.
STEPS = """select conv_id as conv, node, cast(row_number() over (partition by conv_id, node order by turn) - 1 as bigint) as idx, role, text, type, think, think_present
from (select conv_id, turn, turn // 4 as node, case when role = 'system' then 'user' when role = 'user' and (conv_id + turn) % 3 = 0 then 'tool_response' when role = 'assistant' and (conv_id + turn // 2) % 2 = 0 then 'tool_call' else role end as role,
  coalesce(text, '') || case when (conv_id + turn) % 11 = 0 then ' Error' when (conv_id + turn) % 13 = 0 then ' error' else '' end as text,
  case (conv_id + turn) % 9 when 3 then 'REMOVE' when 5 then 'HIDE' when 7 then 'KEEP' end as type, case when (conv_id + turn) % 4 = 1 then 'so ' || role end as think, (conv_id + turn) % 4 < 2 as think_present from conversations)"""
TURNS = "select distinct conv_id as conv, turn // 4 as node, (conv_id + turn // 4) % 6 <> 5 as decision from conversations"


def derived_steps(t: Tables) -> DataFrame:
    at = F.col("conv_id") + F.col("turn")
    node = F.floor(F.col("turn") / 4).cast("long")
    role = F.when(F.col("role") == "system", "user").when((F.col("role") == "user") & (at % 3 == 0), "tool_response").when((F.col("role") == "assistant") & ((F.col("conv_id") + F.floor(F.col("turn") / 2)) % 2 == 0), "tool_call").otherwise(F.col("role"))
    text = F.concat(F.coalesce("text", F.lit("")), F.when(at % 11 == 0, " Error").when(at % 13 == 0, " error").otherwise(""))
    kind = F.when(at % 9 == 3, "REMOVE").when(at % 9 == 5, "HIDE").when(at % 9 == 7, "KEEP")
    idx = (F.row_number().over(Window.partitionBy("conv_id", node).orderBy("turn")) - 1).cast("long")
    return t.conversations.select(F.col("conv_id").alias("conv"), node.alias("node"), idx.alias("idx"), role.alias("role"), text.alias("text"), kind.alias("type"), F.when(at % 4 == 1, F.concat(F.lit("so "), "role")).alias("think"), (at % 4 < 2).alias("think_present"))


def derived_turns(t: Tables) -> DataFrame:
    node = F.floor(F.col("turn") / 4).cast("long")
    return t.conversations.select(F.col("conv_id").alias("conv"), node.alias("node"), ((F.col("conv_id") + node) % 6 != 5).alias("decision")).distinct()


PAIRED = f"with s as ({STEPS}), t as ({TURNS}), l as (select *, lead(role) over (partition by conv, node order by idx) as nxt from s), m as (select conv, node, count(*) as steps, count(*) filter (role = 'tool_call' and nxt = 'tool_response') as calls, count(*) filter (role = '{{}}' and nxt = '{{}}') as talks from l group by conv, node)"


@query(PAIRED.format("assistant", "user") + """, o as (select t.conv, t.node, m.calls, m.talks, min(case when t.decision and m.steps is not null then 1 else 0 end) over (partition by t.conv order by t.node) as ok from t left join m on m.conv = t.conv and m.node = t.node),
v as (select * from o where ok = 1), c as (select conv, sum(calls + talks) as n from v group by conv having sum(calls + talks) > 0)
select 'steps_per_turn_distribution' as metric, cast(calls + talks as varchar) as value, count(*) as n from v group by 2 union all select 'tool_calls_per_turn_distribution', cast(calls as varchar), count(*) from v group by 2 union all select 'user_interactions_per_turn_distribution', cast(talks as varchar), count(*) from v group by 2
union all select 'steps_per_conversation_distribution', cast(cast(n as bigint) as varchar), count(*) from c group by 2 union all select 'turn_distribution', cast(cast(n as bigint) as varchar), count(*) from c group by 2 union all select 'mcp_server_distribution', role, count(distinct conv_id) from conversations group by role""")
def chain_stats(t):
    servers = t.conversations.select(F.col("conv_id").alias("conv"), F.col("role").alias("server"))
    return turns.chain_stats(derived_steps(t), derived_turns(t), servers)


@query(PAIRED.format("user", "assistant") + " select conv, node, steps, calls as tool_calls, talks as user_interactions from m")
def analysis_turns(t):
    return turns.turn_metrics(derived_steps(t), ("user", "assistant"))


@query(PAIRED.format("user", "assistant") + " select conv, cast(sum(calls + talks) as bigint) as turns, cast(sum(steps) as bigint) as steps, cast(sum(calls) as bigint) as tool_calls, cast(sum(talks) as bigint) as user_interactions from m group by conv")
def analysis_conversations(t):
    return turns.conversation_metrics(turns.turn_metrics(derived_steps(t), ("user", "assistant")))


@query(PAIRED.format("user", "assistant") + """ select any_value(total) as total_conversations, cast(sum(calls + talks) as bigint) as total_turns, cast(sum(steps) as bigint) as total_steps, cast(sum(calls) as bigint) as total_tool_calls, cast(sum(talks) as bigint) as total_user_interactions,
sum(calls + talks) / any_value(total) as avg_turns_per_conversation, sum(steps) / any_value(total) as avg_steps_per_conversation, sum(calls) / any_value(total) as avg_tool_calls_per_conversation, sum(talks) / any_value(total) as avg_user_interactions_per_conversation,
sum(steps) / count(*) as avg_steps_per_turn, sum(calls) / count(*) as avg_tool_calls_per_turn, sum(talks) / count(*) as avg_user_interactions_per_turn from m, (select count(distinct conv_id) as total from conversations)""")
def analysis_metrics(t):
    return turns.analysis_summary(turns.turn_metrics(derived_steps(t), ("user", "assistant")), t.conversations.select("conv_id").distinct())


#: Pairs of the turns that training rows are made of, with what stands before them.
SFT = f"""with s as ({STEPS}), t as ({TURNS}),
a as (select conv, node, bool_and(case when idx % 2 = 0 then role in ('user', 'tool_response') else role in ('assistant', 'tool_call') end) as alt, count(*) filter (role = 'tool_call') as calls from s group by conv, node),
o as (select t.conv, t.node, a.calls, min(case when t.decision and a.alt then 1 else 0 end) over (partition by t.conv order by t.node) as ok from t left join a on a.conv = t.conv and a.node = t.node),
l as (select s.*, lead(s.text) over w as output, lead(s.role) over w as role1, coalesce(lead(s.type) over w, 'KEEP') as type1, lead(s.think) over w as think1, lead(s.think_present) over w as thought1, lead(s.role, 2) over w as role2, lead(s.text, 2) over w as text2 from s join o on o.conv = s.conv and o.node = s.node where o.ok = 1 and o.calls > 0 window w as (partition by s.conv, s.node order by s.idx)),
h as (select *, string_agg(text || chr(10) || output, chr(10)) over w as before, count(*) over w as n_history from l where idx % 2 = 0 and role1 is not null and type1 <> 'REMOVE' window w as (partition by conv order by node, idx rows between unbounded preceding and 1 preceding))"""


@query(SFT + """ select conv, node, idx, md5(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '')) as instruction_md5, md5(case when thought1 then '<think>' || coalesce(think1, 'None') || '</think>' || chr(10) || chr(10) else '' end || output) as output_md5, n_history, md5(coalesce(before, '')) as history_md5
from h where type1 = 'KEEP' and not (role1 = 'tool_call' and coalesce(role2 = 'tool_response', false) and coalesce(contains(text2, 'Fail') or contains(text2, 'Error'), false))""")
def sft_rows(t):
    rows = turns.training_rows(derived_steps(t), derived_turns(t))
    said = F.array_join(F.transform("history", lambda p: F.concat(p[0], F.lit("\n"), p[1])), "\n")
    return rows.select("conv", "node", "idx", F.md5("instruction").alias("instruction_md5"), F.md5("output").alias("output_md5"), F.size("history").cast("long").alias("n_history"), F.md5(said).alias("history_md5"))


@query(f"""with s as ({STEPS}), t as ({TURNS}), b as (select conv, node, string_agg('- ' || case role when 'user' then 'User' when 'assistant' then 'Assistant' when 'tool_call' then 'Tool Call' else 'Tool Response' end || ': ' || text || chr(10), '' order by idx) as said from s where not (conv % 4 = 0 and node = 1) group by conv, node),
p as (select t.conv, t.node, case when t.node = 1 then '[Turn 2] (Current)' else '[Turn 1] (Previous)' end || chr(10) || case when b.said is not null then b.said || chr(10) when t.node = 1 then '- Target Tool Name 1: a-x' || chr(10) || '- Target Tool Name 2: b' || t.conv || chr(10) else chr(10) end as part from t left join b on b.conv = t.conv and b.node = t.node where t.node <= 1)
select conv, md5(regexp_replace(regexp_replace(string_agg(part, '' order by node), '^\\s+', ''), '\\s+$', '')) as conversation_md5 from p group by conv""")
def conversation_at_turn(t):
    asked = derived_turns(t).withColumn("tools", F.array(F.lit("a-x"), F.concat(F.lit("b"), "conv")))
    said = derived_steps(t).where("not (conv % 4 = 0 and node = 1)")
    return turns.rendered_conversation(said, asked, 1).select("conv", F.md5("conversation").alias("conversation_md5"))


PRE = f"select *, min(case when {ALT} then 1 else 0 end) over (partition by conv_id order by idx) as ok, lag(text) over (partition by conv_id order by idx) as instruction from (select *, row_number() over (partition by conv_id order by turn) - 1 as idx from conversations where role <> 'system')"


@query(f"select conv_id, turn, instruction, text as output, count(*) over w as n_history, md5(coalesce(string_agg(instruction || chr(10) || text, chr(10)) over w, '')) as history_md5 from ({PRE}) where ok = 1 and idx % 2 = 1 window w as (partition by conv_id order by idx rows between unbounded preceding and 1 preceding)")
def sft_history(t):
    out = training.supervised(t.conversations)
    joined = F.array_join(F.transform("history", lambda p: F.concat(p[0], F.lit("\n"), p[1])), "\n")
    return out.select("conv_id", "turn", "instruction", "output", F.size("history").cast("long").alias("n_history"), F.md5(joined).alias("history_md5"))


@query("select conv_id, turn, n_messages, md5(p) as prompt_md5 from (select conv_id, turn, role, count(*) over w as n_messages, string_agg(role || ': ' || coalesce(text, ''), chr(10)) over w as p from conversations window w as (partition by conv_id order by turn rows between unbounded preceding and current row)) where role = 'user'")
def rl_prompt_history(t):
    p = training.prompts(t.conversations)
    said = F.array_join(F.transform("prompt", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
    return p.select("conv_id", "turn", F.size("prompt").cast("long").alias("n_messages"), F.md5(said).alias("prompt_md5"))


@query("select conv_id, case when row_number() over (order by conv_id) <= floor(0.9 * count(*) over ()) then 'train' else 'val' end as part from (select distinct conv_id from conversations)")
def train_val_split(t):
    return training.split(t.conversations.select("conv_id").distinct(), 0.9)


@query(f"select conv_id, turn, {draw_sql('42', 'conv_id')} as place from conversations")
def seeded_shuffle(t):
    return training.shuffled(t.conversations.select("conv_id", "turn"), 42, "conv_id").withColumn("place", draw(F.lit(42), F.col("conv_id")))


@query("select conv_id, turn, failed from (select conv_id, turn, coalesce(role = 'assistant' and lead(role) over w = 'user' and (contains(lead(text) over w, 'The') or contains(lead(text) over w, 'Que')), false) as failed from conversations window w as (partition by conv_id order by turn)) where failed")
def filter_failed_tool_call(t):
    return steps.failed_call(t.conversations, ("The", "Que"), call="assistant", response="user").where("failed").select("conv_id", "turn", "failed")


@query("select event_id, coalesce(case event_type when 'error' then 'REMOVE' when 'view' then 'HIDE' end, 'KEEP') = 'KEEP' as emit, coalesce(event_type <> 'error', true) as in_history from events")
def filter_step_type(t):
    kind = F.when(F.col("event_type") == "error", "REMOVE").when(F.col("event_type") == "view", "HIDE")
    return steps.step_flags(t.events.withColumn("type", kind)).select("event_id", "emit", "in_history")


@query("select conv_id, md5(string_agg(role || ': ' || coalesce(text, ''), chr(10) order by turn)) as rendered_md5 from conversations group by conv_id")
def conversation_rendering(t):
    return steps.rendered(t.conversations).select("conv_id", F.md5("rendered").alias("rendered_md5"))


@query("select conv_id, turn from conversations where role = 'assistant'")
def trace_filter(t):
    return steps.trace_filter(t.conversations, role="assistant", conv_id="All").select("conv_id", "turn")


@query("with c as (select conv_id, count(*) as n, avg(length(text)) as a from conversations group by conv_id) select n as length, round(avg(a), 6) as mean, round(median(a), 6) as median, round(stddev_samp(a), 6) as std, count(*) as n from c group by n")
def accuracy_by_length(t):
    c = t.conversations.groupBy("conv_id").agg(F.count("*").alias("length"), F.avg(F.length("text")).alias("a"))
    out = analytics.by_length(c, "length", "a")
    return out.select("length", *(F.round(x, 6).alias(x) for x in ("mean", "median", "std")), "n")


@query("with c as (select count(*) as n, avg(length(text)) as a from conversations group by conv_id) select round(corr(n, a), 6) as r from c")
def length_correlation(t):
    c = t.conversations.groupBy("conv_id").agg(F.count("*").alias("n"), F.avg(F.length("text")).alias("a"))
    return c.agg(F.round(F.corr("n", "a"), 6).alias("r"))


@query("select r_name as domain, n_name as child, count(*) as n, cast(2 - grouping(r_name) - grouping(n_name) as bigint) as level from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)")
def domain_rollup(t):
    known = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    rows = t.customer.join(known, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return analytics.domain_rollup(rows.select(F.coalesce("r_name", F.lit("Other")).alias("domain"), F.col("n_name").alias("child")), "domain", "child")


#: Events as errors of scenarios: types, places and details that reach every severity.
ERRORS = "select event_id as scenario, case event_type when 'error' then 'Load Scenario Error' when 'view' then 'Schema Validation Error' else 'Tool Error' end as type, 'tool' || (user_id % 5) as location, case event_id % 4 when 0 then 'Multiple calls failed' when 1 then 'a SINGLE call failed' when 2 then 'odd' end as details from events"


def derived_errors(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "Load Scenario Error").when(F.col("event_type") == "view", "Schema Validation Error").otherwise("Tool Error")
    said = F.when(F.col("event_id") % 4 == 0, "Multiple calls failed").when(F.col("event_id") % 4 == 1, "a SINGLE call failed").when(F.col("event_id") % 4 == 2, "odd")
    return t.events.select(F.col("event_id").alias("scenario"), kind.alias("type"), F.concat(F.lit("tool"), F.col("user_id") % 5).alias("location"), said.alias("details"))


@query(f"select type, location, count(*) as n, md5(string_agg(lpad(cast(scenario as varchar), 12, '0'), ',' order by scenario)) as scenarios_md5 from ({ERRORS}) group by type, location")
def error_aggregation(t):
    out = analytics.errors(derived_errors(t).withColumn("scenario", F.lpad(F.col("scenario").cast("string"), 12, "0")))
    return out.select("type", "location", "n", F.md5("scenarios").alias("scenarios_md5"))


SEVERITY = "case when type in ('Load Scenario Error', 'Schema Validation Error') then 'critical' when contains(lower(coalesce(details, '')), 'multiple') then 'high' when contains(lower(coalesce(details, '')), 'single') then 'medium' else 'low' end"


@query(f"select severity, count(e.type) as n from (values ('critical'), ('high'), ('medium'), ('low')) v(severity) left join (select *, {SEVERITY} as s from ({ERRORS})) e on e.s = severity group by severity")
def error_severities(t):
    return analytics.severity_summary(derived_errors(t))


@query("select count(*) as total, count(*) filter (quality = 1) as passed, count(*) filter (quality <> 1) as failed, bool_and(quality = 1) as all_passed from labels")
def validation_report(t):
    return analytics.report(t.labels.withColumn("ok", F.col("quality") == 1), "ok")


@query("select user_id, count(*) filter (event_type <> 'error') / 4.0 as accuracy from events group by user_id")
def pass_at_k(t):
    return analytics.pass_at_k(t.events.withColumn("d", F.col("event_type") != "error"), "user_id", "d", 4)


@query("select o_orderkey, o_custkey, o_totalprice from (select * from orders where o_orderstatus = 'F' order by o_totalprice desc, o_orderkey limit 20 offset 5)")
def document_find(t):
    return store.find(t.orders, {"o_orderstatus": "F"}, [("o_totalprice", -1)], limit=20, skip=5, include=["o_custkey", "o_totalprice"], ord_="o_orderkey")


@query("select event_type as _id, cast(sum(coalesce(round(value * 100), 0)) as bigint) as total, count(*) as n, first(event_id order by event_id) as first_event, md5(string_agg(cast(user_id as varchar), ',' order by event_id)) as users_md5 from events where user_id = 8 or user_id is not null group by event_type")
def document_aggregate(t):
    rows = t.events.withColumn("cents", cents("value"))
    out = store.aggregate(rows, [{"$sort": {"event_id": 1}}, {"$group": {"_id": "$event_type", "total": {"$sum": "$cents"}, "n": {"$sum": 1}, "first_event": {"$first": "$event_id"}, "users": {"$push": "$user_id"}}}], ord_="event_id")
    return out.select("_id", "total", F.col("n").cast("long").alias("n"), "first_event", F.md5(F.array_join(F.col("users").cast("array<string>"), ",")).alias("users_md5"))


@query("select count(*) as matched from events where event_type = 'click' and user_id = 3")
def document_count(t):
    return store.aggregate(t.events, [{"$match": {"event_type": "click"}}, {"$match": {"user_id": 3}}, {"$count": "matched"}], ord_="event_id")


@query("select c_custkey, c_name, c_acctbal from customer where c_custkey = 42")
def point_lookup(t):
    return t.customer.where("c_custkey = 42").select("c_custkey", "c_name", "c_acctbal")


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_orderkey || ':' || l_linenumber in ('1:1', '5979:6', '7:2')")
def composite_key_lookup(t):
    return store.at_keys(t.lineitem, ["l_orderkey", "l_linenumber"], ["1:1", "5979:6", "7:2"]).select("l_orderkey", "l_linenumber", "l_quantity")


@query("select p_partkey, p_name from part where contains(lower(p_name), 'ring') or contains(lower(p_type), 'eco')")
def text_search(t):
    return t.part.where(store.contains_any("Ring", "p_name") | store.contains_any("ECO", "p_type")).select("p_partkey", "p_name")


@query("select p_partkey from part where list_has_any(string_split(p_name, ' '), ['red', 'blue']) and not list_contains(string_split(p_name, ' '), 'small')")
def list_predicates(t):
    w = F.split("p_name", " ")
    return t.part.where(F.exists(w, lambda x: x.isin("red", "blue")) & F.forall(w, lambda x: x != "small")).select("p_partkey")


@query("select c_custkey from customer where lower(c_mktsegment) in ('machinery', 'household')")
def csv_argument_in(t):
    return t.customer.where(store.csv_in("c_mktsegment", " Machinery, household ,")).select("c_custkey")


@query("select o_orderkey, o_totalprice from orders where o_totalprice between 1000 and 50000 and strftime(o_orderdate, '%Y-%m-%d') between '1996-01-01' and '1997-06-30'")
def range_filter(t):
    day = F.col("o_orderdate")
    return t.orders.where(F.col("o_totalprice").between(1000, 50000) & (day >= F.lit("1996-01-01").cast("timestamp_ntz")) & (day < F.lit("1997-07-01").cast("timestamp_ntz"))).select("o_orderkey", "o_totalprice")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 15")
def top_k(t):
    return store.top_k(t.orders, F.col("o_totalprice"), 15, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("select p_partkey from part where p_size > 40 order by p_partkey limit 12")
def early_stop_limit(t):
    return t.part.where("p_size > 40").orderBy("p_partkey").limit(12).select("p_partkey")


@query("select p_partkey from (select * from part order by p_partkey limit 200) where p_size > 40")
def limit_then_filter(t):
    return t.part.orderBy("p_partkey").limit(200).where("p_size > 40").select("p_partkey")


@query("select c_custkey, (select cast(ceil(count(*) / 25.0) as bigint) from customer) as total_pages from customer order by c_custkey limit 25 offset 50")
def pagination(t):
    return store.page(t.customer.select("c_custkey"), 3, 25, "c_custkey")


@query("select c_custkey from customer where c_custkey > 100 order by c_custkey limit 30")
def keyset_page(t):
    return store.keyset_page(t.customer.select("c_custkey"), 100, 30, "c_custkey")


@query("select o.o_orderkey, c.c_name from (select * from orders order by o_orderkey limit 40) o join customer c on c.c_custkey = o.o_custkey where c.c_acctbal > 0")
def limit_before_join(t):
    cut = t.orders.orderBy("o_orderkey").limit(40)
    return cut.join(t.customer.where("c_acctbal > 0"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "c_name")


@query("select o.o_orderkey, coalesce(c.c_name, 'Unknown') as name from (select * from orders order by o_orderkey limit 40) o left join (select * from customer where c_acctbal > 0) c on c.c_custkey = o.o_custkey")
def paged_left_join_default(t):
    cut = t.orders.orderBy("o_orderkey").limit(40)
    return cut.join(t.customer.where("c_acctbal > 0"), F.col("c_custkey") == F.col("o_custkey"), "left").select("o_orderkey", F.coalesce("c_name", F.lit("Unknown")).alias("name"))


@query("select 'customer' as kind, 0 as _branch, c_name as name, c_acctbal as balance from customer where c_acctbal > 9000 union all select 'supplier', 1, s_name, s_acctbal from supplier where s_acctbal > 9000")
def tagged_union(t):
    c = t.customer.where("c_acctbal > 9000").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    s_ = t.supplier.where("s_acctbal > 9000").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return store.tagged_union({"customer": c, "supplier": s_}, "name")


@query("select o_custkey, arg_max(o_orderpriority, 10 - cast(substr(o_orderpriority, 1, 1) as int)) as highest from orders group by o_custkey")
def ordinal_max(t):
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderpriority", 10 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("highest"))


@query("with i as (select word, list(p_partkey) as ids from (select unnest(string_split(p_name, ' ')) as word, p_partkey from part) group by word) select word, unnest(ids) as p_partkey from i where contains(word, 'r')")
def index_search(t):
    # the index as a table of (word, id): its entries need not meet to be searched
    index = t.part.select(F.explode(F.split("p_name", " ")).alias("word"), "p_partkey")
    return index.where(store.contains_any("r", "word")).select("word", "p_partkey")


@query("select event_type, count(*) as n from events group by event_type")
def group_count(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"))


@query("select word, round(avg(p_size), 6) as mean_size, count(*) as n from (select unnest(string_split(p_name, ' ')) as word, p_size from part) group by word")
def exploded_average(t):
    return t.part.select(F.explode(F.split("p_name", " ")).alias("word"), "p_size").groupBy("word").agg(F.round(F.avg("p_size"), 6).alias("mean_size"), F.count("*").alias("n"))


@query("with l as (select l_returnflag, list_sort(list(l_extendedprice)) as v from lineitem group by l_returnflag) select l_returnflag, v[len(v) // 4 + 1] as q1, v[len(v) // 2 + 1] as q2, v[3 * len(v) // 4 + 1] as q3 from l")
def floor_quantile(t):
    return store.floor_quantiles(t.lineitem, "l_returnflag", "l_extendedprice")


@query("select word as key, count(*) as n from (select unnest(case when p_size % 5 = 0 then ['N/A'] else string_split(p_name, ' ') end) as word from part) group by word")
def facet_count(t):
    return store.facets(t.part, F.when(F.col("p_size") % 5 != 0, F.split("p_name", " ")))


@query("select p_partkey, score from (select p_partkey, len(list_filter(['red', 'ring', 'small'], lambda s: list_contains(string_split(p_name, ' '), s))) / 3 as score from part) where score > 0.5")
def scored_ranking(t):
    words = F.split("p_name", " ")
    score = F.size(F.array_intersect(F.array(*map(F.lit, ("red", "ring", "small"))), words)) / 3
    return t.part.select("p_partkey", score.alias("score")).where("score > 0.5")


@query("select event_id, round(avg(value) over (partition by user_id order by event_id rows between 6 preceding and current row), 4) as tail from events")
def tail_average(t):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-6, 0)
    return t.events.select("event_id", F.round(F.avg("value").over(w), 4).alias("tail"))


@query("select user_id, count(*) filter (event_type = 'click') as clicks, count(*) filter (event_type = 'error') as errors, count(*) as total from events group by user_id")
def pivot_counts(t):
    return t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count("*").alias("total"))


@query("select o_orderpriority, round(avg(date_diff('second', o_orderdate, l_shipdate + to_hours(l_linenumber)) / 3600.0) filter (l_orderkey % 7 <> 0), 6) as hours from lineitem join orders on l_orderkey = o_orderkey group by o_orderpriority")
def duration_average(t):
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    shipped = F.when(F.col("l_orderkey") % 7 == 0, "some day").otherwise(text(F.col("l_shipdate").cast("timestamp") + F.make_dt_interval(F.lit(0), F.col("l_linenumber"))))
    j = t.lineitem.select("l_orderkey", shipped.alias("shipped")).join(t.orders.select("o_orderkey", text("o_orderdate").alias("ordered"), "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    return store.mean_hours(j, ["o_orderpriority"], F.col("ordered"), F.col("shipped")).withColumn("hours", F.round("hours", 6))


@query("with g as (select n_regionkey, substr(n_name, 1, 1) as letter, string_agg(n_name, '+' order by n_nationkey) as names from nation group by 1, 2) select n_regionkey, string_agg(letter || '=' || names, ',' order by letter) as nations from g group by n_regionkey")
def group_to_nested(t):
    g = store.nested(t.nation.withColumn("letter", F.substring("n_name", 1, 1)), "n_regionkey", "letter", "n_name", "n_nationkey")
    parts = F.transform(F.array_sort(F.map_keys("items")), lambda k: F.concat(k, F.lit("="), F.array_join(F.try_element_at("items", k), "+")))
    return g.select("n_regionkey", F.array_join(parts, ",").alias("nations"))


POINTS = "select n_nationkey as k, n_nationkey * 7.3 - 80 as lat, n_nationkey * 13.7 - 170 as lon from nation"


@query(f"with p as ({POINTS}) select a.k as a, b.k as b, cast(trunc(2 * 6371000 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) as bigint) as metres from p a join p b on a.k < b.k")
def distance_matrix(t):
    p = t.nation.select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") * F.lit(7.3) - 80).alias("lat"), (F.col("n_nationkey") * F.lit(13.7) - 170).alias("lon"))
    a, b = (p.select(*(F.col(c).alias(f"{c}{x}") for c in p.columns)) for x in "12")
    return a.join(b, F.col("k1") < F.col("k2")).select(F.col("k1").alias("a"), F.col("k2").alias("b"), store.haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")).cast("long").alias("metres"))


@query(f"with p as ({POINTS}), c as (select c_custkey, c_acctbal / 60 as lat, c_custkey % 360 - 180 as lon from customer) select c_custkey, arg_min(k, (sqrt(pow(c.lat - p.lat, 2) + pow(c.lon - p.lon, 2)), k)) as nearest from c cross join p group by c_custkey")
def nearest_neighbour(t):
    sites = t.nation.select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") * F.lit(7.3) - 80).alias("lat"), (F.col("n_nationkey") * F.lit(13.7) - 170).alias("lon"))
    return store.nearest(t.customer, F.col("c_acctbal") / 60, F.col("c_custkey") % 360 - 180, sites, "k").select("c_custkey", "nearest")


ZONES = [["AFRICA", "EGYPT", "KENYA"], ["CHINA", "INDIA"], ["FRANCE", "GERMANY"], ["BRAZIL", "PERU"]]


@query("""with z as (select n_nationkey as k, case when contains(n_name, 'AFRICA') or contains(n_name, 'EGYPT') or contains(n_name, 'KENYA') then 1 when contains(n_name, 'CHINA') or contains(n_name, 'INDIA') then 2 when contains(n_name, 'FRANCE') or contains(n_name, 'GERMANY') then 3 when contains(n_name, 'BRAZIL') or contains(n_name, 'PERU') then 4 else 5 end as zone from nation),
o as (select o_orderkey, o_orderpriority as company, x.zone as a, y.zone as b, case when o_orderkey % 9 = 0 then 1.0 else round(o_totalprice / 10000, 1) end as weight from orders join z x on x.k = o_custkey % 25 join z y on y.k = o_orderkey % 25)
select o_orderkey, round_even(case company when '1-URGENT' then 20.0 when '2-HIGH' then 15.0 else 10.0 end * weight * case least(a, b) || '-' || greatest(a, b) when '1-1' then 1.0 when '1-5' then 2.0 when '5-5' then 1.25 else 1.5 end, 2) as price, case when a = b then 1 when abs(a - b) <= 2 then 2 else 3 end as days from o""")
def zone_pricing(t):
    zone = t.nation.select(F.col("n_nationkey").alias("k"), store.first_zone(F.col("n_name"), ZONES).alias("zone"))
    weight = F.when(F.col("o_orderkey") % 9 == 0, "heavy").otherwise(F.round(F.col("o_totalprice") / 10000, 1).cast("string"))
    o = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("company"), weight.alias("weight"), (F.col("o_custkey") % 25).alias("x"), (F.col("o_orderkey") % 25).alias("y"))
    o = o.join(zone.selectExpr("k x", "zone a"), "x").join(zone.selectExpr("k y", "zone b"), "y")
    values = lambda names, *rows: t.spark.createDataFrame(list(rows), names)
    rates, times = values("company string, rate double", ("1-URGENT", 20.0), ("2-HIGH", 15.0)), values("zones string, multiplier double", ("1-1", 1.0), ("1-5", 2.0), ("5-5", 1.25))
    return store.zone_price(o, F.col("a"), F.col("b"), F.col("company"), F.col("weight"), rates, times).select("o_orderkey", "price", "days")


@query("select c_custkey, case when c_custkey % 10 = 0 then 0.0 else c_acctbal end as balance from customer")
def upsert(t):
    old = t.customer.select("c_custkey", F.col("c_acctbal").alias("balance"))
    return store.upsert(old, old.where("c_custkey % 10 = 0").withColumn("balance", F.lit(0.0)), "c_custkey")


@query("select c_custkey, 1 as n from customer union all select max(c_custkey) + 1, 2 from customer")
def insert_if_absent(t):
    old = t.customer.select("c_custkey", F.lit(1).alias("n"))
    new = t.customer.agg(F.max("c_custkey").alias("m")).select(F.explode(F.array("m", F.col("m") + 1)).alias("c_custkey"), F.lit(2).alias("n"))
    return store.insert_absent(old, new, "c_custkey")


@query("select o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal < 0)")
def cascade_delete(t):
    _, left = store.cascade_delete(t.customer.withColumnRenamed("c_custkey", "k"), t.orders, F.col("c_acctbal") < 0, "k", "o_custkey")
    return left.select("o_orderkey")


@query("select c_custkey, c_custkey in (select o_custkey from orders) as found from customer")
def found_missing(t):
    return store.found_missing(t.customer.select("c_custkey"), t.orders.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query("select d.doc_id, l.quality from documents d left join labels l using (doc_id)")
def label_left_join(t):
    return t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")


@query("select coalesce(l.toxic, 0) = 1 as provided, count(*) as n, min(d.doc_id) as first_id from documents d left join labels l using (doc_id) group by 1")
def split_by_user_provided(t):
    j = t.documents.select("doc_id").join(t.labels, "doc_id", "left").withColumn("provided", F.coalesce(F.col("toxic") == 1, F.lit(False)))
    return j.groupBy("provided").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("with v as (select vec_id, cast(embedding as double[]) as e from embeddings) select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.e, b.e), 5) as cosine from v a join v b on a.vec_id < b.vec_id where list_cosine_similarity(a.e, b.e) > 0.4")
def similarity_edges(t):
    return graph.similar_pairs(t.embeddings, "vec_id", "embedding", 0.4).withColumn("cosine", F.round("cosine", 5))


@query("""with recursive v as (select vec_id, cast(embedding as double[]) as e from embeddings), p as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id < b.vec_id where list_cosine_similarity(a.e, b.e) > 0.4),
h as (select a, list(b) as bs, row_number() over (order by a) as k from p group by a),
w as (select cast(0 as bigint) as k, cast([] as bigint[]) as gone, cast(null as bigint) as rep, cast([] as bigint[]) as took union all
  select h.k, case when list_contains(w.gone, h.a) then w.gone else list_concat(w.gone, list_filter(h.bs, lambda x: not list_contains(w.gone, x))) end, h.a, case when list_contains(w.gone, h.a) then [] else list_filter(h.bs, lambda x: not list_contains(w.gone, x)) end from w join h on h.k = w.k + 1)
select unnest(took) as id, rep as representative from w""")
def merge_params(t):
    return graph.merged(graph.similar_pairs(t.embeddings, "vec_id", "embedding", 0.4))


@query("""with c as (select 't' || c_custkey as tool, c_custkey % 4 as k, c_nationkey as n from customer)
select tool, 'a' as name, 'string' as dtype, true as required from c where k < 3 union all select tool, 'b' || n || '.x', 'integer', false from c where k = 1 union all select tool, 'b' || n, 'array', false from c where k = 0
union all select tool, 'c.y', case when n % 2 = 0 then 'number' else 'unknown' end, true from c where k < 3 union all select tool, 'c.z', 'object', true from c where k < 3 union all select tool, 'd', 'object', false from c where k = 2""")
def flatten_schema(t):
    k = F.col("c_custkey") % 4
    items = F.when(k == 1, '{"type": "object", "properties": {"x": {"type": "integer"}}}').otherwise('{"type": "string"}')
    b = F.when(k < 2, F.concat(F.lit(', "b'), "c_nationkey", F.lit('": {"type": "array", "items": '), items, F.lit("}"))).otherwise(F.lit(""))
    y = F.when(F.col("c_nationkey") % 2 == 0, '{"type": "number"}').otherwise('{"description": "no type"}')
    c = F.concat(F.lit(', "c": {"type": "object", "properties": {"y": '), y, F.lit(', "z": {"type": "object", "properties": {"deep": {"type": "string"}}}}}'))
    d = F.when(k == 2, ', "d": {"type": "object"}').otherwise("")
    schema = F.when(k < 3, F.concat(F.lit('{"properties": {"a": {"type": "string"}'), b, c, d, F.lit('}, "required": ["a", "c"]}')))
    return graph.flatten_schema(t.customer.select(F.concat(F.lit("t"), "c_custkey").alias("tool"), schema.alias("schema")))


@query("select p_partkey from part where p_size > 5 and p_partkey not in (select l_partkey from lineitem where l_quantity > 45)")
def audit_orphans(t):
    return graph.orphans(t.part.select("p_partkey", "p_size"), t.lineitem.where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), F.col("p_size") <= 5, "p_partkey").select("p_partkey")


@query("""with c as (select l_orderkey as chain, l_linenumber as pos, l_suppkey % 6 as tool from lineitem), g as (select * from (values (0, 1), (1, 2), (2, 3)) v(tool, param)), n as (select * from (values (3, 1), (4, 2), (5, 3)) v(tool, param)),
f as (select c.chain, g.param, min(c.pos) as at from c join g using (tool) group by all),
a as (select c.chain, bool_and(coalesce(f.at < c.pos, false)) as ok from c join n using (tool) left join f on f.chain = c.chain and f.param = n.param group by c.chain)
select distinct c.chain, coalesce(a.ok, true) as valid from c left join a using (chain)""")
def validate_tool_chain(t):
    calls = t.lineitem.select(F.col("l_orderkey").alias("chain"), F.col("l_linenumber").alias("pos"), (F.col("l_suppkey") % 6).alias("tool"))
    gives = t.spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "tool long, param int")
    needs = t.spark.createDataFrame([(3, 1), (4, 2), (5, 3)], "tool long, param int")
    return graph.valid_chains(calls, F.broadcast(needs), F.broadcast(gives))


@query("select distinct o_custkey as src, l_partkey as dst from orders join lineitem on l_orderkey = o_orderkey where o_custkey in (select c_custkey from customer where c_acctbal > 5000) and l_partkey in (select c_custkey from customer where c_acctbal > 5000)")
def subgraph(t):
    edges = t.orders.join(t.lineitem.select("l_orderkey", "l_partkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    return graph.induced(edges, t.customer.where("c_acctbal > 5000").select(F.col("c_custkey").alias("id")))


#: Suppliers as tools, their nations as servers; an edge leads to the supplier of the order's next line.
NEXT = "select distinct src, dst from (select l_suppkey as src, lead(l_suppkey) over (partition by l_orderkey order by l_linenumber, l_suppkey) as dst from lineitem) where dst is not null and src <> dst"


def next_edges(t: Tables) -> DataFrame:
    ahead = F.lead("l_suppkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey"))
    return t.lineitem.select(F.col("l_suppkey").alias("src"), ahead.alias("dst")).where("dst is not null and src <> dst").distinct()


@query(f"""with recursive e as ({NEXT}), n as (select s_suppkey as node, s_nationkey as server, row_number() over (partition by s_nationkey order by s_suppkey) - 1 as nth, count(*) over (partition by s_nationkey) as many from supplier),
w as (select s_suppkey as seed, cast(0 as bigint) as step, s_suppkey as node, [s_suppkey] as seen from supplier union all
  select seed, step, node, list_append(seen, node) from (select w.seed, w.step + 1 as step, w.seen,
    coalesce((select arg_min(e.dst, ({draw_sql('w.seed', 'w.step + 1', 'e.dst')}, e.dst)) from e where e.src = w.node and not list_contains(w.seen, e.dst)), (select o.node from n h join n o on o.server = h.server where h.node = w.node and o.nth = {draw_sql('w.seed', 'w.step + 1', '1048575')} % h.many)) as node from w where w.step < 4))
select seed, step, node from w""")
def sample_chain(t):
    tools = t.supplier.select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").cast("string").alias("server"))
    return sampling.sample_chain(next_edges(t), tools, t.supplier.selectExpr("s_suppkey seed", "s_suppkey start"), 5)


@query("""with c as (select user_id, event_id, event_type, value, case event_type when 'error' then 'delete' when 'click' then 'add' else 'set' end as op, case when event_type = 'error' then case event_id % 2 when 0 then 'click' else 'view' end else event_type end as item from events),
g as (select *, coalesce(sum(case when op in ('delete', 'set') then 1 else 0 end) over (partition by user_id, item order by event_id), 0) as run, lag(op) over (partition by user_id, item order by event_id) as last_op from c),
v as (select *, case when op = 'delete' then null else sum(case when op = 'delete' then 0 else value end) over (partition by user_id, item, run order by event_id) end as now from g),
s as (select a.user_id, a.event_id, a.op, a.last_op, b.item, b.now, row_number() over (partition by a.user_id, a.event_id, b.item order by b.event_id desc) as nth from v a join v b on b.user_id = a.user_id and b.event_id <= a.event_id)
select user_id, event_id, any_value(case when op = 'delete' then case when last_op is null or last_op = 'delete' then 'missing' else 'deleted' end when last_op is null or last_op = 'delete' then 'created' else 'updated' end) as response, count(now) as size, round(coalesce(sum(now), 0), 4) as total from s where nth = 1 group by user_id, event_id""")
def replay_calls(t):
    gone = F.col("event_type") == "error"
    op = F.when(gone, "delete").when(F.col("event_type") == "click", "add").otherwise("set")
    item = F.when(gone, F.when(F.col("event_id") % 2 == 0, "click").otherwise("view")).otherwise(F.col("event_type"))
    return store.replay(t.events.select("user_id", "event_id", op.alias("op"), item.alias("item"), "value"), "user_id", "event_id").withColumn("total", F.round("total", 4))


@query("select event_id, case event_id % 4 when 3 then 'no json {at all' when 2 then '[' || props || ']' else props end as j from events")
def json_salvage(t):
    k = F.col("event_id") % 4
    said = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("here: "), "props", F.lit(" end"))).when(k == 2, F.concat(F.lit("a list: ["), "props", F.lit("] end"))).otherwise("no json {at all")
    # of a list around one object the outermost object is found first
    salvaged = T.salvage_json(said)
    return t.events.select("event_id", F.when(k == 2, F.concat(F.lit("["), salvaged, F.lit("]"))).otherwise(salvaged).alias("j"))


@query("select page_id, len(regexp_extract_all(html, '(?s)<p(?:\\s[^>]*)?>(.*?)</p>', 1)) as n_paragraphs, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) as title from pages")
def tagged_text_parse(t):
    return t.pages.select("page_id", F.size(T.tag_values(F.col("html"), "p")).cast("long").alias("n_paragraphs"), T.tag_values(F.col("html"), "title")[0].alias("title"))


@query("select conv_id, turn, md5(case turn % 3 when 2 then 'no code: ' else '' end || coalesce(text, '')) as code_md5 from conversations")
def strip_fences(t):
    said = F.coalesce("text", F.lit(""))
    fenced = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("```python\n"), said, F.lit("\n```"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("Here it is:\n```\n"), said, F.lit("\n```\nDone."))).otherwise(F.concat(F.lit("no code: "), said))
    return t.conversations.select("conv_id", "turn", F.md5(T.strip_fences(fenced)).alias("code_md5"))


@query("""select event_id, md5(case event_id % 3 when 0 then event_type when 1 then '<tool_call>' || chr(10) || '{"name": "' || event_type || '-"q", "arguments": ' || props || '}' || chr(10) || '</tool_call>' || chr(10) else '<tool_response>' || chr(10) || event_type || chr(10) || '</tool_response>' || chr(10) || '<tool_response>' || chr(10) || 'ok' || chr(10) || '</tool_response>' || chr(10) end) as step_md5 from events""".replace('-"q', '-' + chr(92) + '"q'))
def format_step(t):
    k = F.col("event_id") % 3
    role = F.when(k == 0, "user").when(k == 1, "tool_call").otherwise("tool_response")
    calls = F.array(F.struct(F.concat("event_type", F.lit('-"q')).alias("name"), F.col("props").alias("arguments")))
    return t.events.select("event_id", F.md5(turns.step_text(role, F.col("event_type"), calls, F.array("event_type", F.lit("ok")))).alias("step_md5"))


@query("select s_suppkey, 'You are ' || s_name || ' of nation ' || s_nationkey || '.' as prompt from supplier")
def system_prompt(t):
    return t.supplier.select("s_suppkey", T.fill_template("You are {name} of nation {nation}.", name=F.col("s_name"), nation=F.col("s_nationkey").cast("string")).alias("prompt"))


@query("select split_part(s_name, '#', 1) as server, count(*) as n from supplier group by 1")
def server_of_tool(t):
    return t.supplier.select(T.server_of(F.replace("s_name", F.lit("#"), F.lit("-"))).alias("server")).groupBy("server").agg(F.count("*").alias("n"))


@query("select source, lang, count(*) as n, cast(sum(n_chars) as bigint) as n_chars from documents group by source, lang")
def corpus_rollup(t):
    return t.documents.groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


@query("select user_id, string_agg(distinct event_type, ',' order by event_type) as servers from events group by user_id")
def distinct_servers(t):
    return t.events.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("servers"))


@query("select e.event_id, e.user_id from events e where exists (select 1 from events x where x.user_id = e.user_id and x.event_type = 'purchase') and e.event_type = 'click'")
def semi_join(t):
    return t.events.where("event_type = 'click'").join(t.events.where("event_type = 'purchase'").select("user_id").distinct(), "user_id", "left_semi").select("event_id", "user_id")


@query("select p_partkey - 1 as row, p_brand || '|' || p_type as cells from part where p_partkey between 3 and 8")
def cell_range_read(t):
    sheet = t.part.select((F.col("p_partkey") - 1).alias("row"), F.array("p_name", "p_brand", "p_type").alias("cells"))
    return store.a1_range(sheet, "B3:C8").select("row", F.array_join("cells", "|").alias("cells"))


@query("select o_custkey, count(*) filter (o_orderstatus = 'F') > 0 and bool_and(o_orderpriority in ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')) as admitted from orders group by o_custkey")
def rl_admission(t):
    known = F.create_map(*(F.lit(x) for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW") for x in (p, "state")))
    g = t.orders.groupBy("o_custkey").agg(F.collect_list(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("calls"), F.collect_set("o_orderpriority").alias("servers"))
    return g.select("o_custkey", catalog.admitted(F.col("calls"), F.col("servers"), known).alias("admitted"))


@query("select s_suppkey from supplier where s_nationkey in (3, 7, 11)")
def server_tool_filter(t):
    tools = t.supplier.select("s_suppkey", F.concat(F.col("s_nationkey").cast("string"), F.lit("-"), "s_name").alias("tool"), F.col("s_nationkey").cast("string").alias("server"))
    state = tools.limit(1).select(F.lit(-1).cast("long").alias("s_suppkey"), F.lit("3-load_scenario").alias("tool"), F.lit("3").alias("server"))
    return catalog.visible_tools(tools.unionByName(state), ["3", "7", "11"]).select("s_suppkey")


@query("select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 49)")
def user_tool_split(t):
    return catalog.assistant_tools(t.part.select("p_partkey", F.col("p_partkey").alias("tool")), t.lineitem.where("l_quantity > 49").select(F.col("l_partkey").alias("tool"))).select("p_partkey")


@query("select 'in' || p_partkey as src, p_brand as dst, 'parameter_to_tool' as edge_type, p_size > 25 as required from part where p_partkey % 2 = 0 union select p_brand, 'in' || p_partkey, 'tool_to_parameter', false from part where p_partkey % 2 = 1")
def io_edges(t):
    return catalog.io_edges(t.part.select(F.col("p_brand").alias("tool"), F.concat(F.lit("in"), "p_partkey").alias("param_id"), F.when(F.col("p_partkey") % 2 == 0, "input").otherwise("output").alias("direction"), (F.col("p_size") > 25).alias("required")))


@query("select p_partkey, p_name || ' (' || p_type || ')' as name_text, case when p_size > 10 then p_brand end as desc_text, p_name || ' (' || p_type || '): ' || case when p_size > 10 then p_brand else '' end as full_text from part")
def embed_texts(t):
    p = t.part.select("p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("dtype"), F.when(F.col("p_size") > 10, F.col("p_brand")).alias("description"))
    return catalog.embed_texts(p).select("p_partkey", "name_text", "desc_text", "full_text")


@query("with i as (select c_custkey as param from customer where c_acctbal > 5000), o as (select distinct l_suppkey as tool, o_custkey as param from lineitem join orders on l_orderkey = o_orderkey where l_quantity > 48) select distinct param, tool from (select i.param, o.tool from i join o using (param) union all select i.param, o.tool from i join o on o.param = i.param - 1)")
def provider_join(t):
    i = t.customer.where("c_acctbal > 5000").select(F.col("c_custkey").alias("param"))
    o = t.lineitem.where("l_quantity > 48").select("l_orderkey", F.col("l_suppkey").alias("tool")).join(t.orders.select("o_orderkey", F.col("o_custkey").alias("param")), F.col("l_orderkey") == F.col("o_orderkey")).select("tool", "param").distinct()
    return catalog.providers(i, o, t.customer.select(F.col("c_custkey").alias("src"), (F.col("c_custkey") + 1).alias("dst")))


@query("select c_custkey as param, c_acctbal > 9000 or c_custkey in (select o_custkey from orders where o_orderstatus = 'P') as fillable from customer")
def validate_parameter(t):
    inputs = t.customer.select(F.col("c_custkey").alias("param"), (F.col("c_acctbal") > 9000).alias("user_provided"))
    return catalog.fillable(inputs, t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("param"))).select("param", "fillable")


@query("with v as (select vec_id, cast(embedding as double[]) as e from embeddings), p as (select a.vec_id as a, b.vec_id as b, list_cosine_similarity(a.e[1:32], b.e[1:32]) as x, list_cosine_similarity(a.e[33:64], b.e[33:64]) as y from v a join v b on a.vec_id < b.vec_id) select a, b, round(0.6 * x + 0.4 * y, 5) as similarity from p where 0.6 * x + 0.4 * y > 0.45")
def weighted_similarity_join(t):
    halves = t.embeddings.select("vec_id", F.slice("embedding", 1, 32).alias("name"), F.slice("embedding", 33, 32).alias("said"))
    return graph.weighted_pairs(halves, "vec_id", "name", "said", 0.45).select("a", "b", F.round("cosine", 5).alias("similarity"))


@query(f"""with recursive l as (select l_orderkey as chain, l_linenumber as pos, row_number() over (partition by l_orderkey order by l_linenumber) as k, {draw_sql('7', 'l_orderkey', 'l_linenumber')} as r from lineitem),
w as (select chain, pos, k, r, cast(1 as bigint) as length, 0 as turn from l where k = 1 union all
  select l.chain, l.pos, l.k, l.r, case when w.length >= 5 or w.r * 5 < w.length * 2147483587 then 1 else w.length + 1 end, case when w.length >= 5 or w.r * 5 < w.length * 2147483587 then w.turn + 1 else w.turn end from w join l on l.chain = w.chain and l.k = w.k + 1)
select chain, pos, turn from w""")
def split_turns(t):
    return sampling.split_turns(t.lineitem.select(F.col("l_orderkey").alias("chain"), F.col("l_linenumber").alias("pos")), most=5, seed=7)


@query()
def topology_sample(t):
    tools = t.supplier.select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").cast("string").alias("server"))
    inputs = t.supplier.select(F.col("s_suppkey").alias("node"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i")).select("node", F.concat(F.lit("p"), (F.col("node") * 7 + F.col("i") * 3) % 40).alias("param"), (F.col("i") == 0).alias("required"), (F.col("i") == 2).alias("user_provided"))
    gives = t.supplier.select(F.col("s_suppkey").alias("node"), F.concat(F.lit("p"), F.col("s_suppkey") % 40).alias("param"))
    return sampling.topology_sample(next_edges(t), inputs, gives, tools, t.supplier.selectExpr("s_suppkey seed", "s_suppkey start"), max_nodes=4)


@query("select event_id, position, message from (select event_id, cast(0 as int) as position, cast(json_extract(props, '$.k') as varchar) as message from events where event_id % 2 = 0 union all select event_id, cast(p.i as int), case p.i when 0 then cast(json_extract(props, '$.k') as varchar) else event_type end from events, (values (0), (1)) p(i) where event_id % 2 = 1)")
def turn_normalisation(t):
    one = F.col("props")
    two = F.concat(F.lit("["), "props", F.lit(', {"k": "'), "event_type", F.lit('"}]'))
    log = t.events.select("event_id", F.col("event_id").cast("string").alias("key"), F.when(F.col("event_id") % 2 == 0, one).otherwise(two).alias("messages"))
    noise = log.withColumn("key", F.lit("summary"))
    return traces.normalised_turns(log.unionByName(noise)).select("event_id", "position", F.get_json_object("message", "$.k").alias("message"))


@query("select conv_id, turn, case when text is not null then case role when 'user' then 'user' when 'assistant' then 'assistant' else 'system' end end as field, length(text) as n_chars from conversations")
def log_message_projection(t):
    message = F.to_json(F.struct(*(F.when(F.col("role") == r, F.col("text")).alias(r) for r in ("user", "assistant", "system"))))
    field, text = traces.shown_message(message)
    return t.conversations.select("conv_id", "turn", field.alias("field"), F.length(text).cast("long").alias("n_chars"))


@query("select user_id, event_type, count(*) as n, md5(string_agg(cast(event_id as varchar), ',' order by event_id)) as messages_md5 from events group by user_id, event_type")
def log_grouping(t):
    g = traces.grouped_log(t.events.withColumn("message", F.col("event_id").cast("string")), "user_id", "event_type", "event_id")
    return g.select("user_id", "event_type", F.size("messages").cast("long").alias("n"), F.md5(F.array_join("messages", ",")).alias("messages_md5"))


@query("select user_id, count(*) as n, count(*) filter (event_type = 'click') as n_first from events where event_type in ('click', 'view') group by user_id")
def log_merge(t):
    a, b = (t.events.where(F.col("event_type") == k).groupBy(F.col("user_id").alias("key")).agg(F.collect_list("event_id").alias("items")) for k in ("click", "view"))
    m = traces.merged_log(a, b).join(a.select("key", F.size("items").alias("f")), "key", "left")
    return m.select(F.col("key").alias("user_id"), F.size("items").cast("long").alias("n"), F.coalesce("f", F.lit(0)).cast("long").alias("n_first"))


@query("select conv_id, turn, case when turn % 3 = 0 and role = 'assistant' then 'REMOVE' end as type from conversations")
def step_classification_merge(t):
    labels = t.conversations.where("turn % 3 = 0").select("conv_id", "turn", F.lit("assistant").alias("role"), F.lit("REMOVE").alias("type"))
    return traces.classified(t.conversations, labels, order="turn").select("conv_id", "turn", "type")


@query("select conv_id, turn from (select conv_id, turn, role, row_number() over w = 1 as f, lag(turn % 3 = 1) over w as p from conversations window w as (partition by conv_id order by turn)) where f or turn % 3 = 1 or (p and role in ('tool_response', 'user'))")
def trajectory_step_filter(t):
    return traces.kept_steps(t.conversations, t.conversations.where("turn % 3 = 1").select("conv_id", "turn"), order="turn").select("conv_id", "turn")


@query("select user_id, event_id from events where user_id in (select user_id from events where event_type = 'purchase')")
def skip_without_calls(t):
    return traces.turns_with(t.events.withColumnRenamed("event_type", "role"), "purchase", ("user_id",)).select("user_id", "event_id")


@query("select doc_id from labels where quality = 1")
def solutions_view(t):
    return traces.solutions(t.labels.withColumn("decision", F.when(F.col("quality") == 1, True))).select("doc_id")


@query("select o_orderkey from orders where o_orderpriority = '3-MEDIUM' order by o_orderkey limit 1")
def scenario_by_complexity(t):
    return traces.first_scenario(t.orders, "3-MEDIUM", "o_orderpriority", "o_orderkey").select("o_orderkey")


@query("select r_regionkey, string_agg(n_name, ',' order by n_name) as kept from nation join region on n_regionkey = r_regionkey where n_name in (select n_name from nation where n_nationkey in (1, 2, 5, 8)) group by r_regionkey")
def scenario_filter(t):
    keep = ["1", "2", "5", "8"]
    m = t.nation.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), "n_name"))).alias("m"))
    kept = m.select("r_regionkey", F.map_values(traces.servers_only(F.col("m"), keep)).alias("v")).where("size(v) > 0")
    return kept.select("r_regionkey", F.array_join(F.sort_array("v"), ",").alias("kept"))


@query("select conv_id, turn, case when turn % 4 < 3 then 'because ' || role end as think, regexp_replace(regexp_replace(coalesce(text, ''), '^\\s+', ''), '\\s+$', '') as answer from conversations where role = 'assistant'")
def think_split(t):
    said = F.coalesce("text", F.lit(""))
    c = t.conversations.where("role = 'assistant'")
    think, answer = T.split_think(F.when(F.col("turn") % 4 < 3, F.concat(F.lit("<think>because "), "role", F.lit("</think> "), said)).otherwise(said))
    return c.select("conv_id", "turn", think.alias("think"), answer.alias("answer"))


@query("select page_id from pages where regexp_matches(url, '^https?://[^/]*/[^/]*/[^/]*$')")
def glob_search(t):
    path = F.concat(F.lit("/"), F.regexp_replace("url", "^https?://", ""))
    hit = F.when(F.col("url").rlike("^https?://"), paths.matches(path, "/*/*/*"))
    return t.pages.where(hit).select("page_id")


TREE = "select '/' || p_brand || '/' || replace(p_type, ' ', '_') || '/' || p_partkey as path, cast(p_size as bigint) as size, p_brand, p_type from part"


@query(f"with f as ({TREE}) select folder, count(*) as n, cast(sum(size) as bigint) as size from (select '/' as folder, size from f union all select '/' || p_brand, size from f union all select '/' || p_brand || '/' || replace(p_type, ' ', '_'), size from f) group by folder")
def directory_tree(t):
    files = t.part.select(F.concat(F.lit("/"), "p_brand", F.lit("/"), F.replace("p_type", F.lit(" "), F.lit("_")), F.lit("/"), "p_partkey").alias("path"), F.col("p_size").cast("long").alias("size"))
    return paths.tree_sizes(files)


@query("select p_brand as name, 'folder' as kind, count(*) as n, cast(sum(p_size) as bigint) as size from part group by p_brand")
def directory_listing(t):
    files = t.part.select(F.concat(F.lit("/"), "p_brand", F.lit("/"), "p_partkey").alias("path"), F.col("p_size").cast("long").alias("size"))
    return paths.listing(files, "/")


@query("select p_partkey, p_brand as removed, p_type as added from part")
def file_diff(t):
    old, new = F.concat("p_name", F.lit("\n"), "p_brand"), F.concat("p_name", F.lit("\n"), "p_type")
    gone, came = paths.changed_lines(old, new)
    return t.part.select("p_partkey", F.array_join(gone, "\n").alias("removed"), F.array_join(came, "\n").alias("added"))


@query("select r_name as source, n_name as target from nation join region on n_regionkey = r_regionkey where contains(lower(n_name), 'a') or contains(lower(r_name), 'a')")
def graph_search(t):
    names = t.nation.select(F.col("n_name").alias("name"), F.lit("nation").alias("kind")).unionByName(t.region.select(F.col("r_name").alias("name"), F.lit("region").alias("kind")))
    entities = names.withColumn("observations", F.array().cast("array<string>"))
    relations = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("source"), F.col("n_name").alias("target"), F.lit("holds").alias("kind"))
    return knowledge.search_nodes(entities, relations, "A")[1].select("source", "target")


@query("select user_id % 7 as src, user_id % 11 as dst, min(event_id) as first_id from events group by 1, 2")
def edge_dedup(t):
    return t.events.groupBy((F.col("user_id") % 7).alias("src"), (F.col("user_id") % 11).alias("dst")).agg(F.min("event_id").alias("first_id"))


@query("select c_custkey, sqrt(pow(c_custkey, 2) + 3) * 2 - c_nationkey / 4.0 as result from customer")
def expression_eval(t):
    return t.customer.select("c_custkey", T.arithmetic("sqrt(c_custkey ** 2 + 3) * 2 - c_nationkey / 4", ("c_custkey", "c_nationkey")).alias("result"))


@query("select n_nationkey as a_key, s_suppkey from supplier join nation on true where sqrt(pow(s_nationkey * 7.3 - n_nationkey * 7.3, 2) + pow(s_nationkey * 1.7 - n_nationkey * 1.7, 2)) * 69 < 1000")
def radius_filter(t):
    centres = t.nation.select(F.col("n_nationkey").alias("a_key"), (F.col("n_nationkey") * F.lit(7.3)).alias("c_lat"), (F.col("n_nationkey") * F.lit(1.7)).alias("c_lon"))
    points = t.supplier.select("s_suppkey", (F.col("s_nationkey") * F.lit(7.3)).alias("lat"), (F.col("s_nationkey") * F.lit(1.7)).alias("lon"))
    return store.within(points, centres, 1000 / 69).select("a_key", "s_suppkey")


@query("select supplier.s_suppkey, md5('11:' || s_suppkey) as new_id, length('x' || s_name) > 1 as client_ok from supplier")
def deterministic_ids(t):
    return t.supplier.select("s_suppkey", T.keyed_id(11, F.col("s_suppkey")).alias("new_id"), T.is_client_tool(F.concat(F.lit("x-"), "s_name")).alias("client_ok"))


@query("select p_partkey, case p_partkey % 3 when 0 then p_brand when 1 then p_brand || chr(10) || p_type end as section from part")
def section_extraction(t):
    k = F.col("p_partkey") % 3
    text = F.when(k == 0, F.concat(F.lit("intro\n### A\n"), "p_brand", F.lit("\n### B\n"), "p_type")).when(k == 1, F.concat(F.lit("### A  "), "p_brand", F.lit("\n"), "p_type", F.lit(" \n"))).otherwise(F.concat(F.lit("### B\n"), "p_type"))
    return t.part.select("p_partkey", T.section(text, "### A", "### B").alias("section"))


@query("select event_id, strftime(ts, '%Y-%m-%d') as day, round_even(value * 4, 0) / 4 as quarter from events")
def date_and_rounding(t):
    mail = F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss +0000")
    return t.events.select("event_id", F.date_format(T.mail_date(mail), "yyyy-MM-dd").alias("day"), (F.bround(F.col("value") * 4, 0) / 4).alias("quarter"))


@query("""select s_suppkey, 'Tool Name: ' || s_name || chr(10) || 'Description: ' || case when s_suppkey % 3 = 0 then 'No description' else 'of nation ' || s_nationkey end || chr(10) || 'Input Schema: {"type": "object", "n": ' || s_nationkey || '}' || chr(10) || case when s_suppkey % 2 = 0 then 'Output Schema: {}' || chr(10) else '' end as text from supplier""")
def tool_schema_text(t):
    said = F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("of nation "), "s_nationkey"))
    schema = F.concat(F.lit('{"type": "object", "n": '), "s_nationkey", F.lit("}"))
    return t.supplier.select("s_suppkey", T.tool_text(F.col("s_name"), said, schema, F.when(F.col("s_suppkey") % 2 == 0, "{}")).alias("text"))