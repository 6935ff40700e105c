"""Conversations of turns of steps: metrics of turns, training rows, rendering.

Steps are rows (conv, node, idx, role, text, ...): the idx-th step of turn `node` of a conversation.
Turns are rows (conv, node, decision); a turn may have no steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .steps import alternates

TURN = ["conv", "node"]
#: Labels of the roles in a rendered conversation.
LABELS = {"user": "User", "assistant": "Assistant", "tool_call": "Tool Call", "tool_response": "Tool Response"}


def turn_metrics(steps: DataFrame, interaction: tuple[str, str] = ("assistant", "user")) -> DataFrame:
    """(conv, node, steps, tool_calls, user_interactions) of every turn with steps: raw steps, and pairs of neighbours."""
    after = F.lead("role").over(Window.partitionBy(*TURN).orderBy("idx"))
    pair = lambda a, b: F.count_if((F.col("role") == a) & (F.col("_after") == b))
    return steps.withColumn("_after", after).groupBy(*TURN).agg(F.count("*").alias("steps"), pair("tool_call", "tool_response").alias("tool_calls"), pair(*interaction).alias("user_interactions"))


def before_break(turns: DataFrame, ok: Column) -> DataFrame:
    """The turns before a conversation's first one that is not ok; null is not."""
    upto = Window.partitionBy("conv").orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return turns.withColumn("_ok", F.min(F.coalesce(ok, F.lit(False)).cast("int")).over(upto)).where("_ok = 1").drop("_ok")


def chain_stats(steps: DataFrame, turns: DataFrame, servers: DataFrame) -> DataFrame:
    """(metric, value, n): the six distributions of valid turns; servers(conv, server) gives the last.

    A turn's steps are its pairs, of both kinds.  A conversation without any does not count;
    turn_distribution holds the same totals as steps_per_conversation, as its makers have it."""
    known = before_break(turns.join(turn_metrics(steps), TURN, "left"), F.col("decision") & F.col("steps").isNotNull())
    known = known.withColumn("pairs", F.col("tool_calls") + F.col("user_interactions"))
    each = F.array(*(F.struct(F.lit(f"{m}_per_turn_distribution").alias("metric"), F.col(c).cast("string").alias("value")) for m, c in (("steps", "pairs"), ("tool_calls", "tool_calls"), ("user_interactions", "user_interactions"))))
    by_turn = known.select(F.inline(each))
    total = known.groupBy("conv").agg(F.sum("pairs").alias("pairs")).where("pairs > 0")
    whole = total.select(F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col("pairs").cast("string").alias("value")) for m in ("steps_per_conversation_distribution", "turn_distribution")))))
    by_server = servers.select("conv", "server").distinct().select(F.lit("mcp_server_distribution").alias("metric"), F.col("server").alias("value"))
    return by_turn.unionByName(whole).unionByName(by_server).groupBy("metric", "value").agg(F.count("*").alias("n"))


def conversation_metrics(metrics: DataFrame) -> DataFrame:
    """(conv, turns, steps, tool_calls, user_interactions) from metrics of turns; turns counts pairs of both kinds."""
    return metrics.groupBy("conv").agg(F.sum(F.col("tool_calls") + F.col("user_interactions")).alias("turns"), *(F.sum(c).alias(c) for c in ("steps", "tool_calls", "user_interactions")))


def analysis_summary(metrics: DataFrame, listed: DataFrame) -> DataFrame:
    """One row of totals and averages.  Averages by conversation divide by the rows of listed, readable or
    not; those by turn by the turns with steps; 0 where there are none."""
    names = ("steps", "tool_calls", "user_interactions")
    sums = conversation_metrics(metrics).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}") for c in ("turns", *names)))
    n = listed.agg(F.count("*").alias("total_conversations"))
    m = metrics.agg(F.count("*").alias("_turns"))
    over = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    one = sums.crossJoin(n).crossJoin(m)  # three rows of one
    return one.select("total_conversations", *(f"total_{c}" for c in ("turns", *names)), *(over(f"total_{c}", "total_conversations").alias(f"avg_{c}_per_conversation") for c in ("turns", *names)), *(over(f"total_{c}", "_turns").alias(f"avg_{c}_per_turn") for c in names))


def json_calls(calls: Column) -> Column:
    """Calls (name, arguments as JSON text) as the text of a step."""
    name = lambda c: F.regexp_extract(F.to_json(F.struct(c["name"].alias("n"))), r"(?s)^\{\"n\":(.*)\}$", 1)
    return F.array_join(F.transform(calls, lambda c: F.concat(F.lit('<tool_call>\n{"name": '), name(c), F.lit(', "arguments": '), c["arguments"], F.lit("}\n</tool_call>\n"))), "")


def json_responses(responses: Column) -> Column:
    return F.array_join(F.transform(responses, lambda r: F.concat(F.lit("<tool_response>\n"), r, F.lit("\n</tool_response>\n"))), "")


def step_text(role: Column, text: Column, calls: Column, responses: Column) -> Column:
    """The text of a step by its role; other roles are an error."""
    return F.when(role.isin("user", "assistant"), text).when(role == "tool_call", json_calls(calls)).when(role == "tool_response", json_responses(responses)).otherwise(F.raise_error(F.concat(F.lit("no such role: "), role)).cast("string"))


def think_prefix(present: Column, think: Column) -> Column:
    """What stands before an output that was thought about; a null thought prints as None."""
    return F.when(F.coalesce(present, F.lit(False)), F.concat(F.lit("<think>"), F.coalesce(think, F.lit("None")), F.lit("</think>\n\n"))).otherwise(F.lit(""))


def training_rows(steps: DataFrame, turns: DataFrame, think: bool = True) -> DataFrame:
    """(conv, node, idx, instruction, output, history) of conversations, whole:

    turns end with the first one that was not accepted, has no steps or breaks the alternation of
    roles (what came before stays); turns without calls are skipped; steps pair up, a last odd one is dropped; a pair typed
    REMOVE leaves no trace, others join the history, and only KEEP (or no type) without a failed call is a row.
    steps(conv, node, idx, role, text, type, think, think_present), text as step_text gives it."""
    shape = steps.groupBy(*TURN).agg(F.every(F.coalesce(alternates(F.col("idx"), F.col("role")), F.lit(False))).alias("_alternates"), F.count_if(F.col("role") == "tool_call").alias("_calls"))
    kept = before_break(turns.join(shape, TURN, "left"), F.col("decision") & F.col("_alternates")).where("_calls > 0").select(*TURN)
    w = Window.partitionBy(*TURN).orderBy("idx")
    ahead = lambda c, k: F.lead(c, k).over(w)
    says = F.coalesce(ahead("text", 2).contains("Fail") | ahead("text", 2).contains("Error"), F.lit(False))
    failed = (ahead("role", 1) == "tool_call") & F.coalesce(ahead("role", 2) == "tool_response", F.lit(False)) & says
    rows = steps.join(kept, TURN, "left_semi").withColumns({"_output": ahead("text", 1), "_role": ahead("role", 1), "_type": F.coalesce(ahead("type", 1), F.lit("KEEP")), "_think": ahead("think", 1), "_thought": ahead("think_present", 1), "_failed": failed})
    rows = rows.where("idx % 2 = 0 and _role is not null and _type <> 'REMOVE'")
    before = Window.partitionBy("conv").orderBy("node", "idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("history", F.collect_list(F.array("text", "_output")).over(before)).where("_type = 'KEEP' and not _failed")
    prefix = think_prefix(F.col("_thought"), F.col("_think")) if think else F.lit("")
    return rows.select("conv", "node", "idx", F.regexp_replace("text", r"^\s+|\s+$", "").alias("instruction"), F.concat(prefix, "_output").alias("output"), "history")


def rendered_conversation(steps: DataFrame, turns: DataFrame, at: int, history: bool = True) -> DataFrame:
    """(conv, conversation): the turns before `at` (if history) and turn `at` as text.

    turns(conv, node, tools): where turn `at` has no steps, the names of its target tools stand for it."""
    label = F.coalesce(*(F.when(F.col("role") == r, F.lit(x)) for r, x in LABELS.items()))
    line = F.when(label.isNotNull(), F.concat(F.lit("- "), label, F.lit(": "), F.coalesce("text", F.lit("None")), F.lit("\n")))
    said = steps.groupBy(*TURN).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", line.alias("line")))), lambda x: x["line"]), "").alias("said"))
    targets = F.array_join(F.transform(F.coalesce("tools", F.array().cast("array<string>")), lambda t, i: F.concat(F.lit("- Target Tool Name "), (i + 1).cast("string"), F.lit(": "), t, F.lit("\n"))), "")
    now = F.col("node") == at
    body = F.when(F.col("said").isNotNull(), F.concat("said", F.lit("\n"))).when(now, targets).otherwise(F.lit("\n"))
    part = F.concat(F.lit("[Turn "), (F.col("node") + 1).cast("string"), F.when(now, F.lit("] (Current)\n")).otherwise(F.lit("] (Previous)\n")), body)
    shown = turns.join(said, TURN, "left").where(now | (F.lit(history) & (F.col("node") < at)))
    return shown.groupBy("conv").agg(F.regexp_replace(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node", part.alias("part")))), lambda x: x["part"]), ""), r"^\s+|\s+$", "").alias("conversation"))
