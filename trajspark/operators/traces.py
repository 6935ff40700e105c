"""Logs, traces and annotated trajectories as tables of messages and steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fields of a log message, in the order in which the first present one is shown.
MESSAGE_FIELDS = ("user", "assistant_think", "assistant", "system")


def is_turn(key: Column) -> Column:
    """Whether a log key names a turn: digits only."""
    return F.coalesce(key.rlike("^[0-9]+$"), F.lit(False))


def normalised_turns(log: DataFrame, key: str = "key", messages: str = "messages") -> DataFrame:
    """(turn, position, message) for each message under a key that names a turn; other keys are dropped.

    messages is JSON text: an array gives its items, an object counts as its only item, others give nothing."""
    m = F.trim(F.col(messages))
    items = F.when(F.startswith(m, F.lit("{")), F.array(m)).when(F.startswith(m, F.lit("[")), F.transform(F.from_json(m, "array<variant>"), lambda v: F.to_json(v)))
    rest = [c for c in log.columns if c not in (key, messages)]
    return log.where(is_turn(F.col(key))).select(*rest, F.col(key).cast("long").alias("turn"), F.posexplode(items).alias("position", "message"))


def shown_message(message: Column) -> tuple[Column, Column]:
    """The first field present in a JSON message, and its content (of a list, the first item)."""
    text = [(f, F.coalesce(F.get_json_object(message, f"$.{f}[0]"), F.get_json_object(message, f"$.{f}"))) for f in MESSAGE_FIELDS]
    return F.coalesce(*(F.when(t.isNotNull(), F.lit(f)) for f, t in text)), F.coalesce(*(t for _, t in text))


def grouped_log(entries: DataFrame, key: str = "conv_id", turn: str = "turn", order: str = "ord", message: str = "message") -> DataFrame:
    """One row for each conversation and turn: its messages in order."""
    at = F.transform(F.sort_array(F.collect_list(F.struct(order, message))), lambda x: x[message])
    return entries.groupBy(key, turn).agg(at.alias("messages"))


def merged_log(old: DataFrame, new: DataFrame, key: str = "key", value: str = "items") -> DataFrame:
    """Log arrays merged by key: old items, then new ones; keys of either side stay."""
    none = F.array().cast(old.schema[value].dataType)
    both = old.withColumnRenamed(value, "_old").join(new.select(key, F.col(value).alias("_new")), key, "full")
    return both.select(key, F.concat(F.coalesce("_old", none), F.coalesce("_new", none)).alias(value))


def classified(steps: DataFrame, labels: DataFrame, key: str = "conv_id", order: str = "idx", kind: str = "type") -> DataFrame:
    """steps with the type of labels(key, order, role, type); a label counts only where the role agrees.

    Of several labels for one step the greatest type is taken; a step without one keeps its own, if it has any."""
    said = labels.groupBy(key, order, "role").agg(F.max(kind).alias("_said"))
    own = F.col(kind) if kind in steps.columns else F.lit(None).cast("string")
    return steps.join(said, [key, order, "role"], "left").withColumn(kind, F.coalesce("_said", own)).drop("_said")


def kept_steps(steps: DataFrame, chosen: DataFrame, key: str = "conv_id", order: str = "idx") -> DataFrame:
    """The first step, the chosen ones (key, order), and after a chosen step the response or user step that follows."""
    w = Window.partitionBy(key).orderBy(order)
    marked = steps.join(chosen.select(key, order).distinct().withColumn("_on", F.lit(True)), [key, order], "left").withColumn("_on", F.coalesce("_on", F.lit(False)))
    marked = marked.withColumns({"_first": F.row_number().over(w) == 1, "_after": F.coalesce(F.lag("_on").over(w), F.lit(False))})
    follows = F.col("_after") & F.col("role").isin("tool_response", "user")
    return marked.where(F.col("_first") | F.col("_on") | follows).select(*steps.columns)


def turns_with(steps: DataFrame, role: str = "tool_call", keys: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """The steps of those turns that hold a step of the role; the others are skipped, not a break."""
    held = steps.where(F.col("role") == role).select(*keys).distinct()
    return steps.join(held, list(keys), "left_semi")


def solutions(traces: DataFrame, decision: str = "decision") -> DataFrame:
    """Traces whose decision is true; null is not."""
    return traces.where(F.coalesce(F.col(decision), F.lit(False)))


def first_scenario(scenarios: DataFrame, level: str, by: str = "complexity_level", order: str = "scenario_id") -> DataFrame:
    """The first scenario of a complexity level, or no row."""
    return scenarios.where(F.col(by) == level).orderBy(order).limit(1)


def servers_only(scenario: Column, servers: list[str]) -> Column:
    """A scenario map cut to the servers."""
    return F.map_filter(scenario, lambda k, _: k.isin(*servers) if servers else F.lit(False))
