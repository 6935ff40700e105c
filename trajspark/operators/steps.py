"""Step-level operators over conversations: one row per step, ordered within its conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Roles that a step may have at even and at odd positions of a turn.
EVEN_ROLES, ODD_ROLES = ("user", "tool_response"), ("assistant", "tool_call")


def in_order(key: str, order: str):
    return Window.partitionBy(key).orderBy(order)


def pair_count(steps: DataFrame, first: str, second: str, key: str = "conv_id", order: str = "turn", name: str = "pairs") -> DataFrame:
    """Adjacent (first, second) role pairs of each conversation; equal to a greedy scan, as the roles differ."""
    return pair_counts(steps, {name: (first, second)}, key, order)


def pair_counts(steps: DataFrame, pairs: dict[str, tuple[str, str]], key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Counts of several kinds of adjacent pairs by name, in one pass."""
    after = F.lead("role").over(in_order(key, order))
    return steps.withColumn("_after", after).groupBy(key).agg(*(F.count_if((F.col("role") == a) & (F.col("_after") == b)).alias(name) for name, (a, b) in pairs.items()))


def valid_prefix(steps: DataFrame, valid: Column, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """The steps before the first invalid one: a break, not a filter.  Null counts as invalid."""
    window = in_order(key, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ok = F.min(F.coalesce(valid, F.lit(False)).cast("int")).over(window)
    return steps.withColumn("_ok", ok).where("_ok = 1").drop("_ok")


def alternates(position: Column, role: Column) -> Column:
    """Whether a role may stand at a 0-based position."""
    return F.when(position % 2 == 0, role.isin(*EVEN_ROLES)).otherwise(role.isin(*ODD_ROLES))


def numbered(steps: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    return steps.withColumn("idx", (F.row_number().over(in_order(key, order)) - 1).cast("long"))


def failed_call(steps: DataFrame, words: tuple[str, ...] = ("Fail", "Error"), key: str = "conv_id", order: str = "turn", call: str = "tool_call", response: str = "tool_response") -> DataFrame:
    """Marks calls whose next step is a response that holds one of the words (case-sensitive)."""
    w = in_order(key, order)
    says = F.lit(False)
    for x in words:
        says = says | F.lead("text").over(w).contains(x)
    return steps.withColumn("failed", F.coalesce((F.col("role") == call) & (F.lead("role").over(w) == response) & says, F.lit(False)))


def step_flags(steps: DataFrame, kind: str = "type") -> DataFrame:
    """emit and in_history of a step type: missing is KEEP; REMOVE gives neither, others history only."""
    t = F.coalesce(F.col(kind), F.lit("KEEP"))
    return steps.withColumn("in_history", t != "REMOVE").withColumn("emit", t == "KEEP")


def keep_conversations(steps: DataFrame, valid: Column, at_least: int = 2, key: str = "conv_id") -> DataFrame:
    """Steps of conversations with enough valid turns."""
    enough = steps.groupBy(key).agg(F.count_if(F.coalesce(valid, F.lit(False))).alias("_n")).where(F.col("_n") >= at_least).select(key)
    return steps.join(enough, key, "left_semi")


def rendered(steps: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """One text for each conversation: "role: text" lines in order."""
    line = F.concat("role", F.lit(": "), F.coalesce("text", F.lit("")))
    return steps.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x["line"]), "\n").alias("rendered"))


def trace_filter(steps: DataFrame, **selected) -> DataFrame:
    """Equality filters in which 'All' lets everything pass."""
    for column, value in selected.items():
        if value != "All":
            steps = steps.where(F.col(column) == value)
    return steps
