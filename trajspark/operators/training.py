"""Training tables from conversations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import draw
from .steps import alternates, in_order, numbered, valid_prefix


def supervised(steps: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """One row for each answered input: instruction, output, and all earlier pairs as history.

    Steps after the first one out of turn are dropped; what was emitted before stays."""
    rows = numbered(steps.where("role <> 'system'"), key, order)
    rows = valid_prefix(rows, alternates(F.col("idx"), F.col("role")), key, "idx")
    w = in_order(key, "idx")
    pairs = rows.withColumn("instruction", F.lag("text").over(w)).where("idx % 2 = 1").withColumnRenamed("text", "output")
    before = Window.partitionBy(key).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return pairs.withColumn("history", F.collect_list(F.array("instruction", "output")).over(before)).select(key, order, "instruction", "output", "history")


def prompts(steps: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """One row for each user step: all messages up to it, as an array of (role, content)."""
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return steps.withColumn("prompt", F.collect_list(F.struct("role", F.coalesce("text", F.lit("")).alias("content"))).over(upto)).where("role = 'user'").select(key, order, "prompt")


def split(rows: DataFrame, ratio: float = 0.9, key: str = "conv_id", seed: int | None = None) -> DataFrame:
    """part 'train' for the first floor(n * ratio) keys, in key order or by a seeded hash.

    Ranks come from sorted ranges and the ranges' sizes, not from one window over all rows."""
    by = [F.col(key)] if seed is None else [F.xxhash64(F.col(key), F.lit(seed)), F.col(key)]
    keys = rows.select(key).distinct().withColumn("_at", by[0])
    n = keys.count()
    cut = math.floor(n * ratio)
    if not 0 < cut < n:
        return rows.withColumn("part", F.lit("train" if cut else "val"))
    edge = keys.orderBy(*by).offset(cut - 1).limit(1).select(F.col("_at").alias("_edge"), F.col(key).alias("_edge_key"))
    before = (F.col("_at") < F.col("_edge")) | ((F.col("_at") == F.col("_edge")) & (F.col(key) <= F.col("_edge_key")))
    return rows.withColumn("_at", by[0]).crossJoin(F.broadcast(edge)).withColumn("part", F.when(before, "train").otherwise("val")).drop("_at", "_edge", "_edge_key")


def shuffled(rows: DataFrame, seed: int, key: str) -> DataFrame:
    """A repeatable order by a keyed draw; keys are whole numbers, or hashed where they are not."""
    whole = rows.schema[key].dataType.typeName() in ("long", "integer", "short", "byte")
    return rows.orderBy(draw(F.lit(seed), F.col(key) if whole else F.xxhash64(key)), F.col(key))
