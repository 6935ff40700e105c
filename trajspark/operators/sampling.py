"""Chains sampled from a tool graph, and their turns: all seeds go a step at a time by joins.

Random draws are keyed hashes of (seed, step, id), so that results repeat anywhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import RANGE, draw
from ..session import cut


def split_turns(chain: DataFrame, most: int = 5, seed: int = 0, key: str = "chain", order: str = "pos") -> DataFrame:
    """chain with turn: a turn ends after a tool with probability (its length so far) / most, at most `most` tools long.

    Whether a turn ends depends on its length and a draw for the tool, so one pass over a chain's tools in order does."""
    tool = F.struct(F.col(order).alias("o"), draw(F.lit(seed), F.col(key), F.col(order)).alias("r"), F.struct(*chain.columns).alias("row"))
    kept = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in chain.schema.fields)
    zero = F.struct(F.lit(0).alias("turn"), F.lit(0).alias("length"), F.array().cast(f"array<struct<row: struct<{kept}>, turn: int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        length = s["length"] + 1
        ends = (length >= most) | (x["r"] * most < length.cast("long") * RANGE)
        out = F.concat(s["out"], F.array(F.struct(x["row"].alias("row"), s["turn"].alias("turn"))))
        return F.struct(F.when(ends, s["turn"] + 1).otherwise(s["turn"]).alias("turn"), F.when(ends, 0).otherwise(length).alias("length"), out.alias("out"))

    tools = chain.groupBy(key).agg(F.sort_array(F.collect_list(tool)).alias("_t"))
    return tools.select(F.inline(F.aggregate("_t", zero, step, lambda s: s["out"]))).select("row.*", "turn")


def random_successor(step: Column, front: DataFrame, edges: DataFrame) -> DataFrame:
    """The random-walk strategy: of each front row (seed, node, seen), one successor that was not seen, if there is any."""
    ahead = front.join(edges.selectExpr("src node", "dst"), "node").where(~F.array_contains("seen", F.col("dst")))
    return ahead.groupBy("seed").agg(F.min_by("dst", F.struct(draw(F.col("seed"), step, F.col("dst")), F.col("dst"))).alias("dst"))


def sample_chain(edges: DataFrame, tools: DataFrame, seeds: DataFrame, max_nodes: int = 10, sampler: Callable[[Column, DataFrame, DataFrame], DataFrame] = random_successor) -> DataFrame:
    """(seed, step, node): the chain of each of seeds(seed, start), breadth first, max_nodes long.

    Each round visits the node at the queue's head and queues what the sampler gives of its successors
    (edges(src, dst)); a sampler that gives none is followed by a random tool of the same server
    (tools(node, server)), which may have been visited before.  A sampler may be any function of
    (step, front(seed, node, seen), edges) to (seed, dst)."""
    ranked = tools.select("server", F.col("node").alias("other"), (F.row_number().over(Window.partitionBy("server").orderBy("node")) - 1).cast("long").alias("_nth"))
    sizes = tools.groupBy("server").agg(F.count("*").alias("_many"))
    homes = tools.select("node", "server").join(sizes, "server")
    now = seeds.select("seed", F.array("start").alias("queue"), F.array().cast(f"array<{seeds.schema['start'].dataType.simpleString()}>").alias("seen"))
    for k in range(max_nodes):
        step = F.lit(k + 1)
        front = now.where("size(queue) > 0").select("seed", F.col("queue")[0].alias("node"), F.slice("queue", F.lit(2), F.size("queue")).alias("queue"), F.concat("seen", F.array(F.col("queue")[0])).alias("seen"))
        front = cut(front)
        found = sampler(step, front.select("seed", "node", "seen"), edges).groupBy("seed").agg(F.array_sort(F.collect_list("dst")).alias("next"))
        rows = front.join(found, "seed", "left").join(homes, "node")
        rows = rows.withColumn("_nth", F.pmod(draw(F.col("seed"), step, F.lit(-1)), F.col("_many")))
        rows = rows.join(ranked, ["server", "_nth"])
        now = rows.select("seed", F.concat("queue", F.coalesce("next", F.array("other"))).alias("queue"), "seen")
    return now.select("seed", F.posexplode("seen").alias("step", "node")).select("seed", F.col("step").cast("long").alias("step"), "node")


def topology_sample(edges: DataFrame, inputs: DataFrame, gives: DataFrame, tools: DataFrame, seeds: DataFrame, max_nodes: int = 10, servers: int = 3, depth: int = 5, optional: float = 0.6, valid: float = 0.9) -> DataFrame:
    """(seed, step, node): chains in which tools that fill a node's inputs come before it.

    edges(src, dst) between tools, inputs(node, param, required, user_provided), gives(node, param), tools(node, server).
    Each round takes the queue's head.  Before it go its priors, level by level up to `depth`: for
    each input one provider, unless the input is optional and a draw is under `optional`, or users or visited nodes fill it already and
    a draw is under `valid`.  After it, a random number (1 to all) of successors that were not visited is queued.
    Once `servers` servers are visited, only their tools are chosen.  A chain stops at max_nodes visited nodes
    (priors may overshoot); without a successor a random tool of the same server is queued.

    All draws of a level look at what was visited before that level."""
    t = seeds.schema["start"].dataType.simpleString()
    none = F.array().cast(f"array<{t}>")
    homes = tools.select("node", "server")
    ranked = tools.select("server", F.col("node").alias("other"), (F.row_number().over(Window.partitionBy("server").orderBy("node")) - 1).cast("long").alias("_nth"))
    many = tools.groupBy("server").agg(F.count("*").alias("_many"))
    under = lambda share, *parts: draw(*parts) < int(share * RANGE)
    now = seeds.select("seed", F.array("start").alias("queue"), none.alias("seen"), F.array().cast("array<string>").alias("homes"))
    allowed = lambda rows: rows.join(homes, "node").where((F.size("homes") < servers) | F.array_contains("homes", F.col("server")))
    for k in range(max_nodes):
        going = F.expr(f"size(queue) > 0 and size(seen) < {max_nodes}")
        done = now.where(~going)
        front = cut(now.where(going).select("seed", F.col("queue")[0].alias("head"), F.slice("queue", F.lit(2), F.size("queue")).alias("queue"), "seen", "homes"))
        # priors of the head, of these, and so on: the deepest go first
        level, state = front.select("seed", F.col("head").alias("node"), "seen", "homes"), front.select("seed", "seen", "homes")
        found = None
        for d in range(depth):
            asked = level.join(inputs, "node")
            filled = asked.select("seed", "node", "param", F.explode("seen").alias("by")).join(gives.selectExpr("node by", "param"), ["by", "param"]).select("seed", "node", "param").distinct().withColumn("_filled", F.lit(True))
            asked = asked.join(filled, ["seed", "node", "param"], "left")
            spot = F.pmod(F.xxhash64("param"), F.lit(1 << 20))
            ok = F.coalesce("_filled", F.lit(False)) | F.coalesce("user_provided", F.lit(False))
            skip = (~F.coalesce("required", F.lit(False)) & under(optional, F.col("seed"), F.lit(k), F.lit(d), spot, F.lit(1))) | (ok & under(valid, F.col("seed"), F.lit(k), F.lit(d), spot, F.lit(2)))
            asked = asked.where(~skip).select("seed", F.col("node").alias("of"), "param", "seen", "homes")
            some = allowed(asked.join(gives, "param").where("node <> of"))
            pick = some.groupBy("seed", "of", "param").agg(F.min_by("node", F.struct(draw(F.col("seed"), F.lit(k), F.lit(d), F.col("node")), F.col("node"))).alias("node"), F.first("seen").alias("seen"))
            pick = cut(pick.where(~F.array_contains("seen", F.col("node"))).groupBy("seed").agg(F.array_sort(F.collect_set("node")).alias("priors")))
            found = pick.withColumn("_d", F.lit(d)) if found is None else found.unionByName(pick.withColumn("_d", F.lit(d)))
            if not pick.limit(1).count():
                break
            new = pick.select("seed", F.explode("priors").alias("node")).join(homes, "node").groupBy("seed").agg(F.collect_list("node").alias("n"), F.collect_set("server").alias("h"))
            state = state.join(new, "seed", "left").select("seed", F.array_union("seen", F.coalesce("n", none)).alias("seen"), F.array_union("homes", F.coalesce("h", F.array().cast("array<string>"))).alias("homes"))
            level = pick.select("seed", F.explode("priors").alias("node")).join(state, "seed")
        before = found.groupBy("seed").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("_d")).alias("o"), "priors"))), lambda x: x["priors"])).alias("before"))
        rows = front.join(before, "seed", "left").join(homes.withColumnRenamed("node", "head"), "head")
        rows = rows.withColumn("seen", F.concat(F.array_distinct(F.concat("seen", F.array_except(F.coalesce("before", none), "seen"))), F.array("head")))
        visited = rows.select("seed", F.explode("seen").alias("node")).join(homes, "node").groupBy("seed").agg(F.collect_set("server").alias("homes"))
        rows = cut(rows.select("seed", "head", "queue", "seen", "server").join(visited, "seed"))
        ahead = rows.select("seed", "head", "seen", "homes").join(edges.selectExpr("src head", "dst node"), "head").where(~F.array_contains("seen", F.col("node")))
        ahead = allowed(ahead).select("seed", "node", draw(F.col("seed"), F.lit(k), F.lit(-2), F.col("node")).alias("_r"))
        ahead = ahead.groupBy("seed").agg(F.transform(F.sort_array(F.collect_set(F.struct("_r", "node"))), lambda x: x["node"]).alias("all"))
        taken = F.slice("all", F.lit(1), (F.pmod(draw(F.col("seed"), F.lit(k), F.lit(-3)), F.size("all")) + 1).cast("int"))
        rows = rows.join(ahead.select("seed", taken.alias("next")), "seed", "left").join(many, "server")
        rows = rows.withColumn("_nth", F.pmod(draw(F.col("seed"), F.lit(k), F.lit(-1)), F.col("_many"))).join(ranked, ["server", "_nth"])
        now = done.unionByName(rows.select("seed", F.concat("queue", F.coalesce("next", F.array("other"))).alias("queue"), "seen", "homes"))
    return now.select("seed", F.posexplode("seen").alias("step", "node")).select("seed", F.col("step").cast("long").alias("step"), "node")
