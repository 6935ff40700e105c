"""The tool graph as tables: parameters, similarity edges, merging, audits, sampling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Vectors of one side that are held at a time; the other side streams past each block.
BLOCK = 4096


def similar_pairs(vectors: DataFrame, key: str, vector: str, over: float, scale: bool = True) -> DataFrame:
    """(a, b, cosine) for a < b with cosine strictly over the threshold; zero vectors have cosine 0.
    Without scale the plain product is taken.

    Blocks of bounded size meet once, each a matrix product; no pair leaves unless it passes."""
    n = vectors.count()
    blocks = max(1, -(-n // BLOCK))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    # block pair (i, j), i <= j: a row of block b goes to (b, *) and (*, b)
    sent = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})

    def pairs(pdf):
        import pandas as pd

        m = np.array(pdf["v"].tolist(), float).reshape(len(pdf), -1)
        norm = np.linalg.norm(m, axis=1) if scale else np.ones(len(m))
        m = m / np.where(norm == 0, 1, norm)[:, None]
        ids, block = pdf["id"].to_numpy(), pdf["block"].to_numpy()
        left, right = block == pdf["i"].iloc[0], block == pdf["j"].iloc[0]
        c = m[left] @ m[right].T
        x, y = np.nonzero(c > over)
        a, b, s = ids[left][x], ids[right][y], c[x, y]
        keep = a < b if pdf["i"].iloc[0] == pdf["j"].iloc[0] else a != b
        return pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "cosine": s[keep]})

    return sent.groupBy("i", "j").applyInPandas(pairs, "a long, b long, cosine double")


def weighted_pairs(vectors: DataFrame, key: str, name: str, said: str, over: float, weight: float = 0.6) -> DataFrame:
    """(a, b, cosine) where weight x the cosine of one vector + the rest x that of another is over the threshold.

    Unit vectors scaled by the roots of the weights and put end to end have that sum as their
    product, so the blocks of similar_pairs serve; a zero part counts as cosine 0."""
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))

    def scaled(column: str, share: float):
        c = F.col(column).cast("array<double>")
        by = F.coalesce(F.try_divide(F.lit(share**0.5), norm(c)), F.lit(0.0))
        return F.transform(c, lambda x: x * by)

    both = F.concat(scaled(name, weight), scaled(said, 1 - weight))
    return similar_pairs(vectors.select(key, both.alias("v")), key, "v", over, scale=False)


def similar_between(left: DataFrame, right: DataFrame, over: float | None, key: str = "id", vector: str = "v") -> DataFrame:
    """(a, b, cosine) of rows of left and right with cosine strictly over the threshold, or of all where it is None: the
    whole matrix.  A zero vector has cosine 0.  Blocks of left meet blocks of right once, each a matrix product."""
    sides = []
    for side, df in enumerate((left, right)):
        rows = df.select(F.col(key).cast("string").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        sides.append((rows, max(1, -(-rows.count() // BLOCK))))
    (a, n), (b, m) = sides
    block = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
    a = a.withColumns({"i": block(n), "j": F.explode(F.sequence(F.lit(0), F.lit(m - 1)))})
    b = b.withColumns({"j": block(m), "i": F.explode(F.sequence(F.lit(0), F.lit(n - 1)))})

    def unit(pdf):
        v = np.array(pdf["v"].tolist(), float).reshape(len(pdf), -1)
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        return v / np.where(norm == 0, 1, norm)

    def pairs(x, y):
        import pandas as pd

        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": [], "cosine": []})
        c = unit(x) @ unit(y).T
        p, q = np.nonzero(c > (-np.inf if over is None else over))
        return pd.DataFrame({"a": x["id"].to_numpy()[p], "b": y["id"].to_numpy()[q], "cosine": c[p, q]})

    return a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInPandas(pairs, "a string, b string, cosine double")


def similarity_links(outputs: DataFrame, inputs: DataFrame, over: float) -> DataFrame:
    """(src, dst, edge_type) of outputs(tool, param, v) and inputs(tool, param, v) of other tools whose
    cosine is over the threshold: from tool to tool and from parameter to parameter, each once."""
    close = similar_between(outputs.withColumnRenamed("param", "id"), inputs.withColumnRenamed("param", "id"), over)
    own = lambda df, end: df.select(F.col("param").cast("string").alias(end), F.col("tool").cast("string").alias(f"{end}_tool"))
    pairs = close.join(own(outputs, "a"), "a").join(own(inputs, "b"), "b").where("a_tool <> b_tool")
    both = F.array(F.struct(F.col("a_tool").alias("src"), F.col("b_tool").alias("dst"), F.lit("tool_to_tool").alias("edge_type")), F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("parameter_to_parameter").alias("edge_type")))
    return pairs.select(F.inline(both)).where("src <> dst").distinct()


def insert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """edges, and the new ones between ends that no edge joins yet in this direction."""
    return edges.unionByName(new.join(edges.select("src", "dst"), ["src", "dst"], "left_anti"), allowMissingColumns=True)


def redirected(edges: DataFrame, absorbed: DataFrame) -> DataFrame:
    """edges(src, dst, ...) with absorbed ids replaced by their representatives; edges of a node with
    itself go; of edges that fall together the one whose ends come last by id stays, as the last merge writes it."""
    rep = lambda end: absorbed.select(F.col("id").alias(end), F.col("representative").alias(f"_{end}"))
    moved = edges.join(rep("src"), "src", "left").join(rep("dst"), "dst", "left")
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    moved = moved.withColumns({"_to": F.coalesce("_dst", "dst"), "_from": F.coalesce("_src", "src")}).where("_from <> _to")
    last = moved.groupBy("_from", "_to").agg(F.max_by(F.struct(*rest), F.struct("dst", "src")).alias("_e")) if rest else moved.select("_from", "_to").distinct()
    return last.select(F.col("_from").alias("src"), F.col("_to").alias("dst"), *(F.col(f"_e.{c}").alias(c) for c in rest)).select(*edges.columns)


def admitted_edges(proposed: DataFrame, tools: DataFrame, edges: DataFrame) -> DataFrame:
    """Proposed edges (server, src, dst) between tools(tool, server) of one server, as tool_to_tool.

    A server whose proposal names a tool that it has not is refused whole; edges that are there stay as they are."""
    known = lambda end: tools.select(F.col("server"), F.col("tool").alias(end), F.lit(True).alias(f"_{end}"))
    marked = proposed.join(known("src"), ["server", "src"], "left").join(known("dst"), ["server", "dst"], "left")
    refused = marked.where("_src is null or _dst is null").select("server").distinct()
    good = marked.join(refused, "server", "left_anti").select("src", "dst").distinct()
    return insert_edges(edges, good.withColumn("edge_type", F.lit("tool_to_tool")))


def build_nodes(tools: DataFrame, params: DataFrame) -> DataFrame:
    """(id, node_type): tools(tool) and params(param_id), each once."""
    return tools.select(F.col("tool").cast("string").alias("id"), F.lit("tool").alias("node_type")).unionByName(params.select(F.col("param_id").cast("string").alias("id"), F.lit("parameter").alias("node_type"))).distinct()


def merged(pairs: DataFrame) -> DataFrame:
    """(id, representative) of absorbed nodes, greedy by id: the least unabsorbed node takes every
    later one it is paired with.  Not the transitive closure.

    In rounds: a node whose earlier partners are all absorbed is a representative; those it is
    paired with are absorbed; both leave.  Each round settles at least the least node of every
    connected part, and all parts at once."""
    left = cut(pairs.select("a", "b").distinct())
    done = None
    while left.limit(1).count():
        heads = left.select(F.col("a").alias("head")).distinct().join(left.select(F.col("b").alias("head")), "head", "left_anti")
        taken = cut(left.join(heads, left["a"] == heads["head"]).groupBy(F.col("b").alias("id")).agg(F.min("a").alias("representative")))
        done = taken if done is None else done.unionByName(taken)
        gone = taken.select("id").unionByName(taken.select(F.col("representative").alias("id")).distinct())
        left = cut(left.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti"))
    return done if done is not None else left.selectExpr("a id", "b representative")


def flatten_schema(tools: DataFrame, tool: str = "tool", schema: str = "schema") -> DataFrame:
    """(tool, name, dtype, required): an object or array of objects with properties gives p.child, two levels only."""
    child = "map<string, struct<type: string, properties: map<string, struct<type: string>>, items: struct<type: string, properties: map<string, struct<type: string>>>>>"
    parsed = F.from_json(schema, f"properties {child}, required array<string>")
    p = tools.withColumn("s", parsed).select(tool, F.col("s.required").alias("needed"), F.explode(F.map_entries("s.properties")).alias("p"))
    inner = F.coalesce(F.when(F.col("p.value.type") == "array", F.col("p.value.items.properties")), F.when(F.col("p.value.type") == "object", F.col("p.value.properties")))
    p = p.withColumn("inner", inner)
    flat = p.where("inner is null or size(inner) = 0").select(tool, "needed", F.col("p.key").alias("name"), F.coalesce("p.value.type", F.lit("unknown")).alias("dtype"))
    deep = p.where("size(inner) > 0").select(tool, "needed", F.col("p.key").alias("base"), F.explode(F.map_entries("inner")).alias("c")).select(tool, "needed", F.concat("base", F.lit("."), F.col("c.key")).alias("name"), F.coalesce("c.value.type", F.lit("unknown")).alias("dtype"))
    out = flat.unionByName(deep)
    return out.select(tool, "name", "dtype", F.coalesce(F.array_contains("needed", F.col("name")) | F.array_contains("needed", F.split_part("name", F.lit("."), F.lit(1))), F.lit(False)).alias("required"))


def patched(params: DataFrame, orphan: DataFrame, key: str, provided: str = "user_provided") -> DataFrame:
    """params with the orphans marked as provided by users."""
    marks = orphan.select(key).distinct().withColumn("_orphan", F.lit(True))
    return params.join(marks, key, "left").withColumn(provided, F.when(F.col("_orphan"), True).otherwise(F.col(provided))).select(*params.columns)


def valid_tools(inputs: DataFrame, provided: DataFrame, tools: DataFrame, user: str = "user_provided") -> DataFrame:
    """(tool, valid): users or some tool provide every input(tool, param, user); a tool without inputs is valid."""
    by = provided.select("param").distinct().withColumn("_by", F.lit(True))
    each = inputs.join(by, "param", "left").groupBy("tool").agg(F.every(F.coalesce(F.col(user), F.lit(False)) | F.coalesce("_by", F.lit(False))).alias("_ok"))
    return tools.select("tool").distinct().join(each, "tool", "left").select("tool", F.coalesce("_ok", F.lit(True)).alias("valid"))


def orphans(inputs: DataFrame, provided: DataFrame, user: Column, key: str) -> DataFrame:
    """Inputs that neither a user nor a tool provides; null is not provided."""
    return inputs.where(~F.coalesce(user, F.lit(False))).join(provided.select(key).distinct(), key, "left_anti")


def valid_chains(calls: DataFrame, needs: DataFrame, gives: DataFrame) -> DataFrame:
    """(chain, valid): every required input of the tool at a position is provided by users, or given by a tool before it.

    calls(chain, pos, tool), needs(tool, param) with user_provided and required where known (else false and true), gives(tool, param);
    an optional input never fails."""
    if "required" in needs.columns:
        needs = needs.where(F.coalesce("required", F.lit(False)))
    if "user_provided" in needs.columns:
        needs = needs.where(~F.coalesce("user_provided", F.lit(False)))
    needs = needs.select("tool", "param")
    first = calls.join(gives, "tool").groupBy("chain", "param").agg(F.min("pos").alias("at"))
    asked = calls.join(needs, "tool").join(first, ["chain", "param"], "left").groupBy("chain").agg(F.every(F.coalesce(F.col("at") < F.col("pos"), F.lit(False))).alias("ok"))
    return calls.select("chain").distinct().join(asked, "chain", "left").select("chain", F.coalesce("ok", F.lit(True)).alias("valid"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with both ends among nodes(id)."""
    return edges.join(nodes.selectExpr("id src"), "src", "left_semi").join(nodes.selectExpr("id dst"), "dst", "left_semi")


