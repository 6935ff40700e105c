"""Tools, servers and parameters as tables: admission, visibility, edges, texts for embeddings, turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Calls that manage a server's state and are never offered to an assistant.
STATE_TOOLS = ("load_scenario", "save_scenario")


def admitted(calls: Column, servers: Column, scenario: Column) -> Column:
    """At least one call, and every server is a key of the scenario map.

    True for no servers; null servers, a null map or no calls are not admitted, unless servers is empty."""
    all_there = F.forall(servers, lambda s: F.coalesce(F.map_contains_key(scenario, s), F.lit(False)))
    return (F.coalesce(F.size(calls), F.lit(0)) > 0) & F.coalesce(all_there, F.lit(False))


def visible_tools(tools: DataFrame, servers: list[str] | None = None) -> DataFrame:
    """Tools(tool, server) of the servers, without the state tools; None returns all, with them."""
    if servers is None:
        return tools
    return tools.where(F.col("server").isin(*servers) & ~F.element_at(F.split("tool", "-"), -1).isin(*STATE_TOOLS))


def assistant_tools(tools: DataFrame, user_tools: DataFrame) -> DataFrame:
    """Tools that are not among the user's."""
    return tools.join(user_tools.select("tool").distinct(), "tool", "left_anti")


def io_edges(params: DataFrame) -> DataFrame:
    """(src, dst, edge_type, required) of params(tool, param_id, direction, required): inputs lead to their tool, a tool to its outputs."""
    inputs = params.where("direction = 'input'").select(F.col("param_id").alias("src"), F.col("tool").alias("dst"), F.lit("parameter_to_tool").alias("edge_type"), F.coalesce("required", F.lit(False)).alias("required"))
    outputs = params.where("direction = 'output'").select(F.col("tool").alias("src"), F.col("param_id").alias("dst"), F.lit("tool_to_parameter").alias("edge_type"), F.lit(False).alias("required"))
    return inputs.unionByName(outputs).distinct()


def embed_texts(params: DataFrame) -> DataFrame:
    """The texts to embed: name with type, description (null where blank, for a zero vector), and both in one."""
    name = F.concat("name", F.lit(" ("), F.coalesce("dtype", F.lit("unknown")), F.lit(")"))
    said = F.coalesce("description", F.lit(""))
    return params.withColumns({"name_text": name, "desc_text": F.when(F.trim(said) != "", said), "full_text": F.concat(name, F.lit(": "), said)})


def weighted_similarity(name: Column, desc: Column, weight: float = 0.6) -> Column:
    """weight x the names' cosine + the rest x the descriptions'."""
    return weight * name + (1 - weight) * desc


def providers(inputs: DataFrame, outputs: DataFrame, related: DataFrame) -> DataFrame:
    """(param, tool): the tools that can fill an input, by an output of their own that is the input, or is related to it.

    inputs(param), outputs(tool, param), related(src, dst) between parameters."""
    same = inputs.select("param").join(outputs, "param").select("param", "tool")
    by = related.join(outputs.withColumnRenamed("param", "src"), "src").select(F.col("dst").alias("param"), "tool")
    return same.unionByName(by.join(inputs.select("param"), "param", "left_semi").select("param", "tool")).distinct()


def fillable(inputs: DataFrame, provided: DataFrame, user: str = "user_provided") -> DataFrame:
    """inputs with fillable: the user provides it or some tool does; null is not provided."""
    some = provided.select("param").distinct().withColumn("_by_tool", F.lit(True))
    return inputs.join(some, "param", "left").withColumn("fillable", F.coalesce(user, F.lit(False)) | F.coalesce("_by_tool", F.lit(False))).drop("_by_tool")
