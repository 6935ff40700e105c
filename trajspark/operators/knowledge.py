"""A knowledge graph as two tables: entities(name, kind, observations) and relations(source, target, kind).

All operators return new versions of the tables; nothing is changed in place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import contains_any


def add_entities(entities: DataFrame, new: DataFrame) -> DataFrame:
    """New names join; names that are there, and later repeats inside new, change nothing.

    Of repeats inside new the least row by (kind, observations) is taken."""
    one = new.groupBy("name").agg(F.min(F.struct("kind", "observations")).alias("x")).select("name", "x.kind", "x.observations")
    return entities.unionByName(one.join(entities.select("name"), "name", "left_anti"))


def add_relations(relations: DataFrame, new: DataFrame) -> DataFrame:
    """The set union of (source, target, kind); nulls equal nulls."""
    return relations.unionByName(new).distinct()


def add_observations(entities: DataFrame, new: DataFrame) -> DataFrame:
    """Appends observations(name, observation, ord) that the entity has not yet; repeats inside one batch are kept.

    Names that are no entity are ignored."""
    known = entities.select("name", F.coalesce("observations", F.array().cast("array<string>")).alias("had"))
    fresh = new.join(known, "name").where(~F.array_contains("had", F.col("observation")))
    more = fresh.groupBy("name").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "observation"))), lambda x: x["observation"]).alias("more"))
    joined = entities.join(more, "name", "left")
    return joined.withColumn("observations", F.when(F.col("more").isNull(), F.col("observations")).otherwise(F.concat(F.coalesce("observations", F.array().cast("array<string>")), "more"))).select(*entities.columns)


def delete_entities(entities: DataFrame, relations: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without names(name) and without the relations that touch them."""
    gone = names.select("name").distinct()
    left = relations.join(gone.withColumnRenamed("name", "source"), "source", "left_anti")
    return entities.join(gone, "name", "left_anti"), left.join(gone.withColumnRenamed("name", "target"), "target", "left_anti").select(*relations.columns)


def search_nodes(entities: DataFrame, relations: DataFrame, query: str) -> tuple[DataFrame, DataFrame]:
    """Entities whose name, kind or an observation holds the query (case-insensitive), and the
    relations that have at least one such end."""
    said = F.exists(F.coalesce("observations", F.array().cast("array<string>")), lambda o: F.contains(F.lower(o), F.lit(query.lower())))
    hits = entities.where(contains_any(query, "name", "kind") | F.coalesce(said, F.lit(False)))
    names = hits.select("name").distinct()
    marked = relations.join(names.selectExpr("name source", "true s"), "source", "left").join(names.selectExpr("name target", "true t"), "target", "left")
    return hits, marked.where("s or t").select(*relations.columns)


def open_nodes(entities: DataFrame, relations: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """The named entities, and the relations that have both ends among them."""
    hits = entities.where(F.col("name").isin(*names)) if names else entities.limit(0)
    ends = hits.select("name").distinct()
    sides = [ends.withColumnRenamed("name", side) for side in ("source", "target")]
    return hits, reduce(lambda r, e: r.join(e, e.columns[0], "left_semi"), sides, relations).select(*relations.columns)
