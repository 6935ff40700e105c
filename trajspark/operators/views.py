"""The read queries of the viewers: lists by page, one conversation, one turn, traces, analysis, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Conversations that a list shows at most: a feature of the viewer.
MOST = 100


def in_folders(index: DataFrame, chosen: list[str] | None, folder: str = "folder") -> DataFrame:
    """Rows of the chosen folders; 'All' lets everything pass, nothing chosen lets nothing."""
    if chosen and "All" in chosen:
        return index
    return index.where(F.col(folder).isin(*chosen)) if chosen else index.limit(0)


def newest(index: DataFrame, most: int | None = MOST, modified: str = "modified", key: str = "id") -> DataFrame:
    """The newest entries first, `most` of them at most; ties by id."""
    rows = index.orderBy(F.desc(modified), key)
    return rows.limit(most) if most else rows


def listed(index: DataFrame, number: int, size: int, modified: str = "modified", key: str = "id", most: int | None = MOST) -> DataFrame:
    """A 1-based page of the list, with page, per_page, total and total_pages."""
    rows = newest(index, most, modified, key)
    total = rows.agg(F.count("*").alias("total"))
    shown = rows.offset(max(0, (number - 1) * size)).limit(size)
    return shown.crossJoin(F.broadcast(total)).withColumns({"page": F.lit(number).cast("long"), "per_page": F.lit(size).cast("long"), "total_pages": F.ceil(F.col("total") / size).cast("long")})


def conversation(items: DataFrame, wanted: str | int, key: str = "conv", turn: str = "node", agent: str = "agent") -> DataFrame:
    """(key, turn_indices, agent_roles, n_items) of one conversation; no row where there is none."""
    return items.where(F.col(key) == wanted).groupBy(key).agg(F.sort_array(F.collect_set(turn)).alias("turn_indices"), F.sort_array(F.collect_set(agent)).alias("agent_roles"), F.count("*").alias("n_items"))


def one_turn(items: DataFrame, wanted: str | int, at: int, key: str = "conv", turn: str = "node") -> DataFrame:
    """The items of one turn of a conversation."""
    return items.where((F.col(key) == wanted) & (F.col(turn) == at))


def traces(items: DataFrame, conversation: str | int = "All", agent: str = "All", at: str | int = "All", key: str = "conv", turn: str = "node", role: str = "agent") -> DataFrame:
    """Items by conversation, agent and turn, each 'All' for any; a turn that is no number gives nothing.
    Levels that lose all their items have no rows, and so are gone."""
    if conversation != "All":
        items = items.where(F.col(key) == conversation)
    if agent != "All":
        items = items.where(F.col(role) == agent)
    if at != "All":
        text = str(at).strip()
        items = items.where(F.col(turn) == int(text)) if text.lstrip("+-").isdigit() else items.limit(0)
    return items


def shown(items: DataFrame, index: DataFrame, conversation: str | int = "All", agent: str = "All", at: str | int = "All", key: str = "conv") -> DataFrame:
    """What the trace page shows: the chosen conversation, or the list's first one where none or an unknown one is chosen."""
    first = newest(index).limit(1).select(F.col("id").alias(key))
    if conversation != "All":
        known = newest(index).where(F.col("id").cast("string") == str(conversation)).select(F.col("id").alias(key))
        first = known.withColumn("_rank", F.lit(0)).unionByName(first.withColumn("_rank", F.lit(1))).orderBy("_rank").limit(1).drop("_rank")
    return traces(items, "All", agent, at, key).join(F.broadcast(first), key, "left_semi")


def samples(rows: DataFrame, number: int, size: int, order: str) -> DataFrame:
    """A page of training samples, thought and answer apart."""
    from ..functions.text import split_think

    think, answer = split_think(F.col("output"))
    total = rows.agg(F.count("*").alias("total"))
    return rows.withColumns({"think": think, "answer": answer}).orderBy(order).offset(max(0, (number - 1) * size)).limit(size).crossJoin(F.broadcast(total))
