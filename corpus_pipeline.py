"""A pipeline over `documents`: quality, repeated lines, near duplicates, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are
written to the shared folder and read again.  All stages but the last return the columns of
`documents`.  Stages accept nulls, empty texts, repeated rows, empty tables and extra columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.llm import decontamination, line_dedup, ngram_join, quality_classifier, sentencepiece_codec
from trajspark.llm._tables import cut

#: Ids up to which the rows to drop are broadcast (16 MB); more are joined by shuffle.
BROADCAST_IDS = 2_000_000
#: The column of row numbers within a stage.
ROW = "__row"


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with a number of each row, ascending with doc_id: the doc_id itself where that is a key."""
    size = docs.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("d")).first()
    if size["n"] == size["d"]:
        return docs.withColumn(ROW, F.col("doc_id").cast("long"))
    return cut(docs.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text")).withColumn(ROW, F.monotonically_increasing_id()))


def _texts(rows: DataFrame) -> DataFrame:
    """What operators read of numbered rows: the number as doc_id, and the text."""
    return rows.select(F.col(ROW).alias("doc_id"), "text")


def _without(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Numbered rows without those whose numbers are the doc_ids of found, and without numbers."""
    gone = cut(found.select(F.col("doc_id").alias("gone")).distinct())
    side = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return rows.join(side, rows[ROW] == side.gone, "left_anti").drop(ROW)


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, __rest): all other columns in one, so that their names meet none of an operator's."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others))) if others else F.lit(0)
    return docs.select("doc_id", "text", rest.alias("__rest"))


def _unpacked(rows: DataFrame, columns: list[str]) -> dict[str, F.Column]:
    """The columns of packed rows, by name."""
    others = [c for c in columns if c not in ("doc_id", "text")]
    return {"doc_id": F.col("doc_id"), "text": F.col("text")} | {c: F.col(f"__rest.c{i}").alias(c) for i, c in enumerate(others)}


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    out = quality_classifier.classify(_packed(docs)).where("keep")
    back = _unpacked(out, docs.columns)
    return out.select(*(back[c] for c in docs.columns))


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of line runs of 50 words and more; documents of which nothing is left go."""
    out = line_dedup.line_dedup(_packed(docs)).where("n_lines = 0 or n_removed < n_lines")
    back = _unpacked(out, docs.columns)
    if "n_chars" in back:
        back["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(back["n_chars"]).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*(back[c] for c in docs.columns))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five-word shingles, similarity 0.8) the row of the least doc_id stays."""
    rows = _numbered(docs)
    found = ngram_join.ngram_jaccard(_texts(rows), n_words=5, num=80, den=100)
    return _without(rows, found.where("component_id <> doc_id"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with passages of the benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = _numbered(docs)
    return _without(rows, decontamination.decontaminate(_texts(rows), items).where("contaminated"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether decoding them gives the text back."""
    out = sentencepiece_codec.encode(_packed(docs))
    same = F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), sentencepiece_codec.MARK, " ")
    back = _unpacked(out, docs.columns)
    rest = [back[c] for c in docs.columns if c.lower() not in ("text", "token_ids", "n_tokens", "round_trip")]
    return out.select(*rest, F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", same.alias("round_trip"))


STAGES = [("quality classifier", keep_good), ("line dedup", cut_repeated_lines), ("n-gram Jaccard join", keep_one_of_near_copies), ("benchmark decontamination", drop_leaks), ("sentencepiece", tokens)]

#: The classifier's training can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
