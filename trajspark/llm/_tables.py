"""Tables cut from their lineage, and connected components over them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """The shared folder for cut tables: spark.checkpoint.dir; on one machine, a folder of our own if unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        at = f"file://{tempfile.mkdtemp(prefix='cut-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends at files every executor sees."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/cut-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes a cut table that nothing reads any more."""
    spark = df.sparkSession
    for at in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/cut-" in at:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def numbered(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """rows(key, text, ...) with row_id, a number of each row that no later scan changes and that ascends
    with the key: the key itself where it is one, else a number given once and written down."""
    size = rows.agg(F.count("*").alias("n"), F.count_distinct(key).alias("d")).first()
    if size["n"] == size["d"]:
        return rows.withColumn("row_id", F.col(key).cast("long"))
    return cut(rows.orderBy(F.col(key).asc_nulls_last(), F.xxhash64("text")).withColumn("row_id", F.monotonically_increasing_id()))


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], n: str) -> DataFrame:
    """left joined with right, which has each key once and, in column n, the number of its rows in left.

    Keys of more than a thousandth of these rows, at most 1000 of them, are broadcast; no other
    key can burden one task.  Column n is dropped."""
    right = cut(right)
    total = right.agg(F.sum(n)).first()[0] or 0
    often = F.col(n) * 1000 > total
    hot = right.where(often).drop(n)
    if not hot.limit(1).count():
        return left.join(right.drop(n), keys)
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return left.join(F.broadcast(hot), keys).unionByName(rest.join(right.where(~often).drop(n), keys))


def arrow_rows(spark: SparkSession) -> None:
    """Fewer rows to an Arrow batch than the default, for texts are long; the same for all operators."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): comp is the least node reachable, for every node of edges (u, v).

    Alternates large-star and small-star steps; both only take a minimum for each
    node, with map-side combining, and join it back, so that a node with very many
    neighbours is no group that one task must hold.
    """
    e = cut(edges.where("u <> v").selectExpr("greatest(u, v) u", "least(u, v) v").distinct())
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").selectExpr("v u", "m v").where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(low, "u")
        small = tied.selectExpr("u", "m v").union(tied.where("v <> m").selectExpr("v u", "m v")).distinct()
        after = cut(small)
        now = after.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(38, 0)))")).first()
        drop(e)
        e = after
        if now == before:
            return e.selectExpr("u node", "v comp").union(e.selectExpr("v node", "v comp")).distinct()
        before = now
