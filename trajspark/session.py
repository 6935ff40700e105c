"""Makes the package importable for Python workers of sessions started elsewhere."""

from __future__ import annotations

import functools
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the workers once for each application, unless they have it on their path."""
    if str(PACKAGE.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    context = spark.sparkContext
    if context.applicationId in _done:
        return
    at = tempfile.mkdtemp(prefix="ship-")
    shutil.copytree(PACKAGE, f"{at}/src/{PACKAGE.name}", ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(f"{at}/{PACKAGE.name}", "zip", f"{at}/src"))
    _done.add(context.applicationId)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def cut(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder that spark.checkpoint.dir names: its lineage ends there.

    On one machine without that setting a folder of our own is used; on a cluster that is an error."""
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        at = f"file://{tempfile.mkdtemp(prefix='cut-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    path, schema = f"{at.rstrip('/')}/cut-{uuid.uuid4().hex}", df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)
