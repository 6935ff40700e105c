"""File trees as tables of (path, size): glob search, listing, tree roll-ups, differences."""

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob over the whole text: ** crosses folders, * and ? do not."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] in "*?":
            out, i = out + ("[^/]*" if glob[i] == "*" else "[^/]"), i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def matches(path: Column, glob: str) -> Column:
    return path.rlike(glob_pattern(glob))


def below(path: Column, folder: str) -> Column:
    """Whether a path lies below a folder; the root holds all."""
    return F.startswith(path, F.lit(folder.rstrip("/") + "/"))


def listing(files: DataFrame, folder: str) -> DataFrame:
    """(name, kind, n, size): what stands directly in a folder; a folder's size is that of all below."""
    depth = len([p for p in folder.split("/") if p])
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    here = files.where(below(F.col("path"), folder)).select(F.element_at(parts, depth + 1).alias("name"), F.when(F.size(parts) > depth + 1, "folder").otherwise("file").alias("kind"), "size")
    return here.groupBy("name", "kind").agg(F.count("*").alias("n"), F.sum("size").alias("size"))


def tree_sizes(files: DataFrame) -> DataFrame:
    """(folder, n, size) for every folder above a file, the root ('/') included."""
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    upto = F.transform(F.sequence(F.lit(0), F.size("parts") - 1), lambda k: F.concat(F.lit("/"), F.array_join(F.slice("parts", F.lit(1), k), "/")))
    return files.select(parts.alias("parts"), "size").where("size(parts) > 0").select(F.explode(upto).alias("folder"), "size").groupBy("folder").agg(F.count("*").alias("n"), F.sum("size").alias("size"))


def changed_lines(old: Column, new: Column) -> tuple[Column, Column]:
    """Lines of old that new lacks, and of new that old lacks, each once, in order."""
    a, b = (F.split(F.coalesce(t, F.lit("")), "\n") for t in (old, new))
    return F.array_except(a, b), F.array_except(b, a)


def unified_diff(rows: DataFrame, old: str, new: str, name: str = "path") -> DataFrame:
    """rows with diff: the unified difference of two texts (empty where equal); nulls are empty texts.

    Columns other than the two texts and the name are kept as they are."""

    @F.pandas_udf("string")
    def diff(a: pd.Series, b: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(difflib.unified_diff((x or "").splitlines(), (y or "").splitlines(), f"a/{p}", f"b/{p}", lineterm="")) for x, y, p in zip(a, b, at, strict=True)])

    return rows.withColumn("diff", diff(F.col(old), F.col(new), F.col(name)))
