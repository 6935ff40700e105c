"""Counts, distributions and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distribution(rows: DataFrame, value: str, metric: str | None = None) -> DataFrame:
    """(metric, value, n) of the positive values."""
    out = rows.where(F.col(value) > 0).groupBy(F.col(value).cast("long").alias("value")).agg(F.count("*").alias("n"))
    return out.select(F.lit(metric or value).alias("metric"), "value", "n")


def weighted(dist: DataFrame, value: str = "value", weight: str = "n") -> DataFrame:
    """Mean and median of values repeated by weight; 0 and 0 when empty."""
    return dist.agg(F.coalesce(F.sum(F.col(value) * F.col(weight)) / F.sum(weight), F.lit(0.0)).cast("double").alias("mean"), F.coalesce(F.percentile(value, 0.5, F.col(weight)), F.lit(0.0)).alias("median"))


def by_length(rows: DataFrame, length: str, accuracy: str) -> DataFrame:
    """Mean, median, sample deviation and count of accuracy for each length."""
    known = rows.where(F.col(accuracy).isNotNull() & ~F.isnan(accuracy))
    return known.groupBy(length).agg(F.avg(accuracy).alias("mean"), F.median(accuracy).alias("median"), F.stddev_samp(accuracy).alias("std"), F.count("*").alias("n"))


def domain_rollup(rows: DataFrame, domain: str, child: str) -> DataFrame:
    """Counts of children, of domains, and in all; level says which."""
    return rows.rollup(domain, child).agg(F.count("*").alias("n"), (2 - F.bit_count(F.grouping_id())).cast("long").alias("level"))


def severity(kind: Column, details: Column) -> Column:
    """critical by the type of the error, else high, medium or low by its details."""
    said = F.lower(F.coalesce(details, F.lit("")))
    return F.when(kind.isin("Load Scenario Error", "Schema Validation Error"), "critical").when(F.contains(said, F.lit("multiple")), "high").when(F.contains(said, F.lit("single")), "medium").otherwise("low")


def errors(rows: DataFrame) -> DataFrame:
    """(type, location, n, scenarios): how often a pattern of errors(scenario, type, location, details)
    occurs and in which scenarios, repeats included."""
    return rows.groupBy("type", "location").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("scenario")), ",").alias("scenarios"))


def severity_summary(rows: DataFrame) -> DataFrame:
    """(severity, n) for all four severities, also those that no error has."""
    found = rows.groupBy(severity(F.col("type"), F.col("details")).alias("severity")).agg(F.count("*").alias("found"))
    all_ = rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, ("critical", "high", "medium", "low")))).alias("severity"))
    return all_.join(F.broadcast(found), "severity", "left").select("severity", F.coalesce("found", F.lit(0)).cast("long").alias("n"))


def failed_ids(rows: DataFrame, passed: str, key: str) -> DataFrame:
    """The quick form: the ids of what did not pass."""
    return scenarios(rows, passed, False).select(key)


def scenarios(rows: DataFrame, passed: str, wanted: bool = True) -> DataFrame:
    """The rows that passed, or those that did not; null did not."""
    ok = F.coalesce(F.col(passed), F.lit(False))
    return rows.where(ok if wanted else ~ok)


def known(rows: DataFrame, value: str) -> DataFrame:
    """Rows whose value is a number: neither null nor NaN."""
    return rows.where(F.col(value).isNotNull() & ~F.isnan(value))


def by_provided(params: DataFrame, key: str, name: str = "name", provided: str = "user_provided", order: str = "ord") -> DataFrame:
    """(key, providable, others): the names of parameters that users provide and of the others, in order; null is not provided."""
    named = lambda on: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.coalesce(F.col(provided), F.lit(False)) == on, F.struct(order, name)))), lambda x: x[name]), ", ")
    return params.groupBy(key).agg(named(True).alias("providable"), named(False).alias("others"))


def report(rows: DataFrame, passed: str) -> DataFrame:
    """total, passed, failed, all_passed; an empty table has all passed."""
    ok = F.coalesce(F.col(passed), F.lit(False))
    return rows.agg(F.count("*").alias("total"), F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"), F.coalesce(F.every(ok), F.lit(True)).alias("all_passed"))


def pass_at_k(rows: DataFrame, key: str, decision: str, k: int) -> DataFrame:
    """Truthy decisions over the configured k, not over the number of traces."""
    return rows.groupBy(key).agg((F.count_if(F.coalesce(F.col(decision), F.lit(False))) / F.lit(float(k))).alias("accuracy"))
