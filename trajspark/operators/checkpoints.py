"""Checkpoints of environment generation: final states, histories, statistics, saving and resuming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import exists

STATES = ("idle", "schema_design", "tool_gen", "scenario_gen", "validate_scenarios", "revise", "completed", "failed")
ERROR = "struct<type: string, location: string, details: string, expected_vs_actual: string, root_cause: string, expected_error: boolean>"
RESULT = f"struct<scenario_id: string, passed: boolean, errors: array<{ERROR}>, tool_traces: variant, complexity_level: string, execution_time: double>"
REPORT = f"struct<total_scenarios: int, passed_scenarios: int, failed_scenarios: int, all_passed: boolean, scenario_results: array<{RESULT}>>"
REVISION = f"struct<revision_number: int, failed_scenario_ids: array<string>, aggregated_errors: variant, revised_code_version: int, validation_report: {REPORT}>"
CHECKPOINT = f"""metadata struct<class_name: string, metadata_path: string, checkpoint_version: string, last_updated: string, state: string>, schema variant,
  tool_code_history array<struct<version: int, code: string, timestamp: string, revision_number: int>>,
  scenarios array<struct<scenario_id: string, complexity_level: string, description: string, expected_behavior: string, scenario_data: variant>>,
  validation_results struct<initial: {REPORT}, final: {REPORT}>, revision_history array<{REVISION}>,
  statistics struct<total_revisions: int, total_time: double, success: boolean, error_message: string>, saved_paths map<string, string>"""
#: What a result of a generation run holds; revision_history holds the code of each revision.
RESULT_COLUMNS = ("class_name", "metadata_path", "state", "schema", "tool_code", "initial_tool_code", "scenarios", "initial", "final", "revisions", "total_revisions", "saved_paths", "success", "error_message", "total_time")


def finalized(results: DataFrame, total_time: Column) -> DataFrame:
    """results with success and state as the final validation (struct `final`) says, whatever they said before."""
    ok = F.coalesce(F.col("final.all_passed"), F.lit(False))
    return results.withColumns({"success": ok, "state": F.when(ok, "completed").otherwise("failed"), "total_time": total_time})


def code_history(initial: Column, revisions: Column, time: Column) -> Column:
    """The versions of the code, from the initial one and revisions (revision_number, revised_code).

    A revision that leaves the code as it is adds no version, but the last one then names it."""
    entry = lambda n, code, r: F.struct(n.cast("int").alias("version"), code.alias("code"), time.cast("string").alias("timestamp"), r.cast("int").alias("revision_number"))
    none = F.array().cast("array<struct<version: int, code: string, timestamp: string, revision_number: int>>")
    first = F.when(F.length(initial) > 0, F.array(entry(F.lit(0), initial, F.lit(None)))).otherwise(none)

    def step(done: Column, r: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        again = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(entry(last["version"], last["code"], r["revision_number"])))
        return F.when((F.size(done) > 0) & last["code"].eqNullSafe(r["revised_code"]), again).otherwise(F.concat(done, F.array(entry(F.size(done), r["revised_code"], r["revision_number"]))))

    return F.aggregate(F.coalesce(revisions, F.array().cast("array<struct<revision_number: int, revised_code: string>>")), first, step)


def checkpoint_of(results: DataFrame, time: Column, version: str = "1.0") -> DataFrame:
    """One checkpoint for each row of results (RESULT_COLUMNS; time as ISO text stamps it).

    revisions: array of (revision_number, failed_scenario_ids, aggregated_errors, revised_code, validation_report)."""
    codes = F.transform("revisions", lambda r: F.struct(r["revision_number"].cast("int").alias("revision_number"), r["revised_code"].alias("revised_code")))
    # without an initial code the final one stands for it
    first = F.when(F.length("initial_tool_code") > 0, F.col("initial_tool_code")).otherwise(F.col("tool_code"))
    revisions = F.transform("revisions", lambda r: F.struct(r["revision_number"].alias("revision_number"), r["failed_scenario_ids"].alias("failed_scenario_ids"), r["aggregated_errors"].alias("aggregated_errors"), r["revision_number"].alias("revised_code_version"), r["validation_report"].alias("validation_report")))
    return results.select(
        F.struct("class_name", "metadata_path", F.lit(version).alias("checkpoint_version"), time.cast("string").alias("last_updated"), "state").alias("metadata"), "schema",
        code_history(first, codes, time).alias("tool_code_history"), "scenarios", F.struct("initial", "final").alias("validation_results"), revisions.alias("revision_history"),
        F.struct("total_revisions", "total_time", "success", "error_message").alias("statistics"), "saved_paths")


def result_of(checkpoints: DataFrame) -> DataFrame:
    """Checkpoints back as results (RESULT_COLUMNS), for resuming: the code is the last version, a revision's
    code that of its version, empty where there is none; a missing state is idle."""
    code = lambda k: F.coalesce(F.try_element_at("tool_code_history", k + 1)["code"], F.lit(""))
    revisions = F.transform("revision_history", lambda r: F.struct(r["revision_number"].alias("revision_number"), r["failed_scenario_ids"].alias("failed_scenario_ids"), r["aggregated_errors"].alias("aggregated_errors"), code(F.coalesce(r["revised_code_version"], r["revision_number"])).alias("revised_code"), r["validation_report"].alias("validation_report")))
    return checkpoints.select(
        "metadata.class_name", "metadata.metadata_path", F.coalesce("metadata.state", F.lit("idle")).alias("state"), "schema", F.try_element_at("tool_code_history", F.lit(-1))["code"].alias("tool_code"),
        F.try_element_at("tool_code_history", F.lit(1))["code"].alias("initial_tool_code"), "scenarios", "validation_results.initial", "validation_results.final", revisions.alias("revisions"), F.coalesce("statistics.total_revisions", F.lit(0)).alias("total_revisions"), "saved_paths",
        F.coalesce("statistics.success", F.lit(False)).alias("success"), "statistics.error_message", F.coalesce("statistics.total_time", F.lit(0.0)).alias("total_time"))


def resume_stage(state: Column, has_code: Column) -> Column:
    """Where work on a checkpoint goes on: at scenarios, at validation, from the start, or nowhere (done)."""
    return F.when(state.isin("tool_gen", "scenario_gen"), "scenarios").when(state.isin("validate_scenarios", "revise", "failed"), "validation").when(state == "completed", "done").when(has_code, "scenarios").otherwise("start")


def save_checkpoints(checkpoints: DataFrame, folder: str) -> None:
    """One JSON document for each checkpoint, under the name of its class; the same class is overwritten."""
    rows = checkpoints.select(F.concat("metadata.class_name", F.lit("_checkpoint")).alias("_name"), F.to_json(F.struct(*checkpoints.columns)).alias("value"))
    spark = checkpoints.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode", "static")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        rows.write.mode("overwrite").partitionBy("_name").option("maxRecordsPerFile", 1).format("text").save(folder)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def load_checkpoints(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(checkpoints, (file, text) of documents that are none); missing folders give none."""
    if not exists(spark, folder):
        return spark.createDataFrame([], CHECKPOINT), spark.createDataFrame([], "file string, text string")
    text = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    parsed = text.withColumn("c", F.from_json("text", f"{CHECKPOINT}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    good = F.coalesce(F.col("c._corrupt").isNull() & (F.length("c.metadata.class_name") > 0), F.lit(False))
    return parsed.where(good).select("c.*").drop("_corrupt"), parsed.where(~good).select("file", "text")
