"""Readers and writers for nested JSON, logs, registries, graphs and samples."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A conversation file; open parts stay JSON (variant).
STEP = "role: string, content: variant, think: string, type: string"
CHAIN = f"""seed bigint, scenario string, user_profile variant, user_tools array<struct<name: string, description: string>>, nodes array<struct<initial_scenario: variant, final_scenario: variant,
  steps: array<struct<{STEP}>>, query: string, decision: boolean, accuracy: double, pass_k_trace: variant, pass_k_scenario: variant, pass_k_decision: map<string, boolean>, mcp_servers: array<string>>>"""
#: A registry entry, and a training sample.
REGISTRY = "mcpServers map<string, struct<tool_path: string, stateless: boolean>>"
SAMPLE = "instruction string, input string, output string, system string, history array<array<string>>"
#: A line of the token-usage log.
USAGE = "timestamp string, model string, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint, agent_name string"


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _path(spark, path)
    return fs.exists(at)


def directories(spark: SparkSession, base: str, prefix: str) -> list[str]:
    """The names of the folders in base that begin with prefix, sorted; none where base is missing."""
    fs, at = _path(spark, base)
    if not fs.exists(at):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory() and s.getPath().getName().startswith(prefix))


def _documents(spark: SparkSession, paths: list[str] | str, schema: StructType | str, pattern: str = "*") -> DataFrame:
    """(_file, value, _doc, _good): whole files as text, and parsed under a schema."""
    text = spark.read.option("pathGlobFilter", pattern).text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("_file"), "value")
    if isinstance(schema, StructType):
        parsed = text.withColumn("_doc", F.from_json("value", StructType([*schema.fields]).add("_corrupt", "string"), {"columnNameOfCorruptRecord": "_corrupt"}))
        good = F.col("_doc").isNotNull() & F.col("_doc._corrupt").isNull() & F.trim("value").startswith("{")
        return parsed.withColumns({"_good": F.coalesce(good, F.lit(False)), "_doc": F.col("_doc").dropFields("_corrupt")})
    parsed = text.withColumn("_doc", F.from_json("value", schema))
    return parsed.withColumn("_good", F.col("_doc").isNotNull())


def scan_chains(spark: SparkSession, folders: list[str], schema: StructType | str = CHAIN, max_num: int | None = None) -> tuple[DataFrame, DataFrame]:
    """One JSON document a file, under an explicit schema: (good rows, quarantined rows), by file name.

    Folders that do not exist are skipped; max_num is a limit over all of them."""
    there = [f for f in folders if exists(spark, f)]
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    if not there:
        empty = spark.createDataFrame([], StructType([*schema.fields]).add("_file", "string"))
        return empty, spark.createDataFrame([], "_file string, _corrupt string")
    docs = _documents(spark, there, StructType([*schema.fields]), "*.json")
    good = docs.where("_good").select("_doc.*", "_file").orderBy("_file")
    return (good.limit(max_num) if max_num else good), docs.where("not _good").select("_file", F.col("value").alias("_corrupt"))


def chains_of(rows: DataFrame, column: str) -> DataFrame:
    """rows with the fields of the conversation that a JSON column holds; text that is none gives nulls."""
    parsed = rows.withColumn("_chain", F.from_json(column, CHAIN))
    return parsed.select(*(c for c in rows.columns if c != column), "_chain.*")


def steps_of(chains: DataFrame, key: str) -> DataFrame:
    """(conv, node, idx, role, text, calls, responses, think, think_present, type): the steps of loaded conversations."""
    nodes = chains.select(F.col(key).alias("conv"), F.posexplode("nodes").alias("node", "n"))
    steps = nodes.select("conv", F.col("node").cast("long").alias("node"), F.posexplode("n.steps").alias("idx", "s"))
    content = F.col("s.content")
    calls = F.try_variant_get(content, "$", "array<struct<name: string, arguments: variant>>")
    return steps.select(
        "conv", "node", F.col("idx").cast("long").alias("idx"), F.col("s.role").alias("role"), F.when(F.col("s.role").isin("user", "assistant"), F.try_variant_get(content, "$", "string")).alias("text"),
        F.when(F.col("s.role") == "tool_call", F.transform(calls, lambda c: F.struct(c["name"].alias("name"), F.to_json(c["arguments"]).alias("arguments")))).alias("calls"),
        F.when(F.col("s.role") == "tool_response", F.try_variant_get(content, "$", "array<string>")).alias("responses"), F.col("s.think").alias("think"), F.col("s.think").isNotNull().alias("think_present"), F.col("s.type").alias("type"))


def turns_of(chains: DataFrame, key: str) -> DataFrame:
    """(conv, node, decision, query, mcp_servers) of loaded conversations."""
    nodes = chains.select(F.col(key).alias("conv"), F.posexplode("nodes").alias("node", "n"))
    return nodes.select("conv", F.col("node").cast("long").alias("node"), "n.decision", "n.query", "n.mcp_servers")


def write_json(rows: DataFrame, path: str) -> None:
    """JSON lines, one file a partition."""
    rows.write.mode("overwrite").json(path)


def save_chains(chains: DataFrame, path: str, key: str) -> None:
    """One JSON document for each conversation, in a folder named by its key, as scan_chains reads them."""
    chains.select(F.col(key).alias("_key"), F.to_json(F.struct(*(c for c in chains.columns if c != key)), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").partitionBy("_key").option("maxRecordsPerFile", 1).format("text").save(path)


def write_json_array(rows: DataFrame, path: str, seed: int | None = None, key: str | None = None) -> None:
    """All rows as one JSON array in one file, in the rows' order, or shuffled by a seed over a key.

    Rows stream through one task as text, for the format is one document; none is collected."""
    if seed is not None:
        rows = rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text is None:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array(["[" if last is None else f"{last},"])], ["value"])
                last = text
        yield pa.RecordBatch.from_arrays([pa.array(["[]"] if last is None else [last, "]"])], ["value"])

    text = rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))
    # a task, and so a file, even where there are no rows
    text = text.unionByName(rows.sparkSession.range(1).select(F.lit(None).cast("string").alias("value")))
    text.coalesce(1).mapInArrow(lines, "value string").write.mode("overwrite").text(path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Training samples of a JSON array; no rows where the path is missing or no such array."""
    if not exists(spark, path):
        return spark.createDataFrame([], SAMPLE)
    return _documents(spark, path, f"array<struct<{SAMPLE.replace(' string', ': string').replace(' array', ': array')}>>").select(F.inline("_doc"))


def scan_logs(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modified, length) of all .json files below a folder, newest first; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(folder).select("path", F.col("modificationTime").alias("modified"), "length").orderBy(F.desc("modified"), "path")


def append_lines(rows: DataFrame, path: str) -> None:
    """Appends JSON lines: the sink of logs and of token usage."""
    rows.write.mode("append").json(path)


def dump_log(spark: SparkSession, rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """Writes (key, items) as the log at path; unless overwritten, a log there is updated: a key's new items replace its old ones."""
    if not overwrite and exists(spark, path):
        old = spark.read.schema(rows.schema).json(path)
        rows = old.join(rows.select("key"), "key", "left_anti").unionByName(rows)
        replace(spark, rows, path)
    else:
        rows.write.mode("overwrite").json(path)


def replace(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Overwrites path with JSON lines that may be read from it: written beside it, then renamed."""
    fs, at = _path(spark, path)
    beside = _path(spark, f"{path.rstrip('/')}.new")[1]
    rows.write.mode("overwrite").json(beside.toString())
    fs.delete(at, True)
    if not fs.rename(beside, at):
        raise OSError(f"could not rename {beside.toString()}")


def merged_documents(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """Log documents (key, doc as JSON) merged by key: objects are updated by objects, a list gets the new
    document appended, anything else becomes a list of both; keys of either side stay."""
    both = old.select(key, F.col("doc").alias("_old")).join(new.select(key, F.col("doc").alias("_new")), key, "full")
    is_ = lambda c, mark: F.startswith(F.trim(F.col(c)), F.lit(mark))
    items = lambda c: F.from_json(c, "map<string, variant>")
    fresh = F.map_filter(items("_old"), lambda k, _: ~F.map_contains_key(items("_new"), k))
    updated = F.to_json(F.map_concat(fresh, items("_new")))
    listed = F.when(F.trim("_old").rlike(r"^\[\s*\]$"), F.concat(F.lit("["), "_new", F.lit("]"))).otherwise(F.concat(F.regexp_replace("_old", r"\]\s*$", ""), F.lit(","), "_new", F.lit("]")))
    doc = F.when(F.col("_old").isNull(), F.col("_new")).when(F.col("_new").isNull(), F.col("_old")).when(is_("_old", "{") & is_("_new", "{"), updated).when(is_("_old", "["), listed).otherwise(F.concat(F.lit("["), "_old", F.lit(","), "_new", F.lit("]")))
    return both.select(key, doc.alias("doc"))


def token_usage(spark: SparkSession, path: str) -> DataFrame:
    """Totals by agent and model of line-delimited usage rows."""
    rows = spark.read.schema(USAGE).json(path)
    return rows.groupBy(F.col("agent_name").alias("agent"), "model").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.count("*").alias("calls"))


def checked_metadata(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with class_name, description and tools, and the others."""
    good = F.coalesce((F.length("class_name") > 0) & (F.length("description") > 0) & (F.size("tools") > 0), F.lit(False))
    return rows.where(good), rows.where(~good)


def write_metadata(rows: DataFrame, path: str) -> DataFrame:
    """Writes the rows that checked_metadata passes, and returns those it does not."""
    good, bad = checked_metadata(rows)
    write_json(good, path)
    return bad


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """(server, tool_path, stateless) of a registry file; none where it is missing, empty or broken."""
    none = spark.createDataFrame([], "server string, tool_path string, stateless boolean")
    if not exists(spark, path):
        return none
    rows = _documents(spark, path, StructType.fromDDL(REGISTRY)).where("_good").select("_doc.*")
    return rows.select(F.explode("mcpServers").alias("server", "e")).select("server", "e.tool_path", "e.stateless").unionByName(none)


def update_registry(spark: SparkSession, path: str, new: DataFrame) -> None:
    """Adds or replaces the entries of new(server, tool_path, stateless) in the registry at path."""
    from ..operators.store import upsert

    rows = upsert(read_registry(spark, path), new.select("server", "tool_path", "stateless"), "server")
    entries = rows.groupBy().agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("server", F.struct("tool_path", "stateless"))))).alias("mcpServers"))
    replace(spark, entries, path)


def save_graph(tables: dict[str, DataFrame], path: str) -> None:
    """The tables of a graph (nodes, edges, params) as Parquet, one folder each."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def load_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in directories(spark, path, "")}


def save_scenarios(scenarios: DataFrame, path: str) -> None:
    """Scenarios as one JSON array, ordered by scenario_id."""
    write_json_array(scenarios.orderBy("scenario_id"), path)


def load_scenarios(spark: SparkSession, path: str, schema: str = "scenario_id string, complexity_level string, description string, expected_behavior string, scenario_data variant") -> DataFrame:
    """Scenarios of a JSON array; a document that is none raises an error when it is read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def load_state(rows: DataFrame, column: str, schema: str, check: str = "true") -> tuple[DataFrame, DataFrame]:
    """A store's state from JSON text under its schema: (rows with the fields, rejected rows).

    Text that does not parse or fails the check (SQL over the fields) is rejected whole."""
    full = rows.withColumn("_state", F.from_json(column, f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    fields = [f.name for f in StructType.fromDDL(schema).fields]
    flat = full.select(*rows.columns, *(F.col(f"_state.{f}").alias(f) for f in fields), (F.col("_state").isNotNull() & F.col("_state._corrupt").isNull()).alias("_parsed"))
    good = F.coalesce(F.col("_parsed") & F.expr(check), F.lit(False))
    return flat.where(good).drop("_parsed", column), flat.where(~good).select(*rows.columns)


def save_state(rows: DataFrame, fields: list[str], column: str = "state") -> DataFrame:
    """rows with the fields gathered into one JSON column; nulls are written."""
    return rows.select(*(c for c in rows.columns if c not in fields), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias(column))
