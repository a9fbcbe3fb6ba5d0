"""Files of a tracker's folder: states, settings, config, transcripts and distribution data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.env import env_map
from tidemark.functions.text import is_json
from tidemark.sources.heads import FirstLines

STATE = """
  session_id string, item_id string, cwd string, repo string, issue_number bigint, context_repo string, context_label string,
  status string, created_at string, first_prompt_notified boolean, timer_deadline string, tracking_paused boolean,
  paused_at string, pause_scope string,
  project_status_sync struct<status: string, attempted_at: string, success: boolean, synced_at: string, status_update_id: string, error: string>
"""
SETTINGS = "hooks map<string, array<struct<matcher: string, hooks: array<struct<type: string, command: string>>>>>"


def states(spark: SparkSession, folder: str) -> DataFrame:
    """Every state file: its path, name, time of last write, whether it is valid, and its fields (null where it isn't)."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select("value", "_metadata.file_path", "_metadata.file_name", F.col("_metadata.file_modification_time").alias("last_write_ts"))
    return parsed_states(raw.withColumn("file_id", F.regexp_replace("file_name", r"\.json$", "")), ["file_path", "file_id", "last_write_ts"])


def parsed_states(records: DataFrame, keep: list[str]) -> DataFrame:
    """State records out of their text in `value`: the columns to keep, whether a record is valid, and its fields (null where it isn't)."""
    parsed = records.withColumn("_s", F.from_json("value", STATE + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    ok = F.coalesce(F.col("_s._bad").isNull() & F.col("value").rlike(r"(?s)^\s*\{"), F.lit(False)) & is_json(F.col("value"))
    fields = [F.when(ok, F.col("_s")[c]).alias(c) for c in parsed.schema["_s"].dataType.names if c != "_bad"]
    return parsed.select(*keep, ok.alias("valid"), *fields)


def scanned(parsed: DataFrame) -> DataFrame:
    """How many records of a scan there are, by validity and status."""
    return parsed.groupBy("valid", "status").agg(F.count("*").alias("records"))


def env_file(spark: SparkSession, paths: list[str], last: bool = True, environment: dict[str, str] | None = None) -> DataFrame:
    """key and value over files in order of precedence; last: a file's last line wins, as does the last file; else the first
    of both. What the environment sets wins over every file. A file is read whole, so its lines keep their order."""
    out = None
    for rank, path in enumerate(paths):
        whole = spark.read.text(path, wholetext=True)
        lines = whole.select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"), F.lit(rank).alias("rank"), F.lit(1).alias("one"))
        out = lines if out is None else out.unionByName(lines)
    found = env_map(out, "line", ["rank", "line_no"], ["one"], last).drop("one")
    if environment:
        own = spark.createDataFrame(list(environment.items()), "key string, value string")
        found = found.join(F.broadcast(own.select("key")), "key", "left_anti").unionByName(own)  # a process's variables
    return found


def is_resume(spark: SparkSession, path: str, marker: str = "file-history-snapshot") -> DataFrame:
    """For each transcript whether its first line is JSON of the marker's type; unreadable lines count as not.

    Only first lines are read, of any length.
    """
    spark.dataSource.register(FirstLines)
    first = spark.read.format("first_lines").load(path)
    kind = F.try_variant_get(F.try_parse_json("value"), "$.type", "string")
    return first.select("file_path", F.coalesce(is_json(F.col("value")) & (kind == marker), F.lit(False)).alias("is_resume"))


def settings(spark: SparkSession, scopes: list[tuple[str, str]], commands: list[str]) -> DataFrame:
    """For each (scope, path): exists, installed (some command names one of ours), invalid (no JSON)."""
    wanted = spark.createDataFrame(scopes, "scope string, path string")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = [p for _, p in scopes if (q := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(q)]  # a handful of configured paths
    texts = spark.createDataFrame([], "path string, value string")
    for p in there:
        texts = texts.unionByName(spark.read.text(p, wholetext=True).select(F.lit(p).alias("path"), "value"))
    parsed = texts.withColumn("_s", F.from_json("value", SETTINGS + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    known = F.array(*[F.lit(c) for c in commands])
    ours = F.exists(F.flatten(F.map_values("_s.hooks")), lambda e: F.exists(e["hooks"], lambda h: F.exists(known, lambda f: F.contains(h["command"], f))))
    found = parsed.select("path", F.lit(True).alias("exists"), (F.col("_s._bad").isNotNull() | ~F.col("value").rlike(r"(?s)^\s*\{")).alias("invalid"), F.coalesce(ours, F.lit(False)).alias("installed"))
    return wanted.join(found, "path", "left").select("scope", "path", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("exists", "installed", "invalid")])


def family(name: Column, alike: Column) -> Column:
    """The package family of a distribution's ID and ID_LIKE: the first of four that either names, else the ID."""
    both = F.concat_ws(" ", name, alike)
    found = F.lit(None).cast("string")
    for kind, words in (("opensuse", ("suse",)), ("arch", ("arch",)), ("fedora", ("fedora", "rhel")), ("debian", ("debian", "ubuntu"))):
        for word in words:
            found = F.when(F.contains(both, F.lit(word)), kind).otherwise(found)
    return F.coalesce(found, F.nullif(name, F.lit("")), F.lit("unknown"))


def distro_family(values: DataFrame) -> DataFrame:
    """family out of an os-release map (key, value)."""
    value = lambda k: F.max(F.when(F.col("key") == k, F.lower("value")))
    row = values.groupBy().agg(value("ID").alias("id"), value("ID_LIKE").alias("alike"))
    return row.select(family(F.col("id"), F.col("alike")).alias("family"))
