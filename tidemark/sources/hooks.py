"""The hook log: lifecycle events of sessions, read from JSON payloads or projected from the events table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.temporal import running_count

#: Event names, and the status that each state-writing event sets.
HOOKS = {"signup": "SessionStart", "click": "UserPromptSubmit", "view": "PostToolUse", "purchase": "Stop", "error": "SessionEnd"}
STATUS = {"SessionStart": "registered", "UserPromptSubmit": "responding", "Stop": "waiting", "SessionEnd": "closed"}
QUESTION_TOOL = "AskUserQuestion"

PAYLOAD = """
  session_id string, cwd string, hook_event_name string, prompt string, transcript_path string, tool_name string,
  last_assistant_message string,
  tool_input struct<questions: array<struct<question: string, options: array<struct<label: string, description: string>>>>>,
  tool_response struct<answers: map<string, string>>
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parse_payloads(lines: DataFrame, column: str = "value", strict: bool = False) -> DataFrame:
    """One row per payload that is JSON and names its session; fields that are missing are null. Others are dropped, or,
    if strict, what isn't JSON is an error."""
    # a corrupt payload and one without session both come out with a null session_id
    parsed = lines.withColumn("_p", F.from_json(column, PAYLOAD, {"mode": "FAILFAST" if strict else "PERMISSIVE"}))
    return parsed.filter("coalesce(_p.session_id, '') <> ''").select(*[c for c in lines.columns if c != column], "_p.*")


def payload_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """The payloads that come in as files of lines, as a stream, with the time that their file was written."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    return route(parse_payloads(lines.select("value", F.col("_metadata.file_modification_time").alias("ts"))))


def route(payloads: DataFrame) -> DataFrame:
    """Payloads that some handler takes: tool results only of the question tool."""
    hook = F.col("hook_event_name")
    return payloads.filter(hook.isin("SessionStart", "UserPromptSubmit", "Stop", "SessionEnd") | ((hook == "PostToolUse") & (F.col("tool_name") == QUESTION_TOOL)))


def parsed(events: DataFrame) -> DataFrame:
    """What hook events and the board's updates need of the events table, with k out of its JSON."""
    return events.select("event_id", "ts", "user_id", "event_type", _k(events).alias("k"))


def _k(events: DataFrame) -> Column:
    if "k" in events.columns:
        return F.col("k")
    # an object of k and a number alone, as most are, needs no parser
    plain = F.nullif(F.regexp_extract("props", r'^\{"k": (0|[1-9][0-9]{0,8})\}$', 1), F.lit(""))
    return F.coalesce(plain, F.get_json_object("props", "$.k")).cast("int")


def hook_events(events: DataFrame) -> DataFrame:
    """The events table as hook events: a user is a workspace, each signup begins its next session."""
    name = F.create_map(*[F.lit(x) for kv in HOOKS.items() for x in kv])[F.col("event_type")]
    k = _k(events)
    return events.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("user_id").alias("cwd"), name.alias("hook"), k.alias("k"), ((name == "SessionStart") & (k % 2 == 0)).alias("is_resume"))


def hook_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_of(table(spark, sf_dir, "events"))


def log_of(events: DataFrame, large: DataFrame | None = None) -> DataFrame:
    """Hook events with their workspace's sessions so far (n) and the session that they belong to. large: the workspaces (cwd) of
    many events, if they are known."""
    log = running_count(hook_events(events), ["cwd"], F.col("hook") == "SessionStart", "ts", "event_id", "n", large=large)
    return log.withColumn("session_id", F.concat_ws("-", F.col("cwd").cast("string"), F.col("n").cast("string")))


def tracked(log: DataFrame) -> DataFrame:
    """Events of sessions that have a state; those before a workspace's first start have none."""
    return log.filter("n > 0")


def audit_rows(events: DataFrame, marker: str) -> DataFrame:
    """Status updates of the board: a tenth of the events, a third of them without the marker."""
    e = events.withColumn("k", _k(events)).filter("k < 10")
    status = F.when(F.col("k") < 5, "INACTIVE").otherwise("ON_TRACK")
    body = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit(marker + "\n"), F.col("event_type"))).otherwise(F.col("event_type"))
    return e.select(F.col("event_id").alias("update_id"), F.col("ts").cast("timestamp_ntz").alias("created_at"), F.col("user_id").alias("project"), status.alias("status"), body.alias("body"))


def board_audit(spark: SparkSession, sf_dir: str, marker: str) -> DataFrame:
    return audit_rows(table(spark, sf_dir, "events"), marker)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts and answers: conversations without system rows."""
    return table(spark, sf_dir, "conversations").filter("role in ('user', 'assistant')")


def remotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A git remote for each page, in eight forms."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"://([^./]+)", 1).alias("owner"))
    repo = F.concat(F.lit("repo"), (F.col("page_id") % 97).cast("string"))
    o = F.col("owner")
    forms = [
        F.concat(F.lit("https://github.com/"), o, F.lit("/"), repo),
        F.concat(F.lit("https://github.com/"), o, F.lit("/"), repo, F.lit(".git")),
        F.concat(F.lit("git@github.com:"), o, F.lit("/"), repo, F.lit(".git")),
        F.concat(F.lit("ssh://git@ssh.github.com:443/"), o, F.lit("/"), repo),
        F.concat(F.lit("https://example.org/"), o, F.lit("/"), repo),
        F.concat(F.lit("https://github.com/"), o),
        F.concat(F.lit(" http://github.com/"), o, F.lit("/"), repo, F.lit("/tree/main")),
        F.concat(F.lit("https://github.com/"), o, F.lit("/"), repo, F.lit("/")),
    ]
    which, url = F.col("page_id") % 8, F.lit(None).cast("string")
    for i, f in enumerate(forms):
        url = F.when(which == i, f).otherwise(url)
    return pages.select("page_id", url.alias("url"))


def env_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight lines of an env file for each page: quoted, commented, blank, repeated and with `=` in the value."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("page_id").cast("string").alias("i"))
    i = F.col("i")
    lines = [
        F.concat(F.lit("OWNER=user"), i), F.concat(F.lit(' REPO = "o/r'), i, F.lit('"  ')), F.lit("# OWNER=none"), F.lit(""),
        F.concat(F.lit("TIMEOUT="), i, F.lit(" # seconds")), F.concat(F.lit("OWNER='other"), i, F.lit("'")), F.concat(F.lit("QUERY=a=b&c="), i), F.concat(F.lit("NOTE=\"'x#"), i, F.lit("'\"")),
    ]
    return pages.select("page_id", F.posexplode(F.array(*lines)).alias("line_no", "line"))
