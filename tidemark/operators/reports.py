"""The status report of each workspace."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions import urls as U
from tidemark.operators import audit as A
from tidemark.operators import gates as G
from tidemark.operators import install as I
from tidemark.operators import states as S


def _scope(invalid, exists, installed):
    return F.when(invalid & exists, "invalid settings").when(installed & exists, "installed").when(exists, "present but hooks missing").otherwise("not present")


def workspaces(log: DataFrame, audit: DataFrame, rows: DataFrame, machines: DataFrame) -> DataFrame:
    """A row for each workspace of the log with what its report tells: its installation (machines; c_custkey is the workspace), its
    open session that was written last, what the board was told last, and why tracking is blocked, if it is. rows: the machine's."""
    sync = A.last(A.tries(audit)).withColumnRenamed("project", "cwd")
    m = I.with_state(machines).withColumnRenamed("c_custkey", "cwd")
    return log.select("cwd").distinct().join(S.last_of(rows), "cwd", "left").join(sync, "cwd", "left").join(m, "cwd", "left")


def status_report(found: DataFrame) -> DataFrame:
    """Lines of label and value, in order, for each workspace (a row of workspaces)."""
    synced = F.date_format("last_synced_at", "yyyy-MM-dd HH:mm:ss")
    none = lambda c: F.coalesce(c, F.lit("none"))
    lines = {
        "install": none(F.col("state")),
        "files": T.yes_no(F.coalesce(F.col("file_a") & F.col("file_b"), F.lit(False))),
        "user settings": none(_scope(F.lit(False), F.col("user_exists"), F.col("user_hooked"))),
        "local settings": none(_scope(F.col("local_invalid"), F.col("local_exists"), F.col("local_hooked"))),
        "config": T.yes_no(F.coalesce("config", F.lit(False))),
        "timeout": F.concat(T.minutes(F.lit(T.IDLE_SECONDS)).cast("string"), F.lit(" min")),
        "session": none(T.short_id(F.col("session_id"))),
        "status": none(F.col("status")),
        "paused": T.yes_no(F.coalesce("paused", F.lit(False))),
        "issue": none(F.when(F.col("session_id").isNotNull(), U.issue_url(F.lit("team/notes"), F.col("cwd")))),
        "sync": T.sync_text(F.coalesce(synced, F.nullif(F.coalesce("last_error", F.lit("")), F.lit(""))), F.col("last_error").isNull(), F.col("last_status"), F.col("last_error")),
        "blocked": T.yes_no(F.coalesce(F.col("decision") != "ok", F.lit(False))),
        "note": F.coalesce(F.when(F.col("decision").isNotNull(), G.blocked_text(F.col("decision"))), F.lit("no event was gated")),
    }
    rows = F.array(*[F.struct(F.lit(i).alias("nth"), F.lit(k).alias("label"), v.alias("value")) for i, (k, v) in enumerate(lines.items())])
    return found.select("cwd", F.inline(rows))
