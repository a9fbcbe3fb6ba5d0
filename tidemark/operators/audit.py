"""The board's audit trail and the cache of its last values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import audit_body, iso_utc
from tidemark.operators.gates import MARKER
from tidemark.operators.temporal import running_last


def cache(audit: DataFrame) -> DataFrame:
    """After every try to publish a status: the last id and time that went through in that project, and the error if this one didn't.

    audit: project, update_id, created_at, status, ok.
    """
    good = F.when(F.col("ok"), F.struct("created_at", "update_id"))
    return running_last(audit, ["project"], good, "created_at", "update_id", "good").select(
        "update_id", "project", F.col("status").alias("last_status"), F.col("good.created_at").alias("last_synced_at"), F.col("good.update_id").alias("status_update_id"),
        _error().alias("last_error"),
    )


def last(audit: DataFrame) -> DataFrame:
    """Of what cache gives, each project's row of the greatest id, without the history of all rows: project, last_status, last_synced_at, last_error."""
    timed = audit.filter("project is not null and created_at is not null")
    ends = timed.groupBy("project").agg(F.max_by(F.struct("created_at", "update_id", "status", "ok"), "update_id").alias("end")).filter("end is not null").select("project", "end.*")
    good = timed.filter("ok").select("project", F.struct("created_at", "update_id").alias("good"))
    upto = F.max(F.when(F.col("good") <= F.struct("created_at", "update_id"), F.col("good"))).alias("good")
    ends = ends.join(good, "project", "left").groupBy("project", "created_at", "update_id", "status", "ok").agg(upto)
    return ends.select("project", F.col("status").alias("last_status"), F.col("good.created_at").alias("last_synced_at"), _error().alias("last_error"))


def _error() -> Column:
    return F.when(~F.col("ok"), F.concat(F.lit("update "), F.col("update_id").cast("string"), F.lit(" failed")))


def tries(audit: DataFrame) -> DataFrame:
    return audit.withColumn("ok", F.col("update_id") % 4 != 0)


def appended(controls: DataFrame) -> DataFrame:
    """The updates that pauses and resumptions (cwd, action, ts, ok) add to the board, where they went through."""
    status = F.when(F.col("action") == "pause", "INACTIVE").otherwise("ON_TRACK")
    message = F.when(F.col("action") == "pause", "tracking is paused").otherwise("tracking goes on")
    fields = {"Status": status, "Workspace": F.col("cwd").cast("string"), "Time": iso_utc(F.col("ts")), "Actor": F.lit("cli")}
    return controls.filter("ok").select("cwd", F.col("ts").alias("created_at"), status.alias("status"), audit_body(MARKER, fields, message).alias("body"))


def bodies(audit: DataFrame) -> DataFrame:
    fields = {
        "Status": F.col("status"), "Project": F.col("project").cast("string"), "Update": F.col("update_id").cast("string"),
        "Session": F.when(F.col("update_id") % 2 == 0, F.concat(F.lit("s"), F.col("update_id").cast("string"))), "Workspace": F.lit(""), "Actor": F.lit("cli"),
    }
    return audit.select("update_id", audit_body(MARKER, fields, F.lower("status")).alias("text"))
