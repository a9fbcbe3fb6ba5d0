"""Gates: privacy of the repository, activity of the board, and their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.machine import INACTIVE
from tidemark.operators.temporal import asof_join, bucket

#: Reasons, and the number of updates that the gate looks at.
PUBLIC, UNCHECKED = "notes_repo_public", "notes_repo_check_failed"
NEWEST = 20
MARKER = "<!-- tidemark-status -->"


def privacy(visibility: Column) -> Column:
    """ok, or why not; anything but a plain answer fails closed."""
    v = F.lower(F.trim(visibility))
    return F.when(v.isin("true", "private"), "ok").when(v.isin("false", "public"), PUBLIC).otherwise(UNCHECKED)


def board_inactive(audit: DataFrame, marker: str = MARKER, newest: int = NEWEST) -> DataFrame:
    """One row: whether the newest marked update among the newest ones says inactive. Updates are limited before they are filtered."""
    top = audit.orderBy(F.desc("created_at"), F.desc("update_id")).limit(newest)
    top = top.filter(F.contains(F.coalesce("body", F.lit("")), F.lit(marker)))
    return top.agg(F.coalesce(F.max_by("status", F.struct("created_at", "update_id")) == "INACTIVE", F.lit(False)).alias("inactive"))


def board_history(audit: DataFrame, marker: str = MARKER, newest: int = NEWEST) -> DataFrame:
    """created_at, update_id and board_status after each update: the newest marked one's status, null where that isn't
    among the newest `newest` updates of whatever kind. Hours are ranked each by itself; a row for each hour adds them up."""
    marked = F.contains(F.coalesce("body", F.lit("")), F.lit(marker))
    own = audit.select("created_at", "update_id", "status", marked.alias("marked"), bucket(F.col("created_at"), "HOUR").alias("_b"))
    order = Window.partitionBy("_b").orderBy("created_at", "update_id")
    own = own.withColumn("nth", F.row_number().over(order).cast("long"))
    own = own.withColumn("hit", F.last(F.when(F.col("marked"), F.struct(F.col("nth").alias("rank"), "status")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    hours = own.groupBy("_b").agg(F.max("nth").alias("n"), F.max_by("hit", "nth").alias("end"))
    hours = hours.withColumn("before", F.sum("n").over(Window.orderBy("_b")) - F.col("n"))
    ranked = lambda hit: F.when(F.col(hit).isNotNull(), F.struct((F.col("before") + F.col(hit)["rank"]).alias("rank"), F.col(hit)["status"].alias("status")))
    hours = hours.withColumn("earlier", F.last(ranked("end"), ignorenulls=True).over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).select("_b", "before", "earlier")
    both = own.join(hours, "_b").withColumn("last", F.coalesce(ranked("hit"), "earlier"))
    return both.select("created_at", "update_id", F.when(F.col("before") + F.col("nth") - F.col("last.rank") < newest, F.col("last.status")).alias("board_status"))


def board_asof(log: DataFrame, board: DataFrame, ts: str = "ts") -> DataFrame:
    """The log with board_status, as the gate would see it at each row's time; board is what board_history gives."""
    return asof_join(log, board, ts, "created_at", ["board_status"], right_order="update_id")


def is_inactive(board_status: Column) -> Column:
    return F.coalesce(board_status == "INACTIVE", F.lit(False))


def visibility_of(key: Column) -> Column:
    """The fixture's answers about repositories."""
    return F.when(key % 11 == 0, "PUBLIC").when(key % 13 == 0, "error").otherwise(" private ")


def visibilities(customer: DataFrame) -> DataFrame:
    """A lookup of workspaces' repositories: cwd and visibility, one row each."""
    return customer.select(F.col("c_custkey").alias("cwd"), visibility_of(F.col("c_custkey")).alias("visibility"))


def blocked_text(reason: Column) -> Column:
    return (
        F.when(reason == PUBLIC, "tracking is off: the notes repository is public")
        .when(reason == UNCHECKED, "tracking is off: the notes repository could not be checked")
        .when(reason == INACTIVE, "tracking is off: the board is inactive")
        .otherwise("tracking is on")
    )


def pause_spans(controls: DataFrame, key: str = "cwd") -> DataFrame:
    """Pauses and resumptions (action, ts, ok) as spans: a pause holds at once, a resumption only if its update went through."""
    order = Window.partitionBy(key).orderBy("ts")
    real = controls.filter("action = 'pause' or ok")
    real = real.withColumn("until", F.lead("ts").over(order))
    return real.filter("action = 'pause'").select(key, F.col("ts").alias("paused_at"), "until")


def controls(audit: DataFrame) -> DataFrame:
    """Pauses and resumptions of workspaces, out of the board's updates; an update in five doesn't go through."""
    return audit.select(F.col("project").alias("cwd"), F.when(F.col("status") == "INACTIVE", "pause").otherwise("resume").alias("action"), F.col("created_at").alias("ts"), (F.col("update_id") % 5 != 0).alias("ok"))
