"""The tracker's commands as functions over its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import catalogue

#: The commands' names; any other, or none, sets up.
COMMANDS = {"status": "status_report", "doctor": "doctor_report", "pause": "control_updates", "resume": "control_updates", "uninstall": "uninstall_report"}
SETUP = "setup_next_step"


def dispatch(command: str | None) -> Callable[[SparkSession, str], DataFrame]:
    """The query that answers a command."""
    query = catalogue.QUERIES[COMMANDS.get(command or "", SETUP)]
    if command in ("pause", "resume"):
        status = "INACTIVE" if command == "pause" else "ON_TRACK"
        return lambda spark, sf_dir: query(spark, sf_dir).filter(f"status = '{status}'")
    return query
