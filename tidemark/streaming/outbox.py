"""Effects to be sent, each exactly once, whatever batches run again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.state_table import finished

EFFECTS = "session_id string, at_ts timestamp_ntz, event_id bigint, kind string, value string"
#: What makes an effect the same one when it comes again.
IDENTITY = ("session_id", "at_ts", "event_id", "kind")
#: Kinds that set a value, of which only the last one need be sent; the others are sent one by one.
SETTING = ("status", "active_date", "title")


class Outbox:
    """Effects under `folder`, in versions by batch and in parts by day.

    put() may be called by foreachBatch: a batch that runs again replaces its own effects, and effects that an earlier batch has
    put, by their identity, are left out. The same effect has the same time, so only the days that a batch has are
    looked through. Of effects of one identity in a batch, that of the least value stays. Effects without a time share a day.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.schema = spark.createDataFrame([], f"{EFFECTS}, key string, v int, day string").schema

    def read(self, after: int = -1, before: int | None = None) -> DataFrame:
        """Effects with key, v (their batch) and day, of batches after one and before another."""
        paths = [f"{self.folder}/v={v}" for v in finished(self.spark, self.folder) if v > after and (before is None or v < before)]
        return self.spark.read.schema(self.schema).option("basePath", self.folder).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def put(self, effects: DataFrame, batch: int) -> None:
        keyed = effects.select(*[f.name for f in self.schema.fields[:5]])
        parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in IDENTITY]
        key = F.sha2(F.to_json(F.array(*parts, *[F.col(c).isNull().cast("string") for c in IDENTITY])), 256)
        one = keyed.groupBy(*IDENTITY).agg(F.min("value").alias("value")).select(*keyed.columns, key.alias("key"))
        day = F.coalesce(F.date_format("at_ts", "yyyy-MM-dd"), F.lit("none")).alias("day")
        fresh = one.select("*", day)
        if any(v < batch for v in finished(self.spark, self.folder)):
            days = [r["day"] for r in keyed.select(day).distinct().collect()]
            sent = self.read(before=batch).filter(F.col("day").isin(days)).select("day", "key")
            fresh = fresh.join(sent, ["day", "key"], "left_anti")
        fresh.hint("rebalance", F.col("day")).write.mode("overwrite").partitionBy("day").parquet(f"{self.folder}/v={batch}")

    def unsent(self, after: int) -> DataFrame:
        """What a sender that has sent up to batch `after` has to send: of a kind that sets a value, a session's last one."""
        return net(self.read(after))


def net(effects: DataFrame) -> DataFrame:
    """Effects without those that a later one of their session and kind makes void."""
    setting, names = F.col("kind").isin(*SETTING), ["session_id", "at_ts", "event_id", "kind", "value"]
    last = effects.filter(setting).groupBy("session_id", "kind").agg(F.max_by(F.struct("at_ts", "event_id", "value"), F.struct("at_ts", "event_id", "value")).alias("x"))
    return effects.filter(~setting).select(*names).unionByName(last.select("session_id", "kind", "x.*").select(*names))
