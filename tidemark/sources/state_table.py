"""A table of one row per key that is kept up to date batch by batch, rewriting only what a batch touches.

Rows lie in buckets by the key's hash, in versions by batch: a batch writes the buckets of its own keys under v=<batch>, and
of each bucket the newest version counts. A version counts once Spark has marked its write as finished, so a batch that is
cut short leaves the table as it was (a dynamic partition overwrite would delete a bucket before it moves the new one in).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.temporal import latest_by
from tidemark.sources.store import drop, names, remove, written

BUCKETS = 64


def finished(spark: SparkSession, folder: str) -> list[int]:
    """Batches whose write under folder/v=<batch> is complete, in order."""
    found = (n for n in names(spark, folder) if n.startswith("v="))
    return sorted(int(n[2:]) for n in found if "_SUCCESS" in names(spark, f"{folder}/{n}"))


class StateTable:
    """schema: of the rows (DDL), with the key and the columns of `order`, of which the greatest row is a key's state.

    Null keys are a key of their own; a null in order comes before any value. Of rows equal in order, the greatest by the
    other columns stays, so the same rows in any batches give the same table. buckets belongs to a folder for good: choose
    it so that a bucket fits a few tasks.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str, order: Iterable[str], buckets: int = BUCKETS):
        self.spark, self.folder, self.key, self.order, self.buckets = spark, folder.rstrip("/"), key, list(order), buckets
        self.schema = spark.createDataFrame([], schema).schema

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def versions(self) -> dict[int, list[int]]:
        """For each bucket, the finished batches that wrote it and are still there, in order."""
        out: dict[int, list[int]] = {}
        for v in finished(self.spark, self.folder):
            for n in names(self.spark, f"{self.folder}/v={v}"):
                if n.startswith("bucket="):
                    out.setdefault(int(n[7:]), []).append(v)
        return out

    def read(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """The table, or some of its buckets."""
        there = self.versions()
        wanted = there if buckets is None else [b for b in buckets if b in there]
        paths = [f"{self.folder}/v={there[b][-1]}/bucket={b}" for b in wanted]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _latest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in self.schema.names if c != self.key and c not in self.order]
        return latest_by(rows, [self.key], [*self.order, *rest], [c for c in self.schema.names if c != self.key]).select(*self.schema.names)

    def upsert(self, rows: DataFrame, batch: int | None = None) -> list[int]:
        """Takes a batch of rows and returns the buckets that it rewrote. A batch that is finished already changes nothing."""
        done = finished(self.spark, self.folder)
        batch = (done[-1] + 1 if done else 0) if batch is None else batch
        if batch in done:
            return []
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes after batch {done[-1]}")
        new = written(self._latest(rows.select(*self.schema.names)), "upsert")
        touched = sorted(r["b"] for r in new.select(self._bucket().alias("b")).distinct().collect())  # `buckets` at most
        whole = self._latest(self.read(touched).unionByName(new)).withColumn("bucket", self._bucket())
        # a bucket's rows come together; adaptive execution splits large ones and joins small ones
        whole.hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/v={batch}")
        drop(new)
        # what the last batch read goes now, not at once: someone may still read it
        for b, vs in self.versions().items():
            for v in (v for v in vs if v < max((x for x in vs if x < batch), default=v)):
                remove(self.spark, f"{self.folder}/v={v}/bucket={b}")
        return touched
