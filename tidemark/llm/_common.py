"""Scratch tables, shared folders and small expressions used by several operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word is a run of bytes outside this set; it is also what regular expressions below exclude.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where it is unset (local runs)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    made = spark.sparkContext.getCheckpointDir()
    if not made:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        made = spark.sparkContext.getCheckpointDir()
    return made.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage; a lost executor takes none of them along.

    drop() removes a table that no later frame reads. What stays is removed when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self.fs_path(self.root)[0].deleteOnExit(self.fs_path(self.root)[1])
        self.n = 0

    def fs_path(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.parquet(path)
        found = self.spark.read.schema(df.schema).parquet(path)
        found._scratch_path = path
        return found

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = getattr(df, "_scratch_path", None)
            if path:
                fs, p = self.fs_path(path)
                fs.delete(p, True)


def ascii_lower(c: Column) -> Column:
    """A-Z become a-z; every other character stays (lower() would also change letters outside ASCII)."""
    return F.translate(c, UPPER, LOWER)


def n_words(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def remainder(c: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo divisor: what folds are made of."""
    return F.coalesce(F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(divisor)), F.lit(0)).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and y of at most `most` labelled documents, the first in order of a hash of the id.

    Only rows where learn holds are looked at. The chosen ids are few, as `most` bounds them, so they are broadcast.
    A repeated id comes as often as documents repeat it; contradicting labels of an id count as their largest.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("y")).filter(learn & F.col("y").isNotNull())
    chosen = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id")
