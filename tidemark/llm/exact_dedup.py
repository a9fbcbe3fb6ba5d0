"""Exact deduplication by two passes over a Bloom filter of text digests.

Pass 1 sets, for every digest, a few bits of a filter that counts to two. Pass 2 asks for each row whether all
bits of its digest were set twice. Every repeated digest is among those rows, and few others are: only they
shuffle, to be grouped by the whole SHA-256. All other rows are known to be single and pass straight through.

The filter has BITS_PER_ROW bits for each row, split into blocks of 64 KB; a task sends the blocks that it touched
and no fingerprints. One filter is at most MAX_FILTER_BYTES, whatever the input: beyond that the digests are
written in ranges, and each range has a filter of its own, that goes before the next one is made.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import Scratch, ascii_lower, table

BITS_PER_ROW = 8
HASHES = 4
BLOCK_BITS = 1 << 19
MAX_FILTER_BYTES = 32 << 20

_BLOCK_SCHEMA = "block int, once binary, twice binary"


def _places(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each hash, and its HASHES bits within that block."""
    h = h.astype(np.uint64)
    block = ((h >> np.uint64(40)) % np.uint64(blocks)).astype(np.int64)
    step = (h * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    bits = [((h + np.uint64(i) * step) >> np.uint64(13)) % np.uint64(BLOCK_BITS) for i in range(HASHES)]
    return block, np.stack(bits, axis=1).astype(np.int64)


def _merge(into: dict, block: int, once: np.ndarray, twice: np.ndarray) -> None:
    if block in into:
        a, b = into[block]
        b |= twice
        b |= a & once
        a |= once
    else:
        into[block] = (once.copy(), twice.copy())


def _emit(blocks: dict) -> Iterator[pa.RecordBatch]:
    for k, (a, b) in blocks.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary())], ["block", "once", "twice"])


def _build(blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            block, bits = _places(batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64), blocks)
            for k in np.unique(block):
                # a digest's bits differ from each other before they are counted, so one row never counts as two
                own = np.sort(bits[block == k], axis=1)
                own = own[np.concatenate([np.ones((len(own), 1), bool), own[:, 1:] != own[:, :-1]], axis=1)]
                n = np.bincount(own, minlength=BLOCK_BITS)
                _merge(found, int(k), np.packbits(n >= 1), np.packbits(n >= 2))
        yield from _emit(found)

    return run


def _join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for k, a, b in zip(*(batch.column(c) for c in ("block", "once", "twice")), strict=True):
            _merge(found, k.as_py(), np.frombuffer(a.as_buffer(), np.uint8), np.frombuffer(b.as_buffer(), np.uint8))
    yield from _emit(found)


def _ask(filters, blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = filters.value
        for batch in batches:
            block, bits = _places(batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64), blocks)
            hit = np.zeros(len(block), bool)
            for k in np.unique(block):
                own = block == k
                if int(k) in twice:
                    field = np.frombuffer(twice[int(k)], np.uint8)
                    b = bits[own]
                    hit[own] = ((field[b >> 3] >> (7 - (b & 7)).astype(np.uint8)) & 1).all(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit)], [*batch.schema.names, "suspect"])

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after A-Z become a-z; a null text is an empty one. The largest id of a group
    stays; rows that repeat the same id and text share its fate. A null id never stays over another; a group
    with null ids alone keeps them. Other columns of docs are ignored, so their names can't clash. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = docs.select(F.col(id_col).alias("doc_id"), F.sha2(ascii_lower(text).cast("binary"), 256).alias("text_sha256"))
    digest = scratch.write(digest.withColumn("h", F.xxhash64("text_sha256")), "digests")
    rows = digest.count()
    ranges = max(1, -(-rows * BITS_PER_ROW // (8 * max_filter_bytes)))
    if ranges > 1:
        whole = digest
        ranged = whole.withColumn("part", F.pmod(F.xxhash64("h"), F.lit(ranges)).cast("int"))
        path = f"{scratch.root}/ranges"
        ranged.write.partitionBy("part").parquet(path)
        digest = spark.read.schema(ranged.schema).parquet(path)
        scratch.drop(whole)
    blocks = max(1, -(-rows * BITS_PER_ROW // ranges // BLOCK_BITS))
    flagged = []
    for r in range(ranges):
        own = digest.filter(F.col("part") == r).drop("part") if ranges > 1 else digest
        made = own.select("h").mapInArrow(_build(blocks), _BLOCK_SCHEMA)
        made = made.repartition(min(blocks, 64), "block").mapInArrow(_join_blocks, _BLOCK_SCHEMA)
        # at most max_filter_bytes come to the driver, and go out again
        twice = {r["block"]: bytes(r["twice"]) for r in made.select("block", "twice").collect()}
        held = spark.sparkContext.broadcast(twice)
        asked = own.mapInArrow(_ask(held, blocks), "doc_id " + dict(own.dtypes)["doc_id"] + ", text_sha256 string, h bigint, suspect boolean")
        flagged.append(scratch.write(asked.drop("h"), "asked"))
        held.destroy()  # one filter at a time, whatever the number of ranges
    every = functools.reduce(DataFrame.unionByName, flagged)
    single = every.filter("not suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    # both sides written, so that the join is a plain one, of which Spark splits what a text with very many copies makes large
    again = scratch.write(every.filter("suspect").select("doc_id", "text_sha256"), "again")
    groups = scratch.write(again.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    again = again.join(groups, "text_sha256").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    return single.unionByName(again)


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
