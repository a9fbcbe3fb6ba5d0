"""Vectors as short codes: product quantisation, its codebooks found by Lloyd's rounds with Elkan's bounds.

Vectors are of integers and cut into PARTS parts, each with a codebook of its own. For every part of a vector the table
holds its entry, an upper bound of the distance to it, and a lower bound of the distance to each entry. After a round the
bounds are shifted by how far the entries moved. An entry is left out only where a lower bound, or half of the distance
between entries, is strictly above the upper bound, so what may be as near is always compared, by exact integer
distances, and a tie goes to the lower index. Bounds are rounded outwards, so rounding can't leave out an entry either.

A round is one pass that writes the vectors with their bounds, and one that adds up the parts of each entry: a task gives
a row for each entry, and the driver gets ENTRIES rows a part, whatever the input. Codebooks are broadcast; they are
bounded by ENTRIES and the length of a vector.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import Scratch, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows that are compared with a codebook at a time.
CHUNK = 2048

_UP, _DOWN = np.float32(np.inf), np.float32(-np.inf)


def _above(x: np.ndarray) -> np.ndarray:
    """x as 32-bit floats that are no less."""
    return np.nextafter(x.astype(np.float32), _UP)


def _below(x: np.ndarray) -> np.ndarray:
    """x as 32-bit floats that are no more, and none below zero."""
    return np.maximum(np.nextafter(x.astype(np.float32), _DOWN), np.float32(0))


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all entries, exact: in floats where they hold the integers, else in integers."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * x.shape[1] * most * most < 1 << 53:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    out = np.zeros((len(x), len(entries)), np.int64)
    for i in range(x.shape[1]):
        out += (x[:, i : i + 1] - entries[None, :, i]) ** 2
    return out


def first_codes(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entry, upper bound and lower bounds of each row, from all distances."""
    d = squared(x, entries)
    code = d.argmin(axis=1)  # the first of equal ones
    root = np.sqrt(d)
    return code, _above(root[np.arange(len(x)), code]), _below(root)


def next_codes(x: np.ndarray, entries: np.ndarray, moved: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same after the entries have moved by at most `moved`, and how many distances that took."""
    upper, lower = _above(upper.astype(np.float64) + moved[code]), _below(lower.astype(np.float64) - moved)
    code, n = code.copy(), len(entries)
    half = _below(np.sqrt(squared(entries, entries)) / 2)
    np.fill_diagonal(half, np.inf)
    at = np.flatnonzero(upper >= half.min(axis=1)[code])  # for all others their own entry is strictly the nearest
    every = np.arange(n)
    maybe = lambda rows: (lower[rows] <= upper[rows, None]) & (half[code[rows]] <= upper[rows, None]) & (every != code[rows, None])
    at = at[maybe(at).any(axis=1)]
    own = ((x[at] - entries[code[at]]) ** 2).sum(axis=1)
    upper[at], lower[at, code[at]] = _above(np.sqrt(own)), _below(np.sqrt(own))
    row, entry = np.nonzero(maybe(at))
    d = np.empty(len(row), np.int64)
    for i in range(0, len(row), 1 << 16):
        s = slice(i, i + (1 << 16))
        d[s] = ((x[at[row[s]]] - entries[entry[s]]) ** 2).sum(axis=1)
    lower[at[row], entry] = _below(np.sqrt(d))
    order = np.lexsort((entry, d, row))
    best = order[np.concatenate([[True], row[order][1:] != row[order][:-1]])] if len(order) else order
    better = (d[best] < own[row[best]]) | ((d[best] == own[row[best]]) & (entry[best] < code[at[row[best]]]))
    best = best[better]
    code[at[row[best]]], upper[at[row[best]]] = entry[best], _above(np.sqrt(d[best]))
    return code, upper, lower, len(own) + len(row)


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _assign(books: np.ndarray, moved: np.ndarray | None):
    """books: part, entry, position. moved: how far each entry has moved, None in the first round."""
    parts, n, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, len(whole), CHUNK):
                batch = whole.slice(k, CHUNK)
                x = _vectors(batch.column("vec"))
                code, upper, lower = np.empty((len(x), parts), np.int64), np.empty((len(x), parts), np.float32), np.empty((len(x), parts, n), np.float32)
                if moved is not None:
                    code[:], upper[:], lower[:] = (np.frombuffer(b"".join(batch.column(c).to_pylist()), t).reshape(a.shape) for c, t, a in (("code", np.uint8, code), ("upper", np.float32, upper), ("lower", np.float32, lower)))
                for p in range(parts):
                    own = x[:, p * width : (p + 1) * width]
                    if moved is None:
                        code[:, p], upper[:, p], lower[:, p] = first_codes(own, books[p])
                    else:
                        code[:, p], upper[:, p], lower[:, p], _ = next_codes(own, books[p], moved[p], code[:, p], upper[:, p], lower[:, p])
                made = [pa.array([r.tobytes() for r in a], pa.binary()) for a in (code.astype(np.uint8), upper, lower)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("vec"), *made], ["vec_id", "label", "vec", "code", "upper", "lower"])

    return run


def _add_up(parts: int, n: int, width: int):
    """A row for each part and entry that a task has met: how many parts it has, and their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(parts * n, np.int64), np.zeros((parts * n, width), np.int64)
        for batch in batches:
            x = _vectors(batch.column("vec")).reshape(-1, parts, width)
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts)
            at = (code + np.arange(parts) * n).ravel()
            order = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.diff(at[order], prepend=-1))
            if len(first):
                total[at[order][first]] += np.add.reduceat(x.reshape(-1, width)[order], first, axis=0)
                count += np.bincount(at, minlength=parts * n)
        met = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(met // n, pa.int32()), pa.array(met % n, pa.int32()), pa.array(count[met]), pa.array(list(total[met]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

    return run


def _errors(books: np.ndarray):
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, codes = _vectors(batch.column("vec")).reshape(-1, parts, width), batch.column("code").to_pylist()
            code = np.frombuffer(b"".join(codes), np.uint8).reshape(-1, parts)
            error = ((x - books[np.arange(parts), code]) ** 2).sum(axis=(1, 2))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([c.hex() for c in codes], pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return run


def _moved(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(((old - new).astype(np.float64) ** 2).sum(axis=2)), np.inf) * (1 + 1e-12) * (old != new).any(axis=2)


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """One row per kept vector: vec_id, code, error, label_error, codebooks_sha256.

    A component x counts as floor(1024 * x). Vectors that are null or hold a null, NaN or infinity are dropped, and so are
    those that can't be cut into 4 equal parts or aren't as long as the vector of the least id. Codebooks begin with the
    256 vectors of the least ids (ties by components, null ids last), or as many as there are; equal entries go to the
    lower index, and an entry without parts stays. A null id or label is kept, null labels counting as one. Rows
    that repeat an id count each. Other columns are ignored. An empty table gives an empty result. Components so
    large that a squared distance could exceed 64 bits are an error.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "codes")
    vec = F.col(vec_col)
    fine = vec.isNotNull() & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.filter(F.coalesce(fine, F.lit(False)) & (F.size(vec) > 0) & (F.size(vec) % PARTS == 0))
    kept = kept.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.transform(vec, lambda x: F.floor(x.cast("double") * SCALE)).alias("vec"))
    id_type, label_type = (kept.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    out_type = f"vec_id {id_type}, label {label_type}, code string, error bigint"
    kept = scratch.write(kept, "kept")
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "vec").select(F.size("vec").alias("n")).first()
    if first is None:
        return spark.createDataFrame([], f"vec_id {id_type}, code string, error bigint, label_error bigint, codebooks_sha256 string")
    kept = kept.filter(F.size("vec") == first["n"])
    most = kept.agg(F.max(F.greatest(F.abs(F.array_max("vec")), F.abs(F.array_min("vec"))))).first()[0]
    width = first["n"] // PARTS
    if 4 * first["n"] * most * most >= 1 << 63:
        raise ValueError(f"components of up to {most} are too large for 64-bit distances")
    seeds = kept.orderBy(F.asc_nulls_last("vec_id"), "vec").select("vec").limit(ENTRIES).collect()
    books = np.array([r["vec"] for r in seeds], np.int64).reshape(len(seeds), PARTS, width).transpose(1, 0, 2).copy()

    state_type = f"vec_id {id_type}, label {label_type}, vec array<bigint>, code binary, upper binary, lower binary"
    state = scratch.write(kept.mapInArrow(_assign(books, None), state_type), "state")
    for _ in range(rounds):
        sums = state.select("vec", "code").mapInArrow(_add_up(*books.shape), "part int, entry int, n bigint, total array<bigint>")
        sums = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)])
        before, books = books, books.copy()
        for r in sums.collect():  # ENTRIES rows for each part at most
            books[r["part"], r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
        last, state = state, scratch.write(state.mapInArrow(_assign(books, _moved(before, books)), state_type), "state")
        scratch.drop(last)
    coded = scratch.write(state.select("vec_id", "label", "vec", "code").mapInArrow(_errors(books), out_type), "coded")
    scratch.drop(state)
    # both sides written, so that the join is a plain one, of which Spark splits what a label of very many vectors makes large
    per = scratch.write(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "labels")
    out = coded.join(per, coded["label"].eqNullSafe(per["of"]))
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def _round(i: int) -> str:
    """The entries of every part of every vector, by codebook c{i}, and the codebook that follows from them."""
    return f"""
a{i} AS (SELECT id, p, x, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
  SELECT v.id, v.p, v.x, c.e, CAST(list_sum(list_transform(list_zip(v.x, c.y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v JOIN c{i} c ON c.p = v.p) GROUP BY 1, 2, 3),
c{i + 1} AS (SELECT c.p, c.e, coalesce(n.y, c.y) AS y FROM c{i} c LEFT JOIN (
  SELECT p, e, list(m ORDER BY k) AS y FROM (SELECT p, e, k, CAST(floor(sum(q) / count(*)) AS BIGINT) AS m FROM (SELECT p, e, unnest(x) AS q, unnest(range(len(x))) AS k FROM a{i}) GROUP BY 1, 2, 3) GROUP BY 1, 2) n ON n.p = c.p AND n.e = c.e)"""


ORACLE = f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, vec) AS id, vec_id, label, vec FROM (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
v AS (SELECT id, p, vec[p * len(vec) // 4 + 1 : (p + 1) * len(vec) // 4] AS x FROM k, range(4) t(p)),
c0 AS (SELECT p, id - 1 AS e, x AS y FROM v WHERE id <= 256),
{",".join(_round(i) for i in range(5)).lstrip()},
code AS (SELECT id, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 GROUP BY 1),
h AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) AS h FROM c4)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM code JOIN k USING (id), h
"""
