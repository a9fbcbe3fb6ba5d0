"""Audit of five document filters: what each removes in every order, by a Walsh-Hadamard transform.

A document's failures are a mask of five bits. For each part and kind of label, 32 signed sums are aggregated: for every
set of filters, documents that fail an even number of them less those that fail an odd number. Sums combine before they
shuffle, and a part has 4 rows of them, whatever its documents. The transform is its own inverse but for a factor of 32, so
it gives back the number of documents of each mask exactly. From there on all is arithmetic on 32 cells: the
documents that a set of filters leaves, for all 32 sets, give every step of all 120 orders; a document that fails m
filters is removed by each of them in 120 / m orders.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import WORD, Scratch, table

FILTERS = "ABCDE"
CELLS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Fixed values of the filters: words, percent of distinct words, percent of capitals, characters.
FEWEST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, ODD = 100, 80, 10, "[#$%&*|]"
_REPEATED = 1 << FILTERS.index("E")


def failures(text: Column) -> Column:
    """The mask of the filters A to D that a text fails."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    few = F.size(words) < FEWEST_WORDS
    poor = 100 * F.size(F.array_distinct(words)).cast("long") < LEAST_DISTINCT * F.size(words).cast("long")
    loud = 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > MOST_CAPITALS * F.length(text).cast("long")
    return sum((F.when(on, 1 << i).otherwise(0) for i, on in enumerate((few, poor, loud, text.rlike(ODD)))), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, mask, good and toxic of each document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), failures(text).alias("own"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    rows = scratch.write(rows, "rows")
    # both sides written, so that the joins are plain ones, of which Spark splits what a text with very many copies makes large
    first = scratch.write(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first"), "first")
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id"))
    known = scratch.write(known.agg(F.coalesce(F.max("quality") == 1, F.lit(False)).alias("good"), F.coalesce(F.max("toxic") == 1, F.lit(False)).alias("toxic")), "known")
    both = rows.join(first, "digest", "left").join(known, "doc_id", "left")
    again = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return both.select("part", (F.col("own") + F.when(again, _REPEATED).otherwise(0)).alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def _sign(a: Column, b: Column) -> Column:
    return F.lit(1).cast("long") - 2 * (F.bit_count(a.bitwiseAND(b)) % 2)


def _all(f) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), f)


def _total(f) -> Column:
    return F.aggregate(F.sequence(F.lit(0), F.lit(CELLS - 1)), F.lit(0).cast("long"), lambda acc, i: acc + f(i))


def cells(found: DataFrame) -> DataFrame:
    """part, good, toxic and cells: the number of documents of each mask, out of the signed sums of all 32 sets of filters."""
    sums = found.groupBy("part", "good", "toxic").agg(F.array(*[F.sum(_sign(F.col("mask"), F.lit(w))) for w in range(CELLS)]).alias("sums"))
    inverse = _all(lambda m: F.shiftright(_total(lambda w: _sign(m, w) * F.get("sums", w)), len(FILTERS)))
    return sums.select("part", "good", "toxic", inverse.alias("cells"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """A row for each part, order of the filters and step, with the counts kept, removed, redundant, unique_fails,
    good_lost, toxic_lost and shapley.

    The filters: A fewer than 100 words; B less than 80 % of them distinct, as they are written; C over 10 % of all
    characters are A-Z; D any of # $ % & * |; E a text that a smaller id has too, anywhere in the table. Null texts are empty
    ones and fail A alone (or E as well); texts are the same when all their bytes are. A null part counts with the empty
    one. A document with a null id is never E and makes no other so; rows that repeat an id and text aren't E by each
    other. A label counts where it is 1 (contradicting ones of an id: their largest); a document without one is neither
    good nor toxic. Columns of docs and labels that aren't named here are ignored. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "audit")
    each = cells(masks(docs, labels, scratch, id_col, text_col, part_col))
    kinds = each.groupBy("part").agg(F.collect_list(F.struct("good", "toxic", "cells")).alias("kinds"))  # 4 at most
    of = lambda on: _all(lambda m: F.aggregate(F.filter("kinds", on), F.lit(0).cast("long"), lambda acc, k: acc + F.get(k["cells"], m)))
    per = kinds.select("part", of(lambda k: F.lit(True)).alias("all"), of(lambda k: k["good"]).alias("good"), of(lambda k: k["toxic"]).alias("toxic"))
    # what every set of filters leaves
    left = lambda c: _all(lambda s: _total(lambda m: F.when(s.bitwiseAND(m) == 0, F.get(c, m)).otherwise(0).cast("long")))
    share = lambda f: _total(lambda m: F.when(m.bitwiseAND(f) != 0, F.get("all", m) * (F.lit(120) / F.greatest(F.bit_count(m), F.lit(1))).cast("long")).otherwise(0).cast("long"))
    per = per.select("part", "all", left("all").alias("left"), left("good").alias("left_good"), left("toxic").alias("left_toxic"), F.array(*[share(F.lit(1 << i)) for i in range(len(FILTERS))]).alias("shares"))
    per = scratch.write(per, "parts")
    out = per.withColumn("filter_order", F.explode(F.array(*[F.lit(o) for o in ORDERS]))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bits = lambda letters: sum((F.when(F.contains(letters, F.lit(f)), 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    out = out.withColumns({"nth": F.instr(F.lit(FILTERS), letter) - 1, "own": bits(letter), "before": bits(F.substring("filter_order", F.lit(1), F.col("step") - 1))})
    out = out.withColumn("after", F.col("before").bitwiseOR(F.col("own")))
    gone = lambda c: F.get(c, F.col("before")) - F.get(c, F.col("after"))
    fails = F.get("left", F.lit(0)) - F.get("left", F.col("own"))
    return out.select(
        "part", "filter_order", "step", F.get("left", F.col("after")).alias("kept"), gone("left").alias("removed"), (fails - gone("left")).alias("redundant"), F.get("all", F.col("own")).alias("unique_fails"),
        gone("left_good").alias("good_lost"), gone("left_toxic").alias("toxic_lost"), F.get("shares", F.col("nth")).alias("shapley"),
    )


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
d AS (SELECT part, len(words) < 100 AS "A", 100 * len(list_distinct(words)) < 80 * len(words) AS "B", 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS "C",
  regexp_matches(text, '[#$%&*|]') AS "D", coalesce(w.doc_id > first, false) AS "E", coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
-- kinds of documents by the letters that they fail
k AS (SELECT part, concat(CASE WHEN "A" THEN 'A' ELSE '' END, CASE WHEN "B" THEN 'B' ELSE '' END, CASE WHEN "C" THEN 'C' ELSE '' END, CASE WHEN "D" THEN 'D' ELSE '' END, CASE WHEN "E" THEN 'E' ELSE '' END) AS fails, good, toxic, count(*) AS n FROM d GROUP BY ALL),
x(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT concat(a.c, b.c, c.c, d.c, e.c) AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
f AS (SELECT filter_order, step, filter_order[step] AS letter, filter_order[1:step - 1] AS earlier FROM s),
r AS (SELECT k.part, filter_order, step, letter, n, good, toxic, contains(fails, letter) AS fails_it, length(fails) AS many, length(translate(fails, earlier, '')) < length(fails) AS gone FROM k, f),
g AS (SELECT part, filter_order, step, letter, CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND NOT fails_it), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND fails_it), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (WHERE gone AND fails_it), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (WHERE fails_it AND many = 1), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND fails_it AND good), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND fails_it AND toxic), 0) AS BIGINT) AS toxic_lost FROM r GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM g
"""
