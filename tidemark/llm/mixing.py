"""Mixing sources to target weights by entropy balancing, with DataFrame operations alone.

Each document gets the rate exp(lambda * size), at most MOST_COPIES, that moves the least from one copy each, in
relative entropy, while its source's tokens come to the target. lambda of a source is the root of a convex dual's
gradient; Newton steps for all sources run together, each one aggregation over (source, size, documents) counts.
Their sums are of decimals, so no order of the rows changes them and reruns agree.

Rates become copies of size classes: running sums of copies, from long to short, are rounded, which misses a source's
tokens by half of its longest document at most. A few classes in each power of two of lengths, from long to short, then
take or give copies to make up for it, down to about half of the shortest document. Copies of a class go to its
documents in salted cells, so one huge class is spread over many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._common import Scratch, n_words, table

MOST_COPIES = 3
WEIGHTS = (1, 2, 3)
STEPS = 80
TOLERANCE = 1e-7
#: A class's documents are dealt to cells of about this many rows.
CELL_ROWS = 200_000
LEAST_CELLS = 16
#: Size classes in each power of two of lengths that make up for what rounding missed.
EACH = 16

_RATE = f"exp(least(lam * size / scale, {math.log(MOST_COPIES)!r}D))"


#: Sums of this type don't depend on their order.
_EXACT = "decimal(28,9)"


def _targets(hist: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """A row for each source: source_size, scale and target. One task sorts the sources, not their documents."""
    per = hist.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum(F.col("n").cast("decimal(20,0)") * F.col("size") * F.col("size")).cast("double").alias("squares"))
    order = Window.orderBy("key")
    nth = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("w", nth[F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))])
    per = per.withColumn("most", MOST_COPIES * F.col("source_size").cast("double")).withColumn("ratio", F.col("most") / F.col("w"))
    # target = min(most, level * w); the level is the one at which all targets sum to all sizes
    whole = Window.partitionBy()
    fill = Window.orderBy("ratio", "key").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("total", F.sum("source_size").over(whole).cast("double"))
    per = per.withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(fill), F.lit(0.0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(fill), F.lit(0.0))))
    # sources in order of ratio are full until one's ratio exceeds the level there; that level holds for the rest
    per = per.withColumn("level", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct(F.col("ratio"), F.col("key"), F.col("level")))).over(whole)["level"])
    per = per.withColumn("target", F.least(F.col("most"), F.coalesce(F.col("level"), F.lit(math.inf)) * F.col("w")))
    return per.select("key", "source_size", "target", F.greatest(F.coalesce(F.try_divide("squares", "source_size"), F.lit(1.0)), F.lit(1.0)).alias("scale"))


def _balance(hist: DataFrame, targets: DataFrame, scratch: Scratch) -> DataFrame:
    """lam for each source, by Newton's method on log(tokens) - log(target), kept within a bracket."""
    full = F.col("target") >= F.col("source_size") * MOST_COPIES * (1 - 1e-9)
    state = targets.withColumns({"lam": F.when(full, F.lit(1e9)).otherwise(F.lit(0.0)), "lo": F.lit(-1e6), "hi": F.lit(1e6), "done": full | (F.col("source_size") == 0)})
    state = scratch.write(state, "state")
    for _ in range(STEPS):
        open_ = state.filter("not done").select("key", "lam", "scale")
        rated = hist.join(open_, "key").withColumn("x", F.col("size") / F.col("scale")).withColumn("tokens", F.expr(f"n * size * {_RATE}"))
        slope = F.when(F.expr(f"lam * x < {math.log(MOST_COPIES)!r}D"), F.col("tokens") * F.col("x")).otherwise(0.0)
        sums = rated.groupBy("key").agg(F.sum(F.col("tokens").cast(_EXACT)).cast("double").alias("got"), F.sum(slope.cast(_EXACT)).cast("double").alias("slope"))
        new = state.join(sums, "key", "left")
        gap = F.log("got") - F.log("target")
        new = new.withColumn("lo", F.when(F.col("got") < F.col("target"), F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("got") > F.col("target"), F.col("lam")).otherwise(F.col("hi")))
        step = F.col("lam") - F.try_divide(gap * F.col("got"), F.col("slope"))
        wide = (F.col("hi") - F.col("lo")) > 1e5
        halved = F.when(wide & (F.col("got") < F.col("target")), F.col("lam") * 2 + 1).when(wide, F.col("lam") - F.abs("lam") - 1).otherwise((F.col("lo") + F.col("hi")) / 2)
        good = (F.col("slope") > 0) & (step > F.col("lo")) & (step < F.col("hi")) & (F.abs(step - F.col("lam")) <= 50 + F.abs("lam"))
        # doubles end a bracket before the tolerance only where a target is as good as met
        close = (F.abs(F.col("got") - F.col("target")) <= TOLERANCE * F.col("target")) | (F.col("hi") - F.col("lo") <= 1e-12 * F.greatest(F.abs("lo"), F.abs("hi")))
        held = F.col("done") | F.coalesce(close, F.lit(True))
        new = new.withColumn("lam", F.when(held, F.col("lam")).when(good, step).otherwise(halved)).withColumn("done", held)
        before, state = state, scratch.write(new.drop("got", "slope"), "state")
        scratch.drop(before)
        if state.filter("not done").isEmpty():
            return state.select("key", "source_size", "target", "scale", "lam")
    raise RuntimeError(f"rates don't meet their targets after {STEPS} steps")


def _copies(classes: DataFrame) -> DataFrame:
    """copies of each class (key, source_size, target, size, n, want tokens): near want, and together near the target."""
    longest_first = Window.partitionBy("key").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)
    exact = F.when(F.col("size") > 0, F.col("want") / F.col("size")).otherwise(0.0).cast(_EXACT)
    upto = classes.withColumn("exact", exact).withColumn("sum", F.sum("exact").over(longest_first))
    first = (F.round("sum") - F.round(F.col("sum") - F.col("exact"))).cast("long")
    made = upto.withColumn("first", F.least(F.greatest(first, F.lit(0).cast("long")), MOST_COPIES * F.col("n")))
    # of each power of two the EACH shortest classes; a source has as many powers as a length has bits
    shortest = Window.partitionBy("key", F.floor(F.log2("size"))).orderBy("size")
    some = made.filter("size > 0").withColumn("nth", F.row_number().over(shortest)).filter(F.col("nth") <= EACH)
    some = some.groupBy("key").agg(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("short"), "n", "first"))).alias("some"))
    missed = made.groupBy("key").agg((F.max("target").cast(_EXACT) - F.sum(F.col("first") * F.col("size"))).alias("missed"))
    fold = f"""aggregate(some, named_struct('missed', cast(missed as double), 'moved', cast(array() as array<struct<size: bigint, more: bigint>>)), (s, c) ->
      transform(array(greatest(-c.first, least({MOST_COPIES}L * c.n - c.first, cast(round(s.missed / -c.short) as bigint)))), k ->
        named_struct('missed', s.missed + k * c.short, 'moved', concat(s.moved, array(named_struct('size', -c.short, 'more', k)))))[0], s -> s.moved)"""
    moved = some.join(missed, "key").select("key", F.expr(f"inline({fold})"))
    out = made.join(moved, ["key", "size"], "left")
    return out.select("key", "source_size", "target", "size", "n", (F.col("first") + F.coalesce("more", F.lit(0).cast("long"))).alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken.

    size counts the words of the text (null and empty: 0); taken is that times the document's copies, 0 to
    MOST_COPIES. Sources in order of code points, null last, have the weights in turn. A repeated row counts as a
    document of its own. A document or source without words takes none. Other columns are ignored. An empty table
    gives an empty result. The choice depends on ids and sizes alone, so reruns agree.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    key = F.coalesce(F.concat(F.lit("1"), F.col(source_col).cast("string")), F.lit("2"))
    base = scratch.write(docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), n_words(F.col(text_col)).alias("size")), "sizes")
    hist = scratch.write(base.groupBy("key", "size").agg(F.count("*").alias("n")), "counts")
    rates = _balance(hist, _targets(hist, weights), scratch)
    classes = hist.join(rates, "key").withColumn("want", F.expr(f"n * size * {_RATE}"))
    given = scratch.write(_copies(classes), "copies")

    cells = max(LEAST_CELLS, -(-base.count() // CELL_ROWS))
    dealt = base.withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.lit(cells)).cast("int"))
    own = dealt.groupBy("key", "size", "cell").agg(F.count("*").cast("decimal(20,0)").alias("m")).join(given.hint("merge"), ["key", "size"])
    before = F.sum("m").over(Window.partitionBy("key", "size").orderBy("cell")) - F.col("m")
    own = own.withColumn("before", before).selectExpr("key", "size", "cell", "source_size", "target", "copies div n as each", "floor((before + m) * (copies % n) / n) - floor(before * (copies % n) / n) as more")
    ranked = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("key", "size", "cell").orderBy("doc_id")))
    return ranked.join(own.hint("merge"), ["key", "size", "cell"]).select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("each") + (F.col("nth") <= F.col("more")).cast("long"))).alias("taken"))


def op5_mix(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
