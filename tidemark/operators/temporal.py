"""Latest row, as-of and next-at-or-after joins without range joins.

Rows of both sides meet in one sort within (keys, time bucket), and every window grows from its first row, so a bucket is
read once. What a bucket doesn't decide comes from a table of one row for each bucket, so neither a single task nor a
single key has to hold all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Buckets of rows without a time.
SPREAD = 4096


def latest_by(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The columns of each key's row that is last in order; combines before it shuffles."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("latest")).select(*keys, "latest.*")


def bucket(ts: Column, unit: str) -> Column:
    return F.date_trunc(unit, ts.cast("timestamp")).cast("timestamp_ntz")


def _untimed(rows: DataFrame, back: bool) -> Column:
    """One of SPREAD hours before all times (or after them, looking ahead) for a row without a time: there it finds nothing,
    and such rows don't share a bucket."""
    hashed = F.xxhash64(*[f.name for f in rows.schema if not f.dataType.simpleString().startswith(("map", "variant"))])
    first = "timestamp_ntz'0001-01-01 00:00:00'" if back else "timestamp_ntz'9999-01-01 00:00:00'"
    return F.expr(first) + F.make_dt_interval(hours=F.pmod(hashed, F.lit(SPREAD)).cast("int"))


def _order(right_order: str | None) -> Column:
    return F.col(right_order) if right_order else F.lit(0)


def _nearest(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, take: list[str], keys: list[str] | None, unit: str, right_order: str | None, back: bool) -> DataFrame:
    """The last right row at or before each left one (back), or the first at or after it."""
    keys, cols = keys or [], left.columns
    r = right.select(*keys, bucket(F.col(right_ts), unit).alias("_b"), F.col(right_ts).alias("_t"), _order(right_order).alias("_o"), F.struct(*take).alias("_r"), F.lit(0).alias("_side"))
    l = left.withColumns({"_b": F.coalesce(bucket(F.col(left_ts), unit), _untimed(left, back)), "_t": F.col(left_ts), "_side": F.lit(1)})  # noqa: E741
    both = l.unionByName(r, allowMissingColumns=True)
    turn = F.asc if back else F.desc
    # at the same time the right row comes before the left one, whichever way
    within = Window.partitionBy(*keys, "_b").orderBy(turn("_t"), "_side", turn("_o")).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_own", F.last("_r", ignorenulls=True).over(within)).filter("_side = 1")
    pick = F.max_by if back else F.min_by
    ends = r.groupBy(*keys, "_b").agg(pick("_r", F.struct("_t", "_o")).alias("_end"))
    buckets = l.select(*keys, "_b").distinct().join(ends, [*keys, "_b"], "full")
    beyond = Window.partitionBy(*keys).orderBy(turn("_b")).rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("_beyond", F.last("_end", ignorenulls=True).over(beyond)).select(*keys, "_b", "_beyond")
    out = both.join(buckets, [*keys, "_b"], "left").withColumn("_hit", F.coalesce("_own", "_beyond"))
    return out.select(*cols, *[F.col("_hit")[c].alias(c) for c in take])


def asof_join(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, take: list[str], keys: list[str] | None = None, unit: str = "HOUR", right_order: str | None = None) -> DataFrame:
    """left with the columns `take` of the last right row at or before its time (null if none), within keys.

    Columns of left and take mustn't share names. Of right rows at the same time, the greatest right_order counts. A left
    row without a time gets nulls.
    """
    return _nearest(left, right.filter(F.col(right_ts).isNotNull()), left_ts, right_ts, take, keys, unit, right_order, True)


def next_at_or_after(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, take: list[str], keys: list[str] | None = None, unit: str = "HOUR", right_order: str | None = None) -> DataFrame:
    """left with the columns `take` of the first right row at or after its time (null if none), within keys; of right rows
    at the same time, the least right_order. A left row without a time gets nulls."""
    return _nearest(left, right.filter(F.col(right_ts).isNotNull()), left_ts, right_ts, take, keys, unit, right_order, False)


def around(left: DataFrame, left_ts: str, before: tuple, after: tuple, times: DataFrame | None = None, unit: str = "HOUR") -> DataFrame:
    """What asof_join with `before` and then next_at_or_after with `after` give without keys, in one shuffle of left's rows.

    before and after: the right rows, their time, what to take of them and their order at the same time (right, right_ts,
    take, right_order). times: rows that have, under left_ts, all of left's times and maybe others, where they cost less than left.
    """
    times, cols = left if times is None else times, left.columns
    l = left.withColumns({"_b": F.coalesce(bucket(F.col(left_ts), unit), _untimed(left, True)), "_t": F.col(left_ts), "_side": F.lit(1)})  # noqa: E741
    both, buckets = l, times.filter(F.col(left_ts).isNotNull()).select(bucket(F.col(left_ts), unit).alias("_b")).distinct()
    for r, (right, right_ts, take, order) in (("_back", before), ("_ahead", after)):
        right = right.filter(F.col(right_ts).isNotNull()).select(bucket(F.col(right_ts), unit).alias("_b"), F.col(right_ts).alias("_t"), F.col(order).alias("_o"), F.struct(*take).alias(r))
        both = both.unionByName(right.withColumn("_side", F.lit(0)), allowMissingColumns=True)
        pick = F.max_by if r == "_back" else F.min_by
        buckets = buckets.join(right.groupBy("_b").agg(pick(r, F.struct("_t", "_o")).alias(f"_end{r}")), "_b", "full")
    # in order of time first: the windows' own sorts, which begin with the bucket, then find their rows in runs
    both = both.repartition("_b").sortWithinPartitions("_t", "_side", "_o")
    for r, turn in (("_back", F.asc), ("_ahead", F.desc)):
        within = Window.partitionBy("_b").orderBy(turn("_t"), "_side", turn("_o")).rowsBetween(Window.unboundedPreceding, 0)
        both = both.withColumn(f"_own{r}", F.last(r, ignorenulls=True).over(within))
        beyond = Window.orderBy(turn("_b")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
        buckets = buckets.withColumn(f"_beyond{r}", F.last(f"_end{r}", ignorenulls=True).over(beyond))
    out = both.filter("_side = 1").join(buckets.select("_b", "_beyond_back", "_beyond_ahead"), "_b", "left")
    hits = [F.coalesce(f"_own{r}", f"_beyond{r}")[c].alias(c) for r, (_, _, take, _) in (("_back", before), ("_ahead", after)) for c in take]
    return out.select(*cols, *hits)


def numbered(df: DataFrame, ts: str, order: str, unit: str = "HOUR") -> DataFrame:
    """df with `rank`, a row's place among all in (ts, order), from 1. Buckets are counted and numbered each by itself."""
    own = df.withColumn("_b", bucket(F.col(ts), unit))
    before = own.groupBy("_b").agg(F.count("*").alias("_n"))
    before = before.withColumn("_before", F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).select("_b", "_before")  # a row for each bucket
    own = own.withColumn("_nth", F.row_number().over(Window.partitionBy("_b").orderBy(ts, order)))
    return own.join(before, "_b").withColumn("rank", F.col("_before") + F.col("_nth")).drop("_b", "_before", "_nth")


def running_count(df: DataFrame, keys: list[str], flag: Column, ts: str, order: str, name: str, unit: str = "DAY", large: DataFrame | None = None) -> DataFrame:
    """df with `name`: how many of its key's rows up to this one have the flag. Each of a key's buckets is sorted by itself; if
    `large` gives the keys that have many rows, only theirs are, and the rows of any other key at once. Rows without a key or time go."""
    if large is not None:
        few, some = df.dropna(subset=[*keys, ts]), not large.isEmpty()
        upto = Window.partitionBy(*keys).orderBy(ts, order).rowsBetween(Window.unboundedPreceding, 0)
        counted = F.sum(F.coalesce(flag, F.lit(False)).cast("long")).over(upto)
        whole = (few.join(large, keys, "left_anti") if some else few).withColumn(name, counted)
        return whole.unionByName(running_count(df.join(large, keys, "left_semi"), keys, flag, ts, order, name, unit)) if some else whole
    own = df.withColumns({"_b": bucket(F.col(ts), unit), "_f": F.coalesce(flag, F.lit(False)).cast("long")})
    per = own.groupBy(*keys, "_b").agg(F.sum("_f").alias("_n"))
    per = per.withColumn("_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b")) - F.col("_n")).drop("_n")
    upto = Window.partitionBy(*keys, "_b").orderBy(ts, order).rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("_own", F.sum("_f").over(upto))
    return own.join(per, [*keys, "_b"]).withColumn(name, F.col("_own") + F.col("_before")).drop("_b", "_f", "_own", "_before")


def running_last(df: DataFrame, keys: list[str], value: Column, ts: str, order: str, name: str, unit: str = "DAY") -> DataFrame:
    """df with `name`: the last value that isn't null of its key's rows up to this one. Each of a key's buckets is sorted by itself."""
    own = df.withColumns({"_b": bucket(F.col(ts), unit), "_v": value})
    upto = Window.partitionBy(*keys, "_b").orderBy(ts, order).rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("_own", F.last("_v", ignorenulls=True).over(upto))
    per = own.groupBy(*keys, "_b").agg(F.max_by("_own", F.struct(ts, order)).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_before", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    return own.join(per, [*keys, "_b"]).withColumn(name, F.coalesce("_own", "_before")).drop("_b", "_v", "_own", "_before")
