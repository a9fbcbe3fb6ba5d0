"""The lifecycle as a stream, batch by batch, with the same rules and the same result as over the whole log.

Rows are held back until the newest one is DELAY past them, so that a batch takes them in order of time, however they fell
into batches; a prompt may come before its session's start. Rows that come later than that are set aside. What is due
later, the deadlines of stops, waits with them. Each batch reads the open sessions, finds those that its starts sweep, and
runs the workspaces that it touches through operators/machine.py, with the board's updates and pause controls of the same
stream and the visibility of repositories as it is then.

Everything is kept under one named folder, in versions by batch: a batch reads the versions of the last finished one and
writes its own, and its rows replace what an earlier try of it may have written. A stream that is cut short goes on
from there, and a batch that runs again adds nothing. Closed sessions lie in buckets by workspace, of which a batch
rewrites those that it touches.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import gates as G
from tidemark.operators import machine as M
from tidemark.operators import states as S
from tidemark.operators.lifecycle import effects
from tidemark.operators.temporal import next_at_or_after, running_count
from tidemark.sources import hooks as H
from tidemark.sources.store import names, remove, shared_folder
from tidemark.streaming.outbox import Outbox

DELAY_SECONDS = 12
BUCKETS = 16
#: Rows of the stream: hook events, controls (hook is pause or resume) and updates of the board (hook is update).
ROWS = "cwd bigint, ts timestamp_ntz, nth int, event_id bigint, hook string, session_id string, is_resume boolean, went boolean, status string, body string"
STATE = "cwd bigint, session_id string, status string, paused boolean, wrote bigint, deadline bigint, sweep_at bigint, sweep_id bigint, notified boolean, issue_session string, depth bigint"
END_OF_TIME = dt.datetime(9000, 1, 1)
_UPDATE = ["event_id", "ts", "status", "body"]


def _at(t: dt.datetime) -> Column:
    return F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")


def stream_rows(events: DataFrame) -> DataFrame:
    """The events table as rows of the stream: its hook events, and the board's updates and controls that it holds."""
    log, audit = H.hook_events(events), H.audit_rows(events, G.MARKER)
    log = log.select("cwd", "ts", F.lit(0).alias("nth"), "event_id", "hook", F.lit(None).cast("string").alias("session_id"), "is_resume", F.lit(True).alias("went"))
    updates = audit.select(F.col("project").alias("cwd"), F.col("created_at").alias("ts"), F.lit(0).alias("nth"), F.col("update_id").alias("event_id"), F.lit("update").alias("hook"), "status", "body")
    return log.unionByName(S.control_rows(G.controls(audit))).unionByName(updates, allowMissingColumns=True)


class Tracker:
    """A stream's state under the folder `root`. seen() gives the visibility of repositories (cwd, visibility), and is asked
    for each batch. Events without a session id belong to their workspace's latest start; sessions are numbered. Effects of
    each batch go to the outbox, if there is one, before the batch counts as finished."""

    def __init__(self, spark: SparkSession, root: str, seen: Callable[[], DataFrame], delay_seconds: int = DELAY_SECONDS, buckets: int = BUCKETS, stop_gate: bool = True, outbox: Outbox | None = None):
        self.spark, self.root, self.seen, self.buckets, self.stop_gate = spark, root.rstrip("/"), seen, buckets, stop_gate
        self.delay, self.outbox = dt.timedelta(seconds=delay_seconds), outbox

    def start(self, rows: DataFrame) -> StreamingQuery:
        """The stream of rows (ROWS, those that are missing are null) into this state, until all there is has been read."""
        return rows.writeStream.foreachBatch(lambda df, i: self.batch(df, i)).option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start()

    def finished(self) -> list[int]:
        return sorted(int(n[2:]) for n in names(self.spark, f"{self.root}/done") if n.startswith("v="))

    def rows(self) -> DataFrame:
        """All that finished batches gave, a row for each event, control that names a session, timer and sweep."""
        parts = [f"{self.root}/rows/v={v}" for v in self.finished()]
        return self.spark.read.schema(self._row_type()).parquet(*parts) if parts else self.spark.createDataFrame([], self._row_type())

    def rest(self) -> DataFrame:
        """What comes of the rows that are held back and of pending deadlines, as if the stream had ended. Nothing of that is kept."""
        v = max(self.finished(), default=-1) + 1
        self.batch(self.spark.createDataFrame([], ROWS), v, END_OF_TIME)
        return self._read("rows", v, self._row_type())

    def rows_to_the_end(self) -> DataFrame:
        return self.rows().unionByName(self.rest())

    def outcome(self) -> S.Outcome:
        """The same as for a whole log: decisions, runtime status, history, and what operators/lifecycle.py makes of them. Its
        effects are exactly once, as a batch that runs again replaces its rows."""
        return S.Outcome(self.rows())

    def late(self) -> DataFrame:
        """Rows that came after their time had been settled, or have no time."""
        parts = [f"{self.root}/late/v={v}" for v in self.finished()]
        return self.spark.read.schema(ROWS).parquet(*parts) if parts else self.spark.createDataFrame([], ROWS)

    def _row_type(self):
        out = self.spark.createDataFrame([], f"cwd bigint, piece int, {M.OUTPUT_TYPES}")
        return S.shown(out).schema

    def _read(self, part: str, v: int | None, schema) -> DataFrame:
        return self.spark.createDataFrame([], schema) if v is None else self.spark.read.schema(schema).parquet(f"{self.root}/{part}/v={v}")

    def _write(self, df: DataFrame, part: str, v: int) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{part}/v={v}")
        return self._read(part, v, df.schema)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("cwd"), F.lit(self.buckets)).cast("int").alias("bucket")

    def _closed(self, buckets: list[int], before: int) -> DataFrame:
        """Closed sessions of these buckets, each from the last finished batch that wrote it."""
        newest = {}
        for v in (v for v in self.finished() if v < before):
            newest |= {int(n[7:]): v for n in names(self.spark, f"{self.root}/closed/v={v}") if n.startswith("bucket=")}
        paths = [f"{self.root}/closed/v={newest[k]}/bucket={k}" for k in buckets if k in newest]
        return self.spark.read.schema(STATE).parquet(*paths) if paths else self.spark.createDataFrame([], STATE)

    def _named(self, events: DataFrame, last: int | None, v: int) -> DataFrame:
        """Events without a session id get that of their workspace's latest start, counting on from the last batch."""
        before = self._read("counts", last, "cwd bigint, n bigint")
        bare = running_count(events.filter("session_id is null"), ["cwd"], F.col("hook") == "SessionStart", "ts", "event_id", "own")
        bare = bare.join(before, "cwd", "left").withColumn("n", F.coalesce("n", F.lit(0)) + F.col("own"))
        bare = self._write(bare.withColumn("session_id", F.concat_ws("-", F.col("cwd").cast("string"), F.col("n").cast("string"))).drop("own"), "named", v)
        self._write(before.unionByName(bare.select("cwd", "n")).groupBy("cwd").agg(F.max("n").alias("n")), "counts", v)
        return bare.drop("n").unionByName(events.filter("session_id is not null"))

    def batch(self, rows: DataFrame, v: int, upto: dt.datetime | None = None) -> None:
        """Takes a batch of rows; upto: settle all up to then, and don't count as finished."""
        last = max((x for x in self.finished() if x < v), default=None)
        settled = self._read("done", last, "upto timestamp_ntz").first()
        settled = settled and settled["upto"]
        columns = [F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.spark.createDataFrame([], ROWS).schema]
        rows.select(*columns).write.mode("overwrite").parquet(f"{self.root}/new/v={v}")
        new, final = self._read("new", v, ROWS), upto is not None
        in_time = F.col("ts").isNotNull() if settled is None else F.coalesce(F.col("ts") > _at(settled), F.lit(False))
        self._write(new.filter(~in_time), "late", v)
        newest = new.agg(F.max("ts")).first()[0]
        upto = upto or max((t for t in (settled, newest and newest - self.delay) if t), default=dt.datetime(1, 1, 1))
        waiting = self._read("pending", last, ROWS).unionByName(new.filter(in_time))
        now = waiting.filter(F.col("ts") <= _at(upto))

        events = self._named(now.filter("hook not in ('update', 'pause', 'resume', 'deadline')"), last, v)
        due = S.event_rows(events.filter("hook = 'Stop'")).filter("hook = 'deadline'")
        rest = waiting.filter(F.col("ts") > _at(upto)).unionByName(due.filter(F.col("ts") > _at(upto)), allowMissingColumns=True)
        self._write(rest, "pending", v)
        acting = now.filter("hook in ('pause', 'resume', 'deadline')").unionByName(events).select(*S.ROW).unionByName(due.filter(F.col("ts") <= _at(upto)))

        updates = self._read("board", last, ROWS).select(*_UPDATE).unionByName(now.filter("hook = 'update'").select(*_UPDATE))
        newest_updates = updates.orderBy(F.desc("ts"), F.desc("event_id")).limit(G.NEWEST)
        self._write(self.spark.createDataFrame([], ROWS).unionByName(newest_updates, allowMissingColumns=True), "board", v)
        board = G.board_history(updates.withColumnsRenamed({"ts": "created_at", "event_id": "update_id"}))
        gated = self._write(S.gate(acting, self.seen(), board), "gated", v)
        starts = S.passing(gated)

        # open sessions that a start of this batch sweeps, unless they are written before
        there = self._read("open", last, STATE).withColumn("due", F.timestamp_micros("wrote").cast("timestamp_ntz") + F.expr(S.IDLE))
        there = next_at_or_after(there, starts, "due", "start_ts", ["start_ts", "start_id"], right_order="start_id")
        there = there.withColumns({"sweep_at": F.coalesce("sweep_at", F.unix_micros(F.col("start_ts").cast("timestamp"))), "sweep_id": F.coalesce("sweep_id", "start_id")}).select(*[c.split()[0] for c in STATE.split(", ")])
        there = self._write(there, "there", v)
        touched = self._write(gated.select("cwd").unionByName(there.filter("sweep_at is not null").select("cwd")).distinct(), "touched", v)
        buckets = [r["bucket"] for r in touched.select(self._bucket()).distinct().collect()]  # `buckets` at most
        closed = self._closed(buckets, v)
        carried = there.join(touched, "cwd", "left_semi").unionByName(closed.join(gated.select("session_id").distinct(), "session_id", "left_semi"))
        one = {"piece": F.lit(0), "last": F.lit(True)}
        out = self._write(S.run_machine(S.machine_rows(gated, starts).withColumns(one), carried.withColumns(one), self.stop_gate, ends=True), "out", v)

        self._write(S.shown(out), "rows", v)
        ends = out.filter("kind = 'end'").select(*there.columns)
        self._write(there.join(touched, "cwd", "left_anti").unionByName(ends.filter("status <> 'closed'")), "open", v)
        closed = closed.join(ends.select("session_id"), "session_id", "left_anti").unionByName(ends.filter("status = 'closed'"))
        closed.withColumn("bucket", self._bucket()).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/closed/v={v}")
        if final:
            return
        if self.outbox:
            self.outbox.put(effects(S.Outcome(self._read("rows", v, self._row_type()))), v)
        self._write(self.spark.createDataFrame([(upto,)], "upto timestamp_ntz"), "done", v)
        for part in ("new", "named", "counts", "pending", "board", "gated", "open", "there", "touched", "out"):
            for n in names(self.spark, f"{self.root}/{part}"):
                if last is not None and int(n[2:]) < last:  # the last batch's are kept, for a batch that runs again
                    remove(self.spark, f"{self.root}/{part}/{n}")


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream. A batch takes all files that are there: a table's files may overlap in time, and what comes
    later than DELAY_SECONDS after a batch before it is set aside."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return stream_rows(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet"))


def run_available(spark: SparkSession, sf_dir: str, root: str | None = None) -> DataFrame:
    """All events there are, through the stream, and the history of sessions that comes of them, to the end.

    root: the stream's folder; a run with the same folder goes on where the last one was. A new one in the shared folder, if none is named.
    """
    seen = lambda: G.visibilities(H.table(spark, sf_dir, "customer"))
    tracker = Tracker(spark, root or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}", seen)
    tracker.start(read_events(spark, sf_dir)).awaitTermination()
    return S.history(tracker.rows_to_the_end())


def run_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The effects of all events there are: what the stream's batches put into an outbox, and what comes after the last one."""
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    outbox = Outbox(spark, f"{root}/outbox")
    tracker = Tracker(spark, root, lambda: G.visibilities(H.table(spark, sf_dir, "customer")), outbox=outbox)
    tracker.start(read_events(spark, sf_dir)).awaitTermination()
    rest = effects(S.Outcome(tracker.rest()))
    return outbox.read().select(*rest.columns).unionByName(rest)
