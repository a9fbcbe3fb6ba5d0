"""Sessions' states in order of events: gates and pauses that act, timers, sweeps and resumed sessions.

What a row needs from other workspaces (what the board says at that time, which start sweeps next) is looked up by as-of
joins. The rows of each workspace are then sorted and streamed through operators/machine.py, which has the rules. A
workspace of more than PIECE rows is cut into pieces of time, which run at once as if each were the first; a piece
whose sessions turn out to begin otherwise than it was run with runs again, until nothing changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.operators import gates as G
from tidemark.operators import machine as M
from tidemark.operators.temporal import around, next_at_or_after
from tidemark.sources.store import drop, written

IDLE_SECONDS = M.IDLE_SECONDS
IDLE = f"interval {IDLE_SECONDS} seconds"
#: Rows of a workspace that are taken one after the other; a piece ends with the hour in which it has that many.
PIECE = 200_000

_CARRY = "carry"
_ORDER = ("at", "nth", "event_id", "session_id")
_TYPES = f"cwd bigint, piece int, {M.OUTPUT_TYPES}"
#: What only a next piece or batch needs.
_INNER = ("piece", "wrote", "deadline", "sweep_at", "sweep_id")
#: What tells the last state of each session and the last word on each workspace.
_BRIEF = ("cwd", "kind", "session_id", "at", "nth", "event_id", "runtime", "writes", "status", "paused")


def _time(us: str) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def _us(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


#: What gates and the machine need of a row.
ROW = ["cwd", "ts", "nth", "event_id", "hook", "session_id", "is_resume", "went"]


def event_rows(log: DataFrame) -> DataFrame:
    """Events, and the deadline of each stop, which comes before an event at the same time."""
    stop, due = F.col("hook") == "Stop", F.col("nth") == -1
    events = log.withColumn("nth", F.explode(F.when(stop, F.array(F.lit(0), F.lit(-1))).otherwise(F.array(F.lit(0)))))
    return events.select("cwd", F.when(due, F.expr(f"ts + {IDLE}")).otherwise(F.col("ts")).alias("ts"), "nth", "event_id", F.when(due, "deadline").otherwise(F.col("hook")).alias("hook"), "session_id", F.coalesce("is_resume", F.lit(False)).alias("is_resume"), F.lit(True).alias("went"))


def control_rows(controls: DataFrame) -> DataFrame:
    """Controls, which come after an event at the same time."""
    return controls.select("cwd", "ts", F.lit(1).alias("nth"), F.lit(None).cast("long").alias("event_id"), F.col("action").alias("hook"), F.lit(None).cast("string").alias("session_id"), F.lit(False).alias("is_resume"), F.col("ok").alias("went"))


def gate(rows: DataFrame, seen: DataFrame, board: DataFrame) -> DataFrame:
    """Rows with whether the board is inactive then, and why their workspace's starts may not be tracked. A workspace
    that the lookup `seen` doesn't have fails the privacy check."""
    return _with_reason(G.board_asof(rows, board).withColumn("inactive", G.is_inactive(F.col("board_status"))).drop("board_status"), seen)


def _with_reason(rows: DataFrame, seen: DataFrame) -> DataFrame:
    return rows.join(seen, "cwd", "left").withColumn("reason", G.privacy(F.col("visibility"))).drop("visibility")


def passing(rows: DataFrame) -> DataFrame:
    """Starts that pass their gates, and so sweep."""
    return rows.filter("hook = 'SessionStart' and reason = 'ok' and not inactive").select(F.col("ts").alias("start_ts"), F.col("event_id").alias("start_id"))


def machine_rows(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """cwd and the machine's input."""
    rows = next_at_or_after(rows.withColumn("due", F.expr(f"ts + {IDLE}")), starts, "due", "start_ts", ["start_ts", "start_id"], right_order="start_id")
    return rows.select("cwd", _us("ts").alias("at"), "nth", "event_id", "hook", "session_id", "is_resume", "reason", "inactive", "went", _us("start_ts").alias("next_at"), F.col("start_id").alias("next_id"))


def _values(column: pa.Array) -> list:
    """What to_pylist gives, through numpy, which takes a fraction of its time."""
    if column.null_count == len(column):
        return [None] * len(column)
    if not pa.types.is_integer(column.type):
        return column.to_numpy(zero_copy_only=False).tolist()
    found = column.fill_null(0).to_numpy(zero_copy_only=False).tolist()
    if not column.null_count:
        return found
    return [x if there else None for x, there in zip(found, column.is_valid().to_numpy(zero_copy_only=False).tolist(), strict=True)]


def _fold(schema: pa.Schema, carried: bool, stop_gate: bool, ends: bool, whole: bool = False, brief: bool = False):
    """Rows (cwd, piece, last, the machine's input, and kind and what is carried, if anything is) sorted by workspace, piece
    and time. Sweeps after the last row count where the piece is its workspace's last; else, or with ends, the sessions at its
    end are given. whole: workspaces come in one piece each, without piece and last. brief: of what a workspace gives within a batch only the last rows (M.Lasts)."""
    lead, parts = (("cwd",), 1) if whole else (("cwd", "piece", "last"), 2)
    columns = (*lead, *M.INPUT, *(("kind", *M.CARRIED) if carried else ()))
    a, b = len(lead), len(lead) + len(M.INPUT)
    given = [(i, schema.field(c).type) for i, c in enumerate((*lead[:parts], *M.OUTPUT)) if c in schema.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin = M.Lasts if brief else M.Machine
        state, key, last, done = begin(stop_gate), None, False, []

        def close() -> None:
            if key is None:
                return
            if last:
                state.settle(None)
            if ends or not last:
                state.ends()
            take()

        def take() -> None:
            done.extend((*key, *x) for x in state.taken())

        def flush() -> Iterator[pa.RecordBatch]:
            if done:
                made = list(zip(*done, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(made[i], t) for i, t in given], schema=schema)
                done.clear()

        for batch in batches:
            for x in zip(*(_values(batch.column(c)) for c in columns), strict=True):
                if x[:parts] != key:
                    close()
                    state, key, last = begin(stop_gate), x[:parts], whole or x[2]
                if carried and x[b] == _CARRY:
                    state.carry(x[a + M.INPUT.index("session_id")], *x[b + 1 :])
                else:
                    state.row(*x[a:b])
            if key is not None:
                take()
            yield from flush()
        close()
        yield from flush()

    return run


def run_machine(rows: DataFrame, carried: DataFrame | None = None, stop_gate: bool = True, ends: bool = False, inner: bool = True) -> DataFrame:
    """rows: cwd, piece, last and the machine's input. carried: cwd, piece, last, session_id and what is carried of it.
    inner: whether to give what only a next piece or batch needs."""
    out = StructType([f for f in StructType.fromDDL(_TYPES) if inner or f.name not in _INNER])
    rows, first = rows.select("cwd", "piece", "last", *M.INPUT), []
    if carried is not None:
        rows = rows.withColumn("kind", F.lit(None).cast("string")).unionByName(carried.select("cwd", "piece", "last", "session_id", *M.CARRIED).withColumn("kind", F.lit(_CARRY)), allowMissingColumns=True)
        types = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(_TYPES)}
        rows = rows.select("cwd", "piece", "last", *M.INPUT, "kind", *[F.col(c).cast(types[c]) for c in M.CARRIED])
        first = [F.col("kind").isNull(), "wrote"]
    dealt = rows.repartition("cwd", "piece").sortWithinPartitions("cwd", "piece", *first, *_ORDER)
    return dealt.mapInArrow(_fold(to_arrow_schema(out), carried is not None, stop_gate, ends), out)


def _run_whole(rows: DataFrame, seen: DataFrame, stop_gate: bool, brief: bool) -> DataFrame:
    """The machine over workspaces in one piece each: rows without their reason, which `seen` gives them where they are dealt."""
    dealt = _with_reason(rows.repartition("cwd"), seen.hint("shuffle_hash")).withColumn("reason", F.when(F.col("hook") == "SessionStart", F.col("reason")))
    dealt = dealt.select("cwd", *M.INPUT).sortWithinPartitions("cwd", *_ORDER)
    types = StructType.fromDDL(_TYPES)
    out = StructType([f for f in types if (f.name in _BRIEF if brief else f.name not in _INNER)])
    return dealt.mapInArrow(_fold(to_arrow_schema(out), False, stop_gate, False, True, brief), out)


def _pieces(rows: DataFrame, piece: int) -> DataFrame:
    """Rows with the piece of their workspace's history that they are in, and whether it is the last."""
    hours = rows.withColumn("hour", F.floor(F.col("at") / 3_600_000_000))
    per = hours.groupBy("cwd", "hour").agg(F.count("*").alias("n"))
    order = Window.partitionBy("cwd").orderBy("hour")
    per = per.withColumn("nth_piece", F.floor((F.sum("n").over(order) - F.col("n")) / piece))
    per = per.withColumn("piece", F.dense_rank().over(Window.partitionBy("cwd").orderBy("nth_piece")) - 1)
    per = per.withColumn("last", F.col("piece") == F.max("piece").over(Window.partitionBy("cwd"))).select("cwd", "hour", "piece", "last")
    return hours.join(per, ["cwd", "hour"]).drop("hour")


def _in_pieces(rows: DataFrame, piece: int, stop_gate: bool) -> DataFrame:
    """The machine over workspaces of many rows: all pieces at once, then again those that begin otherwise than they were run with."""
    rows = written(_pieces(rows, piece), "pieces")
    most = rows.agg(F.max("piece")).first()[0] or 0
    until = rows.filter("session_id is not null").groupBy("session_id").agg(F.max("piece").alias("until"))
    lasts = rows.select("cwd", "piece", "last").distinct()
    out, given = written(run_machine(rows, None, stop_gate), "folded"), None
    for _ in range(most + 1):
        # sessions that are open, or of which more rows come
        left = out.filter("kind = 'end'").drop("kind").join(until, "session_id").filter("status <> 'closed' or until > piece")
        begins = left.withColumn("piece", F.col("piece") + 1).join(lasts, ["cwd", "piece"]).select("cwd", "piece", "last", "session_id", *M.CARRIED)
        begins = written(begins, "begins")
        other = begins if given is None else begins.exceptAll(given).unionByName(given.exceptAll(begins))
        changed = written(other.select("cwd", "piece").distinct(), "changed")
        if changed.isEmpty():
            drop(rows, begins, changed, given)
            return out
        again = run_machine(rows.join(changed, ["cwd", "piece"], "left_semi"), begins.join(changed, ["cwd", "piece"], "left_semi"), stop_gate)
        before, out = out, written(out.join(changed, ["cwd", "piece"], "left_anti").unionByName(again), "folded")
        drop(before, changed, given)
        given = begins
    raise RuntimeError(f"states still change after {most + 1} rounds of {most + 1} pieces")


class Outcome:
    """What follows from the machine's rows: every event, every control that names a session, every timer that fires and every
    sweep, each with what it decides and changes and the state that it leaves."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def decisions(self) -> DataFrame:
        """Every event with what it meets first: no state, a pause, the privacy gate (starts alone), the board gate (not the end), or nothing."""
        return self.rows.filter("kind = 'event'").select("event_id", "session_id", "cwd", "ts", "hook", "decision")

    def runtime(self) -> DataFrame:
        """Each workspace's last save or clear of the reason why nothing is tracked, by an event or a stop's timer."""
        said = self.rows.filter("runtime is not null").groupBy("cwd").agg(F.max_by(F.struct("ts", "kind", "event_id", "runtime"), F.struct("ts", "nth", "event_id")).alias("last"))
        return said.select("cwd", F.col("last.ts").alias("at_ts"), F.col("last.kind").alias("cause"), "last.event_id", F.col("last.runtime").alias("decision"), G.blocked_text(F.col("last.runtime")).alias("text"))

    @property
    def resumed(self) -> DataFrame:
        """Resuming starts with the session that each resumes."""
        return self.rows.filter("resumes is not null").select("event_id", "session_id", "cwd", "ts", "resumes")

    @property
    def writes(self) -> DataFrame:
        """Events and controls that change a session's state file, with the status after them."""
        return self.rows.filter("writes and kind in ('event', 'control')")

    def closings(self) -> DataFrame:
        """session_id, cwd, at_ts, cause (timer or sweep) and the start that swept: once for each time a session closes by itself."""
        ends = self.rows.filter("kind in ('timer', 'sweep') and sets = 'closed'")
        return ends.select("session_id", "cwd", F.col("ts").alias("at_ts"), F.col("kind").alias("cause"), F.when(F.col("kind") == "sweep", F.col("event_id")).alias("swept_by"))

    def history(self) -> DataFrame:
        """session_id, at_ts, cause (event, control, timer or sweep), event_id, hook, status after it and whether that is the session's last row."""
        return history(self.rows)

    def current(self) -> DataFrame:
        return self.history().filter("is_current").select("session_id", "status")


def shown(out: DataFrame) -> DataFrame:
    """The machine's output with its times as times."""
    return out.filter("kind <> 'end'").withColumn("ts", _time("at")).drop("at", *_INNER)


def history(rows: DataFrame) -> DataFrame:
    rows = rows.filter("writes and (kind in ('event', 'control') or sets = 'closed')")
    # at the same time a sweep comes before a timer, and both before a write
    order = Window.partitionBy("session_id").orderBy("ts", "nth", "event_id")
    event = F.when(F.col("kind").isin("event", "sweep"), F.col("event_id"))
    return rows.select("session_id", F.col("ts").alias("at_ts"), F.col("kind").alias("cause"), event.alias("event_id"), "hook", "status", F.lead("ts").over(order).isNull().alias("is_current"))


def large_workspaces(plain: DataFrame, controls: DataFrame, piece: int = PIECE) -> DataFrame:
    """A written table of the workspaces (cwd) that have more than `piece` rows: events, stops' deadlines and controls."""
    each = plain.select("cwd", F.when(F.col("hook") == "Stop", 2).otherwise(1).alias("n")).unionByName(controls.select("cwd", F.lit(1).alias("n")))
    return written(each.groupBy("cwd").agg(F.sum("n").alias("n")).filter(F.col("n") > piece).select("cwd"), "hot")


def looked_up(log: DataFrame, audit: DataFrame, seen: DataFrame, controls: DataFrame, stop_gate: bool = True, piece: int = PIECE, plain: DataFrame | None = None, hot: DataFrame | None = None, brief: bool = False) -> tuple[DataFrame, list[DataFrame]]:
    """The machine's rows (see States), or with brief at least the last ones of each session and workspace, which are enough for
    last_of; and the written tables that they read, to be dropped after that. plain: the log's event_id, ts, cwd and hook, where
    they come at a lesser cost than with its sessions. hot: what large_workspaces gives of these."""
    plain = log if plain is None else plain
    hot = large_workspaces(plain, controls, piece) if hot is None else hot
    board = written(G.board_history(audit), "board")
    starts = plain.filter("hook = 'SessionStart'").select("cwd", "ts", "event_id", "hook")
    starts = written(passing(gate(starts, seen.hint("shuffle_hash"), board)).withColumn("from_ts", F.expr(f"start_ts - {IDLE}")), "starts")
    times = plain.select(F.explode(F.array("ts", F.expr(f"ts + {IDLE}"))).alias("ts")).unionByName(controls.select("ts"))
    acting = event_rows(log).unionByName(control_rows(controls))
    rows = around(acting, "ts", (board, "created_at", ["board_status"], "update_id"), (starts, "from_ts", ["start_ts", "start_id"], "start_id"), times)
    rows = rows.select("cwd", _us("ts").alias("at"), "nth", "event_id", "hook", "session_id", "is_resume", G.is_inactive(F.col("board_status")).alias("inactive"), "went", _us("start_ts").alias("next_at"), F.col("start_id").alias("next_id"))
    if hot.isEmpty():
        drop(hot)
        return shown(_run_whole(rows, seen, stop_gate, brief)), [board, starts]
    rows = written(rows, "gated")
    drop(board, starts)
    cut = shown(_in_pieces(_with_reason(rows.join(hot, "cwd", "left_semi"), seen), piece, stop_gate))
    whole = shown(_run_whole(rows.join(hot, "cwd", "left_anti"), seen, stop_gate, brief))
    return whole.unionByName(cut.select(whole.columns)), [hot, rows]


def last_of(rows: DataFrame) -> DataFrame:
    """cwd, its open session that was written last (session_id, status, paused; null if there is none), and what its last save or
    clear of the reason why nothing is tracked said (decision), of the machine's rows."""
    at = F.struct("ts", "nth", "event_id")
    wrote = F.max_by(F.struct("status", "paused", "ts"), F.when(F.col("writes"), at)).alias("last")
    said = F.max_by(F.struct(at.alias("at"), "runtime"), F.when(F.col("runtime").isNotNull(), at)).alias("said")
    per = rows.groupBy("cwd", "session_id").agg(wrote, said)
    newest = F.max_by(F.struct("session_id", "last.status", "last.paused"), F.when(F.col("last.status") != "closed", F.struct("last.ts", "session_id")))
    per = per.groupBy("cwd").agg(newest.alias("a"), F.max_by("said.runtime", "said.at").alias("decision"))
    return per.select("cwd", "a.*", "decision")


class States(Outcome):
    """All that follows from a log, the board's updates, the visibility of repositories and pause controls.

    log: event_id, ts, cwd, hook, session_id, is_resume; audit: created_at, update_id, status, body; seen: cwd, visibility;
    controls: cwd, action (pause or resume), ts, ok. One table is written, of the rows of all.
    """

    def __init__(self, log: DataFrame, audit: DataFrame, seen: DataFrame, controls: DataFrame, stop_gate: bool = True, piece: int = PIECE, plain: DataFrame | None = None, hot: DataFrame | None = None):
        out, read = looked_up(log, audit, seen, controls, stop_gate, piece, plain, hot)
        super().__init__(written(out, "states"))
        drop(*read)

    def drop(self) -> None:
        drop(self.rows)
