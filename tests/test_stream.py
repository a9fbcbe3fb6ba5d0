"""The lifecycle as a stream against the whole log, and batches that come in disorder, again, or late."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_core import at
from tidemark.operators import gates, lifecycle, states
from tidemark.plans import catalogue
from tidemark.sources import hooks
from tidemark.sources.store import names, remove
from tidemark.streaming import lifecycle as L
from tidemark.streaming.outbox import Outbox

SCHEMA = "cwd long, ts timestamp_ntz, event_id long, hook string, session_id string, is_resume boolean, went boolean, status string, body string"
START, PROMPT, STOP, END = "SessionStart", "UserPromptSubmit", "Stop", "SessionEnd"


def rows_of(spark, rows):
    """rows: (seconds, cwd, hook, n), or (seconds, cwd, pause or resume, ok), or (seconds, None, update, status)."""
    made = []
    for i, (t, cwd, hook, x) in enumerate(rows):
        event = hook in (START, PROMPT, STOP, END)
        made.append((cwd, None if t is None else at(t), int((t or 0) * 10), hook, f"{cwd}-{x}" if event else None, False, True if event else x if isinstance(x, bool) else None, x if hook == "update" else None, gates.MARKER))
    return spark.createDataFrame(made, SCHEMA).withColumn("nth", F.when(F.col("hook").isin("pause", "resume"), 1).otherwise(0))


def tracker(spark, folder, private=lambda: range(1, 9), **how):
    return L.Tracker(spark, str(folder), lambda: spark.createDataFrame([(c, "private") for c in private()], "cwd long, visibility string"), **how)


def shown(df):
    return sorted((r["session_id"] or "", r["kind"], r["ts"], r["hook"] or "", r["decision"] or "", r["status"] or "") for r in df.collect())


def test_shuffled_files_give_the_batch_result(spark, sf_dir, tmp_path):
    """Rows shuffled within twelve seconds, in files that overlap; the stream is cut short in between and goes on."""
    events = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/events.parquet").collect()]
    rng, schema = random.Random(7), spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events.sort(key=lambda e: e["ts"].timestamp() + rng.uniform(0, 11.9))
    cuts = [0, 250, 600, len(events)]
    (tmp_path / "in").mkdir()
    runs = []
    for i in range(3):
        spark.createDataFrame(events[cuts[i] : cuts[i + 1]], schema).coalesce(1).write.parquet(str(tmp_path / "made" / str(i)))
        for f in (tmp_path / "made" / str(i)).glob("*.parquet"):
            f.rename(tmp_path / "in" / f"{i}.parquet")
        own = L.Tracker(spark, str(tmp_path / "state"), lambda: gates.visibilities(hooks.table(spark, sf_dir, "customer")))
        own.start(L.stream_rows(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))).awaitTermination()
        runs.append(own.rows().count())
    assert own.finished() == [0, 1, 2] and runs[0] < runs[1] < runs[2] and own.late().isEmpty()
    got = sorted(map(str, states.history(own.rows_to_the_end()).collect()))
    assert got == sorted(map(str, catalogue.states(spark, sf_dir).history().collect()))
    assert own.rows().count() == runs[2]  # the look to the end has kept nothing


def test_early_late_and_repeated_rows(spark, tmp_path):
    own = tracker(spark, tmp_path)
    own.batch(rows_of(spark, [(5, 1, PROMPT, 1), (0, 2, START, 1)]), 0)  # a prompt before its start
    own.batch(rows_of(spark, [(4, 1, START, 1), (30, 1, STOP, 1), (1, 2, PROMPT, 1)]), 1)
    first = shown(own.rows())
    own.batch(rows_of(spark, [(2000, 1, PROMPT, 1), (10, 2, STOP, 1), (None, 2, STOP, 1)]), 2)  # 10 s is settled by now
    assert ("1-1", "event", at(5), PROMPT, "ok", "responding") in first and [r["hook"] for r in own.late().collect()] == [STOP, STOP]
    then, sent = shown(own.rows()), sorted(map(str, lifecycle.effects(own.outcome()).collect()))
    assert ("1-1", "timer", at(1830), "", "", "closed") in then
    own.batch(rows_of(spark, [(2000, 1, PROMPT, 1), (10, 2, STOP, 1), (None, 2, STOP, 1)]), 2)  # the same batch again
    assert shown(own.rows()) == then and own.finished() == [0, 1, 2]
    assert sorted(map(str, lifecycle.effects(own.outcome()).collect())) == sent and len(sent) == len(set(sent))


def test_gates_controls_and_sweeps_act_between_batches(spark, tmp_path):
    seen = {1, 2, 3}
    own = tracker(spark, tmp_path, lambda: sorted(seen))
    own.batch(rows_of(spark, [(0, 1, START, 1), (1, 2, START, 1), (2, 4, START, 1), (10, 1, "pause", True), (100, 3, START, 1)]), 0)
    seen.add(4)
    own.batch(rows_of(spark, [(200, 1, PROMPT, 1), (210, None, "update", "INACTIVE"), (220, 2, PROMPT, 1), (230, 4, PROMPT, 1), (240, 4, START, 2), (250, None, "update", "ON_TRACK"), (260, 4, START, 3), (400, 1, "resume", True)]), 1)
    own.batch(rows_of(spark, [(500, 1, PROMPT, 1), (2500, 4, START, 4), (2600, 3, PROMPT, 1)]), 2)
    got = {(r["session_id"], int((r["ts"] - at(0)).total_seconds())): r["decision"] for r in own.rows_to_the_end().filter("kind = 'event'").collect()}
    assert got[("4-1", 2)] == gates.UNCHECKED and got[("4-1", 230)] == "no_state" and got[("4-2", 240)] == "project_inactive" and got[("4-3", 260)] == "ok"
    assert got[("1-1", 200)] == "paused" and got[("2-1", 220)] == "project_inactive" and got[("1-1", 500)] == "ok"
    swept = {(r["session_id"], r["ts"]) for r in own.rows_to_the_end().filter("kind = 'sweep'").collect()}
    assert swept == {("1-1", at(2500)), ("2-1", at(2500)), ("3-1", at(2500)), ("4-3", at(2500))}


def test_a_batch_rewrites_the_buckets_it_touches(spark, tmp_path):
    own = tracker(spark, tmp_path, lambda: range(40), buckets=8)
    own.batch(rows_of(spark, [(c, c, h, 1) for c in range(40) for h in (START,)] + [(c + 50, c, END, 1) for c in range(40)] + [(200, 0, PROMPT, 1)]), 0)
    own.batch(rows_of(spark, [(300, 5, PROMPT, 1), (310, 5, END, 1), (400, 5, START, 2)]), 1)
    folders = {v: [n for n in names(spark, f"{tmp_path}/closed/v={v}") if n.startswith("bucket=")] for v in (0, 1)}
    assert len(folders[0]) > 4 and len(folders[1]) == 2  # that of workspace 5, and of 0, whose prompt was held back
    own.batch(rows_of(spark, [(500, 7, PROMPT, 1), (600, 7, END, 1)]), 2)
    whole = {r["session_id"]: r["status"] for r in states.history(own.rows_to_the_end()).filter("is_current").collect()}
    assert len(whole) == 41 and whole["7-1"] == "closed"


@pytest.mark.parametrize("empty", [[], [(5, 1, PROMPT, 1)]])
def test_nothing_yet(spark, tmp_path, empty):
    own = tracker(spark, tmp_path)
    assert own.rows().isEmpty() and own.late().isEmpty()
    own.batch(rows_of(spark, empty), 0)
    assert own.rows().isEmpty() and own.rows_to_the_end().count() == len(empty)


def test_effects_go_to_the_outbox_once(spark, tmp_path):
    """Batches that run again, or stop after their effects were put and before they count as finished, add nothing."""
    box = Outbox(spark, f"{tmp_path}/outbox")
    own = tracker(spark, tmp_path / "state", outbox=box)
    batches = [[(0, 1, START, 1), (5, 1, PROMPT, 1), (60, 2, START, 1)], [(100, 1, STOP, 1), (3000, 1, PROMPT, 1)], [(3010, 2, END, 1), (9000, 3, START, 1)]]
    for v, rows in enumerate(batches):
        own.batch(rows_of(spark, rows), v)
        if v == 1:
            remove(spark, f"{tmp_path}/state/done/v=1")  # cut short
            own.batch(rows_of(spark, rows), v)
    own.batch(rows_of(spark, batches[2]), 2)
    kept = ["session_id", "at_ts", "event_id", "kind", "value"]
    got = sorted(map(str, box.read().select(*kept).collect()))
    assert got == sorted(map(str, lifecycle.effects(own.outcome()).select(*kept).collect())) and len(got) == len(set(got)) > 10
    before = box.read().count()
    assert not own.rest().isEmpty() and box.read().count() == before  # the look to the end puts nothing


def test_files_that_overlap_in_time_lose_nothing(spark, sf_dir, tmp_path):
    """A table in files that each span the whole time gives the effects of the log: none of its rows counts as late."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    for i in range(3):
        events.filter(F.col("event_id") % 3 == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    hooks.table(spark, sf_dir, "customer").write.parquet(f"{tmp_path}/customer.parquet")
    kept = ["session_id", "at_ts", "event_id", "kind", "value"]
    got = sorted(map(str, L.run_effects(spark, str(tmp_path)).select(*kept).collect()))
    assert got == sorted(map(str, lifecycle.effects(catalogue.states(spark, sf_dir)).select(*kept).collect()))
