"""Scalars, files, temporal joins and state rules on small fixtures."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import env, text, urls
from tidemark.operators import content, gates, install, lifecycle, remote, states, temporal
from tidemark.sources import files, hooks

DAY = dt.datetime(2024, 1, 1)


def at(seconds):
    return DAY + dt.timedelta(seconds=seconds)


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], [*values]) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def log(spark, rows):
    """rows: (seconds, cwd, hook, n, is_resume)."""
    made = [(i, at(s), c, h, n, f"{c}-{n}", r) for i, (s, c, h, n, r) in enumerate(rows)]
    return spark.createDataFrame(made, "event_id long, ts timestamp_ntz, cwd long, hook string, n long, session_id string, is_resume boolean")


def test_strict_and_loose_repos(spark):
    cases = {
        "https://github.com/o/r.git": ("o/r", "o/r"), "git@github.com:o/r": ("o/r", "o/r"), "ssh://git@ssh.github.com/o/r.git": ("o/r", None), "https://github.com/o": (None, None),
        "https://example.org/o/r": (None, None), "https://github.com/o/widget": ("o/widget", "o/widge"), "https://github.com/a/b/c": ("a/b", "b/c"), "": (None, None),
    }
    for url, (strict, loose) in cases.items():
        assert one(spark, urls.repo_strict(F.lit(url))) == strict
        if loose:
            assert one(spark, urls.repo_loose(F.lit(url))) == loose


def test_titles_and_blanks(spark):
    assert one(spark, text.strip_ws(F.lit(" \n x y 　"))) == "x y"
    assert one(spark, text.title_prefix(F.lit("c" * 40), F.lit("p" * 90))) == "[" + "c" * 30 + "...] " + "p" * 44
    assert one(spark, text.title_prefix(F.lit(""), F.lit("p" * 90))) == "p" * 80
    assert one(spark, text.normal_path(F.lit("/a//b/./c/"))) == "/a/b/c" and one(spark, text.folder_name(F.lit("/"))) == "workspace"
    assert one(spark, text.name_mode(F.lit(" Label "))) == "label" and one(spark, text.name_mode(F.lit("x"))) == "prefix"
    assert one(spark, text.answer_line(F.lit("q"), F.lit("a"), F.lit(""))) == "- **q** → a"
    assert one(spark, text.sync_text(F.lit("t"), F.lit(False), F.lit("s"), F.lit("no answer"))) == "failed (no answer)"


def test_env_lines(spark, tmp_path):
    p = tmp_path / "config.env"
    p.write_text("# c\nA=1 # x\nB='q#r'\n\nA=2\nC=a=b\n")
    (tmp_path / "first.env").write_text("A=0\n")
    assert dict(files.env_file(spark, [str(p)]).collect()) == {"A": "2", "B": "q#r", "C": "a=b"}
    assert dict(files.env_file(spark, [str(tmp_path / "first.env"), str(p)], last=False).collect())["A"] == "0"
    assert one(spark, env.env_text({"A": F.lit("1")}, {"B": F.lit(""), "C": F.lit("3")})) == "A=1\nC=3\n"


def test_environment_wins_and_idle_seconds(spark, tmp_path):
    (tmp_path / "c.env").write_text("A=1\r\nB=2\r\n")
    assert dict(files.env_file(spark, [str(tmp_path / "c.env")], last=False, environment={"A": "9", "Z": "8"}).collect()) == {"A": "9", "B": "2", "Z": "8"}
    assert one(spark, text.idle_seconds(F.lit(" 60 "))) == 60 and one(spark, text.idle_seconds(F.lit(None).cast("string"))) == 1800
    with pytest.raises(Exception):
        one(spark, text.idle_seconds(F.lit("soon")))
    assert one(spark, text.iso_utc(F.lit(at(1)))) == "2024-01-01T00:00:01.000Z" and one(spark, text.iso_plain(F.lit(at(1)))) == "2024-01-01T00:00:01.000000"
    (tmp_path / "os-release").write_text('ID="Rocky"\nID_LIKE="rhel fedora"\n')
    assert files.distro_family(files.env_file(spark, [str(tmp_path / "os-release")])).first()["family"] == "fedora"


def test_payloads_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"session_id": f"s{i}", "hook_event_name": h}) for i, h in enumerate(("Stop", "SessionEnd", "PostToolUse"))) + "\nbroken\n")
    query = hooks.payload_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("payloads").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r["session_id"], r["hook_event_name"]) for r in spark.table("payloads").collect()} == {("s0", "Stop"), ("s1", "SessionEnd")}
    with pytest.raises(Exception):
        hooks.parse_payloads(spark.createDataFrame([("broken",)], "value string"), strict=True).collect()


def test_commands(spark, sf_dir):
    from tidemark import api

    assert {r["status"] for r in api.dispatch("pause")(spark, sf_dir).collect()} == {"INACTIVE"} and {r["status"] for r in api.dispatch("resume")(spark, sf_dir).collect()} == {"ON_TRACK"}
    assert "next_step" in api.dispatch(None)(spark, sf_dir).columns and "removed" in api.dispatch("uninstall")(spark, sf_dir).columns
    assert one(spark, remote.settings_text(F.create_map(F.lit("hooks"), F.lit("x")))) == '{"hooks":"x"}'


def test_state_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"session_id": "a", "status": "waiting", "issue_number": 42, "tracking_paused": True}))
    (tmp_path / "b.json").write_text("{broken")
    rows = {r["file_id"]: r for r in files.states(spark, str(tmp_path)).collect()}
    assert rows["a"]["valid"] and rows["a"]["issue_number"] == 42 and not rows["b"]["valid"] and rows["b"]["session_id"] is None


def test_transcripts_and_settings(spark, tmp_path):
    t = tmp_path / "t"
    t.mkdir()
    (t / "yes.jsonl").write_text('{"type": "file-history-snapshot"}\n{"type": "x"}\n')
    (t / "no.jsonl").write_text("nonsense\n")
    got = {r["file_path"].rsplit("/", 1)[1]: r["is_resume"] for r in files.is_resume(spark, str(t)).collect()}
    assert got == {"yes.jsonl": True, "no.jsonl": False}
    s = tmp_path / "settings.json"
    s.write_text(json.dumps({"hooks": {"Stop": [{"hooks": [{"type": "command", "command": "python3 /x/stop.py"}]}]}}))
    rows = {r["scope"]: r for r in files.settings(spark, [("user", str(s)), ("local", str(tmp_path / "none.json"))], ["stop.py"]).collect()}
    assert rows["user"]["installed"] and not rows["user"]["invalid"] and not rows["local"]["exists"]


def test_payloads(spark):
    good = {"session_id": "s", "hook_event_name": "PostToolUse", "tool_name": "AskUserQuestion"}
    lines = [json.dumps(good), "not json", json.dumps({"prompt": "x"}), json.dumps(good | {"tool_name": "Bash"}), json.dumps(good | {"hook_event_name": "Stop"})]
    parsed = hooks.parse_payloads(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert parsed.count() == 3 and hooks.route(parsed).count() == 2


def test_asof_and_next_across_buckets(spark):
    left = spark.createDataFrame([(1, at(10)), (2, at(90_000)), (3, at(500_000)), (4, at(0))], "i long, t timestamp_ntz")
    right = spark.createDataFrame([(at(10), "a", 1), (at(10), "b", 2), (at(86_000), "c", 3), (at(400_000), "d", 4)], "u timestamp_ntz, v string, o long")
    got = {r["i"]: r["v"] for r in temporal.asof_join(left, right, "t", "u", ["v"], right_order="o").collect()}
    assert got == {1: "b", 2: "c", 3: "d", 4: None}
    got = {r["i"]: r["v"] for r in temporal.next_at_or_after(left, right, "t", "u", ["v"], right_order="o").collect()}
    assert got == {1: "a", 2: "d", 3: None, 4: "a"}


def test_idle_boundary(spark):
    df = log(spark, [(0, 1, "SessionStart", 1, False), (10, 1, "Stop", 1, False), (1810, 1, "UserPromptSubmit", 1, False), (2000, 1, "Stop", 1, False), (3799, 1, "SessionEnd", 1, False)])
    assert [r["closes"] for r in lifecycle.idle_close(df).orderBy("event_id").collect()] == [True, False]


def test_sweep_takes_stale_sessions_alone(spark):
    df = log(spark, [(0, 1, "SessionStart", 1, False), (5, 2, "SessionStart", 1, False), (7, 2, "SessionEnd", 1, False), (1800, 3, "SessionStart", 1, False)])
    rows = lifecycle.stale_sweep(df).collect()
    assert [(r["session_id"], r["swept_by"]) for r in rows] == [("1-1", 3)]


def audit_of(spark, rows):
    """rows: (seconds, status, marked)."""
    made = [(i, at(t), status, gates.MARKER if marked else "by hand") for i, (t, status, marked) in enumerate(rows)]
    return spark.createDataFrame(made, "update_id long, created_at timestamp_ntz, status string, body string")


def test_states_in_order_of_events(spark):
    """Starts, ends, timers, sweeps, pauses, gates and resumed sessions, each in a workspace of its own."""
    start, prompt, stop, end = "SessionStart", "UserPromptSubmit", "Stop", "SessionEnd"
    rows = [
        (0, 1, start, 1, False), (100, 1, start, 2, False), (200, 1, end, 2, False), (300, 1, start, 3, True),  # the newest that is open, not the newest
        (1, 2, start, 1, False), (10, 2, stop, 1, False), (900, 2, start, 2, True),  # a resumed session's timer is cancelled
        (5000, 3, start, 1, False), (5010, 3, end, 1, False), (5020, 3, end, 1, False), (5030, 3, prompt, 1, False), (5040, 3, end, 1, False),
        (6000, 4, start, 1, False), (6010, 4, prompt, 1, False), (6020, 4, stop, 1, False), (6030, 4, end, 1, False), (6050, 4, end, 1, False),
        (7000, 5, start, 1, False), (7010, 5, stop, 1, False),  # at its deadline the board is inactive
        (10610, 6, start, 1, False), (7100, 7, start, 1, False), (8850, 7, prompt, 1, False),
        (20000, 8, start, 1, False), (20010, 8, stop, 1, False), (21810, 8, end, 1, False),  # a write at the deadline comes too late
        (6100, 11, start, 1, False), (6110, 11, prompt, 1, False), (6200, 12, start, 1, False), (8860, 9, start, 1, False), (8870, 9, prompt, 1, False),
    ]
    events = log(spark, rows).withColumn("k", F.lit(1))
    audit = audit_of(spark, [(8800, "INACTIVE", True), (9000, "ON_TRACK", True)])
    seen = spark.createDataFrame([(i, "public" if i == 11 else "private") for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 11)], "cwd long, visibility string")
    controls = spark.createDataFrame([(4, "pause", at(6005), True), (4, "resume", at(6035), False), (4, "resume", at(6040), True), (9, "pause", at(8865), True)], "cwd long, action string, ts timestamp_ntz, ok boolean")
    s = states.States(events, audit, seen, controls)
    assert {(r["session_id"], r["resumes"]) for r in s.resumed.collect()} == {("1-3", "1-1"), ("2-2", "2-1")}
    closed = {(r["session_id"], r["cause"], int((r["at_ts"] - DAY).total_seconds())) for r in s.closings().collect()}
    assert closed == {(x, "sweep", 5000) for x in ("1-1", "1-3", "2-1", "2-2")} | {("5-1", "sweep", 10610), ("6-1", "sweep", 20000), ("7-1", "sweep", 20000), ("8-1", "timer", 21810)}
    history = s.history().collect()
    assert {r["session_id"] for r in history} == {"1-1", "1-2", "1-3", "2-1", "2-2", "3-1", "4-1", "5-1", "6-1", "7-1", "8-1"}
    own = [(r["hook"], r["status"]) for r in sorted(history, key=lambda r: r["at_ts"]) if r["session_id"] == "4-1"]
    assert own == [(start, "registered"), ("pause", "registered"), (stop, "registered"), (end, "registered"), ("resume", "registered"), ("resume", "registered"), (end, "closed")]
    assert [r["status"] for r in sorted(history, key=lambda r: r["at_ts"]) if r["session_id"] == "7-1"] == ["registered", "registered", "closed"]
    sent = lifecycle.effects(s).collect()
    closes = sorted((r["session_id"], int((r["at_ts"] - DAY).total_seconds())) for r in sent if r["kind"] == "close")
    assert closes == sorted([(x, t) for x, _, t in closed] + [("1-2", 200), ("3-1", 5010), ("3-1", 5040), ("4-1", 6050)])
    assert {r["session_id"] for r in sent if r["kind"] == "resumed"} == {"1-3", "2-2"} and not [r for r in sent if r["kind"] == "issue" and r["session_id"] in ("1-3", "2-2")]
    chain = {r["session_id"]: (r["issue_session"], r["depth"], r["shared_item"]) for r in lifecycle.issue_chain(s).collect()}
    assert chain["1-3"] == ("1-1", 1, True) and chain["1-1"] == ("1-1", 0, True) and chain["1-2"] == ("1-2", 0, False)
    assert {r["status"]: r["sessions"] for r in lifecycle.board_snapshot(s).collect()} == {"closed": 11}


def test_a_chain_of_resumptions(spark):
    rows = [(100 * i, 1, "SessionStart", i, i > 1) for i in range(1, 8)] + [(250, 1, "UserPromptSubmit", 2, False)]
    seen = spark.createDataFrame([(1, "private")], "cwd long, visibility string")
    none = spark.createDataFrame([], "cwd long, action string, ts timestamp_ntz, ok boolean")
    s = states.States(log(spark, rows).withColumn("k", F.lit(1)), audit_of(spark, [(0, "ON_TRACK", False)]), seen, none)
    chain = {r["session_id"]: (r["issue_session"], r["depth"]) for r in lifecycle.issue_chain(s).collect()}
    assert chain == {f"1-{i}": ("1-1", i - 1) for i in range(1, 8)}
    assert [r["session_id"] for r in lifecycle.first_prompt_notice(s).collect()] == ["1-2"]
    told = {r["session_id"]: r["notified"] for r in lifecycle.inherited(s).collect()}
    assert told == {f"1-{i}": i > 2 for i in range(1, 8)}


def test_board_gate_as_of_counts_unmarked_updates(spark):
    audit = audit_of(spark, [(0, "INACTIVE", True)] + [(100 * i, "ON_TRACK", False) for i in range(1, 26)])
    seen = [r["board_status"] for r in gates.board_history(audit).orderBy("update_id").collect()]
    assert seen == ["INACTIVE"] * 20 + [None] * 6
    assert not gates.board_inactive(audit).first()["inactive"]


def test_many_deadlines_in_one_day(spark):
    import time

    n = 80_000
    left = spark.range(n).select(F.col("id").alias("i"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id)").alias("t"))
    right = spark.range(5).select(F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 20000)").alias("u"), F.col("id").alias("v"))
    began = time.time()
    got = temporal.next_at_or_after(left, right, "t", "u", ["v"], unit="DAY").groupBy("v").agg(F.count("*").alias("n")).collect()
    assert {r["v"]: r["n"] for r in got} == {0: 1, 1: 20000, 2: 20000, 3: 20000, 4: 19999} and time.time() - began < 30


def test_board_gate_limits_before_it_filters(spark):
    rows = [(i, at(i), "INACTIVE" if i == 0 else "ON_TRACK", gates.MARKER if i == 0 else "by hand") for i in range(20)]
    schema = "update_id long, created_at timestamp_ntz, status string, body string"
    assert gates.board_inactive(spark.createDataFrame(rows, schema)).first()["inactive"]
    rows.append((20, at(20), "ON_TRACK", "by hand"))
    assert not gates.board_inactive(spark.createDataFrame(rows, schema)).first()["inactive"]


def test_privacy_fails_closed(spark):
    for seen, want in ((" TRUE\t".strip(), "ok"), ("private", "ok"), ("false", gates.PUBLIC), ("HTTP 404", gates.UNCHECKED)):
        assert one(spark, gates.privacy(F.lit(seen))) == want
    assert one(spark, gates.privacy(F.lit(None).cast("string"))) == gates.UNCHECKED


def test_pause_holds_and_resume_needs_its_update(spark):
    rows = [(1, "pause", at(0), False), (1, "resume", at(5), False), (1, "resume", at(9), True), (2, "pause", at(1), True)]
    got = {r["cwd"]: r["until"] for r in gates.pause_spans(spark.createDataFrame(rows, "cwd long, action string, ts timestamp_ntz, ok boolean")).collect()}
    assert got == {1: at(9), 2: None}


def test_labels_ledger_and_uninstall(spark):
    assert one(spark, content.labels_of(F.lit("session"), F.lit("label"))) == ["session"]
    step, action = install.ledger(F.array(*[F.lit(s) for s in install.STEPS]))
    assert one(spark, step) is None and one(spark, action) == "restore"
    found = spark.createDataFrame([("a",), ("b",)], "name string")
    assert tuple(install.uninstall(found, spark.createDataFrame([("a",), ("z",)], "name string")).first()) == (1, 1)


def test_last_state_overwrites_whole_records(spark):
    rows = spark.createDataFrame([("s", at(1), 1, "x"), ("s", at(2), 2, None)], "session_id string, ts timestamp_ntz, event_id long, repo string")
    assert lifecycle.last_state(rows).first()["repo"] is None


NO_CONTROLS = "cwd long, action string, ts timestamp_ntz, ok boolean"


def states_of(spark, rows, audit=(), controls=(), public=(), **how):
    events = log(spark, rows)
    seen = spark.createDataFrame([(c, "public" if c in public else "private") for c in {r[1] for r in rows}], "cwd long, visibility string")
    asked = spark.createDataFrame([(c, a, at(t), ok) for t, c, a, ok in controls], NO_CONTROLS)
    return states.States(events, audit_of(spark, list(audit)), seen, asked, **how)


def decided(s):
    return {int((r["ts"] - DAY).total_seconds()): r["decision"] for r in s.decisions().collect()}


def test_a_refused_session_stays_without_state(spark):
    """The reason why nothing is tracked outlives the events of a session that was refused."""
    rows = [(0, 1, "SessionStart", 1, False), (10, 1, "UserPromptSubmit", 1, False), (20, 1, "PostToolUse", 1, False), (30, 1, "Stop", 1, False), (40, 1, "SessionEnd", 1, False)]
    s = states_of(spark, rows, public=(1,))
    assert decided(s) == {0: gates.PUBLIC, 10: "no_state", 20: "no_state", 30: "no_state", 40: "no_state"}
    assert [(r["at_ts"], r["decision"]) for r in s.runtime().collect()] == [(at(0), gates.PUBLIC)] and s.writes.isEmpty()


def test_what_is_saved_and_cleared(spark):
    """By a timer on an inactive board, a timer on an active one, and never by an end or in a pause."""
    start, prompt, stop, end = "SessionStart", "UserPromptSubmit", "Stop", "SessionEnd"
    rows = [(0, 1, start, 1, False), (10, 1, stop, 1, False), (0, 2, start, 1, False), (2500, 2, stop, 1, False), (2600, 2, end, 1, False)]
    rows += [(1, 3, start, 1, False), (1500, 3, prompt, 1, False), (1600, 3, stop, 1, False), (5, 4, start, 1, False), (1800, 4, prompt, 1, False), (1801, 4, end, 1, False)]
    s = states_of(spark, rows, [(1700, "INACTIVE", True), (2400, "ON_TRACK", True)], [(1750, 4, "pause", True)])
    got = {r["cwd"]: (int((r["at_ts"] - DAY).total_seconds()), r["cause"], r["decision"]) for r in s.runtime().collect()}
    assert got == {1: (1810, "timer", "project_inactive"), 2: (2500, "event", "ok"), 3: (3400, "timer", "ok"), 4: (5, "event", "ok")}
    closed = {(r["session_id"], r["cause"]) for r in s.closings().collect()}
    assert closed == {("3-1", "timer")}


def test_a_pause_names_the_open_session_written_last(spark):
    start, prompt = "SessionStart", "UserPromptSubmit"
    rows = [(0, 1, start, 1, False), (10, 1, start, 2, False), (20, 1, "SessionEnd", 2, False), (40, 1, prompt, 1, False), (50, 1, prompt, 2, False), (70, 1, prompt, 1, False), (90, 1, prompt, 1, False), (110, 1, prompt, 1, False)]
    # the newest session has ended, so the older one is paused; then that is resumed, though the other was written last, but not by an update that failed
    s = states_of(spark, rows, controls=[(30, 1, "pause", True), (60, 1, "resume", False), (80, 1, "resume", True), (100, 1, "resume", True)])
    assert decided(s) == {0: "ok", 10: "ok", 20: "ok", 40: "paused", 50: "ok", 70: "paused", 90: "ok", 110: "ok"}
    named = [(r["hook"], r["session_id"]) for r in s.rows.filter("kind = 'control'").orderBy("ts").collect()]
    assert named == [("pause", "1-1"), ("resume", "1-1"), ("resume", "1-1")]


def test_a_pause_goes_on_in_a_resumed_session(spark):
    rows = [(0, 1, "SessionStart", 1, False), (720, 1, "SessionStart", 2, True), (840, 1, "UserPromptSubmit", 2, False), (960, 1, "UserPromptSubmit", 2, False)]
    s = states_of(spark, rows, controls=[(480, 1, "pause", True), (900, 1, "resume", True)])
    assert decided(s) == {0: "ok", 720: "ok", 840: "paused", 960: "ok"}
    told = {r["session_id"]: r["notified"] for r in lifecycle.inherited(s).collect()}
    assert told == {"1-1": False, "1-2": False}


def test_resumptions_that_hang_on_cancelled_timers(spark):
    """Each resumption cancels a timer that would have closed what the next one resumes."""
    start, stop, prompt = "SessionStart", "Stop", "UserPromptSubmit"
    rows = [(0, 1, start, 1, False), (10, 1, stop, 1, False), (900, 1, start, 2, True), (910, 1, stop, 2, False), (1790, 1, prompt, 1, False), (2000, 1, start, 3, True), (2010, 1, stop, 3, False), (2700, 1, prompt, 2, False), (2900, 1, start, 4, True), (3000, 1, prompt, 3, False), (3500, 1, start, 5, True)]
    s = states_of(spark, rows)
    assert {r["session_id"]: r["resumes"] for r in s.resumed.collect()} == {"1-2": "1-1", "1-3": "1-1", "1-4": "1-2", "1-5": "1-3"}
    assert {r["session_id"]: (r["issue_session"], r["depth"]) for r in lifecycle.inherited(s).collect()} == {"1-1": ("1-1", 0), "1-2": ("1-1", 1), "1-3": ("1-1", 1), "1-4": ("1-1", 2), "1-5": ("1-1", 2)}


def test_a_stop_may_pass_an_inactive_board(spark):
    rows = [(0, 1, "SessionStart", 1, False), (100, 1, "Stop", 1, False)]
    gated, passed = (states_of(spark, rows, [(50, "INACTIVE", True), (1000, "ON_TRACK", True)], stop_gate=g) for g in (True, False))
    assert [r["status"] for r in gated.current().collect()] == ["registered"] and [r["status"] for r in passed.current().collect()] == ["closed"]
    assert gated.runtime().first()["decision"] == "project_inactive" and passed.runtime().first()["cause"] == "timer"


@pytest.mark.parametrize("piece", [3, 40])
def test_workspaces_in_pieces(spark, sf_dir, piece):
    """A history that is cut into pieces gives what it gives whole, pauses of many pieces included."""
    audit, events = hooks.board_audit(spark, sf_dir, gates.MARKER), hooks.hook_log(spark, sf_dir).filter("cwd % 3 = 0")
    seen = gates.visibilities(hooks.table(spark, sf_dir, "customer"))
    made = [states.States(events, audit, seen, gates.controls(audit), piece=p) for p in (1 << 20, piece)]
    whole, cut = (sorted(map(str, s.rows.collect())) for s in made)
    assert whole == cut and any("paused" in r for r in whole)


def test_rows_without_a_time_are_spread(spark):
    left = spark.range(20_000).select(F.col("id").alias("i"), F.when(F.col("id") % 20 == 0, F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id)")).alias("t"))
    right = spark.createDataFrame([(at(100), "a")], "u timestamp_ntz, v string")
    for join, hits in ((temporal.asof_join, 995), (temporal.next_at_or_after, 6)):
        out = join(left, right, "t", "u", ["v"])
        assert out.count() == 20_000 and out.filter("v is not null").count() == hits
    place = left.withColumn("b", F.coalesce(temporal.bucket(F.col("t"), "HOUR"), temporal._untimed(left, True))).filter("t is null")
    most = place.groupBy("b").count().agg(F.max("count"), F.count("*")).first()
    assert most[0] < 30 and most[1] > 3000


def test_first_lines_of_any_length(spark, tmp_path):
    (tmp_path / "long.jsonl").write_text(json.dumps({"pad": "x" * 1_000_000, "type": "file-history-snapshot"}) + "\n{}\n")
    (tmp_path / "other.jsonl").write_text(json.dumps({"type": "x"}) + "\n" + json.dumps({"type": "file-history-snapshot"}) + "\n")
    assert {r["file_path"][-10:]: r["is_resume"] for r in files.is_resume(spark, str(tmp_path)).collect()} == {"long.jsonl": True, "ther.jsonl": False}


def test_states_are_built_once(spark, sf_dir):
    from tidemark.plans import catalogue

    assert catalogue.states(spark, sf_dir) is catalogue.states(spark, sf_dir)


def test_states_and_their_report_read_the_events_once(spark, sf_dir, monkeypatch):
    from tidemark.plans import catalogue

    read, table = [], hooks.table
    monkeypatch.setattr(hooks, "table", lambda s, d, name: read.append(name) or table(s, d, name))
    monkeypatch.setattr(catalogue, "_STATES", {})
    catalogue.QUERIES["status_report"](spark, sf_dir).count()
    assert read.count("events") == 1
    for built in catalogue._STATES.values():
        built.drop()


def test_values_are_what_arrow_gives():
    import pyarrow as pa

    for column in (pa.array([2**60 + 1, None, -5]), pa.array([1, 2], "int32"), pa.array(["a", None, "é"]), pa.array([True, None]), pa.array([None, None], "int64"), pa.array([], "string"), pa.array([7, None, 2**60 + 1])[1:]):
        got = states._values(column)
        assert got == column.to_pylist() and [type(x) for x in got] == [type(x) for x in column.to_pylist()]


def test_both_lookups_in_one_pass(spark):
    left = spark.createDataFrame([(i, None if i % 9 == 0 else at(i * 997 % 40_000 - 2)) for i in range(300)], "i long, t timestamp_ntz")
    before = spark.createDataFrame([(at(i * 1777 % 30_000 // 10 * 10), i, f"b{i}" if i % 3 else None) for i in range(40)], "u timestamp_ntz, o long, b string")
    after = spark.createDataFrame([(at(i * 997 * 7 % 40_000 - 2), i, f"a{i}") for i in range(40)] + [(None, 40, "a40")], "v timestamp_ntz, p long, a string")
    one_by_one = temporal.next_at_or_after(temporal.asof_join(left, before, "t", "u", ["b"], right_order="o"), after, "t", "v", ["a"], right_order="p")
    wanted = sorted(map(str, one_by_one.collect()))
    assert any("a=None" in r for r in wanted) and any("a='a" in r and "b='b" in r for r in wanted)
    more = left.select("t").unionByName(spark.createDataFrame([(at(999_999),), (None,)], "t timestamp_ntz"))
    for times in (None, more):
        assert sorted(map(str, temporal.around(left, "t", (before, "u", ["b"], "o"), (after, "v", ["a"], "p"), times).collect())) == wanted


def test_large_keys_are_counted_as_others_are(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 50 > 0, F.col("id") % 3).alias("c"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, id * 7919 % 200)").alias("t"), "id")
    counted = lambda **how: sorted(map(str, temporal.running_count(df, ["c"], F.col("id") % 4 == 0, "t", "id", "n", **how).collect()))
    keys = spark.createDataFrame([(1,)], "c long")
    assert counted() == counted(large=keys) == counted(large=keys.filter("c = 2"))


def test_last_tries_are_the_last_of_the_cache(spark):
    """Times don't follow the ids, some projects have none that went through, and one has a last one without a time."""
    from tidemark.operators import audit

    rows = [(i, i % 7 if i % 11 else None, None if i == 399 else at(i * 7919 % 997), "ON_TRACK" if i % 2 else "INACTIVE") for i in range(400)] + [(404, 90, at(5), "INACTIVE")]
    tries = audit.tries(spark.createDataFrame(rows, "update_id long, project long, created_at timestamp_ntz, status string"))
    last = audit.cache(tries).groupBy("project").agg(F.max_by(F.struct("last_status", "last_synced_at", "last_error"), "update_id").alias("s")).filter("project is not null").select("project", "s.*")
    got = sorted(map(str, audit.last(tries).collect()))
    assert got == sorted(map(str, last.collect())) and len(got) == 8 and any("last_synced_at=None" in r for r in got)


@pytest.mark.parametrize("piece", [1 << 20, 60])
def test_last_rows_alone_tell_what_all_rows_tell(spark, piece):
    sf_dir = "/root/testdata/sf0.01"
    events = hooks.parsed(hooks.table(spark, sf_dir, "events")).filter("user_id % 3 = 0")
    board, seen = hooks.audit_rows(events, gates.MARKER), gates.visibilities(hooks.table(spark, sf_dir, "customer"))
    how = {"log": hooks.log_of(events), "audit": board, "seen": seen, "controls": gates.controls(board), "piece": piece}
    rows, _ = states.looked_up(**how, brief=True)
    all_ = states.States(**how)
    got = sorted(map(str, states.last_of(rows).collect()))
    assert got == sorted(map(str, states.last_of(all_.rows).collect())) and any("session_id='" in r for r in got)
    assert {r["cwd"]: r["decision"] for r in states.last_of(rows).collect() if r["decision"]} == {r["cwd"]: r["decision"] for r in all_.runtime().collect()}
    assert rows.count() < all_.rows.count() or piece == 60


def test_the_report_alone_writes_no_states(spark, sf_dir, monkeypatch):
    from tidemark.plans import catalogue
    from tidemark.sources import store

    names, write = [], store.written
    for module in (store, states):
        monkeypatch.setattr(module, "written", lambda df, name: names.append(name) or write(df, name))
    monkeypatch.setattr(catalogue, "_STATES", {})
    alone = sorted(map(str, catalogue.QUERIES["status_report"](spark, sf_dir).collect()))
    assert "states" not in names and not catalogue._STATES
    built = catalogue.states(spark, sf_dir)
    assert "states" in names and sorted(map(str, catalogue.QUERIES["status_report"](spark, sf_dir).collect())) == alone
    built.drop()


def test_k_with_and_without_the_parser(spark):
    texts = ['{"k": 76}', '{"k": 0}', '{"k": 007}', '{"k":5}', '{"k": -3}', '{"k": 4, "x": 1}', '{"k": 9999999999}', '{"k": "8"}', "{}", "", None, '{"k": 1}\n', ' {"k": 2}']
    df = spark.createDataFrame([(t,) for t in texts], "props string")
    for r in df.select(hooks._k(df).alias("got"), F.get_json_object("props", "$.k").try_cast("int").alias("wanted"), "props").filter("props not like '%9999%'").collect():
        assert r["got"] == r["wanted"], r
