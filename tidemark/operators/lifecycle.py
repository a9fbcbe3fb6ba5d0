"""Session state out of the hook log: status, timers, sweeps, resumed sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.urls import issue_url
from tidemark.operators.gates import blocked_text
from tidemark.operators.states import IDLE, Outcome
from tidemark.operators.temporal import latest_by, next_at_or_after, numbered
from tidemark.sources.hooks import STATUS, tracked


def _session():
    return Window.partitionBy("session_id").orderBy("ts", "event_id")


def status_of(hook: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])[hook]


def writes(log: DataFrame) -> DataFrame:
    """Events that write a session's state."""
    return tracked(log).filter("hook <> 'PostToolUse'")


def board_snapshot(states: Outcome) -> DataFrame:
    return states.current().groupBy("status").agg(F.count("*").alias("sessions"))


def idle_close(log: DataFrame) -> DataFrame:
    """Each stop's deadline, and whether it closes the session: no event that cancels the timer comes before it."""
    w = writes(log).withColumn("next_ts", F.lead("ts").over(_session())).filter("hook = 'Stop'")
    deadline = F.expr(f"ts + {IDLE}")
    return w.select("event_id", "session_id", F.col("ts").alias("stop_ts"), deadline.alias("deadline"), (F.col("next_ts").isNull() | (F.col("next_ts") >= deadline)).alias("closes"))


def duplicate_start(log: DataFrame) -> DataFrame:
    """Starts under a key of workspace and k, of which all but the first change nothing."""
    key = F.concat_ws("-", F.col("cwd").cast("string"), (F.col("k") % 10).cast("string"))
    starts = log.filter("hook = 'SessionStart'").select("event_id", key.alias("start_key"), "ts")
    nth = F.row_number().over(Window.partitionBy("start_key").orderBy("ts", "event_id"))
    return starts.withColumn("nth", nth.cast("long")).select("event_id", "start_key", "nth", (F.col("nth") > 1).alias("skipped"))


def first_prompt_notice(states: Outcome) -> DataFrame:
    """The first prompt of each session that passed the gates, unless a session that it goes on had one before."""
    first = states.rows.filter("first_prompt")
    return first.select("session_id", "event_id", F.concat(F.lit("Session "), F.col("session_id"), F.lit(" is tracked")).alias("notice"))


def stale_sweep(log: DataFrame) -> DataFrame:
    """Sessions that a start in any workspace finds open and unwritten for the idle time, once for each such write."""
    w = writes(log).withColumns({"next_ts": F.lead("ts").over(_session()), "due": F.expr(f"ts + {IDLE}")}).filter("hook <> 'SessionEnd'").select("event_id", "session_id", "due", "next_ts")
    starts = log.filter("hook = 'SessionStart'").select(F.col("ts").alias("start_ts"), F.col("event_id").alias("start_id"))
    # a start's own write comes after its sweep, so a session written at that very time is still swept
    out = next_at_or_after(w, starts, "due", "start_ts", ["start_ts", "start_id"], right_order="start_id")
    return out.filter("start_ts is not null and (next_ts is null or start_ts <= next_ts)").select("event_id", "session_id", "due", F.col("start_id").alias("swept_by"), F.col("start_ts").alias("swept_at"))


def sweep_count(log: DataFrame) -> DataFrame:
    return stale_sweep(log).groupBy("swept_by").agg(F.count("*").alias("sessions"))


def inherited(states: Outcome) -> DataFrame:
    """For every session with a state: issue_session, from which its issue comes down by resumptions, their number
    (depth), and notified, whether a session before it had its first prompt when it was resumed."""
    return states.rows.filter("acts and hook = 'SessionStart'").select("session_id", "issue_session", "depth", "notified")


def issue_chain(states: Outcome) -> DataFrame:
    """The issue of every session: that of the session it resumes, else its own; how many resumptions led there, and
    whether others share it."""
    chain = inherited(states)
    shared = chain.groupBy("issue_session").agg((F.count("*") > 1).alias("shared_item"))
    return chain.join(shared, "issue_session").select("session_id", "issue_session", "depth", "shared_item")


def latest_session(log: DataFrame) -> DataFrame:
    """The newest session of each workspace and when it was last written."""
    return latest_by(writes(log), ["cwd"], ["ts", "session_id", "event_id"], ["session_id", "ts"]).withColumnRenamed("ts", "last_write_ts")


def active_dates(log: DataFrame) -> DataFrame:
    """First and last day of each session: the day of its start, and of its last prompt or stop."""
    day = F.to_date("ts")
    return tracked(log).groupBy("session_id").agg(F.min(F.when(F.col("hook") == "SessionStart", day)).alias("created_on"), F.max(F.when(F.col("hook").isin("UserPromptSubmit", "Stop"), day)).alias("last_active"))


def last_state(states: DataFrame, key: str = "session_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """One row per key, the last written, as a whole-record upsert leaves it."""
    return latest_by(states, [key], list(order), [c for c in states.columns if c != key])


def effects(states: Outcome) -> DataFrame:
    """What the tracker would send out, a row each: session, time, event (none for a timer), kind and value.

    A new session opens an issue, with title, body and label; one that resumes another takes over its item. A session
    closes once, by its end, its timer or a sweep, until a prompt or stop opens it again.
    """
    rows = states.rows.filter("acts")
    stamp, cwd = F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.col("cwd").cast("string")
    new, label = "hook = 'SessionStart' and resumes is null", F.concat(F.lit("area"), (F.col("cwd") % 7).cast("string"))
    made = {
        "issue": (new, T.issue_title(stamp, F.concat(F.lit("p"), cwd))),
        "body": (new, T.issue_body({"session": F.col("session_id"), "time": stamp, "address": address(F.col("cwd")), "folder": F.concat(F.lit("/home/u/p"), cwd), "transcript": transcript(F.col("session_id"))})),
        "label": (f"{new} and cwd % 2 = 0", label),
        "created_date": (new, F.to_date("ts").cast("string")),
        "resumed": ("hook = 'SessionStart' and resumes is not null", F.concat(F.lit("goes on from "), F.col("resumes"))),
        "status": ("sets <> 'closed'", F.col("sets")),
        "close": ("sets = 'closed'", F.lit("end")),
        "active_date": ("hook in ('UserPromptSubmit', 'Stop')", F.to_date("ts").cast("string")),
        "title": ("hook = 'UserPromptSubmit'", F.concat(F.lit("prompt "), F.col("event_id").cast("string"))),
        "comment": ("hook in ('UserPromptSubmit', 'Stop', 'PostToolUse')", F.col("hook")),
    }
    each = F.array_compact(F.array(*[F.when(F.expr(on), F.struct(F.lit(kind).alias("kind"), value.alias("value"))) for kind, (on, value) in made.items()]))
    out = rows.select("session_id", F.col("ts").alias("at_ts"), "event_id", F.inline(each))
    own = states.closings().select("session_id", "at_ts", F.col("swept_by").alias("event_id"), F.lit("close").alias("kind"), F.col("cause").alias("value"))
    return out.unionByName(own)


def address(cwd: Column) -> Column:
    """A workspace's machine, of which the tables have nothing: an address out of its number."""
    return F.concat_ws(".", F.lit("10.0"), F.pmod(F.floor(cwd / 250), F.lit(250)).cast("string"), F.pmod(cwd, F.lit(250)).cast("string"))


def transcript(session: Column) -> Column:
    return F.concat(F.lit("/home/u/transcripts/"), session, F.lit(".jsonl"))


def prompt_effects(states: Outcome, prompts: DataFrame) -> DataFrame:
    """The title and the comment that each prompt which says something sends out, with its text (event_id, prompt): the
    title with the workspace's context in front, or alone where the context is a label. A prompt without text sends neither."""
    rows = states.rows.filter("acts and hook = 'UserPromptSubmit'").join(prompts, "event_id")
    stamp, context = F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.concat(F.lit("team/context-of-workspace-area-"), (F.col("cwd") % 7).cast("string"))
    title = F.when(F.col("cwd") % 2 == 0, T.title_label(F.col("prompt"))).otherwise(T.title_prefix(context, F.col("prompt")))
    kinds = F.array(F.struct(F.lit("title").alias("kind"), title.alias("value")), F.struct(F.lit("comment").alias("kind"), T.comment(stamp, F.lit("Prompt"), F.col("prompt")).alias("value")))
    return rows.select("session_id", F.col("ts").alias("at_ts"), "event_id", F.inline(kinds))


def said_prompts(log: DataFrame, turns: DataFrame) -> DataFrame:
    """event_id and prompt: the n-th prompt of a workspace says what the n-th user turn of the conversation of its number does."""
    nth = F.row_number().over(Window.partitionBy("cwd").orderBy("ts", "event_id"))
    asked = log.filter("hook = 'UserPromptSubmit'").select("event_id", "cwd", nth.alias("nth"))
    turn = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text"))
    said = turns.filter("role = 'user'").select(F.col("conv_id").alias("cwd"), turn.alias("nth"), T.strip_ws(F.col("text")).alias("prompt"))
    return asked.join(said.filter("length(prompt) > 0"), ["cwd", "nth"]).select("event_id", "prompt")


def state_records(states: Outcome) -> DataFrame:
    """What lies in the state files: the JSON text of each session's last state; every eleventh workspace's were cut short by a crash."""
    last = states.history().filter("is_current").withColumn("cwd", F.split_part("session_id", F.lit("-"), F.lit(1)))
    text = F.to_json(F.struct("session_id", "cwd", "status", T.iso_plain(F.col("at_ts")).alias("created_at")))
    return last.select("session_id", F.when(F.col("cwd").cast("long") % 11 == 0, F.substring(text, F.lit(1), F.length(text) - 5)).otherwise(text).alias("value"))


def issue_numbers(states: Outcome) -> DataFrame:
    """The number of each new session's issue, in order of their starts over all workspaces."""
    new = states.rows.filter("acts and hook = 'SessionStart' and resumes is null").select("session_id", "ts", "event_id")
    return numbered(new, "ts", "event_id").select("session_id", "event_id", F.col("rank").alias("number"))


def notices(states: Outcome) -> DataFrame:
    """What a user is told: where a new or a resumed session is tracked, or why a start isn't."""
    chain = inherited(states).join(issue_numbers(states).select(F.col("session_id").alias("issue_session"), "number"), "issue_session")
    url = issue_url(F.lit("team/notes"), F.col("number"))
    told = states.rows.filter("acts and hook = 'SessionStart'").select("session_id", "event_id").join(chain, "session_id")
    told = told.select("event_id", "session_id", F.concat(F.lit("This session is tracked at "), url, F.when(F.col("depth") > 0, " (resumed)").otherwise("")).alias("notice"))
    blocked = states.decisions().filter("hook = 'SessionStart' and decision <> 'ok'")
    return told.unionByName(blocked.select("event_id", "session_id", blocked_text(F.col("decision")).alias("notice")))
