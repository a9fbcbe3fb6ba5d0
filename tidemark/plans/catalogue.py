"""Every registered query with its SQL counterpart."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions import env, urls
from tidemark.functions import text as T
from tidemark.operators import audit as A
from tidemark.operators import content as C
from tidemark.operators import gates as G
from tidemark.operators import install as I
from tidemark.operators import lifecycle as L
from tidemark.operators import remote as B
from tidemark.operators import reports as R
from tidemark.operators import states as S
from tidemark.plans.sql import ORACLES  # noqa: F401
from tidemark.sources import files, store
from tidemark.sources import hooks as H
from tidemark.sources.state_table import StateTable
from tidemark.streaming.outbox import net


def _log(f):
    return lambda spark, d: f(H.hook_log(spark, d))


def _audit(f):
    return lambda spark, d: f(H.board_audit(spark, d, G.MARKER))


def _both(f):
    return lambda spark, d: f(H.hook_log(spark, d), H.board_audit(spark, d, G.MARKER))


def _seen(spark, d):
    return G.visibilities(H.table(spark, d, "customer"))


def _events(spark, d):
    """A folder's events as they are read for states: once, for all that follows."""
    return store.written(H.parsed(H.table(spark, d, "events")), "events")


def _plain(events):
    """The log's rows without their sessions."""
    return H.hook_events(events).filter("cwd is not null and ts is not null")


def _inputs(spark, d, events):
    """What a folder's states are made of."""
    audit, plain = H.audit_rows(events, G.MARKER), _plain(events)
    controls = G.controls(audit)
    hot = S.large_workspaces(plain, controls)
    return {"log": H.log_of(events, hot), "audit": audit, "seen": _seen(spark, d), "controls": controls, "plain": plain, "hot": hot}


class _Built(S.States):
    """The states of a folder's tables, with its events."""

    def __init__(self, spark, d):
        self.events = _events(spark, d)
        super().__init__(**_inputs(spark, d, self.events))

    def drop(self):
        super().drop()
        store.drop(self.events)


_STATES: dict[tuple, _Built] = {}


def _key(spark, d) -> tuple:
    return (spark.sparkContext.applicationId, d, store.stamp(spark, f"{d}/events.parquet"), store.stamp(spark, f"{d}/customer.parquet"))


def states(spark, d) -> _Built:
    """The states of a folder's tables, built once in a session for as long as the files stay the same."""
    key = _key(spark, d)
    own = key[:2]
    if key not in _STATES:
        for old in [k for k in _STATES if k[:2] == own or k[0] != own[0]]:
            gone = _STATES.pop(old)
            if old[0] == own[0]:
                gone.drop()
        _STATES[key] = _Built(spark, d)
    return _STATES[key]


def _from(f):
    return lambda spark, d: f(states(spark, d))


def _report(spark, d):
    """From the states if the session has them; else from the machine's last rows alone, and no states are written."""
    built, machines, read = _STATES.get(_key(spark, d)), I.machines(H.table(spark, d, "customer")), []
    events = built.events if built else _events(spark, d)
    if built:
        rows = built.rows
    else:
        rows, read = S.looked_up(**_inputs(spark, d, events), brief=True)
    found = R.workspaces(_plain(events), H.audit_rows(events, G.MARKER), rows, machines)
    if not built:
        found = store.written(found, "workspaces")
        store.drop(events, *read)
    return R.status_report(found)


def _examples(turns):
    mode, context = F.when(F.col("conv_id") % 2 == 0, "label").otherwise("prefix"), F.concat(F.lit("team/r"), F.col("conv_id").cast("string"))
    return C.prompts(turns).select("conv_id", "turn", T.title_example(mode, context, F.col("prompt")).alias("example"))


def _of(name, f):
    return lambda spark, d: f(H.table(spark, d, name))


def _turns(f):
    return lambda spark, d: f(H.turns(spark, d))


def _machines(f):
    return lambda spark, d: f(I.machines(H.table(spark, d, "customer")))


def _privacy(pages):
    seen = F.when(F.col("page_id") % 5 == 0, " PRIVATE ").when(F.col("page_id") % 5 == 1, "true").when(F.col("page_id") % 5 == 2, "public").when(F.col("page_id") % 5 == 3, "False").otherwise("HTTP 404")
    return pages.select("page_id", G.privacy(seen).alias("decision"))


def _remotes(f):
    return lambda spark, d: H.remotes(spark, d).select("page_id", f(F.col("url")).alias("repo"))


def _context(spark, d):
    r = H.remotes(spark, d)
    notes = F.when(F.col("page_id") % 3 == 0, "team/notes").otherwise("")
    path = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/home/u/p"), F.col("page_id").cast("string"), F.lit("/"))).otherwise("/")
    return r.select("page_id", F.coalesce(urls.repo_strict(F.col("url")), F.nullif(notes, F.lit("")), T.folder_name(T.normal_path(path))).alias("context"))


def _env(last):
    return lambda spark, d: env.env_map(H.env_lines(spark, d), "line", ["line_no"], ["page_id"], last)


def _tools(f):
    return lambda spark, d: f(C.question_events(H.hook_log(spark, d), H.table(spark, d, "part")))


def _labels(spark, d):
    t = H.turns(spark, d)
    context = F.when(F.col("conv_id") % 3 != 0, F.concat(F.lit("area"), (F.col("conv_id") % 7).cast("string"))).otherwise("")
    mode = F.when(F.col("conv_id") % 2 == 0, "label").otherwise("prefix")
    wanted = t.select(F.concat(F.lit("team/r"), (F.col("conv_id") % 4).cast("string")).alias("repo"), C.labels_of(context, mode).alias("labels"))
    there = t.filter("conv_id % 5 = 0").select(F.concat(F.lit("team/r"), (F.col("conv_id") % 4).cast("string")).alias("repo"), F.concat(F.lit("area"), (F.col("conv_id") % 7).cast("string")).alias("label"))
    return C.missing_labels(wanted, there)


def _stream(spark, d):
    from tidemark.streaming.lifecycle import run_available

    return run_available(spark, d)


def _stream_effects(spark, d):
    from tidemark.streaming.lifecycle import run_effects

    return run_effects(spark, d)


def _last_state_rows(log):
    return L.writes(log).select("session_id", "ts", "event_id", "cwd", "hook", L.status_of(F.col("hook")).alias("status"))


def _last_state_by_day(spark, d):
    """The last states as a table that the log comes into day by day: all but the last two days first, then each of them."""
    rows = store.written(_last_state_rows(H.hook_log(spark, d)).withColumn("day", F.to_date("ts")), "days")
    last = [r["day"] for r in rows.filter("day is not null").select("day").distinct().orderBy(F.desc("day")).limit(2).collect()]
    folder = f"{store.shared_folder(spark)}/last-state-{uuid.uuid4().hex}"
    table = StateTable(spark, folder, "session_id string, ts timestamp_ntz, event_id bigint, cwd bigint, hook string, status string", "session_id", ["ts", "event_id"])
    days = [F.coalesce(~F.col("day").isin(last), F.lit(True)) if last else F.lit(True), *[F.col("day") == x for x in reversed(last)]]
    for i, on in enumerate(days):
        table.upsert(rows.filter(on), i)
    store.drop(rows)
    store.gone_at_exit(spark, folder)
    return table.read()


def _prompt_effects(spark, d):
    return L.prompt_effects(states(spark, d), L.said_prompts(H.hook_log(spark, d), H.turns(spark, d)))


def _events_wide(log):
    return log.select("event_id", "ts", "cwd", "hook", "n", "session_id", "k", "is_resume")


def _addresses(spark, d):
    o = H.table(spark, d, "orders")
    repo, number = F.when(F.col("o_orderkey") % 3 != 0, "team/notes").otherwise(""), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey"))
    return o.select("o_orderkey", urls.issue_url(repo, number).alias("issue"), urls.board_url(F.nullif(repo, F.lit("")), F.col("o_orderkey") % 5).alias("board"), T.short_id(F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"))).alias("short"), T.yes_no(F.col("o_orderstatus") == "F").alias("done"), T.minutes(F.col("o_orderkey") * 61).alias("minutes"))


def _config(orders):
    key = F.col("o_orderkey").cast("string")
    text_ = env.env_text({"OWNER": F.concat(F.lit("u"), key), "NUMBER": key}, {"LABEL": F.when(F.col("o_orderkey") % 2 == 0, "label"), "NOTE": F.when(F.col("o_orderkey") % 3 == 0, "").otherwise("n")})
    return orders.select("o_orderkey", text_.alias("text"))


def _families(customer):
    """Distributions of machines by name, like, and what family that makes."""
    ids = F.get(F.array(*[F.lit(x) for x in ("ubuntu", "rocky", "manjaro", "opensuse-leap", "Void", "")]), (F.col("c_custkey") % 6).cast("int"))
    alike = F.get(F.array(*[F.lit(x) for x in ("debian", "rhel fedora", "arch", "suse opensuse", "", "")]), (F.col("c_custkey") % 6).cast("int"))
    return customer.select("c_custkey", files.family(F.lower(ids), alike).alias("family"))


def _uninstall(nation):
    found, known = nation.select(F.col("n_name").alias("name")), nation.filter("n_nationkey % 3 = 0").select(F.col("n_name").alias("name"))
    return I.uninstall(found, known)


def _open_sessions(log):
    w = L.last_state(L.writes(log).select("session_id", F.col("ts").alias("last_write_ts"), "ts", "event_id", L.status_of(F.col("hook")).alias("status"), (F.col("k") % 3 == 0).alias("tracking_paused")))
    return B.sessions(w, active_only=True, paused_only=True).select("session_id", "last_write_ts", "status")


def _sync(audit):
    a = A.tries(audit).withColumn("s", B.sync_record(F.col("status"), F.col("created_at"), F.col("ok"), F.col("update_id"), F.lit("the board did not answer")))
    return a.select("update_id", "s.status", "s.success", "s.synced_at", "s.status_update_id", "s.error")


QUERIES = {
    "hook_log": _log(_events_wide),
    "orphan_events": _log(lambda log: log.filter("n = 0").select("event_id", "cwd", "hook")),
    "board_snapshot": _from(L.board_snapshot),
    "status_history": _from(lambda s: s.history()),
    "idle_close": _log(L.idle_close),
    "duplicate_start": _log(L.duplicate_start),
    "first_prompt_notice": _from(L.first_prompt_notice),
    "stale_sweep": _log(L.stale_sweep),
    "sweep_count": _log(L.sweep_count),
    "resume_match": _from(lambda s: s.resumed.select("event_id", "session_id", "resumes")),
    "issue_chain": _from(L.issue_chain),
    "latest_session_by_cwd": _log(L.latest_session),
    "active_dates": _log(L.active_dates),
    "effects": _from(L.effects),
    "prompt_effects": _prompt_effects,
    "net_effects": _from(lambda s: net(L.effects(s))),
    "last_state": _log(lambda log: L.last_state(_last_state_rows(log))),
    "last_state_by_day": _last_state_by_day,
    "state_scan": _from(lambda s: files.scanned(files.parsed_states(L.state_records(s), []))),
    "board_gate": _both(lambda log, audit: G.board_asof(log, G.board_history(audit)).select("event_id", "board_status", F.coalesce(F.col("board_status") == "INACTIVE", F.lit(False)).alias("gated"))),
    "board_status_now": _audit(G.board_inactive),
    "closings": _from(lambda s: s.closings().select("session_id", "at_ts", "cause", "swept_by")),
    "gated_status": _from(lambda s: s.decisions().select("event_id", "hook", "decision")),
    "runtime_status": _from(lambda s: s.runtime()),
    "audit_cache": _audit(lambda a: A.cache(A.tries(a))),
    "audit_body": _audit(A.bodies),
    "privacy_gate": _of("pages", _privacy),
    "issue_title_prefix": _turns(lambda t: C.titles(t, "prefix")),
    "issue_title_label": _turns(lambda t: C.titles(t, "label")),
    "latest_title": _turns(C.latest_title),
    "session_comments": _turns(C.comments),
    "repo_from_url_strict": _remotes(urls.repo_strict),
    "repo_from_url_loose": _remotes(urls.repo_loose),
    "context_repo": _context,
    "env_parse_last": _env(True),
    "env_parse_first": _env(False),
    "answer_lines": _tools(C.answers),
    "answer_comment": _tools(C.answer_comments),
    "labels_ensure": _labels,
    "addresses": _addresses,
    "hooks_merge": _of("nation", I.hooks_merged),
    "hooks_remove": _of("nation", I.hooks_removed),
    "install_state": _machines(I.install_states),
    "doctor_report": _machines(I.doctor),
    "doctor_verdict": _machines(I.verdicts),
    "setup_next_step": _of("customer", I.setup_next_step),
    "meta_complete": _of("customer", I.meta_complete),
    "status_report": _report,
    "pause_spans": _audit(lambda a: G.pause_spans(G.controls(a))),
    "sync_record": _audit(_sync),
    "open_sessions": _log(_open_sessions),
    "board_projects": _of("orders", B.board_projects),
    "create_response": _of("orders", B.responses),
    "meta_decode": _of("orders", B.metadata),
    "first_project": _of("orders", lambda o: B.first_titled(o.select(F.col("o_orderkey").alias("number"), F.col("o_orderpriority").alias("title")), "1-URGENT")),
    "config_text": _of("orders", _config),
    "distro_family": _of("customer", _families),
    "uninstall_report": _of("nation", _uninstall),
    "issue_numbers": _from(L.issue_numbers),
    "notices": _from(L.notices),
    "control_updates": _audit(lambda a: A.appended(G.controls(a))),
    "setup_cleanup": _of("customer", lambda c: I.cleanup(I.ledgers(c))),
    "title_examples": _turns(_examples),
    "stream_lifecycle": _stream,
    "stream_effects": _stream_effects,
}
