"""The catalogue's queries as SQL."""

from tidemark.functions.text import BLANKS

_B = "'" + BLANKS + "'"
_M = "<!-- tidemark-status -->"

_LOG = """log AS (
  SELECT *, concat(cwd, '-', n) AS session_id, hook = 'SessionStart' AND k % 2 = 0 AS is_resume FROM (
    SELECT event_id, ts, user_id AS cwd,
      CASE event_type WHEN 'signup' THEN 'SessionStart' WHEN 'click' THEN 'UserPromptSubmit' WHEN 'view' THEN 'PostToolUse' WHEN 'purchase' THEN 'Stop' WHEN 'error' THEN 'SessionEnd' END AS hook,
      CAST(count(*) FILTER (WHERE event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n,
      CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
    FROM events)),
w AS (SELECT *, CASE hook WHEN 'SessionStart' THEN 'registered' WHEN 'UserPromptSubmit' THEN 'responding' WHEN 'Stop' THEN 'waiting' ELSE 'closed' END AS status
  FROM log WHERE n > 0 AND hook <> 'PostToolUse'),
audit AS (
  SELECT event_id AS update_id, ts AS created_at, user_id AS project, CASE WHEN k < 5 THEN 'INACTIVE' ELSE 'ON_TRACK' END AS status, event_id % 3 <> 0 AS marked
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) WHERE k < 10)"""
_IDLE = "INTERVAL 1800 SECOND"
# the newest twenty updates as each event finds them, and among them the newest marked one
_BOARD = """ranked AS (SELECT *, row_number() OVER (ORDER BY created_at, update_id) AS place FROM audit),
board AS (SELECT r.created_at, arg_max(m.status, m.place) AS board_status FROM ranked r LEFT JOIN ranked m ON m.marked AND m.place BETWEEN r.place - 19 AND r.place GROUP BY r.place, r.created_at)"""


def _session(**changed: str) -> str:
    """A session's record t with some fields changed: name, status, paused, last write, deadline, sweep and its start, told, issue, depth."""
    return "{" + ", ".join(f"'{k}': {changed.get(k, 't.' + k)}" for k in ("s", "st", "p", "w", "d", "sw", "si", "nt", "iss", "dep")) + "}"


_STALE = "(t.st <> 'closed' AND t.d IS NULL AND coalesce(t.sw <= {at}, false))"
# every row of a workspace changes the list of its sessions, as a hook reads and writes their files
_STATES = f"""WITH RECURSIVE {_LOG}, {_BOARD},
probe AS (
  SELECT cwd, ts, 0 AS nth, event_id, hook, session_id, is_resume, true AS went FROM log
  UNION ALL SELECT cwd, ts + {_IDLE}, -1, event_id, 'deadline', session_id, false, true FROM log WHERE hook = 'Stop'
  UNION ALL SELECT project, created_at, 1, update_id, CASE WHEN status = 'INACTIVE' THEN 'pause' ELSE 'resume' END, NULL, false, update_id % 5 <> 0 FROM audit),
gated AS (SELECT probe.*, coalesce(board.board_status = 'INACTIVE', false) AS inactive,
    CASE WHEN c.c_custkey % 11 = 0 THEN 'notes_repo_public' WHEN c.c_custkey IS NULL OR c.c_custkey % 13 = 0 THEN 'notes_repo_check_failed' ELSE 'ok' END AS reason
  FROM probe ASOF LEFT JOIN board ON probe.ts >= board.created_at LEFT JOIN customer c ON c.c_custkey = probe.cwd),
passed AS (SELECT session_id, ts AS start_ts, event_id AS start_id FROM gated WHERE hook = 'SessionStart' AND reason = 'ok' AND NOT inactive),
x AS (SELECT g.*, passed.start_ts AS next_ts, passed.start_id AS next_id, row_number() OVER (PARTITION BY g.cwd ORDER BY g.ts, g.nth, g.event_id) AS j
  FROM (SELECT *, ts + {_IDLE} AS due FROM gated) g ASOF LEFT JOIN passed ON g.due <= passed.start_ts),
m AS (
  SELECT cwd, 0::BIGINT AS j, NULL::TIMESTAMP AS ts, NULL::INTEGER AS nth, NULL::BIGINT AS event_id, NULL::VARCHAR AS hook, NULL::VARCHAR AS session_id, NULL::VARCHAR AS decision, NULL::VARCHAR AS runtime, NULL::VARCHAR AS resumes, NULL::VARCHAR AS sets,
    false AS acts, false AS writes, false AS first, [{{'s': '', 'st': '', 'p': false, 'w': NULL::TIMESTAMP, 'd': NULL::TIMESTAMP, 'sw': NULL::TIMESTAMP, 'si': NULL::BIGINT, 'nt': false, 'iss': '', 'dep': 0::BIGINT}}][1:0] AS sessions,
    [{{'s': '', 'at': NULL::TIMESTAMP, 'si': NULL::BIGINT}}][1:0] AS swept FROM (SELECT DISTINCT cwd FROM x)
  UNION ALL
  SELECT cwd, j, ts, nth, event_id, hook, target, decision, runtime, resumes, sets, acts, writes, first,
    CASE WHEN begins THEN list_append(list_transform(now, lambda t: CASE WHEN t.s = resumes THEN {_session(d="NULL::TIMESTAMP")} ELSE t END),
        {{'s': session_id, 'st': 'registered', 'p': coalesce(old.p, false), 'w': ts, 'd': NULL::TIMESTAMP, 'sw': next_ts, 'si': next_id, 'nt': coalesce(old.nt, false), 'iss': coalesce(old.iss, session_id), 'dep': coalesce(old.dep + 1, 0)}})
      WHEN hook = 'SessionStart' THEN now
      ELSE list_transform(now, lambda t: CASE WHEN t.s <> coalesce(target, '') THEN t
        WHEN writes THEN {_session(st="coalesce(sets, t.st)", p="CASE WHEN hook = 'pause' THEN true WHEN hook = 'resume' AND went THEN false ELSE t.p END", w="ts", d=f"CASE WHEN sets = 'waiting' THEN ts + {_IDLE} END", sw="next_ts", si="next_id", nt="t.nt OR first")}
        ELSE t END) END,
    swept
  FROM (
    SELECT *, own IS NOT NULL AND (CASE hook WHEN 'deadline' THEN own.d = ts WHEN 'SessionStart' THEN false WHEN 'PostToolUse' THEN false WHEN 'UserPromptSubmit' THEN NOT own.p ELSE true END) IS TRUE OR begins AS writes,
      CASE hook WHEN 'SessionStart' THEN begins WHEN 'SessionEnd' THEN decision = 'ok' AND own.st <> 'closed' ELSE coalesce(decision = 'ok', false) END AS acts,
      CASE WHEN begins THEN 'registered' WHEN hook = 'deadline' AND own.d = ts AND NOT inactive THEN 'closed' WHEN hook = 'SessionEnd' AND decision = 'ok' AND own.st <> 'closed' THEN 'closed'
        WHEN hook = 'UserPromptSubmit' AND decision = 'ok' THEN 'responding' WHEN hook = 'Stop' AND decision = 'ok' THEN 'waiting' END AS sets,
      coalesce(hook = 'UserPromptSubmit' AND decision = 'ok' AND NOT own.nt, false) AS first,
      CASE WHEN hook = 'deadline' AND own.d = ts THEN CASE WHEN inactive THEN 'project_inactive' ELSE 'ok' END WHEN hook = 'SessionStart' AND decision <> 'ok' THEN decision WHEN begins THEN 'ok'
        WHEN hook IN ('UserPromptSubmit', 'Stop', 'PostToolUse') AND decision IN ('ok', 'project_inactive') THEN decision END AS runtime,
      list_filter(now, lambda t: t.s = resumes)[1] AS old
    FROM (
      SELECT *, hook = 'SessionStart' AND reason = 'ok' AND NOT inactive AND own IS NULL AS begins, CASE WHEN hook = 'SessionStart' AND reason = 'ok' AND NOT inactive AND own IS NULL AND is_resume THEN newest END AS resumes,
        CASE WHEN hook IN ('deadline', 'pause', 'resume') THEN NULL WHEN hook = 'SessionStart' THEN CASE WHEN reason <> 'ok' THEN reason WHEN inactive THEN 'project_inactive' ELSE 'ok' END
          WHEN own IS NULL THEN 'no_state' WHEN own.p THEN 'paused' WHEN inactive AND hook <> 'SessionEnd' THEN 'project_inactive' ELSE 'ok' END AS decision
      FROM (
        SELECT *, list_filter(now, lambda t: t.s = target)[1] AS own FROM (
          SELECT *, CASE WHEN hook IN ('pause', 'resume') THEN newest ELSE session_id END AS target FROM (
            SELECT *, list_sort(list_transform(list_filter(now, lambda t: t.st <> 'closed' AND (hook <> 'resume' OR t.p)), lambda t: {{'w': t.w, 's': t.s}}))[-1].s AS newest FROM (
              SELECT x.*, list_transform(list_filter(m.sessions, lambda t: {_STALE.format(at="x.ts")}), lambda t: {{'s': t.s, 'at': t.sw, 'si': t.si}}) AS swept,
                list_transform(m.sessions, lambda t: CASE WHEN {_STALE.format(at="x.ts")} THEN {_session(st="'closed'")} ELSE t END) AS now
              FROM m JOIN x ON x.cwd = m.cwd AND x.j = m.j + 1))))))),
sweeps AS (
  SELECT cwd, unnest(swept) AS u FROM m
  UNION ALL SELECT cwd, unnest(list_transform(list_filter(sessions, lambda t: {_STALE.format(at="'9999-01-01'::TIMESTAMP")}), lambda t: {{'s': t.s, 'at': t.sw, 'si': t.si}})) FROM m WHERE (cwd, j) IN (SELECT cwd, max(j) FROM x GROUP BY 1)),
closings AS (SELECT u.s AS session_id, cwd, u."at" AS at_ts, 'sweep' AS cause, u.si AS swept_by FROM sweeps UNION ALL SELECT session_id, cwd, ts, 'timer', NULL FROM m WHERE hook = 'deadline' AND sets = 'closed'),
own AS (SELECT *, list_filter(sessions, lambda t: t.s = session_id)[1] AS me FROM m WHERE hook IS NOT NULL AND hook <> 'deadline'),
h AS (SELECT session_id, ts AS at_ts, CASE WHEN nth = 0 THEN 'event' ELSE 'control' END AS cause, CASE WHEN nth = 0 THEN event_id END AS event_id, hook, me.st AS status, nth FROM own WHERE writes
  UNION ALL SELECT session_id, at_ts, cause, swept_by, NULL, 'closed', CASE cause WHEN 'sweep' THEN -2 ELSE -1 END FROM closings),
history AS (SELECT *, lead(at_ts) OVER (PARTITION BY session_id ORDER BY at_ts, nth, event_id) IS NULL AS is_current FROM h),
d AS (SELECT event_id, cwd, session_id, ts, hook, decision FROM m WHERE decision IS NOT NULL),
res AS (SELECT event_id, session_id, cwd, ts, resumes FROM m WHERE resumes IS NOT NULL),
chain AS (SELECT session_id, me.iss AS issue_session, me.dep AS depth, me.nt AS notified FROM own WHERE hook = 'SessionStart' AND acts),
said AS (SELECT cwd, arg_max({{'at': ts, 'cause': CASE nth WHEN 0 THEN 'event' ELSE 'timer' END, 'id': event_id, 'why': runtime}}, (ts, nth, event_id)) AS l FROM m WHERE runtime IS NOT NULL GROUP BY 1),
run AS (SELECT cwd, l."at" AS at_ts, l.cause AS cause, l.id AS event_id, l.why AS decision FROM said)"""
_SWEEP = f"""WITH {_LOG},
x AS (SELECT event_id, session_id, hook, ts + {_IDLE} AS due, lead(ts) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS next_ts FROM w),
s AS (SELECT ts AS start_ts, event_id AS start_id FROM log WHERE hook = 'SessionStart'),
sweep AS (SELECT x.event_id, x.session_id, x.due, s.start_id AS swept_by, s.start_ts AS swept_at
  FROM x ASOF JOIN s ON x.due <= s.start_ts WHERE x.hook <> 'SessionEnd' AND (x.next_ts IS NULL OR s.start_ts <= x.next_ts))"""
_TEXTS = "CASE decision WHEN 'notes_repo_public' THEN 'tracking is off: the notes repository is public' WHEN 'notes_repo_check_failed' THEN 'tracking is off: the notes repository could not be checked' WHEN 'project_inactive' THEN 'tracking is off: the board is inactive' ELSE 'tracking is on' END"
_CACHE = """SELECT update_id, project, status AS last_status,
  last_value(CASE WHEN update_id % 4 <> 0 THEN created_at END IGNORE NULLS) OVER o AS last_synced_at,
  last_value(CASE WHEN update_id % 4 <> 0 THEN update_id END IGNORE NULLS) OVER o AS status_update_id,
  CASE WHEN update_id % 4 = 0 THEN concat('update ', update_id, ' failed') END AS last_error
FROM audit WINDOW o AS (PARTITION BY project ORDER BY created_at, update_id ROWS UNBOUNDED PRECEDING)"""
_PROMPTS = f"p AS (SELECT conv_id, turn, trim(text, {_B}) AS prompt FROM conversations WHERE role = 'user' AND length(trim(text, {_B})) > 0)"
_REMOTES = """r AS (SELECT page_id, CASE page_id % 8
    WHEN 0 THEN concat('https://github.com/', o, '/', repo) WHEN 1 THEN concat('https://github.com/', o, '/', repo, '.git')
    WHEN 2 THEN concat('git@github.com:', o, '/', repo, '.git') WHEN 3 THEN concat('ssh://git@ssh.github.com:443/', o, '/', repo)
    WHEN 4 THEN concat('https://example.org/', o, '/', repo) WHEN 5 THEN concat('https://github.com/', o)
    WHEN 6 THEN concat(' http://github.com/', o, '/', repo, '/tree/main') ELSE concat('https://github.com/', o, '/', repo, '/') END AS url
  FROM (SELECT page_id, regexp_extract(url, '://([^./]+)', 1) AS o, concat('repo', page_id % 97) AS repo FROM pages)),
strict AS (SELECT page_id, url, CASE WHEN len(parts) >= 2 THEN concat(parts[1], '/', parts[2]) END AS repo FROM (
  SELECT page_id, url, list_filter(string_split(CASE
      WHEN regexp_matches(bare, '^https?://') THEN regexp_extract(bare, '^https?://github\\.com/+([^?#]*)', 1)
      WHEN regexp_matches(bare, '^ssh://') THEN regexp_extract(bare, '^ssh://(?:[^/@]*@)?(?:ssh\\.)?github\\.com(?::\\d+)?/+([^?#]*)', 1)
      ELSE regexp_extract(bare, '^(?:[^@/]+@)?github\\.com:(.+)$', 1) END, '/'), lambda x: x <> '') AS parts
  FROM (SELECT page_id, url, regexp_replace(trim(url), '\\.git$', '') AS bare FROM r)))"""
_ENV = f"""WITH lines AS (
  SELECT page_id, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS line_no, unnest([concat('OWNER=user', page_id), concat(' REPO = "o/r', page_id, '"  '), '# OWNER=none', '',
    concat('TIMEOUT=', page_id, ' # seconds'), concat('OWNER=''other', page_id, ''''), concat('QUERY=a=b&c=', page_id), concat('NOTE="''x#', page_id, '''"')]) AS line FROM pages),
pairs AS (SELECT page_id, line_no, trim(string_split(t, '=')[1], {_B}) AS key, trim(regexp_extract(t, '(?s)^[^=]*=(.*)$', 1), {_B}) AS raw
  FROM (SELECT *, trim(line, {_B}) AS t FROM lines) WHERE NOT starts_with(t, '#') AND contains(t, '=')),
plain AS (SELECT page_id, line_no, key, CASE WHEN raw[1] IN ('"', '''') THEN raw ELSE trim(string_split(raw, '#')[1], {_B}) END AS v FROM pairs)
"""
_ASK = f"""WITH {_LOG}, t AS (
  SELECT log.event_id, log.k, part.* FROM log JOIN part ON log.k + 1 = part.p_partkey WHERE log.hook = 'PostToolUse'),
lines AS (
  SELECT event_id, 0 AS pos, concat('- **', p_name, '** → yes', ' _(last)_') AS line FROM t
  UNION ALL SELECT event_id, 1, concat('- **Which brand?** → ', p_brand, CASE WHEN k % 2 = 0 AND p_type <> '' THEN concat(' _(', p_type, ')_') ELSE '' END) FROM t
  UNION ALL SELECT event_id, 2, '- **Not asked?** → maybe' FROM t)"""
_MACHINES = """WITH m AS (SELECT c_custkey, c_custkey // 1 % 2 = 1 AS python, c_custkey // 2 % 2 = 1 AS gh, c_custkey // 4 % 2 = 1 AS auth, c_custkey // 8 % 2 = 1 AS sp, c_custkey // 16 % 2 = 1 AS sr,
  c_custkey // 32 % 2 = 1 AS config, c_custkey // 64 % 2 = 1 AND c_custkey // 128 % 2 = 1 AS files, c_custkey // 256 % 2 = 1 AS ue, c_custkey // 512 % 2 = 1 AS uh,
  c_custkey % 3 = 0 AS le, c_custkey % 9 = 0 AS lh, c_custkey % 6 = 0 AS li, c_custkey % 4 AS bad, c_custkey % 5 AS vis FROM customer)"""
_P = "CASE WHEN {} THEN 'PASS' ELSE 'FAIL' END"
_CHECKS = _MACHINES + ", d AS (" + " UNION ALL ".join(
    f"SELECT c_custkey, {n} AS nth, {status} AS status, '{label}' AS label, {detail} AS detail FROM m WHERE {on}"
    for n, on, status, label, detail in (
        (1, "true", _P.format("python"), "python", "''"),
        (2, "true", _P.format("gh"), "gh", "''"),
        (3, "gh", _P.format("auth"), "auth", "''"),
        (4, "gh AND auth", _P.format("sp AND sr"), "scopes", "CASE WHEN sp AND sr THEN 'project, repo' WHEN sp THEN 'project' WHEN sr THEN 'repo' ELSE 'none' END"),
        (5, "true", _P.format("config"), "config", "''"),
        (6, "true", _P.format("files"), "files", "''"),
        (7, "true", "CASE WHEN ue AND uh THEN 'PASS' ELSE 'WARN' END", "user settings", "''"),
        (8, "true", "CASE WHEN li AND le THEN 'FAIL' WHEN le AND lh THEN 'PASS' ELSE 'WARN' END", "local settings", "''"),
        (9, "NOT (ue AND uh) AND NOT (le AND lh AND NOT li)", "'FAIL'", "registration", "''"),
        (10, "config AND gh", _P.format("vis < 3"), "visibility", "''"),
        (11, "config AND gh", _P.format("vis < 4"), "project", "''"),
        (12, "true", _P.format("bad = 0"), "states", "concat(bad, ' invalid')"),
    )
) + ")"
_SETTINGS = """WITH s AS (SELECT n_regionkey, ['SessionStart', 'UserPromptSubmit', 'PostToolUse', 'Stop', 'SessionEnd', 'Notification'][n_nationkey % 6 + 1] AS event,
  concat('run ', CASE WHEN n_nationkey % 4 = 0 THEN 'tracker.py' ELSE lower(n_name) END) AS command FROM nation)"""

ORACLES = {
    "hook_log": f"WITH {_LOG} SELECT event_id, ts, cwd, hook, n, session_id, k, is_resume FROM log",
    "orphan_events": f"WITH {_LOG} SELECT event_id, cwd, hook FROM log WHERE n = 0",
    "board_snapshot": _STATES + " SELECT status, count(*) AS sessions FROM history WHERE is_current GROUP BY 1",
    "status_history": _STATES + " SELECT session_id, at_ts, cause, event_id, hook, status, is_current FROM history",
    "stream_lifecycle": _STATES + " SELECT session_id, at_ts, cause, event_id, hook, status, is_current FROM history",
    "idle_close": f"""WITH {_LOG}, x AS (SELECT *, lead(ts) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS next_ts FROM w)
      SELECT event_id, session_id, ts AS stop_ts, ts + {_IDLE} AS deadline, next_ts IS NULL OR next_ts >= ts + {_IDLE} AS closes FROM x WHERE hook = 'Stop'""",
    "duplicate_start": f"""WITH {_LOG}, x AS (SELECT event_id, concat(cwd, '-', k % 10) AS start_key, ts FROM log WHERE hook = 'SessionStart'),
      y AS (SELECT *, row_number() OVER (PARTITION BY start_key ORDER BY ts, event_id) AS nth FROM x) SELECT event_id, start_key, nth, nth > 1 AS skipped FROM y""",
    "first_prompt_notice": _STATES + " SELECT session_id, event_id, concat('Session ', session_id, ' is tracked') AS notice FROM m WHERE first",
    "stale_sweep": _SWEEP + " SELECT * FROM sweep",
    "sweep_count": _SWEEP + " SELECT swept_by, count(*) AS sessions FROM sweep GROUP BY 1",
    "resume_match": _STATES + " SELECT event_id, session_id, resumes FROM res",
    "issue_chain": _STATES + " SELECT session_id, issue_session, depth, count(*) OVER (PARTITION BY issue_session) > 1 AS shared_item FROM chain",
    "latest_session_by_cwd": f"WITH {_LOG} SELECT cwd, arg_max(session_id, (ts, session_id, event_id)) AS session_id, max(ts) AS last_write_ts FROM w GROUP BY 1",
    "active_dates": f"""WITH {_LOG} SELECT session_id, min(CASE WHEN hook = 'SessionStart' THEN CAST(ts AS DATE) END) AS created_on, max(CASE WHEN hook IN ('UserPromptSubmit', 'Stop') THEN CAST(ts AS DATE) END) AS last_active FROM log WHERE n > 0 GROUP BY 1""",
    "effects": _STATES + """, e AS (SELECT *, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp FROM m WHERE acts)
      SELECT session_id, ts AS at_ts, event_id, 'issue' AS kind, concat('[', stamp, '] … — p', cwd) AS value FROM e WHERE hook = 'SessionStart' AND resumes IS NULL
      UNION ALL SELECT session_id, ts, event_id, 'body', concat('**session:** `', session_id, '`  ', chr(10), '**time:** `', stamp, '`  ', chr(10), '**address:** `10.0.', cwd // 250 % 250, '.', cwd % 250, '`  ', chr(10), '**folder:** `/home/u/p', cwd, '`  ', chr(10), '**transcript:** `/home/u/transcripts/', session_id, '.jsonl`  ') FROM e WHERE hook = 'SessionStart' AND resumes IS NULL
      UNION ALL SELECT session_id, ts, event_id, 'label', concat('area', cwd % 7) FROM e WHERE hook = 'SessionStart' AND resumes IS NULL AND cwd % 2 = 0
      UNION ALL SELECT session_id, ts, event_id, 'created_date', CAST(CAST(ts AS DATE) AS VARCHAR) FROM e WHERE hook = 'SessionStart' AND resumes IS NULL
      UNION ALL SELECT session_id, ts, event_id, 'resumed', concat('goes on from ', resumes) FROM e WHERE hook = 'SessionStart' AND resumes IS NOT NULL
      UNION ALL SELECT session_id, ts, event_id, 'status', CASE hook WHEN 'SessionStart' THEN 'registered' WHEN 'UserPromptSubmit' THEN 'responding' ELSE 'waiting' END FROM e WHERE hook IN ('SessionStart', 'UserPromptSubmit', 'Stop')
      UNION ALL SELECT session_id, ts, event_id, 'active_date', CAST(CAST(ts AS DATE) AS VARCHAR) FROM e WHERE hook IN ('UserPromptSubmit', 'Stop')
      UNION ALL SELECT session_id, ts, event_id, 'title', concat('prompt ', event_id) FROM e WHERE hook = 'UserPromptSubmit'
      UNION ALL SELECT session_id, ts, event_id, 'comment', hook FROM e WHERE hook IN ('UserPromptSubmit', 'Stop', 'PostToolUse')
      UNION ALL SELECT session_id, ts, event_id, 'close', 'end' FROM e WHERE hook = 'SessionEnd'
      UNION ALL SELECT session_id, at_ts, swept_by, 'close', cause FROM closings""",
    "last_state": f"WITH {_LOG} SELECT session_id, ts, event_id, cwd, hook, status FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) AS r FROM w) WHERE r = 1",
    "closings": _STATES + " SELECT session_id, at_ts, cause, swept_by FROM closings",
    "board_gate": f"WITH {_LOG}, {_BOARD} SELECT log.event_id, board.board_status, coalesce(board.board_status = 'INACTIVE', false) AS gated FROM log ASOF LEFT JOIN board ON log.ts >= board.created_at",
    "board_status_now": f"WITH {_LOG} SELECT coalesce(arg_max(status, (created_at, update_id)) = 'INACTIVE', false) AS inactive FROM (SELECT * FROM audit ORDER BY created_at DESC, update_id DESC LIMIT 20) WHERE marked",
    "gated_status": _STATES + " SELECT event_id, hook, decision FROM d",
    "runtime_status": _STATES + f" SELECT *, {_TEXTS} AS text FROM run",
    "audit_cache": f"WITH {_LOG} {_CACHE}",
    "audit_body": f"""WITH {_LOG} SELECT update_id, concat('{_M}', chr(10), '- Status: ', status, chr(10), '- Project: ', project, chr(10), '- Update: ', update_id, chr(10), '- Session: ',
      CASE WHEN update_id % 2 = 0 THEN concat('s', update_id) ELSE '_Unavailable_' END, chr(10), '- Workspace: _Unavailable_', chr(10), '- Actor: cli', chr(10), chr(10), lower(status)) AS text FROM audit""",
    "privacy_gate": "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'ok' WHEN 2 THEN 'notes_repo_public' WHEN 3 THEN 'notes_repo_public' ELSE 'notes_repo_check_failed' END AS decision FROM pages",
    "issue_title_prefix": f"""WITH {_PROMPTS}, c AS (SELECT *, concat('team/context-of-conversation-', conv_id) AS ctx FROM p)
      SELECT conv_id, turn, substring(concat('[', CASE WHEN length(ctx) > 30 THEN concat(substring(ctx, 1, 30), '...') ELSE ctx END, '] ', prompt), 1, 80) AS title FROM c""",
    "issue_title_label": f"WITH {_PROMPTS} SELECT conv_id, turn, substring(prompt, 1, 80) AS title FROM p",
    "latest_title": f"WITH {_PROMPTS} SELECT conv_id, arg_max(substring(prompt, 1, 80), turn) AS title, max(turn) AS turn FROM p GROUP BY 1",
    "session_comments": f"""SELECT conv_id, turn, concat('**[turn ', turn, '] ', CASE role WHEN 'user' THEN 'Prompt' ELSE 'Response' END, '**', chr(10), chr(10), trim(text, {_B})) AS body
      FROM conversations WHERE role IN ('user', 'assistant') AND length(trim(text, {_B})) > 0""",
    "repo_from_url_strict": f"WITH {_REMOTES} SELECT page_id, repo FROM strict",
    "repo_from_url_loose": f"""WITH {_REMOTES}, b AS (SELECT page_id, regexp_replace(trim(url), '[.git]+$', '') AS bare FROM r)
      SELECT page_id, CASE WHEN NOT contains(bare, 'github.com') THEN NULL WHEN starts_with(bare, 'https') THEN concat(string_split(bare, '/')[-2], '/', string_split(bare, '/')[-1]) ELSE string_split(bare, ':')[-1] END AS repo FROM b""",
    "context_repo": f"""WITH {_REMOTES} SELECT page_id, coalesce(repo, CASE WHEN page_id % 3 = 0 THEN 'team/notes' END, CASE WHEN page_id % 2 = 0 THEN concat('p', page_id) ELSE 'workspace' END) AS context FROM strict""",
    "env_parse_last": _ENV + "SELECT page_id, key, arg_max(regexp_replace(regexp_replace(v, '^[\"'']', ''), '[\"'']$', ''), line_no) AS value FROM plain GROUP BY 1, 2",
    "env_parse_first": _ENV + "SELECT page_id, key, arg_min(trim(trim(v, '\"'), ''''), line_no) AS value FROM plain GROUP BY 1, 2",
    "answer_lines": _ASK + " SELECT event_id, CAST(pos AS BIGINT) AS pos, line FROM lines",
    "answer_comment": _ASK + " SELECT event_id, concat('**Answer**', chr(10), chr(10), string_agg(line, chr(10) ORDER BY pos)) AS body FROM lines GROUP BY 1",
    "labels_ensure": """WITH t AS (SELECT conv_id, concat('team/r', conv_id % 4) AS repo, concat('area', conv_id % 7) AS area FROM conversations WHERE role IN ('user', 'assistant')),
      wanted AS (SELECT repo, 'session' AS label FROM t UNION SELECT repo, area FROM t WHERE conv_id % 2 = 0 AND conv_id % 3 <> 0)
      SELECT repo, label FROM wanted EXCEPT SELECT repo, area FROM t WHERE conv_id % 5 = 0""",
    "addresses": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 4 <> 0 THEN concat('https://github.com/team/notes/issues/', o_orderkey) END AS issue,
      CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 THEN concat('https://github.com/users/team/notes/projects/', o_orderkey % 5) END AS board,
      concat(substring(concat('order-', o_orderkey), 1, 8), '…') AS short, CASE WHEN o_orderstatus = 'F' THEN 'yes' ELSE 'no' END AS done, o_orderkey * 61 // 60 AS minutes FROM orders""",
    "hooks_merge": _SETTINGS + """ SELECT n_regionkey, event, string_agg(command, ',' ORDER BY command) AS commands FROM s WHERE event = 'Notification' GROUP BY 1, 2
      UNION ALL SELECT r, unnest(['SessionStart', 'UserPromptSubmit', 'PostToolUse', 'Stop', 'SessionEnd']), 'run tracker.py' FROM (SELECT DISTINCT n_regionkey AS r FROM nation)""",
    "hooks_remove": _SETTINGS + " SELECT n_regionkey, event, string_agg(command, ',' ORDER BY command) AS commands FROM s WHERE NOT contains(command, 'tracker.py') GROUP BY 1, 2",
    "install_state": _MACHINES + " SELECT c_custkey, CASE WHEN config AND files AND ((ue AND uh) OR (le AND lh)) THEN 'installed' WHEN config OR files OR ue OR le THEN 'partial' ELSE 'not-installed' END AS state FROM m",
    "doctor_report": _CHECKS + " SELECT * FROM d",
    "doctor_verdict": _CHECKS + " SELECT c_custkey, CASE WHEN bool_or(status = 'FAIL') THEN 'action needed' ELSE 'healthy' END AS verdict, CAST(bool_or(status = 'FAIL') AS INTEGER) AS exit_code, count(*) FILTER (WHERE status = 'WARN') AS warnings FROM d GROUP BY 1",
    "setup_next_step": """WITH s AS (SELECT c_custkey, list_distinct(list_concat(list_filter([CASE WHEN c_custkey % 2 = 1 THEN 'storage' END, CASE WHEN c_custkey // 2 % 2 = 1 THEN 'project' END, CASE WHEN c_custkey // 4 % 2 = 1 THEN 'fields' END,
        CASE WHEN c_custkey // 8 % 2 = 1 THEN 'statuses' END, CASE WHEN c_custkey // 16 % 2 = 1 THEN 'link' END], lambda x: x IS NOT NULL), [CASE WHEN c_custkey % 7 = 0 THEN 'storage' ELSE 'project' END])) AS done FROM customer),
      x AS (SELECT *, list_filter(['storage', 'project', 'fields', 'statuses', 'link'], lambda x: NOT list_contains(done, x)) AS todo FROM s)
      SELECT c_custkey, array_to_string(list_sort(done), ',') AS done, todo[1] AS next_step, CASE WHEN len(todo) = 0 THEN 'restore' WHEN len(todo) = 5 THEN 'start' ELSE 'resume' END AS action FROM x""",
    "meta_complete": """WITH x AS (SELECT c_custkey, CAST(c_custkey % 5 = 0 AS BIGINT) + CAST(c_custkey % 6 = 0 AS BIGINT) + CAST(c_custkey % 7 = 0 AS BIGINT) + CAST(c_custkey % 8 = 0 AS BIGINT) + CAST(c_custkey % 9 = 0 AS BIGINT) + CAST(c_custkey % 10 = 0 AS BIGINT) AS missing FROM customer)
      SELECT c_custkey, CASE WHEN missing = 0 THEN 'reuse' ELSE 'rebuild' END AS plan, missing FROM x""",
    "status_report": _STATES.replace("WITH RECURSIVE ", _MACHINES.replace("WITH m AS", "WITH RECURSIVE box AS") + ", ", 1) + f""", c AS ({_CACHE}), s AS (SELECT project, arg_max({{'st': last_status, 'at': last_synced_at, 'err': last_error}}, update_id) AS s FROM c GROUP BY 1),
      ends AS (SELECT cwd, unnest(sessions) AS t FROM m WHERE (cwd, j) IN (SELECT cwd, max(j) FROM x GROUP BY 1)),
      o AS (SELECT cwd, t.s AS session_id, t.st AS status, t.w AS last_ts, t.p AS paused FROM ends WHERE t.st <> 'closed' AND t.sw IS NULL),
      act AS (SELECT cwd, arg_max({{'id': session_id, 'st': status, 'paused': paused}}, (last_ts, session_id)) AS o FROM o GROUP BY 1),
      r AS (SELECT w.cwd, act.o.id AS session_id, act.o.st AS status, coalesce(act.o.paused, false) AS paused, s.s.st AS last_status, s.s.err AS err, coalesce(strftime(s.s."at", '%Y-%m-%d %H:%M:%S'), s.s.err) AS synced, run.decision, box.*
        FROM (SELECT DISTINCT cwd FROM log) w LEFT JOIN act ON act.cwd = w.cwd LEFT JOIN s ON s.project = w.cwd LEFT JOIN run ON run.cwd = w.cwd LEFT JOIN box ON box.c_custkey = w.cwd)
      SELECT cwd, 0 AS nth, 'install' AS label, CASE WHEN c_custkey IS NULL THEN 'none' WHEN config AND files AND ((ue AND uh) OR (le AND lh)) THEN 'installed' WHEN config OR files OR ue OR le THEN 'partial' ELSE 'not-installed' END AS value FROM r
      UNION ALL SELECT cwd, 1, 'files', CASE WHEN coalesce(files, false) THEN 'yes' ELSE 'no' END FROM r
      UNION ALL SELECT cwd, 2, 'user settings', CASE WHEN c_custkey IS NULL THEN 'none' WHEN ue AND uh THEN 'installed' WHEN ue THEN 'present but hooks missing' ELSE 'not present' END FROM r
      UNION ALL SELECT cwd, 3, 'local settings', CASE WHEN c_custkey IS NULL THEN 'none' WHEN li AND le THEN 'invalid settings' WHEN le AND lh THEN 'installed' WHEN le THEN 'present but hooks missing' ELSE 'not present' END FROM r
      UNION ALL SELECT cwd, 4, 'config', CASE WHEN coalesce(config, false) THEN 'yes' ELSE 'no' END FROM r
      UNION ALL SELECT cwd, 5, 'timeout', '30 min' FROM r
      UNION ALL SELECT cwd, 6, 'session', coalesce(substring(session_id, 1, 8) || '…', 'none') FROM r
      UNION ALL SELECT cwd, 7, 'status', coalesce(status, 'none') FROM r
      UNION ALL SELECT cwd, 8, 'paused', CASE WHEN paused THEN 'yes' ELSE 'no' END FROM r
      UNION ALL SELECT cwd, 9, 'issue', CASE WHEN session_id IS NOT NULL AND cwd <> 0 THEN concat('https://github.com/team/notes/issues/', cwd) ELSE 'none' END FROM r
      UNION ALL SELECT cwd, 10, 'sync', CASE WHEN synced IS NULL THEN 'never' WHEN err IS NULL THEN concat(last_status, ' at ', synced) ELSE concat('failed (', err, ')') END FROM r
      UNION ALL SELECT cwd, 11, 'blocked', CASE WHEN coalesce(decision <> 'ok', false) THEN 'yes' ELSE 'no' END FROM r
      UNION ALL SELECT cwd, 12, 'note', CASE WHEN decision IS NULL THEN 'no event was gated' ELSE {_TEXTS} END FROM r""",
    "issue_numbers": _STATES + " SELECT session_id, event_id, row_number() OVER (ORDER BY ts, event_id) AS number FROM m WHERE hook = 'SessionStart' AND acts AND resumes IS NULL",
    "notices": _STATES + f""", num AS (SELECT session_id, row_number() OVER (ORDER BY ts, event_id) AS number FROM m WHERE hook = 'SessionStart' AND acts AND resumes IS NULL)
      SELECT m.event_id, m.session_id, concat('This session is tracked at https://github.com/team/notes/issues/', num.number, CASE WHEN chain.depth > 0 THEN ' (resumed)' ELSE '' END) AS notice
      FROM m JOIN chain ON chain.session_id = m.session_id JOIN num ON num.session_id = chain.issue_session WHERE m.hook = 'SessionStart' AND m.acts
      UNION ALL SELECT event_id, session_id, {_TEXTS} FROM d WHERE hook = 'SessionStart' AND decision <> 'ok'""",
    "control_updates": f"""WITH {_LOG} SELECT project AS cwd, created_at, status, concat('{_M}', chr(10), '- Status: ', status, chr(10), '- Workspace: ', project, chr(10), '- Time: ', strftime(created_at, '%Y-%m-%dT%H:%M:%S.%g'), 'Z', chr(10), '- Actor: cli', chr(10), chr(10),
      CASE WHEN status = 'INACTIVE' THEN 'tracking is paused' ELSE 'tracking goes on' END) AS body FROM audit WHERE update_id % 5 <> 0""",
    "setup_cleanup": """SELECT c_custkey AS id, 0 AS nth, 'delete_project' AS kind, CASE WHEN c_custkey % 2 = 0 THEN concat('P', c_custkey) ELSE CAST(c_custkey AS VARCHAR) END AS value FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0
      UNION ALL SELECT c_custkey, 1, 'delete_repo', concat('team/r', c_custkey) FROM customer WHERE c_custkey % 5 < 3 UNION ALL SELECT c_custkey, 2, 'clear_ledger', '' FROM customer""",
    "title_examples": f"""WITH {_PROMPTS} SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN concat(substring(prompt, 1, 80), '  (team/r', conv_id, ')') ELSE substring(concat('[team/r', conv_id, '] ', prompt), 1, 80) END AS example FROM p""",
    "pause_spans": f"""WITH {_LOG}, c AS (SELECT project AS cwd, status = 'INACTIVE' AS pause, created_at AS ts FROM audit WHERE status = 'INACTIVE' OR update_id % 5 <> 0),
      x AS (SELECT *, lead(ts) OVER (PARTITION BY cwd ORDER BY ts) AS until FROM c) SELECT cwd, ts AS paused_at, until FROM x WHERE pause""",
    "sync_record": f"""WITH {_LOG} SELECT update_id, status, update_id % 4 <> 0 AS success, CASE WHEN update_id % 4 <> 0 THEN created_at END AS synced_at,
      CASE WHEN update_id % 4 <> 0 THEN update_id END AS status_update_id, CASE WHEN update_id % 4 = 0 THEN 'the board did not answer' END AS error FROM audit""",
    "open_sessions": f"""WITH {_LOG}, x AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) AS r FROM w)
      SELECT session_id, ts AS last_write_ts, status FROM x WHERE r = 1 AND status <> 'closed' AND k % 3 = 0""",
    "board_projects": """SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN concat('u', o_orderkey) END, CASE WHEN o_orderkey % 2 = 0 THEN concat('g', o_orderkey) END) AS project,
      CASE WHEN 1 + o_orderkey % 40 <= 30 THEN 1 + o_orderkey % 40 END AS field,
      array_to_string(list_sort(list_filter([CASE WHEN o_orderkey % 2 = 0 THEN 'registered' END, CASE WHEN o_orderkey % 3 = 0 THEN 'responding' END, CASE WHEN o_orderkey % 4 = 0 THEN 'waiting' END, CASE WHEN o_orderkey % 5 = 0 THEN 'closed' END], lambda x: x IS NOT NULL)), ',') AS missing FROM orders""",
    "create_response": """SELECT o_orderkey, concat('I_', o_orderkey) AS item_id, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey + 7 END AS number, o_orderkey % 6 = 0 AS scopes,
      CASE WHEN o_orderkey % 4 = 0 THEN concat('AB12-', lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0')) END AS code FROM orders""",
    "meta_decode": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN concat('P', o_orderkey) END AS project, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey END AS number, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END AS waiting FROM orders",
    "first_project": "SELECT number, title FROM (SELECT o_orderkey AS number, o_orderpriority AS title FROM orders ORDER BY 1 DESC LIMIT 20) WHERE title = '1-URGENT' ORDER BY number DESC LIMIT 1",
    "config_text": """SELECT o_orderkey, concat('OWNER=u', o_orderkey, chr(10), 'NUMBER=', o_orderkey, chr(10), CASE WHEN o_orderkey % 2 = 0 THEN concat('LABEL=label', chr(10)) ELSE '' END, CASE WHEN o_orderkey % 3 <> 0 THEN concat('NOTE=n', chr(10)) ELSE '' END) AS text FROM orders""",
    "distro_family": "SELECT c_custkey, ['debian', 'fedora', 'arch', 'opensuse', 'void', 'unknown'][c_custkey % 6 + 1] AS family FROM customer",
    "uninstall_report": "SELECT count(*) FILTER (WHERE n_nationkey % 3 = 0) AS removed, count(*) FILTER (WHERE n_nationkey % 3 <> 0) AS \"left\" FROM nation",
}

ORACLES |= {
    "stream_effects": ORACLES["effects"],
    "last_state_by_day": ORACLES["last_state"],
    # of statuses, days and titles a session's last one
    "net_effects": f"""WITH x AS ({ORACLES["effects"]}), y AS (SELECT *, kind IN ('status', 'active_date', 'title') AS setting, row_number() OVER (PARTITION BY session_id, kind ORDER BY at_ts DESC, event_id DESC, value DESC) AS r FROM x)
      SELECT session_id, at_ts, event_id, kind, value FROM y WHERE NOT setting OR r = 1""",
    "prompt_effects": _STATES + f""", asked AS (SELECT event_id, cwd, row_number() OVER (PARTITION BY cwd ORDER BY ts, event_id) AS nth FROM log WHERE hook = 'UserPromptSubmit'),
      spoken AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS nth, trim(text, {_B}) AS prompt FROM conversations WHERE role = 'user'),
      e AS (SELECT m.session_id, m.ts AS at_ts, m.event_id, m.cwd, prompt, concat('team/context-of-workspace-area-', m.cwd % 7) AS ctx, strftime(m.ts, '%Y-%m-%d %H:%M:%S') AS stamp
        FROM m JOIN asked ON asked.event_id = m.event_id JOIN spoken ON spoken.conv_id = asked.cwd AND spoken.nth = asked.nth WHERE m.acts AND m.hook = 'UserPromptSubmit' AND length(prompt) > 0)
      SELECT session_id, at_ts, event_id, 'title' AS kind, CASE WHEN cwd % 2 = 0 THEN substring(prompt, 1, 80)
        ELSE substring(concat('[', CASE WHEN length(ctx) > 30 THEN concat(substring(ctx, 1, 30), '...') ELSE ctx END, '] ', prompt), 1, 80) END AS value FROM e
      UNION ALL SELECT session_id, at_ts, event_id, 'comment', concat('**[', stamp, '] Prompt**', chr(10), chr(10), prompt) FROM e""",
    # the text of each session's last state, cut short in every eleventh workspace, and read as JSON again
    "state_scan": _STATES + """, t AS (SELECT CAST(split_part(session_id, '-', 1) AS BIGINT) AS cwd, concat('{"session_id":"', session_id, '","status":"', status, '","created_at":"', strftime(at_ts, '%Y-%m-%dT%H:%M:%S.%f'), '"}') AS whole FROM history WHERE is_current),
      r AS (SELECT CASE WHEN cwd % 11 = 0 THEN substring(whole, 1, length(whole) - 5) ELSE whole END AS value FROM t)
      SELECT json_valid(value) AS valid, CASE WHEN json_valid(value) THEN json_extract_string(value, '$.status') END AS status, count(*) AS records FROM r GROUP BY 1, 2""",
}
