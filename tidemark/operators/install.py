"""Installation state, health checks, hook settings and the setup ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The five events that an installation handles, and the steps of a setup in order.
EVENTS = ("SessionStart", "UserPromptSubmit", "PostToolUse", "Stop", "SessionEnd")
STEPS = ("storage", "project", "fields", "statuses", "link")
REQUIRED = ("projectId", "projectNumber", "statusFieldId", "statusMap", "createdFieldId", "lastActiveFieldId")


def install_state(config: Column, files: list[Column], scopes: list[Column], exists: list[Column]) -> Column:
    """installed: config, all files and a registered scope; partial: any sign of one; else not-installed."""
    every = F.lit(True)
    for f in files:
        every = every & f
    hooked, there = F.lit(False), F.lit(False)
    for s in scopes:
        hooked = hooked | s
    for e in exists:
        there = there | e
    return F.when(config & every & hooked, "installed").when(config | every | there, "partial").otherwise("not-installed")


def machines(customer: DataFrame) -> DataFrame:
    """What a check would find on a machine, out of bits of the customer's key."""
    bit = lambda n: F.expr(f"(c_custkey div {1 << n}) % 2 = 1")
    names = ["python", "gh", "auth", "scope_project", "scope_repo", "config", "file_a", "file_b", "user_exists", "user_hooked"]
    cols = {n: bit(i) for i, n in enumerate(names)}
    cols |= {"local_exists": F.col("c_custkey") % 3 == 0, "local_hooked": F.col("c_custkey") % 9 == 0, "local_invalid": F.col("c_custkey") % 6 == 0}
    return customer.select("c_custkey", *[c.alias(n) for n, c in cols.items()], (F.col("c_custkey") % 4).alias("bad_states"), (F.col("c_custkey") % 5).alias("visibility"))


def with_state(m: DataFrame) -> DataFrame:
    c = F.col
    state = install_state(c("config"), [c("file_a"), c("file_b")], [c("user_exists") & c("user_hooked"), c("local_exists") & c("local_hooked")], [c("user_exists"), c("local_exists")])
    return m.withColumn("state", state)


def install_states(m: DataFrame) -> DataFrame:
    return with_state(m).select("c_custkey", "state")


def doctor(m: DataFrame) -> DataFrame:
    """A row per check that applies, in order: status, label and detail."""
    c = F.col
    passed = lambda ok, bad="FAIL": F.when(ok, "PASS").otherwise(bad)
    scope = lambda invalid, exists, hooked: F.when(invalid & exists, "FAIL").when(exists & hooked, "PASS").otherwise("WARN")
    hooked = (c("user_exists") & c("user_hooked")) | (c("local_exists") & c("local_hooked") & ~c("local_invalid"))
    have = F.array_sort(F.array_compact(F.array(F.when(c("scope_project"), "project"), F.when(c("scope_repo"), "repo"))))
    scopes = F.coalesce(F.nullif(F.array_join(have, ", "), F.lit("")), F.lit("none"))
    rows = [
        (1, F.lit(True), passed(c("python")), "python", None),
        (2, F.lit(True), passed(c("gh")), "gh", None),
        (3, c("gh"), passed(c("auth")), "auth", None),
        (4, c("gh") & c("auth"), passed(c("scope_project") & c("scope_repo")), "scopes", scopes),
        (5, F.lit(True), passed(c("config")), "config", None),
        (6, F.lit(True), passed(c("file_a") & c("file_b")), "files", None),
        (7, F.lit(True), scope(F.lit(False), c("user_exists"), c("user_hooked")), "user settings", None),
        (8, F.lit(True), scope(c("local_invalid"), c("local_exists"), c("local_hooked")), "local settings", None),
        (9, ~hooked, F.lit("FAIL"), "registration", None),
        (10, c("config") & c("gh"), passed(c("visibility") < 3), "visibility", None),
        (11, c("config") & c("gh"), passed(c("visibility") < 4), "project", None),
        (12, F.lit(True), passed(c("bad_states") == 0), "states", F.concat(c("bad_states").cast("string"), F.lit(" invalid"))),
    ]
    made = F.array_compact(F.array(*[F.when(on, F.struct(F.lit(n).alias("nth"), s.alias("status"), F.lit(label).alias("label"), F.coalesce(detail if detail is not None else F.lit(None).cast("string"), F.lit("")).alias("detail"))) for n, on, s, label, detail in rows]))
    return m.select("c_custkey", F.inline(made))


def verdicts(m: DataFrame) -> DataFrame:
    d = doctor(m).groupBy("c_custkey").agg(F.bool_or(F.col("status") == "FAIL").alias("bad"), F.count_if(F.col("status") == "WARN").alias("warnings"))
    return d.select("c_custkey", F.when(F.col("bad"), "action needed").otherwise("healthy").alias("verdict"), F.col("bad").cast("int").alias("exit_code"), "warnings")


def ledger(done: Column) -> tuple[Column, Column]:
    """The next step that a ledger's set of steps leaves, and what to do about it."""
    left = F.filter(F.array(*[F.lit(s) for s in STEPS]), lambda s: ~F.array_contains(done, s))
    return F.get(left, F.lit(0)), F.when(F.size(left) == 0, "restore").when(F.size(left) == len(STEPS), "start").otherwise("resume")


def record_step(done: Column, step: Column) -> Column:
    return F.array_union(done, F.array(step))


def setup_next_step(customer: DataFrame) -> DataFrame:
    bits = F.array_compact(F.array(*[F.when(F.expr(f"(c_custkey div {1 << i}) % 2 = 1"), s) for i, s in enumerate(STEPS)]))
    done = record_step(bits, F.when(F.col("c_custkey") % 7 == 0, STEPS[0]).otherwise(STEPS[1]))
    step, action = ledger(done)
    return customer.select("c_custkey", F.array_join(F.array_sort(done), ",").alias("done"), step.alias("next_step"), action.alias("action"))


def meta_complete(customer: DataFrame) -> DataFrame:
    """Whether a project's metadata has all that is required, so it can be used again."""
    values = F.array(*[F.when(F.col("c_custkey") % (i + 5) != 0, F.lit(f)) for i, f in enumerate(REQUIRED)])
    full = F.forall(values, lambda v: v.isNotNull())
    return customer.select("c_custkey", F.when(full, "reuse").otherwise("rebuild").alias("plan"), (F.lit(len(REQUIRED)) - F.size(F.array_compact(values))).cast("long").alias("missing"))


def _ours(entry: Column, commands: Column) -> Column:
    return F.exists(entry["hooks"], lambda h: F.exists(commands, lambda f: F.contains(h["command"], f)))


def merge_hooks(old: Column, ours: Column) -> Column:
    """ours over old: an event of ours replaces what old has for it."""
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(ours), k)), ours)


def remove_hooks(old: Column, commands: Column) -> Column:
    """old without entries that run one of the commands; events left empty go, and a map left empty is null."""
    left = F.map_filter(F.transform_values(old, lambda k, v: F.filter(v, lambda e: ~_ours(e, commands))), lambda k, v: F.size(v) > 0)
    return F.when(F.size(left) > 0, left)


def settings_of(nation: DataFrame) -> DataFrame:
    """Hook settings for each region: an event for each residue of the nation's key, an entry for each nation."""
    event = F.get(F.array(*[F.lit(e) for e in (*EVENTS, "Notification")]), (F.col("n_nationkey") % 6).cast("int"))
    command = F.concat(F.lit("run "), F.when(F.col("n_nationkey") % 4 == 0, "tracker.py").otherwise(F.lower("n_name")))
    entries = nation.groupBy("n_regionkey", event.alias("event")).agg(F.sort_array(F.collect_list(F.struct(F.array(F.struct(command.alias("command"))).alias("hooks")))).alias("entries"))
    return entries.groupBy("n_regionkey").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("event", "entries")))).alias("hooks"))


def flat_hooks(df: DataFrame, column: str = "hooks") -> DataFrame:
    rows = df.select("n_regionkey", F.explode(column).alias("event", "entries"))
    return rows.select("n_regionkey", "event", F.array_join(F.transform("entries", lambda e: e["hooks"][0]["command"]), ",").alias("commands"))


def hooks_merged(nation: DataFrame) -> DataFrame:
    entry = F.array(F.struct(F.array(F.struct(F.lit("run tracker.py").alias("command"))).alias("hooks")))
    ours = F.create_map(*[x for e in EVENTS for x in (F.lit(e), entry)])
    return flat_hooks(settings_of(nation).select("n_regionkey", merge_hooks(F.col("hooks"), ours).alias("hooks")))


def hooks_removed(nation: DataFrame) -> DataFrame:
    return flat_hooks(settings_of(nation).select("n_regionkey", remove_hooks(F.col("hooks"), F.array(F.lit("tracker.py"), F.lit("tracker_old.py"))).alias("hooks")))


def uninstall(found: DataFrame, known: DataFrame) -> DataFrame:
    """Dry run: how many of the files that are there would go, and how many stay."""
    both = found.join(known.select("name", F.lit(True).alias("ours")).distinct(), "name", "left")
    return both.agg(F.count_if(F.col("ours").isNotNull()).alias("removed"), F.count_if(F.col("ours").isNull()).alias("left"))


def cleanup(ledgers: DataFrame) -> DataFrame:
    """What gives up a setup that was begun, a row each in order: the project (by its id, else its number), the repository,
    and always the ledger itself. Ledgers: id, project_id, project_number, repo."""
    named = F.col("project_id").isNotNull() | F.col("project_number").isNotNull()
    rows = [
        (F.col("id").isNotNull() & named, "delete_project", F.coalesce("project_id", F.col("project_number").cast("string"))),
        (F.col("repo").isNotNull(), "delete_repo", F.col("repo")),
        (F.lit(True), "clear_ledger", F.lit("")),
    ]
    made = F.array_compact(F.array(*[F.when(on, F.struct(F.lit(i).alias("nth"), F.lit(kind).alias("kind"), value.alias("value"))) for i, (on, kind, value) in enumerate(rows)]))
    return ledgers.select("id", F.inline(made))


def ledgers(customer: DataFrame) -> DataFrame:
    """A setup for each customer, broken off after a project, a repository, both or neither."""
    key = F.col("c_custkey")
    return customer.select(
        key.alias("id"), F.when(key % 2 == 0, F.concat(F.lit("P"), key.cast("string"))).alias("project_id"),
        F.when(key % 3 == 0, key).alias("project_number"), F.when(key % 5 < 3, F.concat(F.lit("team/r"), key.cast("string"))).alias("repo"),
    )
