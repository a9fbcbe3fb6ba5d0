"""Answers of the remote board, and what is written to it: projects, fields, options, config and settings texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import decoded_json

#: The board's statuses in order, and how many fields and projects a lookup reads.
STATUS_KEYS = ("registered", "responding", "waiting", "closed")
MOST_FIELDS, MOST_PROJECTS = 30, 20
META = "projectId string, projectNumber long, statusFieldId string, statusMap map<string, string>"


def either_project(user: Column, organization: Column) -> Column:
    """A user's project, else the organization's."""
    return F.coalesce(user, organization)


def status_field(fields: Column, name: str = "Status", most: int = MOST_FIELDS) -> Column:
    """The first of the first fields with that name."""
    return F.get(F.filter(F.slice(fields, 1, most), lambda f: f["name"] == name), F.lit(0))


def option_ids(options: Column, names: dict[str, str]) -> Column:
    """status key -> option id; null for a key whose option is missing."""

    def option(name: str) -> Column:
        return F.get(F.filter(options, lambda o: o["name"] == name), F.lit(0))["id"]

    return F.create_map(*[x for key, name in names.items() for x in (F.lit(key), option(name))])


def missing_options(ids: Column) -> Column:
    return F.array_sort(F.map_keys(F.map_filter(ids, lambda k, v: v.isNull())))


def create_response(text: Column) -> tuple[Column, Column]:
    """Item id and number out of the two lines that creating an issue answers; quotes come off."""
    lines = F.split(F.trim(text), "\n")
    return F.btrim(F.get(lines, F.lit(0)), F.lit('"')), F.get(lines, F.lit(1)).try_cast("long")


def scopes_ok(output: Column) -> Column:
    return F.contains(output, F.lit("project")) & F.contains(output, F.lit("repo"))


def device_code(output: Column) -> Column:
    return F.nullif(F.regexp_extract(output, r"[A-Z0-9]{4}-[A-Z0-9]{4}", 0), F.lit(""))


def board_projects(orders: DataFrame) -> DataFrame:
    """A project answer for each order: its owner kind, up to forty fields, four options of which some are missing."""
    key = F.col("o_orderkey")
    fields = F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.struct(F.when((i == 1 + key % 40) | (i == 37), "Status").otherwise(F.concat(F.lit("f"), i.cast("string"))).alias("name"), i.alias("id")))
    options = F.array_compact(F.array(*[F.when(key % (i + 2) != 0, F.struct(F.lit(s).alias("name"), F.lit(f"o{i}").alias("id"))) for i, s in enumerate(STATUS_KEYS)]))
    user, organization = F.when(key % 3 == 0, F.concat(F.lit("u"), key.cast("string"))), F.when(key % 2 == 0, F.concat(F.lit("g"), key.cast("string")))
    ids = option_ids(F.col("options"), {s: s for s in STATUS_KEYS})
    made = orders.select("o_orderkey", either_project(user, organization).alias("project"), status_field(fields)["id"].cast("long").alias("field"), options.alias("options"))
    return made.select("o_orderkey", "project", "field", F.array_join(missing_options(ids), ",").alias("missing"))


def first_titled(projects: DataFrame, title: str, most: int = MOST_PROJECTS) -> DataFrame:
    """The first of the newest projects with that title."""
    newest = projects.orderBy(F.desc("number")).limit(most)
    return newest.filter(F.col("title") == title).orderBy(F.desc("number")).limit(1)


def responses(orders: DataFrame) -> DataFrame:
    """Ids and numbers read from the answers to creating an issue for each order."""
    text = F.concat(F.lit('"I_'), F.col("o_orderkey").cast("string"), F.lit('"\n'), F.when(F.col("o_orderkey") % 5 == 0, "none").otherwise((F.col("o_orderkey") + 7).cast("string")), F.lit("\n"))
    item, number = create_response(text)
    said = F.concat(F.lit("scopes: "), F.when(F.col("o_orderkey") % 2 == 0, "project, ").otherwise(""), F.when(F.col("o_orderkey") % 3 == 0, "repo").otherwise("gist"))
    code = F.concat(F.lit("code "), F.when(F.col("o_orderkey") % 4 == 0, "AB12-").otherwise("ab12-"), F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0"))
    return orders.select("o_orderkey", item.alias("item_id"), number.alias("number"), scopes_ok(said).alias("scopes"), device_code(code).alias("code"))


def metadata(orders: DataFrame) -> DataFrame:
    """Project metadata out of base64-coded JSON; what can't be decoded is null."""
    text = F.to_json(F.struct(F.concat(F.lit("P"), F.col("o_orderkey").cast("string")).alias("projectId"), F.col("o_orderkey").alias("projectNumber"), F.create_map(F.lit("waiting"), F.col("o_orderstatus")).alias("statusMap")))
    coded = F.when(F.col("o_orderkey") % 4 == 0, F.lit("?broken?")).otherwise(F.base64(text.cast("binary")))
    meta = decoded_json(coded, META)
    return orders.select("o_orderkey", meta["projectId"].alias("project"), meta["projectNumber"].alias("number"), meta["statusMap"]["waiting"].alias("waiting"))


def sync_record(status: Column, at: Column, ok: Column, update: Column, error: Column) -> Column:
    """What a session keeps of its last try to publish a status."""
    return F.struct(status.alias("status"), at.alias("attempted_at"), ok.alias("success"), F.when(ok, at).alias("synced_at"), F.when(ok, update).alias("status_update_id"), F.when(~ok, error).alias("error"))


def settings_text(settings: Column) -> Column:
    return F.to_json(settings)


def sessions(states: DataFrame, active_only: bool = False, paused_only: bool = False) -> DataFrame:
    """States, newest first; a missing status counts as open, a missing pause flag as not paused."""
    if active_only:
        states = states.filter("not (status <=> 'closed')")
    if paused_only:
        states = states.filter("coalesce(tracking_paused, false)")
    return states.orderBy(F.desc("last_write_ts"), F.desc("session_id"))
