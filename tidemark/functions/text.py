"""String and display scalars, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that count as white space at either end of a text.
BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0                　"
TITLE_LIMIT, CONTEXT_LIMIT = 80, 30
MODES = ("prefix", "label")
IDLE_SECONDS = 1800


def strip_ws(c: Column) -> Column:
    """Unicode white space removed at both ends; trim() would remove spaces only."""
    return F.btrim(c, F.lit(BLANKS))


def cut(c: Column, limit: int = TITLE_LIMIT) -> Column:
    return F.substring(c, 1, limit)


def title_prefix(context: Column, prompt: Column) -> Column:
    """`[context] prompt`, a long context shortened first; without context, the prompt alone."""
    short = F.when(F.length(context) > CONTEXT_LIMIT, F.concat(cut(context, CONTEXT_LIMIT), F.lit("..."))).otherwise(context)
    return F.when(F.coalesce(context, F.lit("")) == "", cut(prompt)).otherwise(cut(F.concat(F.lit("["), short, F.lit("] "), prompt)))


def title_label(prompt: Column) -> Column:
    return cut(prompt)


def name_mode(c: Column, default: str = "prefix") -> Column:
    mode = F.lower(strip_ws(c))
    return F.when(mode.isin(*MODES), mode).otherwise(default)


def idle_seconds(c: Column, default: int = IDLE_SECONDS) -> Column:
    """Whole seconds; a missing value is the default, a bad one an error."""
    return F.coalesce(F.nullif(strip_ws(c), F.lit("")).cast("int"), F.lit(default))


def minutes(seconds: Column) -> Column:
    return F.floor(seconds / 60).cast("long")


def short_id(c: Column) -> Column:
    return F.concat(F.substring(c, 1, 8), F.lit("…"))


def folder_name(path: Column, default: str = "workspace") -> Column:
    name = F.regexp_extract(path, r"([^/]+)/*$", 1)
    return F.coalesce(F.nullif(name, F.lit("")), F.lit(default))


def normal_path(path: Column) -> Column:
    """Doubled slashes, `.` parts and slashes at the end removed; links in a file system can't be followed from data."""
    once = F.regexp_replace(F.regexp_replace(path, r"/+", "/"), r"(/\.)+(?=/|$)", "")
    return F.when(once.isin("", "/"), F.lit("/")).otherwise(F.regexp_replace(once, r"/+$", ""))


def yes_no(c: Column) -> Column:
    return F.when(c, "yes").otherwise("no")


def comment(stamp: Column, label: Column, text: Column) -> Column:
    return F.concat(F.lit("**["), stamp, F.lit("] "), label, F.lit("**\n\n"), text)


def answer_line(question: Column, answer: Column, description: Column) -> Column:
    more = F.when(F.coalesce(description, F.lit("")) != "", F.concat(F.lit(" _("), description, F.lit(")_"))).otherwise("")
    return F.concat(F.lit("- **"), question, F.lit("** → "), answer, more)


def issue_title(stamp: Column, folder: Column) -> Column:
    return F.concat(F.lit("["), stamp, F.lit("] … — "), folder)


def issue_body(fields: dict[str, Column]) -> Column:
    """A line for each field, in order; a missing value shows as empty."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"**{k}:** `"), F.coalesce(v, F.lit("")), F.lit("`  ")) for k, v in fields.items()])


def sync_text(at: Column, ok: Column, status: Column, error: Column) -> Column:
    """Of the last try to publish a status: none yet, done, failed or unclear."""
    return (
        F.when(at.isNull(), "never").when(ok, F.concat(status, F.lit(" at "), at)).when(error.isNotNull(), F.concat(F.lit("failed ("), error, F.lit(")"))).otherwise("unknown")
    )


def audit_body(marker: str, fields: dict[str, Column], message: Column) -> Column:
    """The marker, a line for each field (a missing value shows as unavailable), a blank line and the message."""
    lines = [F.concat(F.lit(f"- {k}: "), F.coalesce(F.nullif(v, F.lit("")), F.lit("_Unavailable_"))) for k, v in fields.items()]
    return F.concat_ws("\n", F.lit(marker), *lines, F.lit(""), message)


def iso_utc(ts: Column) -> Column:
    """2024-01-02T03:04:05.678Z, of a time that is UTC's."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_plain(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def title_example(mode: Column, context: Column, prompt: Column) -> Column:
    """How a title looks in a mode: the context in front of it, or as a label beside it."""
    return F.when(mode == "label", F.concat(title_label(prompt), F.lit("  ("), context, F.lit(")"))).otherwise(title_prefix(context, prompt))


def decoded_json(c: Column, schema: str) -> Column:
    """A struct out of base64-coded JSON; null where either fails."""
    return F.from_json(F.try_to_binary(c, F.lit("base64")).cast("string"), schema)


def is_json(c: Column) -> Column:
    """Whether a text is one JSON value and nothing else; a parser alone stops at the end of the first value. Nothing but one value
    is at its place both in an array and in an object. No text is none."""
    alone = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"a":'), c, F.lit("}"))).isNotNull()
    return F.coalesce(alone & (F.length(strip_ws(c)) > 0), F.lit(False))
