"""Lines of KEY=VALUE files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import strip_ws


def env_pair(line: Column, quotes: str = "one") -> tuple[Column, Column]:
    """Key and value; both null where the line is blank, a comment or has no `=`.

    A value that doesn't start with a quote ends at the first `#`. quotes: `one` takes at most one quote off either
    end; `all` takes all double quotes off, then all single ones.
    """
    text = strip_ws(line)
    ok = ~text.startswith("#") & F.contains(text, F.lit("="))
    key = strip_ws(F.substring_index(text, "=", 1))
    raw = strip_ws(F.regexp_extract(text, r"(?s)^[^=]*=(.*)$", 1))
    plain = F.when(raw.rlike("^[\"']"), raw).otherwise(strip_ws(F.substring_index(raw, "#", 1)))
    value = F.regexp_replace(plain, "^[\"']|[\"']$", "") if quotes == "one" else F.btrim(F.btrim(plain, F.lit('"')), F.lit("'"))
    return F.when(ok, key), F.when(ok, value)


def env_map(lines: DataFrame, line: str, order: list[str], keys: list[str], last: bool = True) -> DataFrame:
    """One row per file (keys) and key. last: a repeated key's last line wins, else its first; order ranks the lines."""
    key, value = env_pair(F.col(line), "one" if last else "all")
    pairs = lines.select(*keys, *order, key.alias("key"), value.alias("value")).filter("key is not null")
    pick = F.max_by if last else F.min_by
    return pairs.groupBy(*keys, "key").agg(pick("value", F.struct(*order)).alias("value"))


def env_text(values: dict[str, Column], optional: dict[str, Column]) -> Column:
    """KEY=VALUE lines in order; an optional one is left out where it is null or empty."""
    lines = [F.concat(F.lit(f"{k}="), v) for k, v in values.items()] + [F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{k}="), v)) for k, v in optional.items()]
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n"))
