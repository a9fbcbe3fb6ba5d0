"""owner/repo out of git remotes, and web addresses of issues and boards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import strip_ws

HOST = "github.com"


def repo_strict(url: Column, host: str = HOST) -> Column:
    """The first two path parts of an http, https, ssh or scp-like remote of the host; else null."""
    h = host.replace(".", r"\.")
    bare = F.regexp_replace(strip_ws(url), r"\.git$", "")
    web = F.regexp_extract(bare, rf"(?i)^https?://(?:[^/@]*@)?{h}(?::\d+)?/+([^?#]*)", 1)
    ssh = F.regexp_extract(bare, rf"(?i)^ssh://(?:[^/@]*@)?(?:ssh\.)?{h}(?::\d+)?/+([^?#]*)", 1)
    scp = F.regexp_extract(bare, rf"^(?:[^@/]+@)?{h}:(.+)$", 1)
    path = F.when(bare.rlike(r"(?i)^https?://"), web).when(bare.rlike(r"(?i)^ssh://"), ssh).otherwise(scp)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.when(F.size(parts) >= 2, F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))))


def repo_loose(url: Column, host: str = HOST) -> Column:
    """The older reading: dots and the letters g, i and t fall off the end; last two parts of an https remote, else what follows the last colon."""
    bare = F.regexp_replace(strip_ws(url), r"[.git]+$", "")
    parts = F.split(bare, "/")
    tail = F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1))
    return F.when(~F.contains(bare, F.lit(host)), None).when(bare.startswith("https"), tail).otherwise(F.substring_index(bare, ":", -1))


def issue_url(repo: Column, number: Column, host: str = HOST) -> Column:
    """Null without a repo or number; 0 and the empty string count as missing."""
    return F.when((F.coalesce(repo, F.lit("")) != "") & (F.coalesce(number, F.lit(0)) != 0), F.concat(F.lit(f"https://{host}/"), repo, F.lit("/issues/"), number.cast("string")))


def board_url(owner: Column, number: Column, host: str = HOST) -> Column:
    return F.when((F.coalesce(owner, F.lit("")) != "") & (F.coalesce(number, F.lit(0)) != 0), F.concat(F.lit(f"https://{host}/users/"), owner, F.lit("/projects/"), number.cast("string")))
