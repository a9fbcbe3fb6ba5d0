"""Columns of operators that SQL can state, as queries of their own: the operators run whole, the rest of their columns is left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import mixing, secrets, token_counts, url_filter


def mix_targets(spark, sf_dir: str) -> DataFrame:
    return mixing.op5_mix(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def url_rules(spark, sf_dir: str) -> DataFrame:
    return url_filter.op4_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


def token_bytes(spark, sf_dir: str) -> DataFrame:
    return token_counts.op8_token_counts(spark, sf_dir).select("doc_id", "n_bytes")


def secret_counts(spark, sf_dir: str) -> DataFrame:
    return secrets.op9_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


QUERIES = {f.__name__: f for f in (mix_targets, url_rules, token_bytes, secret_counts)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES = {
    "mix_targets": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
-- sources that are full at three times their size go first, in order of that for each unit of weight; the rest share by weight
f AS (SELECT *, sum(source_size) OVER () AS total, coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
  sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights FROM s WINDOW o AS (ORDER BY 3.0 * source_size / w, source NULLS LAST)),
l AS (SELECT arg_min((total - spent) / CAST(weights AS DOUBLE), 3.0 * source_size / w) FILTER (WHERE 3.0 * source_size / w >= (total - spent) / CAST(weights AS DOUBLE)) AS level FROM f),
t AS (SELECT source, source_size, least(3.0 * source_size, coalesce(level, 1e300) * w) AS target FROM f, l)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, round(CAST(target AS DOUBLE), 3) AS target FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source
""",
    "url_rules": f"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
rules(verdict, name, h, q) AS (VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'), ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
hit AS (SELECT page_id, arg_max(name, length(name)) AS rule, arg_max(verdict, length(name)) AS verdict FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY 1)
SELECT p.page_id, host, path, rule, verdict FROM p LEFT JOIN hit ON hit.page_id = p.page_id
""",
    "token_bytes": "SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM documents",
    "secret_counts": r"""
SELECT doc_id,
  CAST(len(list_filter(regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["\x27]?\x20*[:=]\x20*["\x27]?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6)) AS BIGINT) AS n_assign,
  CAST(len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS BIGINT) AS n_access,
  CAST(len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24)) AS BIGINT) AS n_hex
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
""",
}
