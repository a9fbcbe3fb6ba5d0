"""URL filtering: host and path rules first, else logistic regression on hashed character n-grams of host and path.

Scoring is one projection without shuffle. The model is fitted on the driver from the small labelled table below.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import ascii_lower, table

BUCKETS = 1 << 15
GRAMS = (3, 4, 5)
EPOCHS, RATE, RIDGE = 150, 0.05, 1e-4
THRESHOLD = 0.5

#: (verdict, host and path); a rule fits its host and all subdomains where the path starts with the rule's.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: Words of hosts that are to be blocked and of hosts that aren't, and the forms that either come in.
_BLOCKED = ("casino", "slots", "bets", "adult", "xxx", "dating", "spam", "farm-links", "pills", "loans", "warez", "crack", "torrent", "ads", "click-track", "prize")
_LEFT = ("garden", "history", "science", "weather", "music", "poetry", "chess", "travel", "kitchen", "school", "city", "museum", "river", "north", "letters", "tools")
_FORMS = ("www.{}-online.example.com/en/21", "free-{}.example.net/fr/40/", "{}-club.example.org/de/6.html", "m.my-{}.example.com/es/9")

#: The labelled table: 1 is to be blocked.
LABELLED = (
    *((f.format(w), y) for y, words in ((1, _BLOCKED), (0, _LEFT)) for f in _FORMS for w in words),
    *((u, 1) for u in (
        "casino-bonus.example.com/en/win", "www.online-casino.example.net/fr/31", "free-slots.example.org/de/7.html", "m.free-bets.example.com/en/10", "sports-bets.example.net/es/bet/2",
        "best-bets.example.org/en/812/", "adult-video.example.com/fr/18", "adult-x.example.org/en/501", "www.xxx-adult.example.net/es/9", "hot-singles.example.com/de/44",
        "sexy-chat.example.net/en/6.html", "spam-links.example.com/en/77", "www.spam-farm.example.org/en/1", "link-farm.example.net/de/backlinks", "seo-spam.example.com/fr/5/",
        "article-spinner.biz/spin", "ads-server.example.com/en/click", "m.ads-track.example.net/es/3", "track-ads.example.org/en/90", "popads.biz/redirect",
        "click-track.example.com/fr/r", "cheap-pills.example.net/en/14", "www.pills-online.example.com/de/2.html", "payday-loans.example.org/en/8/", "quick-loan.biz/cash",
        "crypto-doubler.io/invest", "warez-crack.example.net/en/23", "free-crack.example.org/fr/61", "torrent-warez.info/download", "get-rich-quick.biz/signup",
        "prize-winner.top/claim", "blog.casino-win.example.com/es/19", "casino-royale.example.org/de/30", "discount-pills.example.org/es/55.html", "free-bets-tips.example.com/de/1",
        "www.adult-dating.example.com/en/29", "spam-mail.example.net/fr/40", "banner-ads.example.com/en/3", "casino-spins.example.net/en/605/", "xxx-videos.example.org/es/12",
    )),
    *((u, 0) for u in (
        "www.university.edu/research/papers", "library.museum.org/collections", "docs.python.org/3/library", "en.wikipedia.org/wiki/Statistics", "news.example.com/en/310",
        "blog.example.org/en/12", "m.example.net/fr/8", "www.example.com/es/33.html", "weather.gov/forecast", "recipes.example.com/fr/62/",
        "history.example.org/de/5", "science.example.net/en/71", "maps.example.com/de/9", "health.gov/advice", "www.newspaper.com/2024/opinion",
        "garden.example.org/es/27", "school.example.edu/courses/algebra", "music.example.net/en/44.html", "travel.example.com/fr/15", "archive.org/details/books",
        "developer.example.com/en/2", "forum.example.net/de/88", "www.hospital.org/patients", "city.example.gov/council/minutes", "poetry.example.org/en/6/",
        "blog.garden.example.net/en/4", "www.chess.example.org/es/53", "m.weather.example.com/en/2", "books.example.net/fr/70", "kids.example.org/de/18.html",
        "blog.history.example.com/de/91", "photos.example.com/en/5", "lectures.example.edu/video/18", "betty.example.org/en/35", "trackandfield.example.com/en/results",
        "www.farmers.example.org/fr/24", "wood-working.example.net/en/36", "sea-side.example.com/es/11", "m.north-wind.example.org/en/64", "old-town.example.com/de/100/",
    )),
)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.lit(1 << 30))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; of null and of urls without ://, empty."""
    return ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; of null and of urls without ://, empty."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _buckets(host: Column, path: Column) -> Column:
    """Bucket numbers, from 0, of the n-grams of the host and of the path, which are kept apart."""

    def grams(text: Column, part: str, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(part), text.substr(i, F.lit(n))), F.lit(BUCKETS)).cast("int"))

    marked = [(F.concat(F.lit("^"), host, F.lit("$")), "host"), (F.concat(path, F.lit("$")), "path")]
    return F.concat(*[grams(text, part, n) for text, part in marked for n in GRAMS])


def fit(spark: SparkSession, labelled=LABELLED) -> tuple[float, list[float]]:
    """Bias and a weight for each bucket, by stochastic gradient descent in a fixed order."""
    rows = spark.createDataFrame([(u.partition("/")[0], "/" + u.partition("/")[2], y) for u, y in labelled], "host string, path string, y int")
    data = [(sorted(set(r[0])), r[1]) for r in rows.select(_buckets(F.col("host"), F.col("path")), "y").collect()]  # the labelled table alone
    bias, weights = -1.0, [0.0] * BUCKETS
    for _ in range(EPOCHS):
        for buckets, y in data:
            scale = 1 / math.sqrt(len(buckets))
            z = bias + scale * sum(weights[b] for b in buckets)
            g = 1 / (1 + math.exp(-z)) - y
            bias -= RATE * g * 0.1
            for b in buckets:
                weights[b] -= RATE * (g * scale * 4 + RIDGE * weights[b])
    return bias, weights


def filter_urls(pages: DataFrame, rules=RULES, labelled=LABELLED, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict (allow or block) and score.

    rules is a short list; the longest fitting rule decides, the first of equal ones, and is named in rule. Where none
    fits, rule is null and a page is blocked whose score is THRESHOLD or more. A null url, or one without ://, has an
    empty host and path, which only the score judges. Repeated rows are judged alike. Other columns are ignored. An
    empty table gives an empty result.
    """
    bias, weights = fit(pages.sparkSession, labelled)
    learnt = F.from_json(F.lit(json.dumps([round(w, 6) for w in weights])), "array<double>")
    named = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    named = named.withColumn("grams", F.array_distinct(_buckets(F.col("host"), F.col("path"))))
    z = F.aggregate("grams", F.lit(bias), lambda a, b: a + F.get(learnt, b) / F.sqrt(F.size("grams")))
    scored = named.withColumn("score", 1 / (1 + F.exp(-z)))
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("score") >= THRESHOLD, "block").otherwise("allow")
    for kind, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return scored.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "score")


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
