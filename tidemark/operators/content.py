"""Titles, comments, answers and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T

#: How a comment names its speaker, by language.
SPEAKERS = {"en": {"user": "Prompt", "assistant": "Response"}, "de": {"user": "Eingabe", "assistant": "Antwort"}, "fr": {"user": "Demande", "assistant": "Réponse"}}


def prompts(turns: DataFrame) -> DataFrame:
    """conv_id, turn and stripped text of prompts that say something."""
    said = turns.filter("role = 'user'").select("conv_id", "turn", T.strip_ws(F.col("text")).alias("prompt"))
    return said.filter("length(prompt) > 0")


def titles(turns: DataFrame, mode: str) -> DataFrame:
    p = prompts(turns)
    context = F.concat(F.lit("team/context-of-conversation-"), F.col("conv_id").cast("string"))
    title = T.title_prefix(context, F.col("prompt")) if mode == "prefix" else T.title_label(F.col("prompt"))
    return p.select("conv_id", "turn", title.alias("title"))


def latest_title(turns: DataFrame) -> DataFrame:
    return titles(turns, "label").groupBy("conv_id").agg(F.max_by("title", "turn").alias("title"), F.max("turn").alias("turn"))


def comments(turns: DataFrame, language: str = "en") -> DataFrame:
    """A comment for every prompt and answer that says something; an unknown language gets English names."""
    spark = turns.sparkSession
    names = SPEAKERS.get(language, SPEAKERS["en"])
    speakers = F.broadcast(spark.createDataFrame(list(names.items()), "role string, speaker string"))  # two rows
    said = turns.withColumn("said", T.strip_ws(F.col("text"))).filter("length(said) > 0").join(speakers, "role")
    return said.select("conv_id", "turn", T.comment(F.concat(F.lit("turn "), F.col("turn").cast("string")), F.col("speaker"), F.col("said")).alias("body"))


def answers(tools: DataFrame) -> DataFrame:
    """A line per answer of each question event (event_id, answers, questions): its question's options give the description.

    Of questions with the same text the last counts; of options with the same label, the first. An answer whose
    question isn't known has no description.
    """
    asked = tools.select("event_id", F.posexplode("questions").alias("at", "q")).select("event_id", F.col("q.question").alias("question"), "at", F.col("q.options").alias("options"))
    asked = asked.groupBy("event_id", "question").agg(F.max_by("options", "at").alias("options"))
    given = tools.select("event_id", F.posexplode(F.map_entries("answers")).alias("pos", "a")).select("event_id", "pos", F.col("a.key").alias("question"), F.col("a.value").alias("answer"))
    found = given.join(asked, ["event_id", "question"], "left")
    first = F.get(F.filter("options", lambda o: o["label"] == F.col("answer")), F.lit(0))["description"]
    return found.select("event_id", F.col("pos").cast("long").alias("pos"), T.answer_line(F.col("question"), F.col("answer"), first).alias("line"))


def answer_comments(tools: DataFrame, heading: str = "Answer") -> DataFrame:
    lines = answers(tools).groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("lines"))  # a few answers an event
    return lines.select("event_id", F.concat(F.lit(f"**{heading}**\n\n"), F.array_join(F.col("lines.line"), "\n")).alias("body"))


def labels_of(context, mode, base: str = "session"):
    """The base label, and in label mode the context's, without repeats."""
    return F.array_distinct(F.array_compact(F.array(F.lit(base), F.when((mode == "label") & (F.coalesce(context, F.lit("")) != ""), context))))


def missing_labels(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """Distinct (repo, label) that aren't there yet."""
    return wanted.select("repo", F.explode("labels").alias("label")).distinct().join(existing.select("repo", "label"), ["repo", "label"], "left_anti")


def question_events(log: DataFrame, part: DataFrame) -> DataFrame:
    """Question events out of the log's tool results: each asks about three parts, two of them alike, and offers brands as options."""
    tools = log.filter("hook = 'PostToolUse'").select("event_id", "k")
    options = part.select(F.col("p_partkey").alias("k1"), "p_name", "p_brand", "p_type")
    asked = tools.join(options, tools["k"] + 1 == options["k1"])
    option = lambda l, d: F.struct(F.lit(l).alias("label") if isinstance(l, str) else l.alias("label"), d.alias("description"))
    q1 = F.struct(F.col("p_name").alias("question"), F.array(option("yes", F.lit("first")), option("yes", F.lit("second"))).alias("options"))
    q2 = F.struct(F.col("p_name").alias("question"), F.array(option(F.col("p_brand"), F.col("p_type")), option("yes", F.lit("last"))).alias("options"))
    q3 = F.struct(F.lit("Which brand?").alias("question"), F.array(option(F.col("p_brand"), F.when(F.col("k") % 2 == 0, F.col("p_type")).otherwise("")), option("none", F.lit("x"))).alias("options"))
    given = F.create_map(F.col("p_name"), F.lit("yes"), F.lit("Which brand?"), F.col("p_brand"), F.lit("Not asked?"), F.lit("maybe"))
    return asked.select("event_id", F.array(q1, q2, q3).alias("questions"), given.alias("answers"))
