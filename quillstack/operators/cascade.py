"""The sources tried for each article, attempt by attempt, over a table of what they gave."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.functions.text import word_count
from quillstack.functions.urls import route, with_provenance
from quillstack.operators.extract import resolve_attempts

RETRIES = 3


def archived_copies(snapshots: DataFrame) -> DataFrame:
    """`snapshots` (url, attempt, archive, snapshot_url, title, text) as what the archive gave, with the note below the text."""
    text = with_provenance(F.col("text"), F.col("archive"), F.col("url"), F.col("snapshot_url"))
    return snapshots.select("url", "attempt", F.lit("archive").alias("source"), "title", text.alias("text"), F.lit(None).cast("string").alias("error"))


def outcomes(articles: DataFrame, given: DataFrame, retries: int = RETRIES) -> DataFrame:
    """url, ok, new_title, new_content, new_words, error of each URL of `articles`, as `apply_outcomes` takes them.

    given: url, attempt (from 0), source, title, text, error; one row for what a source gave on an attempt. An
    attempt goes through the URL's route: the first source with a text ends all, an error ends the attempt,
    and a source that gave nothing leaves it to the next. The archive is asked last, on the last attempt.
    """
    last = F.col("attempt") == retries - 1
    tries = articles.select("url").distinct().select("url", F.explode(F.sequence(F.lit(0), F.lit(retries - 1))).alias("attempt"))
    steps = tries.select("url", "attempt", F.posexplode(F.when(last, route(F.col("url"), True)).otherwise(route(F.col("url"), False))).alias("step", "source"))
    met = steps.join(given, ["url", "attempt", "source"]).where("text IS NOT NULL OR error IS NOT NULL")
    first = met.groupBy("url", "attempt").agg(F.min_by(F.struct("title", "text", "error"), "step").alias("got"))
    each = tries.join(first, ["url", "attempt"], "left").select(
        "url", "attempt", F.col("got.title").alias("title"), F.struct((F.col("got.error").isNull() & F.col("got.text").isNotNull()).alias("ok"), F.col("got.text").alias("text"), F.col("got.error").alias("error")).alias("x"),
    )
    held = each.groupBy("url").agg(F.array_sort(F.collect_list(F.struct("attempt", "x", "title"))).alias("all"))
    end = resolve_attempts(F.transform("all", lambda a: a["x"]))
    title = F.get(F.filter("all", lambda a: a["x"]["ok"]), F.lit(0))["title"]
    return held.select("url", end.alias("end"), title.alias("title")).select(
        "url", F.col("end.ok").alias("ok"), F.col("title").alias("new_title"), F.col("end.text").alias("new_content"), word_count(F.col("end.text")).alias("new_words"), F.col("end.error").alias("error")
    )
