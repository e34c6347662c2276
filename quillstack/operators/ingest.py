"""Keeping the article table: skipping, merging, outcomes, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstack.functions.urls import filename, is_paywalled, paywalled_domain
from quillstack.schema import ARCHIVED, FAILED, PENDING, SUCCESS
from quillstack.sources.bookmarks import scratch


def not_done(rows: DataFrame, articles: DataFrame, retry_failed: bool) -> DataFrame:
    """Rows whose URL is not stored as a success, nor as failed unless those are retried. Archived and pending ones come again."""
    done = [SUCCESS] if retry_failed else [SUCCESS, FAILED]
    return rows.join(articles.where(F.col("status").isin(done)).select("url"), "url", "left_anti")


def last_of_each(rows: DataFrame, key: str = "url", order: str = "ord") -> DataFrame:
    """The last row of each key, with the first one's place as `first`; partial aggregates, no sort of a key's rows."""
    others = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("row"), F.min(order).alias("first")).select(key, "row.*", "first")


def upsert_pending(articles: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows merged by URL: title, folder, timestamp and tags are replaced, as far as both sides have them, and the status is pending again; the rest stays.

    New rows get ids above the present ones, in order of first appearance.
    """
    given = [c for c in ("title", "folder", "timestamp", "tags") if c in articles.columns and c in rows.columns]
    new = last_of_each(rows).select("url", *[F.col(c).alias(f"new_{c}") for c in given], "first")
    fresh = new.join(articles.select("url"), "url", "left_anti").select("url", "first")
    top = articles.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
    ids = numbered(fresh, "first", top)
    kept = [c for c in articles.columns if c not in ("id", "url", "status", *given)]
    return articles.join(new, "url", "full_outer").join(ids, "url", "left").select(
        F.coalesce("id", "number").alias("id"), "url",
        *[F.when(F.col("first").isNotNull(), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in given],
        F.when(F.col("first").isNotNull(), PENDING).otherwise(F.col("status")).alias("status"), *kept,
    )


def numbered(df: DataFrame, order: str, above: int) -> DataFrame:
    """`df` (url and `order`, whose values differ) with `number`, counting from above + 1 in that order, without a single-task window.

    The ranges are written once: sizes and places then speak of the same partitions.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, "numbered")
    df.select("url", order).repartitionByRange(order).withColumn("part", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))  # a row for each partition
    before = sizes.withColumn("before", F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)))
    placed = ranged.withColumn("at", F.row_number().over(W.partitionBy("part").orderBy(order)))
    return placed.join(F.broadcast(before), "part").select("url", (F.lit(above) + F.col("at") + F.coalesce("before", F.lit(0))).alias("number"))


def final_title(extracted: Column, given: Column) -> Column:
    return F.coalesce(F.when(~extracted.isin("", "Untitled"), extracted), F.nullif(given, F.lit("")), F.lit("Untitled"))


def is_archived(content: Column) -> Column:
    return content.contains("Internet Archive Wayback Machine") | content.contains("Archive.ph")


def failure_message(error: Column, url: Column) -> Column:
    """The last error, or why there was nothing."""
    nothing = F.when(is_paywalled(url), F.concat(F.lit("Paywalled site ("), paywalled_domain(url), F.lit(") - no archive available")))
    return F.coalesce(error, nothing, F.lit("Extraction returned no content"))


def apply_outcomes(articles: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Outcomes (url, ok, new_title, new_content, new_words, error; one a URL) written to their articles.

    A success replaces title, file name, content, word count and status, and leaves an old error; a failure
    replaces status and error only. Columns that the articles lack are added.
    """
    articles = articles.withColumns({c: F.lit(None).cast("string") for c in ("filename", "error_message", "content") if c not in articles.columns})
    met = articles.join(outcomes, "url", "left")
    ok, failed = F.coalesce("ok", F.lit(False)), F.coalesce(~F.col("ok"), F.lit(False))
    title = final_title(F.col("new_title"), F.col("title"))
    done = F.when(is_archived(F.col("new_content")), ARCHIVED).otherwise(SUCCESS)
    now = {
        "title": F.when(ok, title).otherwise(F.col("title")), "filename": F.when(ok, filename(F.col("url"), title)).otherwise(F.col("filename")),
        "status": F.when(ok, done).when(failed, FAILED).otherwise(F.col("status")),
        "error_message": F.when(failed, failure_message(F.col("error"), F.col("url"))).otherwise(F.col("error_message")),
        "content": F.when(ok, F.col("new_content")).otherwise(F.col("content")), "word_count": F.when(ok, F.col("new_words")).otherwise(F.col("word_count")),
    }
    return met.select(*[now.get(c, F.col(c)).alias(c) for c in articles.columns])


def status_counts(articles: DataFrame) -> DataFrame:
    """One row of counts; success includes archived. Percentages to one decimal, null for an empty table."""
    done = F.col("status").isin(SUCCESS, ARCHIVED)
    counts = articles.agg(
        F.count("*").alias("total"), F.count_if(done).alias("success"), F.count_if(F.col("status") == ARCHIVED).alias("archived"), F.count_if(F.col("status") == FAILED).alias("failed"),
        F.count_if(F.col("status") == PENDING).alias("pending"), F.coalesce(F.sum(F.when(done, F.col("word_count"))), F.lit(0)).cast("long").alias("total_words"),
    )
    share = lambda c: F.round(100.0 * F.col(c) / F.nullif(F.col("total"), F.lit(0)), 1).alias(f"{c}_pct")
    return counts.select("*", share("success"), share("failed"))


def failed_urls(articles: DataFrame, n: int = 10) -> DataFrame:
    return articles.where(F.col("status") == FAILED).orderBy("id").select("id", "url", F.substring("error_message", 1, 100).alias("error_message")).limit(n)


def read_article(articles: DataFrame, id: int) -> DataFrame:
    return articles.where(F.col("id") == id).select("id", "title", "url", "folder", "word_count", "content").limit(1)


def with_content(articles: DataFrame) -> DataFrame:
    """An older table with content_preview gets it as content; one with neither gets nulls."""
    if "content" in articles.columns:
        return articles
    return articles.withColumn("content", F.col("content_preview") if "content_preview" in articles.columns else F.lit(None).cast("string"))
