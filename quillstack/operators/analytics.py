"""Calendar, distributions, top lists and lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.functions.text import title_terms
from quillstack.functions.urls import netloc
from quillstack.schema import LOCAL_ZONE, STOP_WORDS

WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def local(ts: Column) -> Column:
    """A UTC timestamp without zone as local time."""
    return F.convert_timezone(F.lit("UTC"), F.lit(LOCAL_ZONE), ts)


def enrich(df: DataFrame, ts: str) -> DataFrame:
    at = local(F.col(ts))
    return df.withColumns({
        "local_ts": at, "date": F.to_date(at), "year": F.year(at), "month": F.month(at), "day": F.dayofmonth(at), "hour": F.hour(at), "weekday": F.weekday(at),
        "day_name": F.date_format(at, "EEEE"), "week": F.weekofyear(at), "quarter": F.quarter(at), "year_month": F.date_format(at, "yyyy-MM"),
    })


def daily(rows: DataFrame, since: Column | None = None, strict: bool = False) -> DataFrame:
    """Rows of each local date between the first and last, zero on empty ones.

    Days are steps of a whole day from the first row. since: leaves out the days whose step is before it, and
    counts weeks from the first that stays. strict: leaves out the last date when the last time of day is
    before the first one's, as such steps do.
    """
    counts = rows.groupBy("date").agg(F.count("*").alias("count"), F.min("local_ts").alias("lo"), F.max("local_ts").alias("hi"))
    ends = counts.agg(F.min("date").alias("first"), F.max("date").alias("last"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    first, last = F.col("first"), F.col("last")
    if strict:
        last = F.when(F.date_format("hi", "HH:mm:ss.SSSSSS") < F.date_format("lo", "HH:mm:ss.SSSSSS"), F.date_sub("last", 1)).otherwise(last)
    if since is not None:
        first = F.date_add("first", F.greatest(F.lit(0), F.ceil(F.timestamp_diff("MICROSECOND", F.col("lo"), since) / 86_400_000_000)).cast("int"))
    spine = ends.where("first IS NOT NULL").select(first.alias("first"), last.alias("last")).where("first <= last").select("first", F.explode(F.sequence("first", "last")).alias("date"))
    return spine.join(counts, "date", "left").select(
        "date", F.coalesce("count", F.lit(0)).cast("long").alias("count"), F.weekday("date").alias("weekday"), F.weekofyear("date").alias("week"),
        F.floor(F.date_diff("date", "first") / 7).cast("int").alias("week_adj"),
    )


def calendar_pivot(days: DataFrame) -> DataFrame:
    """Mean count by weekday and week, in long form; missing cells are zero."""
    cells = days.groupBy("weekday", "week_adj").agg(F.avg("count").alias("value"))
    weeks = days.agg(F.max("week_adj").alias("n")).select(F.explode(F.sequence(F.lit(0), F.col("n"))).alias("week_adj"))
    grid = weeks.select("week_adj", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("weekday"))
    return grid.join(cells, ["weekday", "week_adj"], "left").select("weekday", "week_adj", F.coalesce("value", F.lit(0.0)).alias("value"))


def calendar_levels(cells: DataFrame) -> DataFrame:
    """Each cell's intensity from 0 to 4, by the quartiles of the cells that are not zero, cut to integers."""
    q = cells.where("value > 0").agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    bounds = q.select(*[F.get("q", F.lit(i)).cast("int").alias(f"q{i + 1}") for i in range(3)])  # one row
    level = (F.col("value") >= 0.5).cast("int") + sum(((F.col("value") >= F.col(f"q{i}")).cast("int") for i in (1, 2, 3)), F.lit(0))
    return cells.withColumn("k", F.lit(1)).join(F.broadcast(bounds.withColumn("k", F.lit(1))), "k").select("weekday", "week_adj", F.when(F.col("value") == 0, 0).otherwise(level).alias("level"))


def count_by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("count"))


def by_weekday(rows: DataFrame) -> DataFrame:
    """Monday to Sunday; null for a day without rows."""
    spark = rows.sparkSession
    names = spark.createDataFrame([(i, d) for i, d in enumerate(WEEKDAYS)], "weekday int, day_name string")
    return names.join(count_by(rows, "weekday"), "weekday", "left").orderBy("weekday")


def peaks(rows: DataFrame) -> DataFrame:
    """The hour and weekday with most rows; of equals the earliest."""
    hour = count_by(rows, "hour").agg(F.max_by("hour", F.struct("count", -F.col("hour"))).alias("peak_hour"))
    day = count_by(rows, "weekday", "day_name").agg(F.max_by("day_name", F.struct("count", -F.col("weekday"))).alias("peak_day"))
    return hour.withColumn("k", F.lit(1)).join(day.withColumn("k", F.lit(1)), "k").drop("k")


def month_extremes(months: DataFrame) -> DataFrame:
    """Mean, most and least of the months present, and which; of equals the earliest."""
    order = F.to_date(F.concat("year_month", F.lit("-01"))).cast("timestamp").cast("long")
    return months.agg(
        F.avg("count").alias("avg_count"), F.max("count").alias("max_count"), F.min("count").alias("min_count"),
        F.max_by("year_month", F.struct("count", -order)).alias("max_month"), F.min_by("year_month", F.struct("count", order)).alias("min_month"),
    )


def recent_trend(rows: DataFrame, as_of: Column, days: int = 180) -> DataFrame:
    """increasing if the last month present has more rows than the first; null with fewer than two."""
    months = count_by(rows.where(F.col("local_ts") >= as_of - F.expr(f"INTERVAL {days} DAYS")), "year_month")
    up = F.max_by("count", "year_month") > F.min_by("count", "year_month")
    return months.agg(F.count("*").alias("months"), F.when(F.count("*") >= 2, F.when(up, "increasing").otherwise("decreasing")).alias("trend"))


def first_last(rows: DataFrame, ts: str, id: str) -> DataFrame:
    key = F.struct(ts, id)
    ends = rows.where(F.col(ts).isNotNull()).agg(F.min(key).alias("lo"), F.max(F.struct(F.col(ts), (-F.col(id)).alias("neg"))).alias("hi"))
    seconds = F.timestamp_diff("SECOND", F.col(f"lo.{ts}"), F.col(f"hi.{ts}"))
    return ends.select(F.col(f"lo.{id}").alias("first_id"), (-F.col("hi.neg")).alias("last_id"), F.floor(seconds / 86400).cast("long").alias("span_days"))


def ends(rows: DataFrame, ts: str, id: str, *columns: str) -> DataFrame:
    """The first and the last row with their columns, titles and addresses cut to 80 characters, and their local date; of equal times the least id."""
    held = rows.where(F.col(ts).isNotNull()).withColumns({c: F.substring(c, 1, 80) for c in columns})
    row = F.struct(id, ts, *columns)
    both = held.agg(F.min_by(row, F.struct(F.col(ts), F.col(id))).alias("first"), F.max_by(row, F.struct(F.col(ts), (-F.col(id)).alias("neg"))).alias("last"))
    each = both.select(F.inline(F.array(*[F.struct(F.lit(n).alias("which"), F.col(n).alias("row")) for n in ("first", "last")]))).where("row IS NOT NULL")
    return each.select("which", "row.*").withColumn("date", F.to_date(local(F.col(ts)))).drop(ts)


def hour_bars(rows: DataFrame, longest: int = 50) -> DataFrame:
    """Rows of each hour that has any, and bars of at most `longest`."""
    hours = count_by(rows, "hour")
    most = hours.agg(F.max("count").alias("most")).withColumn("k", F.lit(1))
    return hours.withColumn("k", F.lit(1)).join(F.broadcast(most), "k").select("hour", "count", F.floor(F.col("count") / F.col("most") * longest).cast("long").alias("bar"))


def top_domains(pages: DataFrame, n: int) -> DataFrame:
    return count_by(pages.select(netloc(F.col("url")).alias("domain")), "domain").orderBy(F.desc("count"), "domain").limit(n)


def top_terms(titles: DataFrame, n: int = 30) -> DataFrame:
    """Most frequent title terms, and bars of at most 30."""
    terms = titles.where("title IS NOT NULL").select(F.explode(title_terms(F.col("title"))).alias("term")).where(~F.col("term").isin(STOP_WORDS))
    top = count_by(terms, "term").orderBy(F.desc("count"), "term").limit(n)
    most = top.agg(F.max("count").alias("most")).withColumn("k", F.lit(1))
    return top.withColumn("k", F.lit(1)).join(F.broadcast(most), "k").select("term", "count", F.floor(F.col("count") / F.col("most") * 30).cast("long").alias("bar"))


def length_buckets(articles: DataFrame) -> DataFrame:
    """short (to 500 words), medium (to 2,000) and long, each with its count."""
    names = ("short", "medium", "long")
    return length_stats(articles).select(F.inline(F.array(*[F.struct(F.lit(n).alias("bucket"), F.col(n).alias("count")) for n in names])))


def length_stats(articles: DataFrame) -> DataFrame:
    n = F.col("word_count")
    return articles.where(n > 0).agg(
        F.count("*").alias("articles"), F.avg(n).alias("mean"), F.percentile(n, F.lit(0.5)).alias("median"), F.min(n).alias("shortest"), F.max(n).alias("longest"),
        F.count_if(n <= 500).alias("short"), F.count_if((n > 500) & (n <= 2000)).alias("medium"), F.count_if(n > 2000).alias("long"),
    )
