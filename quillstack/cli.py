"""Commands over a stored archive: ingest, stats, index, search, read, failed, analyze, extract, export."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillstack.functions.text import word_count
from quillstack.operators import analytics, extract, ingest, search
from quillstack.schema import ARTICLE
from quillstack.sources import files
from quillstack.sources.bookmarks import read_bookmarks, to_rows


def positive(value: str) -> int:
    number = int(value)
    if number < 1:
        raise argparse.ArgumentTypeError("must be at least 1")
    return number


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillstack")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("ingest", "stats", "failed", "index", "search", "read", "analyze", "extract", "export"):
        sub = commands.add_parser(name)
        sub.add_argument("--table", default="articles", help="Parquet table of articles, or of pages for extract")
    commands.choices["search"].add_argument("terms", nargs="+")
    commands.choices["search"].add_argument("--limit", type=int, default=10)
    commands.choices["search"].add_argument("--index", help="index that the index command wrote; without it the articles are read through")
    commands.choices["search"].add_argument("--plain", action="store_true", help="hits are not highlighted")
    commands.choices["index"].add_argument("out")
    commands.choices["export"].add_argument("folder", help="URI of a folder for one text file an article")
    commands.choices["read"].add_argument("id", type=int)
    commands.choices["extract"].add_argument("out")
    commands.choices["extract"].add_argument("--workers", type=positive, default=20, help="partitions")
    commands.choices["ingest"].add_argument("csv", help="bookmark export")
    commands.choices["ingest"].add_argument("pages", help="Parquet table of url and html, as they were fetched")
    commands.choices["ingest"].add_argument("out", help="the table's next version; the present one is left as it is")
    commands.choices["ingest"].add_argument("--retry-failed", action="store_true")
    commands.choices["ingest"].add_argument("--workers", type=positive, default=20, help="partitions of the extraction")
    return top


def run_ingest(spark: SparkSession, args: argparse.Namespace) -> int:
    """One run over an export: skip what is done, merge the rest, extract their pages, write outcomes. 1 if all of them failed."""
    found = spark._jvm.org.apache.hadoop.fs.Path(args.table)
    exists = found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)
    before = spark.read.parquet(args.table) if exists else spark.createDataFrame([], ARTICLE)
    before = ingest.with_content(before)
    rows = ingest.not_done(to_rows(read_bookmarks(spark, args.csv)), before, args.retry_failed)
    merged = ingest.upsert_pending(before, rows)
    asked = rows.select("url").distinct()
    pages = spark.read.parquet(args.pages).select("url", "html").dropDuplicates(["url"]).join(asked, "url", "left_semi").withColumn("page_id", F.lit(0).cast("long"))
    got = extract.extract_pages(pages.repartition(args.workers)).select("url", F.col("title").alias("new_title"), F.col("text").alias("new_content"))
    outcomes = asked.join(got, "url", "left").select(
        "url", F.col("new_content").isNotNull().alias("ok"), "new_title", "new_content", word_count(F.col("new_content")).alias("new_words"), F.lit(None).cast("string").alias("error"),
    )
    ingest.apply_outcomes(merged, outcomes).write.parquet(args.out)
    done = spark.read.parquet(args.out).join(asked, "url", "left_semi").groupBy("status").count()
    tallies = {r.status: r["count"] for r in done.collect()}
    print(", ".join(f"{n:,} {s}" for s, n in sorted(tallies.items())) or "Nothing to do")
    return 1 if set(tallies) == {"failed"} else 0


def run_analyze(rows) -> int:
    """The reports on the archive's timeline, domains, folders, title terms and lengths."""
    timed = rows.where("timestamp IS NOT NULL").withColumn("at", F.timestamp_seconds("timestamp").cast("timestamp_ntz"))
    local = analytics.enrich(timed, "at")
    months = analytics.count_by(local, "year_month")
    for title, report in (
        ("First and last", analytics.first_last(timed, "at", "id")), ("By hour", analytics.count_by(local, "hour").orderBy("hour")), ("By weekday", analytics.by_weekday(local)),
        ("Peaks", analytics.peaks(local)), ("By month", months.orderBy("year_month")), ("Months", analytics.month_extremes(months)), ("By quarter", analytics.count_by(local, "quarter").orderBy("quarter")),
        ("Domains", analytics.top_domains(rows, 20)), ("Folders", analytics.count_by(rows.where("folder IS NOT NULL"), "folder").orderBy(F.desc("count"), "folder")),
        ("Title terms", analytics.top_terms(rows, 20)), ("Lengths", analytics.length_stats(rows)),
    ):
        print(title)
        report.show(400, truncate=False)
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "ingest":
        return run_ingest(spark, args)
    try:
        rows = spark.read.parquet(args.table)
    except Exception as e:
        print(f"No table at {args.table}: {str(e).splitlines()[0]}", file=sys.stderr)
        return 1
    if args.command == "stats":
        r = ingest.status_counts(rows).first()
        for label, count, share in (("Total", r.total, None), ("Success", r.success, r.success_pct), ("Archived", r.archived, None), ("Failed", r.failed, r.failed_pct), ("Pending", r.pending, None), ("Words", r.total_words, None)):
            print(f"{label:10s} {count:,}" + (f" ({share:.1f}%)" if share is not None else ""))
    elif args.command == "analyze":
        return run_analyze(rows)
    elif args.command == "failed":
        ingest.failed_urls(rows).show(truncate=False)
    elif args.command == "read":
        found = ingest.read_article(rows, args.id).collect()
        if not found:
            print(f"Article {args.id} not found", file=sys.stderr)
            return 1
        print(f"{found[0].title or 'Untitled'}\n{found[0].url}\n\n{found[0].content or ''}")
    elif args.command == "search":
        try:
            index = search.Index.open(spark, args.index) if args.index else None
            shown = search.plain if args.plain or not sys.stdout.isatty() else search.highlighted
            found = search.search(rows, " ".join(args.terms), args.limit, index=index).withColumn("snippet", shown(F.col("snippet"))).collect()
        except search.QueryError as e:
            print(e, file=sys.stderr)
            return 1
        print("\n\n".join(f"[{r.id}] {r.title or 'Untitled'}\n{r.url}\n{r.snippet}" for r in found) or "No articles found")
    elif args.command == "index":
        index = search.Index.build(rows, args.out)
        print(f"{index.n:,} articles")
    elif args.command == "export":
        r = files.write_texts(rows, args.folder).agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
        print(f"{r.n:,} files, {r.bytes:,} bytes")
    else:
        out = extract.extract_pages(rows.repartition(args.workers))
        out.write.parquet(args.out)
        if spark.read.parquet(args.out).where("text IS NOT NULL").limit(1).count() == 0:
            return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
