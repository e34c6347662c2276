"""Registered queries over the archive, its reports and its scalars, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.functions import text as tx
from quillstack.functions import urls
from quillstack.operators import analytics as an
from quillstack.operators import cascade, ingest
from quillstack.schema import PAYWALLED
from quillstack.sources.bookmarks import archive, read_bookmarks, scratch, table, to_rows, write_bookmarks

ARTICLES = """WITH articles AS (
  SELECT d.doc_id AS id, 'https://' || d.source || '.example/' || d.doc_id AS url, substr(split_part(coalesce(d.text, ''), chr(10), 1), 1, 80) AS title,
         d.source AS folder, d.lang AS tags, d.text AS content, CAST(len(regexp_extract_all(d.text, '\\S+')) AS BIGINT) AS word_count,
         CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'success' WHEN l.quality = 1 THEN 'archived' WHEN l.quality = 0 THEN 'failed' ELSE 'pending' END AS status
  FROM documents d LEFT JOIN labels l USING (doc_id))
"""
LOCAL = """WITH e AS (SELECT event_id, event_type, ts, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles' AS lt FROM events),
days AS (SELECT CAST(lt AS DATE) AS date, count(*) AS n FROM e GROUP BY 1),
ends AS (SELECT min(date) AS lo, max(date) AS hi FROM days),
spine AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date, lo FROM ends),
daily AS (SELECT s.date, coalesce(n, 0) AS count, CAST(isodow(s.date) - 1 AS INTEGER) AS weekday, CAST(floor((s.date - s.lo) / 7) AS INTEGER) AS week_adj, CAST(weekofyear(s.date) AS INTEGER) AS week
          FROM spine s LEFT JOIN days USING (date)),
cells AS (SELECT weekday, week_adj, avg(count) AS v FROM daily GROUP BY 1, 2),
grid AS (SELECT w AS week_adj, d AS weekday FROM (SELECT CAST(unnest(generate_series(0, (SELECT max(week_adj) FROM daily))) AS INTEGER) AS w), (SELECT CAST(unnest(generate_series(0, 6)) AS INTEGER) AS d)),
pivot_ AS (SELECT g.weekday, g.week_adj, coalesce(v, 0) AS value FROM grid g LEFT JOIN cells c ON g.weekday = c.weekday AND g.week_adj = c.week_adj)
"""
MONTHS = """WITH o AS (SELECT (o_orderdate AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles' AS lt FROM orders),
m AS (SELECT strftime(lt, '%Y-%m') AS year_month, count(*) AS count FROM o GROUP BY 1)
"""

#: Addresses of many kinds made of each page's number and a listed host: name, Spark SQL and DuckDB SQL of them (alike in both).
KINDS = {
    "plain": "url", "listed": "'https://www.' || host || '/' || page_id || '/a|b?c=[1]'", "user": "'HTTP://me:pw@' || upper(host) || ':8080/x y#z'", "below": "'https://news.' || host || '/' || page_id",
    "video": "'https://youtu.be/v' || page_id", "file": "'https://github.com/o' || page_id || '/r/blob/main/d/f' || page_id || '.md?raw=1'", "repo": "'https://github.com/o' || page_id || '/r' || page_id || '/'",
    "gist": "'https://gist.github.com/' || page_id", "blog": "'https://medium.com/@a/p' || page_id", "short": "'//' || host || '/p'", "none": "'mailto:a@' || host", "odd": "'https://my_host' || page_id || '.com'",
}
URLS = "WITH n AS (SELECT page_id, url, [" + ", ".join(f"'{h}'" for h in PAYWALLED) + f"][1 + page_id % {len(PAYWALLED)}] AS host FROM pages), u AS (" + " UNION ALL ".join(
    f"SELECT page_id, '{kind}' AS kind, {sql} AS url FROM n" for kind, sql in KINDS.items()
) + r"""), a AS (SELECT *, regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1) AS netloc FROM u),
  h AS (SELECT *, CASE WHEN NOT regexp_matches(url, '^[A-Za-z]+://') THEN NULL ELSE regexp_replace(lower(regexp_replace(regexp_replace(netloc, '^.*@', ''), ':[0-9]+$', '')), '^www\.', '') END AS host FROM a)
"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.enrich(table(spark, sf_dir, "events").select("event_id", "event_type", "ts"), "ts")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.enrich(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate")


def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second export: all documents twice with other titles, and pages that are new."""
    docs = archive(spark, sf_dir)
    again = docs.select(F.col("id").alias("ord"), "url", F.concat(F.lit("Re: "), "title").alias("title"), F.lit("again").alias("folder"), "tags")
    twice = docs.select((F.col("id") + 10_000_000).alias("ord"), "url", F.concat(F.lit("Fw: "), "title").alias("title"), F.lit("twice").alias("folder"), "tags")
    pages = table(spark, sf_dir, "pages").select((F.col("page_id") + 20_000_000).alias("ord"), "url", F.lit("").alias("title"), F.lit("new").alias("folder"), F.lit("").alias("tags"))
    return again.unionByName(twice).unionByName(pages)


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outcome for each pending document: those with an odd id succeed."""
    pending = archive(spark, sf_dir).where("status = 'pending'")
    ok = F.col("id") % 2 == 1
    return pending.select("url", ok.alias("ok"), F.when(F.col("id") % 3 == 0, F.lit("Untitled")).otherwise(F.lit("")).alias("new_title"), F.col("content").alias("new_content"), F.col("word_count").alias("new_words"), F.when(F.col("id") % 4 == 0, F.lit("timed out")).alias("error"))


def status_counts(spark, sf):
    return ingest.status_counts(archive(spark, sf))


def skip(retry: bool):
    def run(spark, sf):
        a = archive(spark, sf)
        return ingest.not_done(a.select("url", "id"), a, retry).select("id", "url")
    return run


def upsert_pending(spark, sf):
    return ingest.upsert_pending(archive(spark, sf), export_rows(spark, sf)).select("id", "url", "title", "folder", "tags", "status", "word_count")


def mark_outcomes(spark, sf):
    return ingest.apply_outcomes(archive(spark, sf), outcomes(spark, sf)).select("id", "url", "title", "filename", "status", "error_message", "word_count")


def some_urls(spark, sf):
    """Addresses of many kinds for each page."""
    hosts = F.array(*map(F.lit, PAYWALLED))
    pages = table(spark, sf, "pages").select("page_id", "url", F.get(hosts, (F.col("page_id") % len(PAYWALLED)).cast("int")).alias("host"))
    return pages.select("page_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.expr(sql).alias("url")) for k, sql in KINDS.items()])).alias("x")).select("page_id", "x.*")


def route(spark, sf):
    url = F.col("url")
    return some_urls(spark, sf).select(
        "page_id", "kind", F.array_join(urls.route(url, True), ",").alias("route"), urls.paywalled_domain(url).alias("domain"), urls.netloc(url).alias("netloc"),
        urls.blob_source(url)["raw_url"].alias("raw_url"), urls.blob_source(url)["title"].alias("raw_title"),
    )


def given(spark, sf):
    """What the sources gave for each document: errors, nothing or its text, by attempt."""
    docs, k = archive(spark, sf), F.col("id") % 7
    none = F.lit(None).cast("string")
    fetched = docs.select("url", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("attempt"), "title", "content", k.alias("k")).select(
        "url", "attempt", F.lit("page").alias("source"), "title",
        F.when(((F.col("k") == 0) | ((F.col("k") == 1) & (F.col("attempt") == 1)) | ((F.col("k") == 6) & (F.col("attempt") == 2))), F.col("content")).alias("text"),
        F.when((F.col("k") == 2) | ((F.col("k") == 3) & (F.col("attempt") == 0)) | ((F.col("k") == 4) & (F.col("attempt") == 2)), F.concat(F.lit("timed out "), F.col("attempt"))).otherwise(none).alias("error"),
    )
    copies = docs.where("id % 7 IN (3, 4, 5)").select("url", F.lit(2).alias("attempt"), F.lit("Archive.ph").alias("archive"), F.concat(F.lit("https://archive.ph/"), "id").alias("snapshot_url"), F.lit("").alias("title"), F.when(k != 3, F.col("content")).alias("text"))
    return fetched.unionByName(cascade.archived_copies(copies))


def cascade_outcomes(spark, sf):
    """All documents' outcomes from what their sources gave, written to the articles."""
    docs = archive(spark, sf)
    ends = cascade.outcomes(docs, given(spark, sf))
    return ingest.apply_outcomes(docs, ends).select("id", "status", "title", "error_message", F.md5("content").alias("content_md5"), "word_count")


def saved(spark, sf):
    """Articles of the archive with the time of the event of their number."""
    return archive(spark, sf).join(table(spark, sf, "events").select(F.col("event_id").alias("id"), "ts"), "id")


def csv_roundtrip(spark, sf):
    """The archive's bookmarks written as CSV and read back."""
    path = scratch(spark, "bookmarks")
    rows = archive(spark, sf).select(F.col("url").alias("URL"), F.col("title").alias("Title"), F.lit("").alias("Selection"), F.col("folder").alias("Folder"), F.lit("17").alias("Timestamp"), F.col("tags").alias("Tags"))
    write_bookmarks(rows, path)
    return to_rows(read_bookmarks(spark, path)).select("url", "title", "folder", "tags")


def normalized(spark, sf):
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.normalize_lines(t)).alias("lines_md5"), F.octet_length(tx.normalize_lines(t)).cast("long").alias("bytes"), F.md5(tx.collapse(t)).alias("baseline_md5"))


def captions(spark, sf):
    """Each conversation as a caption text: cue lines between its turns."""
    talk = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
    cue = F.transform("x", lambda r: F.concat(F.lit("00:01 --> 00:02\n<c>"), r["role"], F.lit("</c> &amp;gt; "), F.coalesce(r["text"], F.lit(""))))
    return talk.select("conv_id", tx.clean_captions(F.concat(F.lit("WEBVTT\nKind: captions\n\n"), F.array_join(cue, "\n"))).alias("transcript"))


QUERIES = {
    "status_counts": (status_counts, ARTICLES + """SELECT *, round(100.0 * success / nullif(total, 0), 1) AS success_pct, round(100.0 * failed / nullif(total, 0), 1) AS failed_pct FROM (
      SELECT count(*) AS total, count(*) FILTER (WHERE status IN ('success', 'archived')) AS success, count(*) FILTER (WHERE status = 'archived') AS archived,
             count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'pending') AS pending,
             CAST(coalesce(sum(word_count) FILTER (WHERE status IN ('success', 'archived')), 0) AS BIGINT) AS total_words FROM articles)"""),
    "skip_filter": (skip(False), ARTICLES + "SELECT id, url FROM articles WHERE status NOT IN ('success', 'failed')"),
    "skip_filter_retry": (skip(True), ARTICLES + "SELECT id, url FROM articles WHERE status <> 'success'"),
    "upsert_pending": (upsert_pending, ARTICLES + """, rows_ AS (
      SELECT id AS ord, url, 'Re: ' || title AS title, 'again' AS folder, tags FROM articles
      UNION ALL SELECT id + 10000000, url, 'Fw: ' || title, 'twice', tags FROM articles
      UNION ALL SELECT page_id + 20000000, url, '', 'new', '' FROM pages),
    latest AS (SELECT url, arg_max(title, ord) AS title, arg_max(folder, ord) AS folder, arg_max(tags, ord) AS tags, min(ord) AS first FROM rows_ GROUP BY url),
    fresh AS (SELECT url, row_number() OVER (ORDER BY first) + (SELECT max(id) FROM articles) AS id FROM latest WHERE url NOT IN (SELECT url FROM articles))
    SELECT coalesce(a.id, f.id) AS id, coalesce(a.url, n.url) AS url, coalesce(n.title, a.title) AS title, coalesce(n.folder, a.folder) AS folder, coalesce(n.tags, a.tags) AS tags,
           CASE WHEN n.url IS NOT NULL THEN 'pending' ELSE a.status END AS status, a.word_count
    FROM articles a FULL JOIN latest n ON a.url = n.url LEFT JOIN fresh f ON n.url = f.url"""),
    "mark_outcomes": (mark_outcomes, ARTICLES + r"""SELECT id, url, title2 AS title,
      CASE WHEN ok THEN substr(sha256(url), 1, 12) || '_' || coalesce(nullif(substr(regexp_replace(regexp_replace(regexp_replace(title2, '[<>:"/\\|?*]', '', 'g'), '^\s+|\s+$', '', 'g'), '\s+', '_', 'g'), 1, 80), ''), 'untitled') || '.txt' END AS filename,
      CASE WHEN ok AND (contains(content, 'Internet Archive Wayback Machine') OR contains(content, 'Archive.ph')) THEN 'archived' WHEN ok THEN 'success' WHEN bad THEN 'failed' ELSE status END AS status,
      CASE WHEN bad THEN CASE WHEN id % 4 = 0 THEN 'timed out' ELSE 'Extraction returned no content' END WHEN status = 'failed' THEN 'no content: ' || id END AS error_message, word_count
    FROM (SELECT *, status = 'pending' AND id % 2 = 1 AS ok, status = 'pending' AND id % 2 = 0 AS bad,
          CASE WHEN status = 'pending' AND id % 2 = 1 THEN coalesce(nullif(title, ''), 'Untitled') ELSE title END AS title2 FROM articles)"""),
    "failed_urls_top10": (lambda spark, sf: ingest.failed_urls(archive(spark, sf)), ARTICLES + "SELECT id, url, 'no content: ' || id AS error_message FROM articles WHERE status = 'failed' ORDER BY id LIMIT 10"),
    "read_by_id": (lambda spark, sf: ingest.read_article(archive(spark, sf), 42), ARTICLES + "SELECT id, title, url, folder, word_count, content FROM articles WHERE id = 42"),
    "article_id_filename": (lambda spark, sf: table(spark, sf, "pages").select("page_id", urls.article_id(F.col("url")).alias("article_id"), urls.filename(F.col("url"), F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)).alias("filename")),
        r"""SELECT page_id, substr(sha256(url), 1, 12) AS article_id, substr(sha256(url), 1, 12) || '_' || coalesce(nullif(substr(regexp_replace(trim(regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1, 's'), '[<>:"/\\|?*]', '', 'g')), '\s+', '_', 'g'), 1, 80), ''), 'untitled') || '.txt' AS filename FROM pages"""),
    "url_route": (route, URLS + f"""SELECT page_id, kind, concat_ws(',', CASE WHEN contains(url, 'youtube.com') OR contains(url, 'youtu.be') THEN 'video' END, CASE WHEN contains(url, 'github.com') AND NOT contains(url, 'gist.') THEN 'code' END,
        CASE WHEN contains(url, 'medium.com') OR contains(url, 'towardsdatascience.com') THEN 'archive' END, CASE WHEN host IN {tuple(PAYWALLED)} THEN 'reader' END, 'page', 'archive') AS route,
        CASE WHEN host IN {tuple(PAYWALLED)} THEN host END AS domain, netloc, CASE WHEN contains(url, '/blob/') THEN replace(replace(url, 'https://github.com', 'https://raw.githubusercontent.com'), '/blob/', '/') END AS raw_url,
        CASE WHEN contains(url, '/blob/') THEN split_part(url, '/', 4) || '/' || split_part(url, '/', 5) || ': ' || split_part(split_part(url, '?', 1), '/', 9) END AS raw_title FROM h"""),
    "paywall_domain": (lambda spark, sf: some_urls(spark, sf).select("page_id", "kind", urls.host(F.col("url")).alias("host"), urls.is_paywalled(F.col("url")).alias("paywalled"), urls.paywalled_domain(F.col("url")).alias("domain")),
        URLS + f"SELECT page_id, kind, host, coalesce(host IN {tuple(PAYWALLED)}, false) AS paywalled, CASE WHEN host IN {tuple(PAYWALLED)} THEN host END AS domain FROM h"),
    "cascade_outcomes": (cascade_outcomes, ARTICLES + """, k AS (SELECT *, id % 7 AS k FROM articles), o AS (SELECT *,
        k IN (0, 1, 6) AND content IS NOT NULL OR k = 5 AND content IS NOT NULL AS ok,
        CASE WHEN k = 5 THEN content || chr(10) || chr(10) || '---' || chr(10) || 'Note: This article was retrieved from Archive.ph' || chr(10) || 'Original URL: ' || url || chr(10) || 'Archive URL: https://archive.ph/' || id || chr(10) ELSE content END AS new,
        CASE WHEN k IN (2, 4) THEN 'timed out 2' ELSE 'Extraction returned no content' END AS why FROM k)
      SELECT id, CASE WHEN NOT ok THEN 'failed' WHEN contains(new, 'Internet Archive Wayback Machine') OR contains(new, 'Archive.ph') THEN 'archived' ELSE 'success' END AS status,
        CASE WHEN ok THEN coalesce(nullif(title, ''), 'Untitled') ELSE title END AS title,
        CASE WHEN ok THEN CASE WHEN status = 'failed' THEN 'no content: ' || id END ELSE why END AS error_message, md5(CASE WHEN ok THEN new ELSE content END) AS content_md5,
        CASE WHEN ok THEN CAST(len(regexp_extract_all(new, '\\S+')) AS BIGINT) ELSE word_count END AS word_count FROM o"""),
    "first_last_articles": (lambda spark, sf: an.ends(saved(spark, sf), "ts", "id", "title", "url").withColumn("date", F.col("date").cast("string")), ARTICLES + """, s AS (SELECT id, substr(title, 1, 80) AS title, substr(url, 1, 80) AS url, ts, CAST(CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles' AS DATE) AS VARCHAR) AS date FROM articles JOIN events ON id = event_id WHERE ts IS NOT NULL)
      SELECT 'first' AS which, id, title, url, date FROM (SELECT * FROM s ORDER BY ts, id LIMIT 1) UNION ALL SELECT 'last', id, title, url, date FROM (SELECT * FROM s ORDER BY ts DESC, id LIMIT 1)"""),
    "hour_bars": (lambda spark, sf: an.hour_bars(events(spark, sf)), LOCAL + ", b AS (SELECT CAST(hour(lt) AS INTEGER) AS hour, count(*) AS count FROM e GROUP BY 1) SELECT hour, count, CAST(floor(count / (SELECT max(count) FROM b) * 50) AS BIGINT) AS bar FROM b"),
    "calendar_365": (lambda spark, sf: an.daily(orders(spark, sf), F.lit("2001-07-31 09:30:00").cast("timestamp_ntz") - F.expr("INTERVAL 365 DAYS"), strict=True).withColumn("date", F.col("date").cast("string")),
        """WITH o AS (SELECT (o_orderdate AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles' AS lt FROM orders), b AS (SELECT min(lt) AS lo, max(lt) AS hi FROM o),
      steps AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS step FROM b), kept AS (SELECT step, min(CAST(step AS DATE)) OVER () AS first FROM steps WHERE step >= TIMESTAMP '2001-07-31 09:30:00' - INTERVAL 365 DAY),
      days AS (SELECT CAST(lt AS DATE) AS date, count(*) AS n FROM o GROUP BY 1)
      SELECT CAST(CAST(step AS DATE) AS VARCHAR) AS date, coalesce(n, 0) AS count, CAST(isodow(step) - 1 AS INTEGER) AS weekday, CAST(weekofyear(step) AS INTEGER) AS week, CAST(floor((CAST(step AS DATE) - first) / 7) AS INTEGER) AS week_adj
      FROM kept LEFT JOIN days ON date = CAST(step AS DATE)"""),
    "csv_roundtrip": (csv_roundtrip, ARTICLES + """SELECT url, title, folder, tags FROM articles"""),
    "length_buckets": (lambda spark, sf: an.length_buckets(archive(spark, sf)), ARTICLES + """SELECT b.bucket, count(a.id) AS count FROM (VALUES ('short'), ('medium'), ('long')) AS b(bucket)
      LEFT JOIN articles a ON a.word_count > 0 AND b.bucket = CASE WHEN a.word_count <= 500 THEN 'short' WHEN a.word_count <= 2000 THEN 'medium' ELSE 'long' END GROUP BY 1"""),
    "span_days": (lambda spark, sf: an.first_last(table(spark, sf, "events"), "ts", "event_id").select("span_days"), "SELECT CAST(floor(epoch(max(ts) - min(ts)) / 86400) AS BIGINT) AS span_days FROM events"),
    "word_count": (lambda spark, sf: archive(spark, sf).select("id", "word_count"), ARTICLES + "SELECT id, word_count FROM articles"),
    "length_stats": (lambda spark, sf: an.length_stats(archive(spark, sf)), ARTICLES + """SELECT count(*) AS articles, avg(word_count) AS mean, median(word_count) AS median, min(word_count) AS shortest, max(word_count) AS longest,
      count(*) FILTER (WHERE word_count <= 500) AS short, count(*) FILTER (WHERE word_count > 500 AND word_count <= 2000) AS medium, count(*) FILTER (WHERE word_count > 2000) AS long FROM articles WHERE word_count > 0"""),
    "normalize_text": (normalized, r"""WITH n AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS t,
      trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS b FROM documents) SELECT doc_id, md5(t) AS lines_md5, strlen(t) AS bytes, md5(b) AS baseline_md5 FROM n"""),
    "vtt_clean": (captions, r"""WITH t AS (SELECT conv_id, turn, i, trim(regexp_replace(line, '<[^>]+>', '', 'g')) AS line FROM (
        SELECT conv_id, turn, unnest(s) AS line, generate_subscripts(s, 1) AS i FROM (SELECT conv_id, turn, string_split('<c>' || role || '</c> &amp;gt; ' || coalesce(text, ''), chr(10)) AS s FROM conversations)) WHERE trim(line) <> '' AND NOT contains(line, '-->') AND NOT regexp_matches(trim(line), '^(WEBVTT|Kind:|Language:)')),
      p AS (SELECT conv_id, turn, i, trim(replace(replace(replace(line, '&amp;', '&'), '&gt;', '>'), '&lt;', '<')) AS line FROM t),
      f AS (SELECT conv_id, line, min(turn * 100000 + i) AS lt FROM p WHERE line <> '' GROUP BY 1, 2)
      SELECT c.conv_id, string_agg(line, chr(10) ORDER BY lt) AS transcript FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN f USING (conv_id) GROUP BY c.conv_id"""),
    "daily_calendar": (lambda spark, sf: an.daily(events(spark, sf)).withColumn("date", F.col("date").cast("string")), LOCAL + "SELECT CAST(date AS VARCHAR) AS date, count, weekday, week, week_adj FROM daily"),
    "calendar_pivot": (lambda spark, sf: an.calendar_pivot(an.daily(events(spark, sf))), LOCAL + "SELECT weekday, week_adj, value FROM pivot_"),
    "calendar_levels": (lambda spark, sf: an.calendar_levels(an.calendar_pivot(an.daily(events(spark, sf)))), LOCAL + """, q AS (SELECT CAST(trunc(quantile_cont(value, 0.25)) AS INTEGER) AS q1, CAST(trunc(quantile_cont(value, 0.5)) AS INTEGER) AS q2, CAST(trunc(quantile_cont(value, 0.75)) AS INTEGER) AS q3 FROM pivot_ WHERE value > 0)
      SELECT weekday, week_adj, CASE WHEN value = 0 THEN 0 ELSE CAST(value >= 0.5 AS INTEGER) + CAST(value >= q1 AS INTEGER) + CAST(value >= q2 AS INTEGER) + CAST(value >= q3 AS INTEGER) END AS level FROM pivot_, q"""),
    "by_hour": (lambda spark, sf: an.count_by(events(spark, sf), "hour"), LOCAL + "SELECT CAST(hour(lt) AS INTEGER) AS hour, count(*) AS count FROM e GROUP BY 1"),
    "by_weekday": (lambda spark, sf: an.by_weekday(events(spark, sf)), LOCAL + "SELECT CAST(isodow(lt) - 1 AS INTEGER) AS weekday, dayname(lt) AS day_name, count(*) AS count FROM e GROUP BY 1, 2"),
    "peak_hour_day": (lambda spark, sf: an.peaks(events(spark, sf)), LOCAL + """SELECT (SELECT CAST(hour(lt) AS INTEGER) FROM e GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS peak_hour,
      (SELECT d FROM (SELECT dayname(lt) AS d, isodow(lt) AS i, count(*) AS n FROM e GROUP BY 1, 2) ORDER BY n DESC, i LIMIT 1) AS peak_day"""),
    "first_last": (lambda spark, sf: an.first_last(table(spark, sf, "events"), "ts", "event_id"), """SELECT (SELECT event_id FROM events WHERE ts IS NOT NULL ORDER BY ts, event_id LIMIT 1) AS first_id, (SELECT event_id FROM events WHERE ts IS NOT NULL ORDER BY ts DESC, event_id LIMIT 1) AS last_id,
      (SELECT CAST(floor(epoch(max(ts) - min(ts)) / 86400) AS BIGINT) FROM events) AS span_days"""),
    "by_month": (lambda spark, sf: an.count_by(orders(spark, sf), "year_month"), MONTHS + "SELECT * FROM m"),
    "month_extremes": (lambda spark, sf: an.month_extremes(an.count_by(orders(spark, sf), "year_month")), MONTHS + """SELECT avg(count) AS avg_count, max(count) AS max_count, min(count) AS min_count,
      (SELECT year_month FROM m ORDER BY count DESC, year_month LIMIT 1) AS max_month, (SELECT year_month FROM m ORDER BY count, year_month LIMIT 1) AS min_month FROM m"""),
    "recent_trend": (lambda spark, sf: an.recent_trend(orders(spark, sf), F.lit("2001-07-31 17:00:00").cast("timestamp_ntz")), MONTHS + """, r AS (SELECT strftime(lt, '%Y-%m') AS ym, count(*) AS n FROM o WHERE lt >= TIMESTAMP '2001-07-31 17:00:00' - INTERVAL 180 DAY GROUP BY 1)
      SELECT count(*) AS months, CASE WHEN count(*) >= 2 THEN CASE WHEN arg_max(n, ym) > arg_min(n, ym) THEN 'increasing' ELSE 'decreasing' END END AS trend FROM r"""),
    "by_quarter": (lambda spark, sf: an.count_by(orders(spark, sf), "quarter"), MONTHS + "SELECT CAST(quarter(lt) AS INTEGER) AS quarter, count(*) AS count FROM o GROUP BY 1"),
    "top_domains": (lambda spark, sf: an.top_domains(table(spark, sf, "pages"), 20), "SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS domain, count(*) AS count FROM pages GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"),
    "folder_counts": (lambda spark, sf: an.count_by(table(spark, sf, "events").where("event_type IS NOT NULL"), "event_type").withColumnRenamed("event_type", "folder"), "SELECT event_type AS folder, count(*) AS count FROM events WHERE event_type IS NOT NULL GROUP BY 1"),
    "title_terms": (lambda spark, sf: an.top_terms(archive(spark, sf)), ARTICLES + r""", t AS (SELECT unnest(regexp_extract_all(lower(title), '[\p{L}\p{N}_]+')) AS term FROM articles),
      k AS (SELECT term, count(*) AS count FROM t WHERE regexp_matches(term, '^[a-z]{4,}$') AND term NOT IN ('with', 'from', 'that', 'this', 'your', 'github', 'page', 'home', 'about', 'blog', 'news', 'site', 'article') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30)
      SELECT term, count, CAST(floor(count / (SELECT max(count) FROM k) * 30) AS BIGINT) AS bar FROM k"""),
}
