"""Ingest from an export to outcomes, by command and by stream; sources other than pages; attempts; tiers."""

import base64
import json

from pyspark.sql import functions as F

from quillstack import cli
from quillstack.functions import html as H
from quillstack.functions import urls
from quillstack.operators import cascade, extract, ingest, search
from quillstack.schema import ARTICLE
from quillstack.sources import files
from quillstack.sources.bookmarks import read_bookmarks, to_rows
from quillstack.streaming import ingest as stream

HEAD = "URL,Title,Selection,Folder,Timestamp,Tags\n"
BODY = "<title>Given - Site</title><body><article><h1>Head</h1><p>" + "some words of it " * 10 + "</article>"


def test_ingest_command(spark, tmp_path, capsys):
    csv, pages, first, second = (str(tmp_path / n) for n in ("a.csv", "pages", "v1", "v2"))
    (tmp_path / "a.csv").write_text(HEAD + "http://a/1,One,,f,100,t\nhttp://www.wsj.com/2,Two,,f,200,\nhttp://a/3,Three,,,x,\nhttp://a/1,Again,,g,300,u\n")
    spark.createDataFrame([("http://a/1", BODY), ("http://a/3", "<p>no"), ("http://other", BODY)], "url string, html string").write.parquet(pages)
    assert cli.main(["ingest", csv, pages, first, "--table", str(tmp_path / "none")]) == 0
    got = {r.url: r for r in spark.read.parquet(first).collect()}
    assert [f.name for f in ARTICLE] == spark.read.schema(ARTICLE).parquet(first).columns and len(got) == 3
    one, two, three = got["http://a/1"], got["http://www.wsj.com/2"], got["http://a/3"]
    assert (one.id, one.title, one.folder, one.timestamp, one.tags, one.status) == (1, "Head", "g", 300, "u", "success")
    assert one.word_count == len(one.content.split()) and one.filename.endswith("_Head.txt")
    assert (two.id, two.status, two.error_message, two.content) == (2, "failed", "Paywalled site (wsj.com) - no archive available", None)
    assert (three.id, three.status, three.error_message, three.timestamp) == (3, "failed", "Extraction returned no content", None)
    # Successes and failures are done; with retries the failures alone come again, and all of them fail.
    assert cli.main(["ingest", csv, pages, second, "--table", first]) == 0
    assert spark.read.parquet(second).orderBy("id").collect() == spark.read.parquet(first).orderBy("id").collect()
    assert cli.main(["ingest", csv, pages, str(tmp_path / "v3"), "--table", first, "--retry-failed"]) == 1
    assert cli.main(["stats", "--table", first]) == 0 and cli.main(["analyze", "--table", first]) == 0
    assert cli.main(["read", "1", "--table", first]) == 0 and cli.main(["read", "9", "--table", first]) == 1
    assert cli.main(["search", "words", "NOT", "zzz", "--table", first]) == 0 and cli.main(["search", "don't", "--table", first]) == 1
    assert cli.main(["index", str(tmp_path / "index"), "--table", first]) == 0
    assert cli.main(["search", "words", "--table", first, "--index", str(tmp_path / "index")]) == 0
    assert cli.main(["export", f"file://{tmp_path}/texts", "--table", first]) == 0 and (tmp_path / "texts" / one.filename).read_text() == one.content
    out = capsys.readouterr()
    assert out.out.count("a/1\n") >= 2 and "3 articles" in out.out and "1 files" in out.out
    assert "Success    1 (33.3%)" in out.out and "a/1" in out.out and "syntax error" in out.err


def test_merge_keeps_the_rest(spark):
    kept = (7, "u", "t", "f", 1, "x", "name.txt", "archived", "old", "text", 1)
    rows = spark.createDataFrame([(0, "u", "n", "g", 5, "y")], "ord long, url string, title string, folder string, timestamp long, tags string")
    got = ingest.upsert_pending(spark.createDataFrame([kept], ARTICLE), rows).first()
    assert got.asDict() == dict(zip(ARTICLE.fieldNames(), (7, "u", "n", "g", 5, "y", "name.txt", "pending", "old", "text", 1)))


def test_outcomes_keep_the_rest(spark):
    articles = spark.createDataFrame([(i, f"u{i}", "t", "f", 1, "x", "name.txt", "pending", "old", "text", 1) for i in (1, 2, 3, 4)], ARTICLE)
    outcomes = spark.createDataFrame(
        [("u1", True, "", "a b", 2, None), ("u2", False, None, None, None, "timed out"), ("u3", True, "New", "see Archive.ph", 2, None)],
        "url string, ok boolean, new_title string, new_content string, new_words long, error string",
    )
    got = {r.id: r for r in ingest.apply_outcomes(articles, outcomes).collect()}
    assert (got[1].title, got[1].status, got[1].content, got[1].error_message, got[1].folder) == ("t", "success", "a b", "old", "f")
    assert (got[2].status, got[2].error_message, got[2].content, got[2].filename) == ("failed", "timed out", "text", "name.txt")
    assert (got[3].title, got[3].status) == ("New", "archived") and got[4].status == "pending"


def test_stream_merges_exports(spark, tmp_path):
    folder, table, state = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "state")
    folder.mkdir()
    spark.createDataFrame([(1, "http://a", "old", "", 1, "", None, "success", None, "c", 1)], ARTICLE).write.parquet(f"{table}/version=0")
    (folder / "1.csv").write_text(HEAD + "http://a,new,,,2,\nhttp://b,B,,f,3,t\n")
    stream.start(spark, str(folder), table, state).awaitTermination()
    (folder / "2.csv").write_text(HEAD + "http://b,B2,,f,4,t\n")
    stream.start(spark, str(folder), table, state).awaitTermination()
    got = {r.url: (r.id, r.title, r.timestamp, r.status) for r in spark.read.parquet(f"{table}/version=2").collect()}
    assert got == {"http://a": (1, "old", 1, "success"), "http://b": (2, "B2", 4, "pending")}


def test_other_sources(spark):
    body = json.dumps({"content": base64.b64encode("Héllo\nthere".encode()).decode()[:6] + "\n" + base64.b64encode("Héllo\nthere".encode()).decode()[6:]})
    row = spark.createDataFrame([("https://github.com/o/r", body)], "u string, b string")
    assert tuple(row.select(urls.readme_source(F.col("u"), F.col("b")).alias("x")).first().x) == ("o/r", "Héllo\nthere")
    assert row.select(urls.readme_source(F.concat("u", F.lit("/issues")), F.col("b")).alias("x")).first().x is None
    found = json.dumps({"archived_snapshots": {"closest": {"available": True, "url": "http://w"}}})
    asked = spark.createDataFrame([("https://archive.ph/x", 200, found), ("https://archive.ph/x", 404, found), ("https://else", 200, "{}")], "u string, s int, j string")
    assert [r.x and tuple(r.x) for r in asked.select(urls.snapshot(F.col("u"), F.col("s"), F.col("j")).alias("x")).collect()] == [
        ("Archive.ph", "https://archive.ph/x"), ("Internet Archive Wayback Machine", "http://w"), None]
    assert row.select(ingest.is_archived(urls.with_provenance(F.lit("t"), F.lit("Archive.ph"), F.col("u"), F.lit("s"))).alias("x")).first().x


def test_attempts(spark):
    tries = [
        ([(False, None, None)] * 3, (False, None, None)), ([(False, None, "e"), (False, None, None)], (False, None, None)), ([(False, None, None), (False, None, "e")], (False, None, "e")),
        ([(False, None, "e"), (False, None, "f")], (False, None, "f")), ([(False, None, "e"), (True, "t", None)], (True, "t", None)), ([], (False, None, None)),
    ]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(tries)], "i int, a array<struct<ok:boolean,text:string,error:string>>")
    got = [tuple(r.x) for r in df.orderBy("i").select(extract.resolve_attempts(F.col("a")).alias("x")).collect()]
    assert got == [want for _, want in tries]


def test_single_tiers(spark):
    markup = [
        (-1, "http://a/1", '<script type="application/ld+json">{"@graph":[{"articleBody":"' + "long body " * 12 + '"}]}</script><p>no</p>'),
        (-2, None, "<body><div><p>" + "Plain words, without a container. " * 4 + "</p></div></body>"),
        (-3, "http://a/3", "<body><main><h1>Head</h1><p>" + "In the main part &amp; more of it. " * 5 + "<p>Second</main><footer>foot</footer>"),
        (-4, "http://a/4", "<body></body>"), (-5, "http://a/5", "<body><span>Between fifty and one hundred bytes of text in the body.</span></body>"),
    ]
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html").unionByName(spark.createDataFrame(markup, "page_id long, url string, html string"))
    rows = extract.tier_texts(pages).collect()
    found = {n: {r.id: r[n] for r in rows} for n in ("structured", "paragraphs", "body")}
    assert found["structured"][-1].startswith("long body") and sum(t is not None for t in found["structured"].values()) == 1
    assert found["paragraphs"][-2] is None and found["paragraphs"][-3].startswith("In the main part")  # the first has no URL
    assert found["body"][-3].startswith("Head In the main part & more") and "foot" not in found["body"][-3] and found["body"][-4] is None
    assert all(t for i, t in found["body"].items() if i >= 0)


def test_cascade(spark):
    """Routes, attempts and the archive in one flow: a text ends all, an error ends its attempt, the archive comes on the last one."""
    articles = spark.createDataFrame([(u,) for u in ("http://a", "https://medium.com/b", "https://youtu.be/c", "http://d", "https://www.wsj.com/e", "http://f", "http://f")], "url string")
    given = spark.createDataFrame([
        ("http://a", 1, "page", "T", "text a", None), ("http://a", 0, "page", None, None, "timed out"), ("http://a", 1, "archive", "X", "not asked", None),
        ("https://medium.com/b", 0, "archive", "B", "from the archive", None), ("https://medium.com/b", 0, "page", "P", "not asked", None),
        ("https://youtu.be/c", 0, "video", None, None, "no captions"), ("https://youtu.be/c", 0, "page", "C", "not reached", None), ("https://youtu.be/c", 1, "page", "C", "second try", None),
        ("http://d", 2, "archive", "D", "late copy", None), ("http://f", 2, "page", None, None, "refused"), ("http://f", 2, "archive", "F", "not reached", None),
    ], "url string, attempt int, source string, title string, text string, error string")
    got = {r.url: (r.ok, r.new_title, r.new_content, r.new_words, r.error) for r in cascade.outcomes(articles, given).collect()}
    assert got == {
        "http://a": (True, "T", "text a", 2, None), "https://medium.com/b": (True, "B", "from the archive", 3, None), "https://youtu.be/c": (True, "C", "second try", 2, None),
        "http://d": (True, "D", "late copy", 2, None), "https://www.wsj.com/e": (False, None, None, None, None), "http://f": (False, None, None, None, "refused"),
    }


def test_texts_are_files(spark, tmp_path):
    rows = [("a_T.txt", "Héllo\nthere"), ("b.txt", ""), (None, "x"), ("c.txt", None), ("d.txt", "long " * 100_000)]
    articles = spark.createDataFrame(rows, "filename string, content string")
    got = {r.filename: r.bytes for r in files.write_texts(articles, f"file://{tmp_path}/texts").collect()}
    assert got == {"a_T.txt": 12, "b.txt": 0, "d.txt": 500_000}
    assert (tmp_path / "texts" / "a_T.txt").read_bytes() == "Héllo\nthere".encode()
    back = {r.filename: r.content for r in files.read_texts(spark, f"file://{tmp_path}/texts").collect()}
    assert back["a_T.txt"] == "Héllo\nthere" and len(back["d.txt"]) == 500_000


def test_deep_markup():
    deep = "<article><h1>" + "<b>" * 20000 + "end" + "</article>" + "<p>" + "words of it " * 20
    assert H.raw_text(H.parse(deep)).startswith("end")


def test_highlights(spark):
    row = spark.createDataFrame([("...a >>>hit<<< b",)], "s string")
    assert row.select(search.highlighted(F.col("s")), search.plain(F.col("s"))).first()[:] == ("...a \x1b[1;31mhit\x1b[0m b", "...a hit b")


def test_pages_without_readable_markup_keep_their_rows(spark, monkeypatch):
    monkeypatch.setattr(extract, "MAX_BODY", 1000)
    rows = [(1, "http://a/1", None), (2, "http://a/2", ""), (3, "http://a/3", BODY + " " * 1000), (4, "http://a/4", BODY), (5, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = {r.id: r for r in extract.extract_pages(pages).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5] and got[1].url == "http://a/1"
    assert all(tuple(got[i])[2:] == (None,) * 4 for i in (1, 2, 3, 5)) and got[4].title == "Head" and got[4].text
    tiers = {r.id: r for r in extract.tier_texts(pages).collect()}
    assert sorted(tiers) == [1, 2, 3, 4, 5]
    assert all(tuple(tiers[i])[1:] == (None,) * 3 for i in (1, 2, 3, 5)) and tiers[4].body
    assert [r.text for r in extract.extract_pages(pages.where("page_id < 3")).collect()] == [None, None]


def test_new_rows_are_numbered_once(spark):
    """Ids of many new rows, by many partitions: each once, in order of first appearance."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 200)
    try:
        for n in (200_000, 1_000_000):
            one = spark.createDataFrame([(7, "u", "t", "f", 1, "x", "name.txt", "success", "old", "text", 1)], ARTICLE)
            rows = spark.range(n).select(
                F.col("id").alias("ord"), F.concat(F.lit("http://a/"), F.pmod(F.col("id") * 7919, F.lit(n))).alias("url"), F.lit("t").alias("title"),
                F.lit("f").alias("folder"), F.col("id").alias("timestamp"), F.lit("").alias("tags"),
            )
            got = ingest.upsert_pending(one, rows.unionByName(rows.where("ord % 5 = 0").withColumn("ord", F.col("ord") + n))).where("url <> 'u'")
            wrong = (F.col("id") != F.pmod("timestamp", F.lit(n)) + 8) | F.col("id").isNull()
            r = got.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count_if(wrong).alias("wrong")).first()
            assert (r.n, r.ids, r.wrong) == (n, n, 0)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_last_duplicate_is_the_exports(spark, tmp_path):
    """Files in the order of their names, though the larger one is read first."""
    for name, title, more in (("1.csv", "first", 1), ("2.csv", "second", 3000), ("3.csv", "third", 10)):
        (tmp_path / name).write_text(HEAD + f"http://a,{title},,,1,\n" + "".join(f"http://{name}/{i},x,,,1,\n" for i in range(more)))
    rows = ingest.last_of_each(to_rows(read_bookmarks(spark, str(tmp_path))))
    assert rows.where("url = 'http://a'").first().title == "third"


def test_ordinary_urls(spark):
    cases = [
        ("https://www.nytimes.com/a|b", "nytimes.com", "www.nytimes.com"), ("https://www.wsj.com/a[1]", "wsj.com", "www.wsj.com"), ("https://a.com/x y", "a.com", "a.com"),
        ("https://my_host.com/p", "my_host.com", "my_host.com"), ("HTTPS://u:p@WWW.FT.com:8080/x@y?z#w", "ft.com", "u:p@WWW.FT.com:8080"), ("https:/a.com\\b", "a.com", ""),
        ("//x.com/y", None, "x.com"), ("mailto:a@b.c", None, ""), ("https://", None, ""), ("https://a b/c", None, "a b"), ("https://a:b/", None, "a:b"), ("https://a:99999/", None, "a:99999"),
        ("  https://www.www.a.com?q ", "www.a.com", "www.www.a.com"), ("http://[::1]:80/", "[::1]", "[::1]:80"), ("nothing", None, ""), (None, None, ""),
    ]
    df = spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(cases)], "i int, u string").orderBy("i")
    got = [(r.u, r.h, r.n) for r in df.select("u", urls.host(F.col("u")).alias("h"), urls.netloc(F.col("u")).alias("n")).collect()]
    assert got == cases
    assert df.where(urls.is_paywalled(F.col("u"))).count() == 3


def test_older_tables_get_content(spark):
    old = spark.createDataFrame([(1, "text")], "id long, content_preview string")
    assert ingest.with_content(old).first().content == "text" and ingest.with_content(old.select("id")).first().content is None
    new = old.withColumn("content", F.lit("new"))
    assert ingest.with_content(new).first().content == "new"
