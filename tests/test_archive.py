import random
import sqlite3
import threading

import pytest
from pyspark.sql import functions as F

from quillstack.functions import html as H
from quillstack.functions import text as tx
from quillstack.functions import urls
from quillstack.functions.porter import stem
from quillstack.operators import extract as ex
from quillstack.operators import ingest
from quillstack.operators import search as se
from quillstack.plans.registry import ALL
from quillstack.sources.bookmarks import read_bookmarks, to_rows

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column).first()[0]


def test_names(spark):
    assert one(spark, urls.article_id(F.col("u")), u="https://example.com/article") == "632538290468"
    for text, longest, want in [("Hello: World?", 100, "Hello_World"), ("a" * 200, 80, "a" * 80), ("", 80, "untitled"), ("深圳市達妙科技 Hello", 10, "深圳市達妙科技_He")]:
        assert one(spark, urls.sanitize(F.col("t"), longest), t=text) == want
    name = one(spark, urls.filename(F.col("u"), F.col("t")), u="https://example.com", t="Test Article")
    assert name.endswith(".txt") and "_Test_Article" in name


def test_paywalls(spark):
    for url, want in [("https://www.nytimes.com/2024/article", True), ("https://bloomberg.com/news", True), ("https://example.com", False), ("https://github.com/repo", False), ("not a url", False), ("https://sub.wsj.com", False)]:
        assert one(spark, urls.is_paywalled(F.col("u")), u=url) is want
    assert one(spark, urls.paywalled_domain(F.col("u")), u="https://www.wsj.com/article") == "wsj.com"
    assert one(spark, urls.paywalled_domain(F.col("u")), u="https://example.com") is None


def test_captions(spark):
    vtt = "WEBVTT\nKind: captions\n\n1\n00:01 --> 00:02\n<c>Hello</c> &amp;gt; you\n\n00:02 --> 00:03\nHello &amp;gt; you\nnext"
    assert one(spark, tx.clean_captions(F.col("t")), t=vtt) == "1\nHello > you\nnext"
    assert one(spark, tx.clean_captions(F.col("t")), t="WEBVTT\n\n00:01 --> 00:02\n") is None


def test_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('URL,Extra,Title,Selection,Folder,Timestamp,Tags\nhttp://a,x,"one, ""two""\nthree",,"",17,t\nhttp://b,,,,f,x9,\n')
    rows = sorted(to_rows(read_bookmarks(spark, str(path))).collect(), key=lambda r: r.url)
    assert [(r.url, r.title, r.folder, r.timestamp, r.tags) for r in rows] == [("http://a", 'one, "two"\nthree', "", 17, "t"), ("http://b", "", "f", None, "")]
    path.write_text("URL,Title\nhttp://a,b\n")
    with pytest.raises(ValueError, match="expected URL, Title"):
        read_bookmarks(spark, str(path))


def test_upsert_twice_changes_nothing(spark):
    articles = spark.createDataFrame([(1, "u1", "t", "f", "", "success", 5), (2, "u2", "t", "f", "", "failed", None)], "id long, url string, title string, folder string, tags string, status string, word_count long")
    rows = spark.createDataFrame([(0, "u3", "n", "a", ""), (1, "u1", "x", "a", ""), (2, "u3", "m", "b", ""), (3, "u0", "z", "b", "")], "ord long, url string, title string, folder string, tags string")
    once = ingest.upsert_pending(articles, rows)
    got = {r.url: (r.id, r.title, r.status, r.word_count) for r in once.collect()}
    assert got == {"u1": (1, "x", "pending", 5), "u2": (2, "t", "failed", None), "u3": (3, "m", "pending", None), "u0": (4, "z", "pending", None)}
    assert {r.url: (r.id, r.title, r.status, r.word_count) for r in ingest.upsert_pending(once, rows).collect()} == got


def test_html():
    page = '<title>A &amp; B | Site</title><body><nav>menu</nav><article><h1>Head</h1><p>foo<b>bar</b><p>second <div class="social-box">share</div>' + "words " * 20
    title, text, tier, _ = H.extract(page, None)
    assert (title, tier) == ("Head", "container") and text.startswith("Head\nfoo bar\nsecond\nwords words") and "share" not in text and "menu" not in text
    assert H.title_of(H.parse("<title>One - Two | Three</title>")) == "One" and H.title_of(H.parse("<p>x")) == "Untitled"
    body = '<script type="application/ld+json">{bad</script><script type="application/ld+json">[{"x":1},{"articleBody":"%s"}]</script>'
    assert H.extract(body % ("a" * 101), None)[2] == "structured" and H.extract(body % ("a" * 100), None) is None
    assert H.extract("", None) is None and H.extract("<p>short", "http://a") is None
    assert H.fold([(1.0, 10), (0.95, 30)]) == 1 and H.fold([(0.95, 30), (1.0, 10)]) == 1 and H.fold([(1.0, 10), (0.9, 100)]) == 0 and H.fold([]) is None
    assert H.score("word " * 20, 0.0, 4, 1, 0) > H.score("word " * 20, 0.2, 4, 1, 0) > H.score("word " * 20, 0.6, 4, 1, 0)


def test_link_density():
    """Bytes of links over those of the text at the edges at which a score falls."""
    for links, share, factor in ((10, 0.1, 1.0), (11, 0.11, 0.8), (30, 0.3, 0.8), (31, 0.31, 0.5), (50, 0.5, 0.5), (51, 0.51, 0.1)):
        node = next(n for n in H.parse(f"<article>{'x' * (100 - links)}<a href='#'>{'y' * links}</a></article>").walk() if n.tag == "article")
        text = H.text_of(node)
        density = H.link_density(node, text.replace(" ", ""))
        assert density == pytest.approx(share) and H.score(text, density, 0, 0, 0) == pytest.approx(H.score(text, 0.0, 0, 0, 0) * factor)


@pytest.fixture(scope="module")
def library(spark):
    rng = random.Random(8)
    words = "running runs ran relational ties sky agreed caresses naïve Éclair don't the of a generalizations hopping. falling: x_y".split()
    rows = [(i, f"title {rng.choice(words)}", " ".join(rng.choice(words) for _ in range(rng.randrange(5, 120)))) for i in range(1, 60)]
    rows.append((60, "running only here", None))
    db = sqlite3.connect(":memory:")
    for name, tokenizer in (("stems", "porter unicode61"), ("words", "unicode61")):
        db.execute(f"CREATE VIRTUAL TABLE {name} USING fts5(title, content, tokenize='{tokenizer}')")
        db.executemany(f"INSERT INTO {name}(rowid, title, content) VALUES (?, ?, ?)", rows)
    frame = spark.createDataFrame([(i, t, "u", "f", 1, c) for i, t, c in rows], "id long, title string, url string, folder string, word_count long, content string")
    return db, frame


@pytest.fixture(scope="module")
def index(library, tmp_path_factory):
    return se.Index.build(library[1], str(tmp_path_factory.mktemp("index") / "x"))


def test_index_is_pruned_by_term(index):
    plan = index.places.where(se._asks("term", [se.Phrase(["sky"])]))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,sky)]" in plan or "In(term, [sky])" in plan
    words = {r.term: (r.stem, r.df, r.cf) for r in index.words.collect()}
    assert words["running"][0] == "run" and all(1 <= df <= cf for _, df, cf in words.values())


QUERIES = [
    "running", "run sky", "run OR sky", "sky NOT run", "a OR of NOT ties", '"the of"', "rel*", "content:ties", "{title}:running", "- title:ties", "^running", "^title", "(sky OR ran) AND agreed",
    "NEAR(sky ties, 3)", "NEAR(sky ties ran, 4)", 'NEAR("the of" sky, 2)', "NEAR(sky sky, 1) OR ties", "naive", "the + of", '"sky ti"*', '"." sky', "éclair OR zzz", "sky AND ran NOT ties", "a of OR the",
]


@pytest.mark.parametrize("query", QUERIES)
def test_search_equals_the_library(library, index, query):
    db, frame = library
    want = {i: round(r, 6) for i, r in db.execute("SELECT rowid, rank FROM stems WHERE stems MATCH ?", (query,))}
    got = {r.id: round(r["rank"], 6) for r in se.ranked(frame, query).select("id", "rank").collect()}
    assert got == pytest.approx(want, abs=2e-6)
    stored = {r.id: round(r["rank"], 6) for r in se.ranked(index, query).select("id", "rank").collect()}
    assert stored == got


def test_a_tier_is_sought_alone(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<body><p>" + "words, of a page " * 9), (2, None, None), (3, "http://a/", "")], "page_id long, url string, html string")
    every = {r.id: r for r in ex.tier_texts(pages).collect()}
    for tier in ("structured", "paragraphs", "body"):
        alone = ex.tier_texts(pages, tiers=[tier])
        assert alone.columns == ["id", tier] and {r.id: r[tier] for r in alone.collect()} == {i: r[tier] for i, r in every.items()}
    assert every[1].body and every[1].paragraphs and every[2].body is None


def test_a_single_search_reads_the_articles_once(spark, library):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(len(b))
            yield b

    frame = library[1]
    counted = frame.mapInPandas(count, frame.schema)
    assert se.ranked(counted, "running OR tie*").count() == se.ranked(frame, "running OR tie*").count() > 0
    assert read.value == frame.count()


def test_words_of_a_stem_whose_i_was_a_y(spark):
    frame = spark.createDataFrame([(1, "a", "ays"), (2, "a", "aid"), (3, None, None)], "id long, title string, content string")
    assert [r.id for r in se.ranked(frame, "ays").select("id").collect()] == [1]


def test_near_over_thousands_of_places_of_one_article(spark):
    content = "of the " * 3000 + "x " * 40 + "the " * 2000
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE plain USING fts5(title, content)")
    db.executemany("INSERT INTO plain(rowid, title, content) VALUES (?, ?, ?)", rows := [(1, "a", content), (2, "of the", "x"), (3, "of", "the"), *[(i, "b", "c") for i in range(4, 12)]])
    want = {i: round(r, 6) for i, r in db.execute("SELECT rowid, rank FROM plain WHERE plain MATCH 'NEAR(of the, 3)'")}
    stop = threading.Timer(120, spark.sparkContext.cancelAllJobs)
    stop.start()
    got = se.ranked(spark.createDataFrame(rows, "id long, title string, content string"), "NEAR(of the, 3)", stemmed=False).select("id", "rank", F.transform("at", F.size).alias("n")).collect()
    stop.cancel()
    assert {r.id: round(r["rank"], 6) for r in got} == pytest.approx(want, abs=2e-6) and set(want) == {1, 2}
    assert {r.id: r.n for r in got} == {1: [3000, 3000], 2: [1, 1]}


@pytest.mark.parametrize("query", ["running sky", '"the of"', "rel* OR ties"])
def test_snippets_equal_the_library(library, query):
    db, frame = library
    want = {i: s for i, s in db.execute("SELECT rowid, snippet(stems, 1, '>>>', '<<<', '...', 30) FROM stems WHERE stems MATCH ? AND content IS NOT NULL", (query,))}
    got = {r.id: r.snippet for r in se.search(frame, query, 100).collect() if r.id != 60}
    assert got == want


@pytest.mark.parametrize("query", ["(a OR b) c", "NOT a", "a AND", "()", "", "a-b", "x:b", "a.b", "don't", '"a', "a AND NOT b"])
def test_wrong_queries(query):
    with pytest.raises(se.QueryError):
        se.Parser(query, True).parse()


def test_stems_equal_the_library():
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61')")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    ends = "s es ies ed ing eed ational ization iveness fulness ousness aliti ible able ement ion y e ll ss ly izer logi ative ical".split()
    rng = random.Random(1)
    words = sorted({rng.choice(["relat", "hop", "fall", "sk", "agr", "control", "trad", "rat", "conform", "ob", "yell", "electr", "b", "adopt", "sens"]) + "".join(rng.sample(ends, rng.randrange(1, 3))) for _ in range(600)})
    db.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", list(enumerate(words)))
    want = {words[doc]: term for term, doc in db.execute("SELECT term, doc FROM v")}
    assert {w: stem(w) for w in words} == want


def test_every_query_runs(spark):
    for name, (run, _) in ALL.items():
        assert run(spark, SF).limit(5).collect() is not None, name
