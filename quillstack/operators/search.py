"""Full-text search: the query language, a stored index, ranked hits, snippets.

A query is parsed on the driver. Tokens that are part of one of its phrases are kept with the place where
the phrase would start; a phrase is found where all its tokens agree on the start. So every query is one
pass over the asked terms' places and two aggregations by document, whatever its shape.

The index holds the places in segments, each of some articles and sorted by term, so a query reads the pages
of its terms only; the words with their stems, so a stemmed query looks up the few words it asks for; and the articles' lengths. Articles
without an index are searched by one pass over their tokens, of which only the asked ones are kept: for a single
search that is far less work than an index.
"""

from __future__ import annotations

import functools
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstack.functions import text as tx
from quillstack.functions.porter import stem
from quillstack.sources.bookmarks import scratch

COLUMNS = ("title", "content")
K1, B = 1.2, 0.75


class QueryError(ValueError):
    """A query that cannot be read; the message has a hint."""

    def __init__(self, reason: str):
        super().__init__(f"{reason}. Put phrases in double quotes; operators are AND, OR and NOT.")


@dataclass
class Phrase:
    terms: list[str]
    prefix: bool = False
    columns: tuple[str, ...] = COLUMNS
    first: bool = False


@dataclass
class Node:
    """op: phrase, near, and, or, not."""

    op: str
    parts: list = field(default_factory=list)
    phrase: Phrase | None = None
    distance: int = 10


TOKEN = re.compile(r'\s*(?:("(?:[^"]|"")*")|([\w\x80-\U0010ffff]+)|(.))', re.DOTALL)


def fold(text: str) -> list[str]:
    """The terms of a query's string, as documents are tokenised."""
    return re.findall(r"[^\W_]+", text.lower().translate(str.maketrans(tx.ACCENTED, tx.BARE)))


class Parser:
    """Adjacent phrases bind tightest, then NOT, AND, OR. Only phrases may stand side by side."""

    def __init__(self, query: str, stemmed: bool):
        self.items = [m.groups() for m in TOKEN.finditer(query) if any(m.groups())]
        self.items = [x for x in self.items if not (x[2] and x[2].isspace())]
        self.at, self.stemmed = 0, stemmed

    def peek(self) -> tuple:
        return self.items[self.at] if self.at < len(self.items) else (None, None, None)

    def take(self) -> tuple:
        item = self.peek()
        self.at += 1
        return item

    def word(self, value: str) -> bool:
        return self.peek()[1] == value

    def mark(self, value: str) -> bool:
        return self.peek()[2] == value

    def parse(self) -> Node:
        tree = self.either()
        if self.at < len(self.items):
            raise QueryError(f"syntax error near {next(x for x in self.peek() if x)!r}")
        return tree

    def chain(self, op: str, part) -> Node:
        parts = [part()]
        while self.word(op.upper()):
            self.take()
            parts.append(part())
        return parts[0] if len(parts) == 1 else Node(op, parts)

    def either(self) -> Node:
        return self.chain("or", lambda: self.chain("and", lambda: self.chain("not", self.group)))

    def group(self) -> Node:
        if self.mark("("):
            self.take()
            tree = self.either()
            if not self.mark(")"):
                raise QueryError("a parenthesis is not closed")
            self.take()
            return tree
        parts = [self.filtered()]
        while self.peek()[0] or self.mark("^") or self.mark("{") or (self.peek()[1] and self.peek()[1] not in ("AND", "OR", "NOT")):
            parts.append(self.filtered())
        return parts[0] if len(parts) == 1 else Node("and", parts)

    def filtered(self) -> Node:
        start, columns = self.at, None
        without = self.mark("-")
        if without:
            self.take()
        if self.mark("{"):
            self.take()
            columns = []
            while self.peek()[1]:
                columns.append(self.take()[1])
            if not self.mark("}"):
                raise QueryError("a column list is not closed")
            self.take()
        elif self.peek()[1] and self.at + 1 < len(self.items) and self.items[self.at + 1][2] == ":":
            columns = [self.take()[1]]
        if columns is None:
            self.at = start
            if without:
                raise QueryError("syntax error near '-'")
            return self.near_or_phrase(COLUMNS)
        if not self.mark(":"):
            raise QueryError("a column list without a colon")
        self.take()
        unknown = [c for c in columns if c.lower() not in COLUMNS]
        if unknown:
            raise QueryError(f"no such column: {unknown[0]}")
        named = {c.lower() for c in columns}
        return self.near_or_phrase(tuple(c for c in COLUMNS if (c in named) != without))

    def near_or_phrase(self, columns: tuple[str, ...]) -> Node:
        if self.word("NEAR") and self.at + 1 < len(self.items) and self.items[self.at + 1][2] == "(":
            self.at += 2
            parts, distance = [], 10
            while self.peek()[0] or self.peek()[1] or self.mark("^"):
                parts.append(self.phrase(columns))
            if self.mark(","):
                self.take()
                if not (self.peek()[1] or "").isdigit():
                    raise QueryError("NEAR needs a number after the comma")
                distance = int(self.take()[1])
            if not self.mark(")") or not parts:
                raise QueryError("syntax error in NEAR")
            self.take()
            return Node("near", parts, distance=distance)
        return self.phrase(columns)

    def phrase(self, columns: tuple[str, ...]) -> Node:
        first = self.mark("^")
        if first:
            self.take()
        terms: list[str] = []
        while True:
            quoted, bare, other = self.take()
            if quoted is None and (bare is None or bare in ("AND", "OR", "NOT")):
                raise QueryError("unterminated string" if other == '"' else f"syntax error near {other or bare or ''!r}")
            terms += fold(quoted[1:-1].replace('""', '"') if quoted else bare)
            if not self.mark("+"):
                break
            self.take()
        prefix = self.mark("*")
        if prefix:
            self.take()
        if self.stemmed:
            terms = [stem(t) for t in terms]
        return Node("phrase", phrase=Phrase(terms, prefix, columns, first))


def phrases_of(tree: Node) -> list[Phrase]:
    return [tree.phrase] if tree.op == "phrase" else [p for x in tree.parts for p in phrases_of(x)]


@F.pandas_udf(T.StringType())
def stem_column(words: pd.Series) -> pd.Series:
    return words.map(stem)


def _length() -> Column:
    """Tokens of both columns."""
    return sum((F.size(tx.tokens(F.coalesce(F.col(c), F.lit("")))) for c in COLUMNS), F.lit(0))


def postings(articles: DataFrame) -> DataFrame:
    """id, col, pos, term of each token."""
    each = F.array(*[F.struct(F.lit(c).alias("col"), tx.tokens(F.coalesce(F.col(c), F.lit(""))).alias("t")) for c in COLUMNS])
    return articles.select("id", F.inline(each)).select("id", "col", F.posexplode("t").alias("pos", "term"))


#: Bytes of text in a segment of the index, whose tokens a task sorts.
SEGMENT = 32_000_000


@dataclass
class Index:
    """places: term, id, col, pos, sorted by term in each segment; words: term, stem, df, cf; lengths: id, len; rows and their mean length."""

    places: DataFrame
    words: DataFrame
    lengths: DataFrame
    n: int
    mean: float

    @classmethod
    def build(cls, articles: DataFrame, path: str) -> Index:
        """Written under `path`. Articles are dealt to segments by id; a segment's tokens are sorted where they are found, so no token moves."""
        spark = articles.sparkSession
        texts = articles.select("id", *COLUMNS)
        weight = texts.agg(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in COLUMNS), F.lit(0)).cast("long"))).first()[0] or 0
        segments = max(math.ceil(weight / SEGMENT), min(spark.sparkContext.defaultParallelism, math.ceil(weight / 1e6)), 1)
        dealt = texts.repartition(segments, "id")
        postings(dealt).select("term", "id", "col", "pos").sortWithinPartitions("term", "id").write.parquet(f"{path}/places")
        # An article may have a word in both columns.
        own = F.array_distinct(F.flatten(F.array(*[tx.tokens(F.coalesce(F.col(c), F.lit(""))) for c in COLUMNS])))
        df = texts.select(F.explode(own).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        cf = spark.read.parquet(f"{path}/places").groupBy("term").agg(F.count("*").alias("cf"))
        df.join(cf, "term").select("term", stem_column("term").alias("stem"), "df", "cf").sort("stem", "term").write.parquet(f"{path}/words")
        articles.select("id", _length().alias("len")).write.parquet(f"{path}/lengths")
        return cls.open(spark, path)

    @classmethod
    def scan(cls, articles: DataFrame, phrases: list[Phrase], stemmed: bool) -> Index:
        """What an index of all tokens has for `phrases`, by one pass over the articles: their lengths and the tokens that may be asked for.

        The first two letters of a stem are its words', but for an i that was a y: tokens that begin otherwise cannot be asked for.
        """
        spark, path = articles.sparkSession, scratch(articles.sparkSession, "search-scan")
        begins = {t[:2] for p in phrases for t in p.terms}
        begins = sorted(begins | {t.replace("i", "y") for t in begins if t[1:] == "i"}) if stemmed else []
        asked = functools.reduce(lambda x, y: x | y, [F.col("term").startswith(t) for t in begins], F.lit(False)) if stemmed else _asks("term", phrases)
        cut = articles.select("id", *[tx.tokens(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in COLUMNS])
        size = sum((F.size(c) for c in COLUMNS), F.lit(0))
        # The first row of each article has its length.
        each = cut.select("id", F.inline(F.array(*[F.struct(F.lit(c).alias("col"), (F.lit(None).cast("int") if i else size).alias("len"), F.col(c).alias("t")) for i, c in enumerate(COLUMNS)])))
        rows = each.select("id", "col", "len", F.posexplode_outer("t").alias("pos", "term")).withColumn("len", F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("len")))
        rows.withColumn("hit", F.coalesce(asked, F.lit(False))).where("hit OR len IS NOT NULL").write.parquet(path)
        held = spark.read.parquet(path)
        places, lengths = held.where("hit").select("term", "id", "col", "pos"), held.where("len IS NOT NULL").select("id", "len")
        r = lengths.agg(F.count("*").alias("n"), F.avg("len").alias("mean")).first()
        return cls(places, places.select("term").distinct().withColumn("stem", stem_column("term")), lengths, r.n, r.mean or 0.0)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        lengths = spark.read.parquet(f"{path}/lengths")
        r = lengths.agg(F.count("*").alias("n"), F.avg("len").alias("mean")).first()
        return cls(spark.read.parquet(f"{path}/places"), spark.read.parquet(f"{path}/words"), lengths, r.n, r.mean or 0.0)


#: Words that a query's terms may stand for before they are joined instead of being listed.
LISTED = 2_000


def _asks(column: str | Column, phrases: list[Phrase]) -> Column:
    """Whether a column holds a term that some phrase asks for."""
    column = F.col(column) if isinstance(column, str) else column
    whole = sorted({t for p in phrases for t in (p.terms[:-1] if p.prefix else p.terms)})
    begun = sorted({p.terms[-1] for p in phrases if p.prefix and p.terms})
    return functools.reduce(lambda x, y: x | y, [column.startswith(t) for t in begun], column.isin(whole) if whole else F.lit(False))


def _asked(index: Index, phrases: list[Phrase], stemmed: bool) -> DataFrame:
    """id, col, pos, term (its stem, if stemmed) of the tokens that the phrases ask for."""
    tokens, words = index.places, index.words
    if not stemmed:
        found = tokens.where(_asks("term", phrases))
    else:
        listed = words.where(_asks("stem", phrases)).select("term", "stem").limit(LISTED + 1).collect()
        if len(listed) <= LISTED:
            few = tokens.sparkSession.createDataFrame([(r.term, r.stem) for r in listed], "term string, stem string")
            found = tokens.where(F.col("term").isin([r.term for r in listed])).join(F.broadcast(few), "term")
        else:
            found = tokens.join(words.where(_asks("stem", phrases)).select("term", "stem"), "term")
        found = found.drop("term").withColumnRenamed("stem", "term")
    return found.select("id", "col", "pos", "term")


def _starts(tokens: DataFrame, phrases: list[Phrase]) -> DataFrame:
    """id, p, col, start of each place where phrase p is found."""
    checks = []
    for p, phrase in enumerate(phrases):
        for i, term in enumerate(phrase.terms):
            last = phrase.prefix and i == len(phrase.terms) - 1
            hit = (F.col("term").startswith(term) if last else F.col("term") == term) & F.col("col").isin(list(phrase.columns))
            checks.append(F.when(hit, F.struct(F.lit(p).alias("p"), F.lit(i).alias("i"))))
    if not checks:
        return tokens.limit(0).select("id", F.lit(0).alias("p"), "col", F.lit(0).alias("start"))
    met = tokens.select("id", "col", "pos", F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("x"))
    whole = met.select("id", "col", F.col("x.p").alias("p"), (F.col("pos") - F.col("x.i")).alias("start")).groupBy("id", "p", "col", "start").agg(F.count("*").alias("n"))
    lengths = F.array(*[F.lit(len(p.terms)) for p in phrases])
    firsts = F.array(*[F.lit(p.first) for p in phrases])
    return whole.where((F.col("n") == F.get(lengths, F.col("p"))) & (~F.get(firsts, F.col("p")) | (F.col("start") == 0))).select("id", "p", "col", "start")


def _nears(tree: Node, numbers: Iterator[int]) -> Iterator[tuple[Node, list[int]]]:
    """The NEAR nodes of a tree with the numbers of their phrases."""
    if tree.op == "near":
        yield tree, [next(numbers) for _ in tree.parts]
    elif tree.op == "phrase":
        next(numbers)
    else:
        for part in tree.parts:
            yield from _nears(part, numbers)


def _near_starts(starts: DataFrame, tree: Node, phrases: list[Phrase]) -> DataFrame:
    """The starts that count: under NEAR those in a group of places of all its phrases that stand close enough.

    A group ends where one of its phrases starts last; each other phrase starts no later, and at most
    `distance` tokens are between its end and that place. So a place is an end if the last start of each phrase
    up to it is close, and a place counts if the next end is: two runs over a column's places in order.
    """
    for near, own in _nears(tree, iter(range(len(phrases)))):
        asked = [p for p in own if phrases[p].terms]
        if not asked:
            continue
        column, mine = Window.partitionBy("id", "col"), F.col("p").isin(asked)
        reach = F.get(F.array(*[F.lit(len(p.terms) + near.distance) for p in phrases]), F.col("p"))
        up, down = (column.orderBy(x).rangeBetween(Window.unboundedPreceding, Window.currentRow) for x in (F.asc("start"), F.desc("start")))
        close = [F.max(F.when(F.col("p") == p, F.col("start"))).over(up) >= F.col("start") - len(phrases[p].terms) - near.distance for p in asked]
        ends = starts.withColumn("end", F.when(functools.reduce(lambda x, y: x & y, close, mine), F.col("start")))
        starts = ends.withColumn("end", F.min("end").over(down)).where(~mine | (F.col("end") <= F.col("start") + reach)).drop("end")
    return starts


def _masks(tree: Node, numbers: Iterator[int], phrases: list[Phrase], mask: Column) -> list[Column]:
    """For each phrase, whether its hits count for the rank: all nodes above that need others have them too."""
    if tree.op == "phrase":
        next(numbers)
        return [mask]
    first = next(iter(numbers_ahead := list(_count(tree, numbers))), 0)
    own = iter(range(first, first + len(numbers_ahead)))
    if tree.op != "or":
        truth = _truth(tree, iter(range(first, first + len(numbers_ahead))), phrases)
        mask = mask if truth is None else mask & truth
    if tree.op == "near":
        return [mask for _ in numbers_ahead]
    out = []
    for i, part in enumerate(tree.parts):
        out += _masks(part, own, phrases, F.lit(False) if tree.op == "not" and i else mask)
    return out


def _count(tree: Node, numbers: Iterator[int]) -> Iterator[int]:
    for _ in phrases_of(tree):
        yield next(numbers)


def _truth(tree: Node, numbers: Iterator[int], phrases: list[Phrase]) -> Column | None:
    """Whether a document's counts and starts meet `tree`; None for phrases without terms, which others ignore."""
    if tree.op == "phrase":
        p = next(numbers)
        return F.get("f", F.lit(p)) > 0 if tree.phrase.terms else None
    parts = [_truth(x, numbers, phrases) for x in tree.parts]
    if tree.op == "not":
        out = parts[0]
        for x in parts[1:]:
            out = out if x is None or out is None else out & ~x
        return out
    out = None
    for x in parts:
        out = x if out is None else out if x is None else (out | x if tree.op == "or" else out & x)
    return out


def ranked(source: DataFrame | Index, query: str, stemmed: bool = True) -> DataFrame:
    """id, rank and the phrases' places of each article that meets the query; a lower rank is better.

    source: an index, or articles, which are read once. A phrase's weight hangs on all articles that have it, its frequency on the
    places that count (under NEAR, the near ones).
    """
    tree = Parser(query, stemmed).parse()
    phrases = phrases_of(tree)
    index = source if isinstance(source, Index) else Index.scan(source, phrases, stemmed)
    n, mean = index.n, index.mean
    starts = _starts(_asked(index, phrases, stemmed), phrases)
    by_phrase = _near_starts(starts, tree, phrases).groupBy("id", "p").agg(F.collect_list(F.struct("col", "start")).alias("starts"))
    grouped = by_phrase.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("p", "starts"))).alias("m"))
    empty = F.array().cast("array<struct<col:string,start:int>>")
    at = F.array(*[F.coalesce(F.try_element_at("m", F.lit(p)), empty) for p in range(len(phrases))])
    held = grouped.select("id", at.alias("at"))
    # A row for the whole corpus: in how many articles each phrase is.
    sizes = starts.select("id", "p").distinct().groupBy("p").agg(F.count("*").alias("n"))
    sizes = {r.p: r.n for r in sizes.collect()}
    docs = held.withColumn("f", F.transform("at", F.size))
    truth = _truth(tree, iter(range(len(phrases))), phrases)
    masks = _masks(tree, iter(range(len(phrases))), phrases, F.lit(True))
    counted = F.array(*[F.when(m, F.get("f", F.lit(p))).otherwise(0) for p, m in enumerate(masks)])
    hits = docs.where(truth if truth is not None else F.lit(False)).select("id", "at", counted.alias("f"))
    joined = hits.join(index.lengths, "id")
    rank = F.lit(0.0)
    for p in range(len(phrases)):
        idf = math.log((n - sizes.get(p, 0) + 0.5) / (sizes.get(p, 0) + 0.5))
        f = F.get("f", F.lit(p)).cast("double")
        rank += F.lit(idf if idf > 0 else 1e-6) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.lit(mean or 1.0)))
    return joined.select("id", (-rank).alias("rank"), "at")


def snippet(text: str, hits: list[tuple[int, int, int]], width: int = 30) -> str:
    """The best window of `width` tokens with hits marked; hits are (start, tokens, phrase) in order."""
    spans = [m.span() for m in re.finditer(r"[^\W_]+", text)]
    n = len(spans)
    if not n:
        return text
    hits = sorted(hits)

    def worth(p: int) -> int:
        seen, total = set(), 0
        for start, _, phrase in hits:
            if p <= start < p + width:
                total += 1 if phrase in seen else 1000
                seen.add(phrase)
        return total

    def centre(p: int) -> int:
        inside = [h for h in hits if p <= h[0] < p + width]
        first, end = inside[0][0], inside[-1][0] + inside[-1][1]
        return max(0, min(first - (width - (end - first)) // 2, n - width))

    sentences = [i for i in range(n) if i == 0 or re.search(r"[.:]\s+$", text[spans[i - 1][1] : spans[i][0]])]
    best, at = -1, 0
    for o, _, _ in hits:
        options = [(worth(o), centre(o))]
        before = [s for s in sentences if s <= o]
        if n > width and before and before[-1] < o:
            options.append((worth(before[-1]) + (120 if before[-1] == 0 else 100), before[-1]))
        for value, start in options:
            if value > best:
                best, at = value, start
    end = min(at + width, n)
    left, right = (spans[at][0] if at else 0), (spans[end - 1][1] if end < n else len(text))
    marked: list[list[int]] = []
    for start, size, _ in hits:
        if start >= at and start + size <= end:
            if marked and start < marked[-1][1]:
                marked[-1][1] = max(marked[-1][1], start + size)
            else:
                marked.append([start, start + size])
    out, last = ["..." if at else ""], left
    for a, b in marked:
        out += [text[last : spans[a][0]], ">>>", text[spans[a][0] : spans[b - 1][1]], "<<<"]
        last = spans[b - 1][1]
    return "".join([*out, text[last:right], "..." if end < n else ""])


def search(articles: DataFrame, query: str, limit: int = 10, stemmed: bool = True, index: Index | None = None) -> DataFrame:
    """The best `limit` articles: id, title, url, folder, word_count, snippet, rank. A null content has an empty snippet."""
    sizes = [len(p.terms) for p in phrases_of(Parser(query, stemmed).parse())]
    top = ranked(index or articles, query, stemmed).orderBy("rank", "id").limit(limit)
    found = F.broadcast(top).join(articles.select("id", "title", "url", "folder", "word_count", "content"), "id")  # at most `limit` rows

    @F.pandas_udf(T.StringType())
    def cut(content: pd.Series, at: pd.Series) -> pd.Series:
        def one(text, places):
            hits = [(x["start"], sizes[p], p) for p, xs in enumerate(json.loads(places)) for x in xs if x["col"] == "content"]
            return snippet(text, hits) if text else ""
        return pd.Series([one(t, a) for t, a in zip(content, at)])

    return found.select("id", "title", "url", "folder", "word_count", cut("content", F.to_json("at")).alias("snippet"), F.round("rank", 6).alias("rank")).orderBy("rank", "id")


def highlighted(snippet_column: Column) -> Column:
    """Hits in bold red on a terminal."""
    return F.replace(F.replace(snippet_column, F.lit(">>>"), F.lit("\x1b[1;31m")), F.lit("<<<"), F.lit("\x1b[0m"))


def plain(snippet_column: Column) -> Column:
    return F.replace(F.replace(snippet_column, F.lit(">>>"), F.lit("")), F.lit("<<<"), F.lit(""))
