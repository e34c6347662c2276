"""Language identification by words first, then shorter and shorter character n-grams.

A known word adds its log frequency in each language. An unseen word is scored by its n-grams of the
greatest length of which the model knows any, from five characters down to one, averaged. The model is
fitted on a bounded sample of labelled texts, of which it keeps every word and n-gram, and goes to the
workers whole; every text is scored.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm.common import Memo, bucket, cut, keyed, spread, table, texts_of, worker_memo

#: The sample's bounds: labelled texts over all languages (each has an equal share, by hash of the row; the share is
#: at least SHARE texts) and the bytes of a text that may be in it. The longest n-gram.
SAMPLE_TEXTS, SHARE, SAMPLE_BYTES, LONGEST = 8000, 50, 1 << 20, 5
#: Unseen words that a worker remembers.
MEMO = 200_000
#: Runs of word characters but digits and the underscore: letters (category L), and numerals that are no digits.
LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    words = LETTERS.findall(text.lower()) if text else []
    if not all(map(str.isalpha, words)):
        words = [x for w in words for x in "".join(c if c.isalpha() else " " for c in w).split()]
    return words


def grams_of(word: str, n: int) -> list[str]:
    framed = f"^{word}$"
    return [framed[i : i + n] for i in range(len(framed) - n + 1)] if n > 1 else list(word)


def count_grams(words: Iterable[tuple[str, int]]) -> Counter:
    """Counts of all n-grams of words and their counts."""
    got: Counter = Counter()
    for word, c in words:
        for n in range(1, LONGEST + 1):
            for g in grams_of(word, n):
                got[g] += c
    return got


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    words: dict[str, int]
    word_logs: np.ndarray
    grams: dict[str, int]
    gram_logs: np.ndarray

    @classmethod
    def of_counts(cls, counts: dict[str, Counter], gram_counts: dict[str, Counter] | None = None) -> LanguageModel:
        """From the word counts of each language, and the n-gram counts if they are at hand."""
        languages = tuple(sorted(counts))
        if gram_counts is None:
            gram_counts = {lang: count_grams(counts[lang].items()) for lang in languages}
        words, grams = sorted(set().union(*counts.values())), sorted(set().union(*gram_counts.values()))
        lengths = np.fromiter(map(len, grams), np.int64, len(grams))
        word_logs, gram_logs = np.zeros((len(words), len(languages))), np.zeros((len(grams), len(languages)))
        for i, lang in enumerate(languages):
            of_word = np.fromiter(map(counts[lang].__getitem__, words), float, len(words))
            of_gram = np.fromiter(map(gram_counts[lang].__getitem__, grams), float, len(grams))
            word_logs[:, i] = np.log((of_word + 0.1) / (of_word.sum() + 0.1 * len(words)))
            gram_logs[:, i] = np.log((of_gram + 0.1) / (np.bincount(lengths, of_gram, LONGEST + 1) + 1)[lengths])
        return cls(languages, {w: i for i, w in enumerate(words)}, word_logs, {g: i for i, g in enumerate(grams)}, gram_logs)

    def unseen(self, word: str) -> np.ndarray:
        for n in range(min(LONGEST, len(word) + 2), 0, -1):
            found = [i for g in grams_of(word, n) if (i := self.grams.get(g)) is not None]
            if found:
                return self.gram_logs[found].mean(axis=0)
        return np.zeros(len(self.languages))

    def predict(self, text: str | None, memo: Memo) -> tuple[str, float]:
        """The most likely language and its probability; `und` and 0 without a letter. Ties go to the first name."""
        words = words_of(text)
        if not words or not self.languages:
            return UNKNOWN, 0.0
        index = np.fromiter(map(self.words.get, words, [-1] * len(words)), np.int64, len(words))
        known = index[index >= 0]
        total = self.word_logs[known].sum(axis=0)
        if len(known) < len(words):
            for i in np.flatnonzero(index < 0).tolist():
                total = total + memo[words[i]]
        odds = np.exp(total - total.max())
        best = int(odds.argmax())
        return self.languages[best], float(odds[best] / odds.sum())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of texts by language."""
    for b in batches:
        got: dict[str, Counter] = {}
        for t, l in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            got.setdefault(l, Counter()).update(words_of(t))
        yield _counts([(l, w, c) for l, x in got.items() for w, c in x.items()])


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-grams of counted words by language."""
    for b in batches:
        got: dict[str, list] = {}
        for l, w, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
            got.setdefault(l, []).append((w, c))
        yield _counts([(l, g, c) for l, words in got.items() for g, c in count_grams(words).items()])


def _counts(flat: list[tuple[str, str, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*flat) if flat else ([], [], []), (pa.string(), pa.string(), pa.int64()), strict=True)], names=["l", "w", "c"])


def _by_language(counted: DataFrame) -> dict[str, Counter]:
    got: dict[str, Counter] = {}
    held = counted.toArrow()
    for l, w, c in zip(*(held.column(x).to_pylist() for x in ("l", "w", "c")), strict=True):
        got.setdefault(l, Counter())[w] = c
    return got


def train(docs: DataFrame, learn: Column, text_column: str = "text", lang_column: str = "lang", sample_texts: int = SAMPLE_TEXTS) -> LanguageModel:
    """Fits the model on rows where `learn` holds and language and text are not null.

    The sample has about `sample_texts` texts at most, of up to SAMPLE_BYTES bytes, an equal share for each
    language, chosen by hash of the row, so that copies of a text are in it or not like other rows. Names
    of languages are as they are written; their number is taken to be small (one row each is collected).
    """
    kept = learn & F.col(lang_column).isNotNull() & (F.octet_length(text_column) <= SAMPLE_BYTES)
    rows = keyed(docs, F.when(kept, F.col(lang_column).cast("string")).alias("l"), F.when(kept, F.col(text_column)).alias("t")).where("l IS NOT NULL")
    sizes = cut(rows.groupBy("l").agg(F.count("*").alias("n")), "languages")
    languages = [r.l for r in sizes.collect()]
    if not languages:
        return LanguageModel.of_counts({})
    share = max(SHARE, sample_texts // len(languages))
    every = sizes.select("l", F.greatest(F.lit(1), F.floor(F.col("n") / share)).alias("every"))
    sample = rows.join(F.broadcast(every), "l").where(F.pmod(F.xxhash64("_f", "_r"), F.col("every")) == 0)
    counted = cut(spread(sample.select("t", "l"), docs).mapInArrow(_count, "l string, w string, c long").groupBy("l", "w").agg(F.sum("c").alias("c")), "language-words")
    grams = counted.mapInArrow(_count_grams, "l string, w string, c long").groupBy("l", "w").agg(F.sum("c").alias("c"))
    words = {l: Counter() for l in languages} | _by_language(counted)
    return LanguageModel.of_counts(words, {l: Counter() for l in languages} | _by_language(grams))


def identify(docs: DataFrame, model: LanguageModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of `docs`: _f, _r (row key), doc_id, lang_pred, score.

    Null texts and texts without a letter are `und` with score 0, as is every text if the model has learned
    no language. Repeated rows are scored alike; other columns are not read; an empty table gives no rows.
    """
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = worker_memo(key, lambda: Memo(shared.value.unseen, MEMO))
        for b in batches:
            found = [shared.value.predict(t, memo) for t in texts_of(b.column(3))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())],
                names=["_f", "_r", "doc_id", "lang_pred", "score"],
            )

    base = keyed(docs, F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return spread(base, docs).mapInArrow(run, "_f long, _r long, doc_id long, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs, bucket("doc_id", 5) != 0)
    held_out = F.coalesce(bucket("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return identify(docs, model).select("doc_id", held_out, "lang_pred", "score")
