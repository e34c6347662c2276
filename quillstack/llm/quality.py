"""Quality classifier with supervised subword embeddings.

A word stands for itself and its character n-grams, and two words in a row for their bigram, each hashed
to a row of vectors. A text is the mean of its features' vectors, and a softmax layer gives the class.
Vectors and layer are trained together by stochastic gradient descent in numpy, on a bounded sample of
labelled texts. With two classes the log odds are linear in the mean, so a word adds one number, which
scoring remembers, and a bigram another.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm.common import Memo, bucket, cut, if_small, keyed, small_batches, spread, table, texts_of, worker_memo

#: The bounds of training: labelled texts (half for each class, by hash of the row), and the bytes of a text that may be one.
SAMPLE_TEXTS, SAMPLE_BYTES = 4000, 1 << 18
#: Rows of words and n-grams, and after them those of bigrams; lengths of n-grams.
ROWS, PAIR_ROWS, WIDTH, SHORTEST, LONGEST, EPOCHS, RATE, SEED = 1 << 16, 1 << 18, 8, 3, 4, 6, 0.4, 13
#: Words that a worker remembers, and training.
MEMO, FIT_MEMO = 150_000, 15_000
THRESHOLD = 0.7
MIX = np.uint32(0x9E3779B1)


def features(word: str, rows: int = ROWS) -> list[int]:
    """Hashed rows of a word and its n-grams; words of more than 64 characters have n-grams of all their length."""
    framed = f"<{word}>"
    digest = xxhash.xxh32_intdigest
    grams = [framed[i : i + n] for n in range(SHORTEST, LONGEST + 1) for i in range(len(framed) - n + 1)]
    return [digest(g) % rows for g in grams] + [digest(framed, 1) % rows]


def word_hash(word: str) -> int:
    return xxhash.xxh32_intdigest(word, 2)


def pair_rows(hashes: np.ndarray) -> np.ndarray:
    """Rows of the bigrams of words with these 32-bit hashes, counted from the first bigram row."""
    mixed = (hashes[:-1] * MIX) ^ hashes[1:]
    mixed = (mixed ^ (mixed >> np.uint32(15))) * MIX
    return (mixed ^ (mixed >> np.uint32(13))) % np.uint32(PAIR_ROWS)


@dataclass(frozen=True)
class QualityModel:
    """Log odds of each feature row (the vectors on the layer's difference) and the bias."""

    odds: np.ndarray
    bias: float

    def word(self, word: str) -> tuple[float, int, int]:
        """Summed log odds and number of a word's own features, and its hash."""
        rows = features(word)
        return float(self.odds[rows].sum()), len(rows), word_hash(word)

    def scores(self, texts: Iterable[str | None], memo: Memo) -> np.ndarray:
        """Probabilities of class 1; that of the bias alone without words. Each word of a batch is looked up once."""
        places: dict[str, int] = {}
        coded = []
        for text in texts:
            words = (text or "").split()
            coded.append(np.fromiter((places.setdefault(w, len(places)) for w in words), np.int64, len(words)))
        known = list(map(memo.__getitem__, places))
        odds, counts = (np.array([x[i] for x in known], float) for i in (0, 1))
        hashes = np.array([x[2] for x in known], np.uint32)
        means = np.zeros(len(coded))
        for i, at in enumerate(coded):
            if len(at):
                pairs = self.odds[ROWS + pair_rows(hashes[at]).astype(np.int64)]
                means[i] = (odds[at].sum() + pairs.sum()) / (counts[at].sum() + len(pairs))
        return 1 / (1 + np.exp(-np.clip(self.bias + means, -60, 60)))


def fit(texts: list[str], labels: list[int], width: int = WIDTH, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> QualityModel:
    """Trains on texts with labels 0 and 1, all features of each. Without labels all scores are one half; with one class, near it."""
    if not texts:
        return QualityModel(np.zeros(ROWS + PAIR_ROWS), 0.0)
    rng = np.random.default_rng(seed)
    vectors = (rng.random((ROWS + PAIR_ROWS, width)) - 0.5) / width
    layer, bias = np.zeros((2, width)), np.zeros(2)
    coded, known = [], Memo(lambda word: (np.array(features(word), np.int32).tobytes(), word_hash(word)), FIT_MEMO)
    for text in texts:
        words = list(map(known.__getitem__, text.split()))
        own = np.frombuffer(b"".join(rows for rows, _ in words), np.int32)
        pairs = ROWS + pair_rows(np.array([h for _, h in words], np.uint32)).astype(np.int32)
        rows, counts = np.unique(np.concatenate([own, pairs]), return_counts=True)
        # In narrow types, as all texts' features are held at once.
        coded.append((rows, counts.astype(np.min_scalar_type(int(counts.max(initial=0)))), int(counts.sum())))
    del known
    steps, total = 0, epochs * len(texts)
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            rows, counts, n = coded[i]
            share, push = counts / max(1, n), min(n, 50)
            step = rate * (1 - steps / total)
            steps += 1
            mean = share @ vectors[rows]
            z = layer @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = layer.T @ p
            layer -= step * np.outer(p, mean)
            bias -= step * p * 0.1
            vectors[rows] -= np.outer(share, step * push * back)
    return QualityModel(vectors @ (layer[1] - layer[0]), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", sample_texts: int = SAMPLE_TEXTS) -> QualityModel:
    """From a sample of the labelled rows whose crc32 of the id modulo 4 is not 2; null labels and ids are passed over.

    The sample has `sample_texts` texts at most, of up to SAMPLE_BYTES bytes, about half of each class,
    those with the least hashes of row and label. An id with two labels gives both, repeated rows count each.
    """
    known = labels.select(F.col(id_column).cast("long").alias("i"), F.col(label_column).cast("int").alias("y")).where("y IN (0, 1)").where(bucket("i", 4) != 2)
    base = keyed(docs, F.col(id_column).cast("long").alias("i"), F.coalesce(F.col(text_column), F.lit("")).alias("t"))
    rows = cut(base.where(F.octet_length("t") <= SAMPLE_BYTES).select("_f", "_r", "i").join(if_small(cut(known, "quality-labels")), "i").select("_f", "_r", "y", F.xxhash64("_f", "_r", "y").alias("h")), "quality-rows")
    chosen = [rows.where(F.col("y") == y).orderBy("h", "_f", "_r").limit(sample_texts // 2) for y in (0, 1)]
    keys = F.broadcast(cut(chosen[0].unionAll(chosen[1]), "quality-sample"))  # sample_texts narrow rows at most
    got = base.join(keys, ["_f", "_r"]).select("h", "y", "t").toArrow().sort_by([("h", "ascending"), ("y", "ascending"), ("t", "ascending")])
    return fit(got.column("t").to_pylist(), got.column("y").to_pylist())


def score(docs: DataFrame, model: QualityModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of `docs`: _f, _r (row key), doc_id, score, predicted.

    Null and empty texts get the score of the bias. Repeated rows are scored alike; other columns are not
    read; an empty table gives no rows.
    """
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = worker_memo(key, lambda: Memo(shared.value.word, MEMO))
        for b in batches:
            found = shared.value.scores(texts_of(b.column(3)), memo)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))],
                names=["_f", "_r", "doc_id", "score", "predicted"],
            )

    base = keyed(docs, F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return spread(base, docs).mapInArrow(run, "_f long, _r long, doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: QualityModel, text_column: str = "text") -> DataFrame:
    """The rows of `docs` that are predicted to be of class 1, with all their columns.

    A null or empty text has the score of the bias, repeated rows are kept or dropped alike, null ids and
    other columns go through as they are.
    """
    small_batches(docs.sparkSession)
    shared, key, at = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex, docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = worker_memo(key, lambda: Memo(shared.value.word, MEMO))
        for b in batches:
            yield b.filter(pa.array(shared.value.scores(texts_of(b.column(at)), memo) >= THRESHOLD))

    return spread(docs, docs).mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return score(docs, model).select("doc_id", held_out, "score", "predicted")
