"""Language-model scoring with a hierarchical Pitman-Yor model.

Every word that comes before another is a context with a restaurant of its own, which holds the words that
follow it; so contexts grow with the input. All contexts share a parent restaurant, whose base is uniform
over the vocabulary and one unseen word. A word's tables in the contexts are its customers in the parent.
Seatings are sampled by Gibbs: in a sweep, all customers of a word in a context leave and sit down again
given all others (`seating`), then those of the parent do. The one approximation is that the totals of other
words, and the parent's probabilities, are those of the last sweep. Predictive probabilities are averaged over
the sweeps kept, and give the score.

Counts cover all training text. Words are numbers: the most frequent ones their rank, the others a 64-bit
hash. A pair that was met once has one table always; only the others are sampled.

Texts are cut into words once: blocks of them are files in the shared folder, with numbers for words. What blocks
send to each other goes as arrays by shards of a hash, a row for each block and shard, and not as a row for each pair:
counts of pairs in training; in scoring each distinct pair and rare word of a block, once, and what the model has of it.
"""

from __future__ import annotations

import gc
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm.common import batches_of, bucket, cut, drop_memos, forget, keyed, ladder, new_path, release, spread, table, texts_of, written
from quillstack.llm.seating import Seater

DISCOUNT, STRENGTH, BURN_IN, KEPT, SEED = 0.75, 1.0, 2, 2, 29
#: Words that have numbers of their own, of which all workers hold what the model has.
FREQUENT = 400_000
#: Tokens of a block, and of a shard, about; pairs seated together; rows of the model that a task holds before it deals them.
BLOCK_TOKENS, SHARD_TOKENS, SWEEP_ROWS, DEALT_ROWS = 2_500_000, 4_000_000, 200_000, 1_000_000
#: Parts of all blocks that are scored one after another, so that the shuffles of one are deleted before the next.
SLICES = 3
END = b"\n"
#: The number of the context at the start of a text. Words have numbers from 1, or negative ones.
START = 0
RARE = -(1 << 63)
DEALT = "shard int, kind int, block int, a binary, b binary, c binary"


def tokens(text: bytes | None) -> list[bytes]:
    """The words of a text and the end."""
    return [*(text or b"").lower().split(), END]


def number(word: bytes) -> int:
    """The number of a word that is not frequent."""
    return xxhash.xxh64_intdigest(word, SEED) % (1 << 63) + RARE


def digest(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A hash of pairs of numbers. It deals and sorts them, and does not decide whether two are equal."""
    x = u.astype(np.int64, copy=False).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x += w.astype(np.int64, copy=False).view(np.uint64)
    for _ in range(2):
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


def _halves(x: np.ndarray) -> bytes:
    """Integers as their low halves and then their high ones, which are mostly alike and pack well."""
    return np.ascontiguousarray(x, np.int64).view(np.int32).reshape(-1, 2).T.tobytes()


def _packed(codes: np.ndarray) -> np.ndarray:
    """The low halves of 32-bit codes, and then the high ones."""
    return codes.view(np.uint16).reshape(-1, 2).T.ravel()


def _whole(*sent: bytes) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(x, np.int32).reshape(2, -1).T.copy().view(np.int64).ravel() for x in sent]])


@dataclass(frozen=True)
class Coded:
    """Texts as blocks of numbers: files in a folder that all executors share.

    A block has words and their hashes; codes: the place of each token among the words; for each text its row key,
    doc_id, its tokens, and whether training takes it.
    """

    folder: str
    names: tuple[str, ...]
    tokens: int

    def each(self, spark: SparkSession, run: Callable[[int, dict[str, pa.Array]], Iterator[pa.RecordBatch]], schema: str, first: int = 0, step: int = 1) -> DataFrame:
        """What `run` makes of each block, or of those from the first by steps; a task for each."""
        names, folder = spark.sparkContext.broadcast(self.names), self.folder

        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            drop_memos()
            for b in batches:
                for i in b.column(0).to_pylist():
                    yield from run(i, read_block(folder, names.value[i]))

        return spark.range(first, max(first, len(self.names)), step, max(1, len(range(first, len(self.names), step)))).mapInArrow(over, schema)

    def shards(self) -> int:
        return self.tokens // SHARD_TOKENS + 1


def read_block(folder: str, name: str) -> dict[str, pa.Array]:
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{root}/{name}") as f, pa.ipc.open_file(f) as held:
        row = held.get_batch(0)
        got = {name: row.column(i).flatten() for i, name in enumerate(row.schema.names)}
        got["codes"] = pa.array(got["codes"].to_numpy().reshape(2, -1).T.copy().view(np.int32).ravel())
        return got


def code(docs: DataFrame, doc_id: Column, text: Column, learn: Column) -> Coded:
    """The texts of `docs`. Rows have keys that stay the same when they are read again."""
    spark, folder = docs.sparkSession, new_path(docs.sparkSession, "lm-blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        drop_memos()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        place: defaultdict[bytes, int] = defaultdict(count().__next__)
        codes: list[np.ndarray] = []
        keys: list[list] = [[], [], [], []]

        def out(many: int) -> pa.RecordBatch:
            words = list(place)
            held = {
                "words": pa.array(words, pa.binary()), "hashes": pa.array(np.fromiter(map(number, words), np.int64, len(words))), "codes": pa.array(_packed(np.concatenate(codes))),
                "lengths": pa.array([len(x) for x in codes], pa.int64()), **{n: pa.array(x, k) for n, x, k in zip(("f", "r", "doc_id", "learn"), keys, (*[pa.int64()] * 3, pa.bool_()))},
            }
            row = pa.RecordBatch.from_arrays([pa.LargeListArray.from_arrays(pa.array([0, len(x)], pa.int64()), x) for x in held.values()], names=list(held))
            name = f"{uuid.uuid4().hex}.arrow"
            with store.open_output_stream(f"{root}/{name}") as f, pa.ipc.new_file(f, row.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as file:
                file.write_batch(row)
            place.clear()
            place.default_factory = count().__next__
            codes.clear()
            for x in keys:
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([many], pa.int64())], names=["name", "tokens"])

        many = 0
        for b in batches:
            for *key, text_ in zip(*(b.column(i).to_pylist() for i in range(4)), texts_of(b.column(4).cast(pa.binary())), strict=True):
                words = tokens(text_)
                codes.append(np.fromiter(map(place.__getitem__, words), np.int32, len(words)))
                for x, value in zip(keys, key):
                    x.append(value)
                many += len(words)
                if many >= BLOCK_TOKENS:
                    yield out(many)
                    many = 0
        if codes:
            yield out(many)

    base = keyed(docs, doc_id.cast("long").alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"), text.cast("string").alias("text"))
    found = sorted((r.name, r.tokens) for r in spread(base, docs).mapInArrow(run, "name string, tokens long").collect())
    return Coded(folder, tuple(x for x, _ in found), sum(n for _, n in found))


def _parts(shards: np.ndarray, size: int) -> Iterator[tuple[int, slice]]:
    """Each shard that sorted `shards` have, and where."""
    at = np.searchsorted(shards, np.arange(size + 1))
    for i in np.flatnonzero(at[1:] > at[:-1]).tolist():
        yield i, slice(int(at[i]), int(at[i + 1]))


def _shard(h: np.ndarray, size: int) -> np.ndarray:
    """The shard of hashes, which rises with them."""
    return ((h >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["shard", "kind", "block", "a", "b", "c"])


def _starts(moved: np.ndarray, size: int) -> np.ndarray:
    """Where runs of equal values begin among `size` sorted ones; moved: whether each but the first differs from the one before."""
    return np.concatenate(([0], np.flatnonzero(moved) + 1)) if size else np.zeros(0, np.int64)


def _summed(u: np.ndarray, w: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs and the sums of their counts."""
    h = digest(u, w)
    order = np.argsort(h)
    h, x, y = h[order], u[order], w[order]
    moved = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    if (moved & (h[1:] == h[:-1])).any():  # pairs of the same hash may lie mixed
        order = np.lexsort((w, u))
        x, y = u[order], w[order]
        moved = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    at = _starts(moved, len(x))
    x, y, c = x[at], y[at], np.add.reduceat(c[order], at) if len(at) else c
    order = np.argsort(x)  # they pack better so
    return x[order], y[order], c[order]


@dataclass(frozen=True)
class Numbers:
    """Numbers of the frequent words by their hashes, which are sorted."""

    hashes: np.ndarray
    numbers: np.ndarray

    @classmethod
    def of(cls, places: dict[bytes, int]) -> Numbers:
        hashes, numbers = (np.fromiter(x, np.int64, len(places)) for x in (map(number, places), places.values()))
        order = np.argsort(hashes)
        return cls(hashes[order], numbers[order])

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers of words by their hashes, and at the end that of the start of a text."""
        out = np.append(hashes, START)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            met = np.flatnonzero(self.hashes[at] == hashes)
            out[met] = self.numbers[at[met]]
        return out


def _before(codes: np.ndarray, lengths: np.ndarray, start: int) -> np.ndarray:
    """The code before each token; `start` for the first ones of texts."""
    out = np.concatenate(([start], codes[:-1]))
    out[(np.cumsum(lengths) - lengths)] = start
    return out


def _vocabulary(coded: Coded, spark: SparkSession) -> DataFrame:
    """w, c: the words of training texts."""
    shards = coded.shards()

    def deal(i: int, block: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
        lengths, learn = block["lengths"].to_numpy(), block["learn"].to_numpy(zero_copy_only=False)
        counts = np.bincount(block["codes"].to_numpy()[np.repeat(learn, lengths)], minlength=len(block["words"]))
        hashes = block["hashes"].to_numpy()
        h = digest(hashes, np.zeros(len(hashes), np.int64))
        order = np.argsort(h)
        order = order[counts[order] > 0]
        for shard, at in _parts(_shard(h[order], shards), shards):
            words = block["words"].take(pa.array(order[at]))
            ends = np.diff(np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1])
            yield _sent([(shard, 0, i, b"".join(words.to_pylist()), ends.astype(np.int64).tobytes(), counts[order[at]].tobytes())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for b in batches:
            for spelled, lengths, counts in zip(*(b.column(i).to_pylist() for i in (3, 4, 5))):
                offsets = np.concatenate(([0], np.cumsum(np.frombuffer(lengths, np.int64)))).astype(np.int32)
                words = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(spelled)])
                found.append(pa.table({"w": words, "c": np.frombuffer(counts, np.int64)}))
        if found:
            got = pa.concat_tables(found).group_by("w").aggregate([("c", "sum")]).combine_chunks()
            yield from pa.table({"w": got.column("w"), "c": got.column("c_sum")}).to_batches(SWEEP_ROWS)

    return coded.each(spark, deal, DEALT).repartitionById(shards, "shard").mapInArrow(add, "w binary, c long")


def _pairs(coded: Coded, numbers: Broadcast, spark: SparkSession) -> DataFrame:
    """u, w, c: words of training texts, the words before them and how often."""
    shards = coded.shards()

    def deal(i: int, block: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
        lengths, codes, n = block["lengths"].to_numpy(), block["codes"].to_numpy(), len(block["words"]) + 1
        own = numbers.value(block["hashes"].to_numpy())
        learn = np.repeat(block["learn"].to_numpy(zero_copy_only=False), lengths)
        keys = (_before(codes, lengths, n - 1).astype(np.int64) * n + codes)[learn]
        keys.sort()
        at = _starts(keys[1:] != keys[:-1], len(keys))
        c = np.diff(np.append(at, len(keys)))
        u, w = np.divmod(keys[at], n)
        u, w = own[u], own[w]
        h = digest(u, w)
        order = np.argsort(h)
        u, w, c = u[order], w[order], c[order]
        for shard, x in _parts(_shard(h[order], shards), shards):
            yield _sent([(shard, 0, i, _halves(u[x]), _halves(w[x]), _halves(c[x]))])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: list[list[bytes]] = [[], [], []]
        for b in batches:
            for x, i in zip(sent, (3, 4, 5)):
                x.extend(b.column(i).to_pylist())
        found = _summed(*[_whole(*sent.pop(0)) for _ in range(3)])
        for i in range(0, len(found[0]), SWEEP_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + SWEEP_ROWS]) for x in found], names=["u", "w", "c"])

    return coded.each(spark, deal, DEALT).repartitionById(shards, "shard").mapInArrow(add, "u long, w long, c long")


def root_share(customers: np.ndarray, tables: np.ndarray, root_customers: float, root_tables: float, words: int) -> np.ndarray:
    """The parent's probability of words with so many customers and tables there."""
    base = (STRENGTH + DISCOUNT * root_tables) / (words + 1)
    return (np.maximum(customers - DISCOUNT * tables, 0) + base) / (STRENGTH + root_customers)


@dataclass(frozen=True)
class Root:
    """Customers and tables of the parent restaurant, and the vocabulary's size."""

    customers: int
    tables: int
    words: int

    def share(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return root_share(customers, tables, self.customers, self.tables, self.words)

    def share_sql(self) -> str:
        """The same in SQL, of columns n and r."""
        base = (STRENGTH + DISCOUNT * self.tables) / (self.words + 1)
        return f"(greatest(n - {DISCOUNT}D * r, 0D) + {base!r}D) / {STRENGTH + self.customers!r}D"

    def unseen(self) -> float:
        return float(self.share(np.zeros(1), np.zeros(1))[0])


def _generator(b: pa.RecordBatch, sweep: int) -> np.random.Generator:
    """Random numbers that are the same when a task is run again over the same rows."""
    first = [int(b.column(i)[0].as_py() or 0) % (1 << 63) for i in (0, 1)]
    return np.random.default_rng([SEED, sweep, b.num_rows, *first])


@dataclass(frozen=True)
class Numbered:
    """What the workers hold in a sweep: by number the tables of the context, and the word's customers and tables in the parent."""

    tables: np.ndarray
    customers: np.ndarray
    roots: np.ndarray

    @classmethod
    def of(cls, contexts: DataFrame, words: DataFrame, size: int) -> Numbered:
        """Of written tables, whose numbers are below `size`."""
        found = cls(*(np.zeros(size, np.int64) for _ in range(3)))
        for df, key, columns in ((contexts, "u", {"tables": found.tables}), (words, "w", {"n": found.customers, "r": found.roots})):
            got = df.where(F.col(key) >= 0).select(key, *columns).toArrow()
            for name, values in columns.items():
                values[got.column(key).to_numpy()] = got.column(name).to_numpy()
        return found


def _looked_up(rows: DataFrame, contexts: DataFrame, words: DataFrame) -> DataFrame:
    """`rows` (u, w and more) with the columns of their rare contexts and words; those of numbered ones are null, as the workers hold them (`Numbered`).

    Nothing is broadcast: hash tables of numbered ones, built anew by the driver for every sweep, took its memory.
    The others shuffle: none of them is hot, or it would have a number. Each part of `rows` is read apart.
    """
    parts = []
    for first in ("u >= 0", "u < 0"):
        for second in ("w >= 0", "w < 0"):
            part = rows.where(f"{first} AND {second}")
            for side, key, kind in ((contexts, "u", first), (words, "w", second)):
                rare = "<" in kind
                part = part.join(side.where(f"{key} < 0"), key) if rare else part.select("*", *[F.lit(None).cast("long").alias(x) for x in side.columns if x != key])
            parts.append(part)
    return reduce(DataFrame.unionByName, parts)


def _reseat(pairs: DataFrame, contexts: DataFrame, words: DataFrame, numbered: Broadcast, root: Root, sweep: int) -> DataFrame:
    """`pairs` (u, w, c, t, ts) with new tables, and the change of each."""
    there = _looked_up(pairs, contexts.select("u", F.col("tables").alias("there")), words.select("w", "n", "r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seater = Seater(STRENGTH, DISCOUNT)
        held: Numbered = numbered.value
        for b in batches:
            if b.num_rows:
                u, w, c, t = (b.column(x).to_numpy(zero_copy_only=False) for x in range(4))
                tables, n, r = (
                    np.where(key >= 0, own[np.maximum(key, 0)], b.column(x).fill_null(0).to_numpy(zero_copy_only=False))
                    for key, own, x in ((u, held.tables, 5), (w, held.customers, 6), (w, held.roots, 7))
                )
                left = n - t  # the word's customers in the parent, without those from here
                share = root.share(left, np.minimum(r, left))
                new = seater.draw(c, t, tables - t, share, _generator(b, sweep))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(new), b.column(4), pa.array(new - t)], names=["u", "w", "c", "t", "ts", "change"])

    return there.select("u", "w", "c", "t", "ts", "there", "n", "r").mapInArrow(run, "u long, w long, c long, t long, ts array<int>, change long")


def _reseat_root(words: DataFrame, root: Root, sweep: int) -> DataFrame:
    """`words` (w, n, r, ps, count) with new tables in the parent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seater = Seater(STRENGTH, DISCOUNT)
        for b in batches:
            if b.num_rows:
                n, r = (b.column(x).to_numpy(zero_copy_only=False) for x in (1, 2))
                r = np.minimum(r, n)
                new = seater.draw(n, r, root.tables - r, np.full(len(n), 1 / (root.words + 1)), _generator(b, sweep))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(new), b.column(3), b.column(4)], names=["w", "n", "r", "ps", "count"])

    return words.select("w", "n", "r", "ps", "count").mapInArrow(run, "w long, n long, r long, ps array<double>, count long")


def _changed(side: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """`side` with `column` moved by the sums of `changes`."""
    moved = changes.groupBy(key).agg(F.sum("change").alias("change"))
    return side.join(moved, key, "left").withColumn(column, F.col(column) + F.coalesce("change", F.lit(0))).drop("change")


@dataclass(frozen=True)
class LanguageModel:
    """All are written tables: words (w, count, ps), contexts (u, size, backs), pairs (u, w, c, own).

    ps: the parent's probability of the word by sweep kept; backs: what the context gives to the parent; own:
    the pair's customers less the discount of its tables, averaged. places: the frequent words' numbers.
    """

    places: dict[bytes, int]
    words: DataFrame
    contexts: DataFrame
    pairs: DataFrame
    unseen: tuple[float, ...]
    train_tokens: int
    vocabulary: int


def train(texts: DataFrame, burn_in: int = BURN_IN, kept: int = KEPT, frequent: int = FREQUENT) -> LanguageModel:
    """Learns from all of `texts` (text). An empty table gives a model that has met no word."""
    coded = code(texts, F.lit(None), F.col("text"), F.lit(True))
    model = learned(texts.sparkSession, coded, burn_in, kept, frequent)
    forget(texts.sparkSession, coded.folder)
    return model


def learned(spark: SparkSession, coded: Coded, burn_in: int = BURN_IN, kept: int = KEPT, frequent: int = FREQUENT) -> LanguageModel:
    """The model of the training texts among those coded."""
    vocabulary, vocabulary_path = written(_vocabulary(coded, spark), "lm-vocabulary")
    n_words, n_tokens = vocabulary.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    top = vocabulary.where(F.col("c") >= ladder(vocabulary, "c", frequent)).orderBy(F.desc("c"), "w").select("w").toArrow()
    places = {w: i for i, w in enumerate(top.column("w").to_pylist(), 1)}
    shared = spark.sparkContext.broadcast(Numbers.of(places))
    forget(spark, vocabulary_path)
    release(spark)
    counted, counted_path = written(_pairs(coded, shared, spark), "lm-pairs")
    shared.destroy()
    release(spark)
    # Contexts whose pairs were all met once, and words with a single customer in the parent, stay as they are.
    several = F.count_if(F.col("c") > 1).alias("several")
    every_context = cut(counted.groupBy("u").agg(F.sum("c").alias("size"), F.count("*").alias("tables"), several), "lm-every-context")
    every_word = cut(counted.groupBy("w").agg(F.sum("c").alias("count"), F.count("*").alias("n"), several), "lm-every-word")
    release(spark)
    still_contexts, still_words = every_context.where("several = 0"), every_word.where("several = 0 AND n = 1")
    contexts, contexts_path = written(every_context.where("several > 0").select("u", "size", "tables", F.array().cast("array<double>").alias("backs")), "lm-contexts")
    words, words_path = written(every_word.where("several > 0 OR n > 1").selectExpr("w", "n", "1L AS r", "cast(array() AS array<double>) AS ps", "count"), "lm-words")
    pairs, pairs_path = written(counted.where("c > 1").selectExpr("u", "w", "c", "1L AS t", "cast(array() AS array<int>) AS ts", "0L AS change"), "lm-state")
    still, roots = still_words.count(), []

    def root() -> Root:
        n, r = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("r"), F.lit(0))).first()
        return Root(n + still, r + still, n_words)

    for sweep in range(burn_in + kept):
        now = root()
        with batches_of(spark, SWEEP_ROWS):
            numbered = spark.sparkContext.broadcast(Numbered.of(contexts, words, len(places) + 1))
            next_pairs, next_pairs_path = written(_reseat(pairs, contexts, words, numbered, now, sweep), "lm-state")
            numbered.destroy()
            changes = next_pairs.where("change <> 0")
            next_contexts, next_contexts_path = written(_changed(contexts, changes, "u", "tables"), "lm-contexts")
            next_words, next_words_path = written(_reseat_root(_changed(words, changes, "w", "n"), now, sweep), "lm-words")
        for path in (pairs_path, contexts_path, words_path):
            forget(spark, path)
        pairs, pairs_path, contexts, contexts_path, words, words_path = next_pairs, next_pairs_path, next_contexts, next_contexts_path, next_words, next_words_path
        release(spark)
        if sweep >= burn_in:
            roots.append(root())
            pairs = pairs.withColumn("ts", F.concat("ts", F.array(F.col("t").cast("int"))))
            contexts = contexts.withColumn("backs", F.concat("backs", F.array(F.expr(f"{STRENGTH}D + {DISCOUNT}D * tables"))))
            words = words.withColumn("ps", F.concat("ps", F.array(F.expr(roots[-1].share_sql()))))
    seated = " + ".join(["0D", *(f"ts[{i}]" for i in range(kept))])
    own = F.expr(f"c - {DISCOUNT}D * ({seated}) / {max(1, kept)}D")
    once = counted.where("c = 1").select("u", "w", "c", F.lit(1 - DISCOUNT).alias("own"))
    alone = "array(" + ", ".join(f"{float(r.share(np.ones(1), np.ones(1))[0])!r}D" for r in roots) + ")"
    return LanguageModel(
        places,
        words.select("w", "count", "ps").unionAll(still_words.selectExpr("w", "count", f"cast({alone} AS array<double>) AS ps")),
        contexts.select("u", "size", "backs").unionAll(still_contexts.selectExpr("u", "size", f"array_repeat({STRENGTH}D + {DISCOUNT}D * tables, {len(roots)}) AS backs")),
        pairs.select("u", "w", "c", own.alias("own")).unionAll(once), tuple(r.unseen() for r in roots), n_tokens, n_words,
    )


def _averaged(own: np.ndarray, size: np.ndarray, backs: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Averaged probability of a word in its context: backs and shares by sweep in rows."""
    return (own + (backs * shares).mean(axis=0)) / (STRENGTH + size)


@dataclass(frozen=True)
class Frequent:
    """What all workers hold: the numbers of frequent words, and by number count, parent's probabilities, and size and backs as a context."""

    numbers: Numbers
    values: np.ndarray

    @classmethod
    def of(cls, model: LanguageModel) -> Frequent:
        sweeps = len(model.unseen)
        values = _blank(model.unseen, len(model.places) + 1)
        words, contexts = (df.where(F.col(key) >= 0).toArrow() for df, key in ((model.words, "w"), (model.contexts, "u")))
        for got, key, one, many, row in ((words, "w", "count", "ps", 0), (contexts, "u", "size", "backs", 1 + sweeps)):
            at = got.column(key).to_numpy()
            if len(at):
                values[row, at] = got.column(one).to_numpy()
                values[row + 1 : row + 1 + sweeps, at] = _lists(got.column(many).combine_chunks(), sweeps)
        return cls(Numbers.of(model.places), values)


def _blank(unseen: tuple[float, ...], size: int) -> np.ndarray:
    """By rows what words have that training never met: count, the parent's probabilities by sweep, size and backs as a context."""
    return np.repeat(np.array([0.0, *unseen, 0.0, *[STRENGTH] * len(unseen)])[:, None], size, axis=1)


def _lists(column: pa.Array, sweeps: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, sweeps).T


class _Side:
    """Rows of the model by pairs of numbers."""

    def __init__(self, u: np.ndarray, w: np.ndarray, values: np.ndarray):
        """values: by row of the array, those of each pair."""
        h = digest(u, w)
        order = np.argsort(h)
        self.h, self.u, self.w, self.values = h[order], u[order], w[order], values[:, order]
        at = _starts(self.h[1:] != self.h[:-1], len(h))
        self.same = int(np.diff(np.append(at, len(h))).max(initial=0))

    def find(self, u: np.ndarray, w: np.ndarray, out: np.ndarray) -> np.ndarray:
        """`out` with the values of the pairs that are there."""
        h = digest(u, w)
        first = np.searchsorted(self.h, h)
        for i in range(self.same):  # one, but for pairs of the same hash
            at = np.minimum(first + i, len(self.h) - 1)
            met = np.flatnonzero((self.u[at] == u) & (self.w[at] == w))
            out[:, met] = self.values[:, at[met]]
        return out


def _dealt(rows: DataFrame, kind: int, shards: int) -> DataFrame:
    """`rows` (u, w, a number and maybe a list of numbers) as arrays by shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            u, w, values = (np.concatenate(x, axis=-1) for x in zip(*held))
            held.clear()
            order, h = _in_order(u, w)
            for shard, at in _parts(_shard(h, shards), shards):
                x = order[at]
                yield _sent([(shard, kind, 0, _halves(u[x]), _halves(w[x]), values[:, x].tobytes())])

        for b in batches:
            if b.num_rows:
                u, w = (b.column(i).to_numpy() for i in (0, 1))
                values = [b.column(2).to_numpy().astype(float)]
                if b.num_columns > 3:
                    values.extend(_lists(b.column(3), len(b.column(3).flatten()) // b.num_rows))
                held.append((u, w, np.array(values)))
                if sum(len(x[0]) for x in held) >= DEALT_ROWS:
                    yield from out()
        if held:
            yield from out()

    return rows.mapInArrow(run, DEALT)


PAIR, WORD, CONTEXT, ASKED_PAIRS, ASKED_WORDS = range(5)
SCORED = "_f long, _r long, doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _in_order(u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order in which pairs are dealt, and their hashes in it."""
    h = digest(u, w)
    order = np.argsort(h)
    if (h[order[1:]] == h[order[:-1]]).any():  # distinct pairs of the same hash: the same order on every machine
        order = np.lexsort((w, u, h))
    return order, h[order]


def score(docs: DataFrame, model: LanguageModel, id_column: str = "doc_id", text_column: str = "text", frequent_pairs: int = 0) -> DataFrame:
    """One row per row of `docs`: _f, _r (row key), doc_id, n_tokens, n_known, train_tokens, base_score, score.

    A null or empty text has one token, its end. Scores are log10 probabilities; a context that training
    never met leaves all to the parent. Repeated rows are scored alike; other columns are not read; an empty
    table gives no rows. `frequent_pairs` does nothing: blocks ask for a pair once, so none needs to go to all workers.
    """
    coded = code(docs, F.col(id_column), F.col(text_column), F.lit(False))
    out = scored(docs.sparkSession, coded, model)
    forget(docs.sparkSession, coded.folder)
    return out


def scored(spark: SparkSession, coded: Coded, model: LanguageModel) -> DataFrame:
    """`score` for texts that are coded, written."""
    release(spark)
    shared = spark.sparkContext.broadcast(Frequent.of(model))
    unseen, sweeps, train_tokens, slices = model.unseen, len(model.unseen), model.train_tokens, SLICES
    total = train_tokens + 0.1 * (model.vocabulary + 1)
    shards = max(coded.tokens, train_tokens) // SHARD_TOKENS + 1

    def met(block: dict[str, pa.Array]) -> tuple[np.ndarray, ...]:
        """Tokens in the order of their pairs, how many have each pair, places of its words in the block, and numbers of the block's words."""
        lengths, codes, n = block["lengths"].to_numpy(), block["codes"].to_numpy(), len(block["words"]) + 1
        keys = _before(codes, lengths, n - 1).astype(np.int64) * n + codes
        order = np.argsort(keys)
        keys = keys[order]
        at = _starts(keys[1:] != keys[:-1], len(keys))
        return order, np.diff(np.append(at, len(keys))), *np.divmod(keys[at], n), shared.value.numbers(block["hashes"].to_numpy())

    def asked(i: int, block: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
        _, _, u, w, own = met(block)
        rare = own[own < 0]
        for kind, first, second in ((ASKED_PAIRS, own[u], own[w]), (ASKED_WORDS, rare, np.zeros(len(rare), np.int64))):
            order, h = _in_order(first, second)
            for shard, at in _parts(_shard(h, shards), shards):
                x = order[at]
                yield _sent([(shard, kind, i, _halves(first[x]), _halves(second[x]) if kind == ASKED_PAIRS else b"", b"")])

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_memos()
        held: list[list[list[bytes]]] = [[[], [], []] for _ in range(3)]
        requests = []
        for b in batches:
            for shard, kind, block, *sent in zip(*(b.column(i).to_pylist() for i in range(6))):
                if kind < ASKED_PAIRS:
                    for x, y in zip(held[kind], sent):
                        x.append(y)
                else:
                    requests.append((shard, kind, block, sent))
        sides = []
        for own, rows in zip(held, (1, 1 + sweeps, 1 + sweeps)):
            values = np.concatenate([np.zeros((rows, 0)), *[np.frombuffer(x).reshape(rows, -1) for x in own[2]]], axis=1)
            sides.append(_Side(_whole(*own[0]), _whole(*own[1]), values))
            own.clear()
        for shard, kind, block, (first, second, _) in requests:
            u = _whole(first)
            if kind == ASKED_PAIRS:
                out = sides[PAIR].find(u, _whole(second), np.zeros((1, len(u))))
            else:
                out = _blank(unseen, len(u))
                for side, rows in ((WORD, out[: 1 + sweeps]), (CONTEXT, out[1 + sweeps :])):
                    sides[side].find(u, np.zeros(len(u), np.int64), rows)
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32()) for x in (block, kind, shard)] + [pa.array([out.tobytes()])], names=["block", "kind", "shard", "a"])

    folder, names = coded.folder, spark.sparkContext.broadcast(coded.names)

    def result(i: int, answers: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        block, held = read_block(folder, names.value[i]), shared.value
        codes, lengths = block["codes"].to_numpy(), block["lengths"].to_numpy()
        order, many, u, w, own = met(block)
        values = _blank(unseen, len(own))
        at = np.flatnonzero(own >= 0)
        values[:, at] = held.values[:, own[at]]
        rare = np.flatnonzero(own < 0)
        ranks, _ = _in_order(own[rare], np.zeros(len(rare), np.int64))
        values[:, rare[ranks]] = np.concatenate([np.zeros((len(values), 0)), *[np.frombuffer(x).reshape(len(values), -1) for kind, _, x in answers if kind == ASKED_WORDS]], axis=1)
        p = np.zeros(len(u))
        p[_in_order(own[u], own[w])[0]] = np.concatenate([np.frombuffer(x) for kind, _, x in answers if kind == ASKED_PAIRS])
        size = values[1 + sweeps]
        for k in range(sweeps):
            p += values[2 + sweeps + k][u] * values[1 + k][w] / sweeps
        p = np.log10(p / (STRENGTH + size[u]))
        text = np.repeat(np.arange(len(lengths)), lengths)
        base = np.log10((values[0] + 0.1) / total)
        known, base, logs = (np.bincount(x, y, len(lengths)) for x, y in ((text, (values[0] > 0)[codes]), (text, base[codes]), (text[order], np.repeat(p, many))))
        return pa.RecordBatch.from_arrays(
            [block["f"], block["r"], block["doc_id"], block["lengths"], pa.array(known.astype(np.int64)), pa.array(np.full(len(lengths), train_tokens, np.int64)), pa.array(base), pa.array(logs)],
            names=["_f", "_r", "doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_memos()
        found: defaultdict[int, list] = defaultdict(list)
        for b in batches:
            for block, *answer in zip(*(b.column(i).to_pylist() for i in range(4))):
                found[block].append(tuple(answer))
        while found:
            i, answers = found.popitem()
            yield result(i, sorted(answers, key=lambda x: x[:2]))

    # What rare contexts and words have. That of the frequent ones is with the workers already.
    zero = F.lit(0).cast("long").alias("z")
    model_rows = (
        (PAIR, model.pairs.select("u", "w", F.col("own").cast("double"))),
        (WORD, model.words.where("w < 0").select("w", zero, "count", "ps")),
        (CONTEXT, model.contexts.where("u < 0").select("u", zero, "size", "backs")),
    )

    def blocks_scored(part: int) -> DataFrame:
        """The texts of a part of the blocks, written. Nothing outside holds its plan, so that its shuffles can go."""
        with batches_of(spark, SWEEP_ROWS):
            rows = reduce(DataFrame.unionAll, [coded.each(spark, asked, DEALT, part, slices), *[_dealt(x, kind, shards) for kind, x in model_rows]])
            answers = rows.repartitionById(shards, "shard").mapInArrow(answered, "block int, kind int, shard int, a binary")
            there = len(range(part, len(coded.names), slices))
            return cut(answers.repartitionById(max(1, there), F.expr(f"block div {slices}").cast("int")).mapInArrow(results, SCORED), "lm-scores")

    parts = []
    for part in range(slices):
        parts.append(blocks_scored(part))
        gc.collect()
        release(spark)
    shared.destroy()
    return reduce(DataFrame.unionAll, parts)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = code(docs, F.col("doc_id"), F.col("text"), bucket("doc_id", 10) != 0)
    out = scored(spark, coded, learned(spark, coded))
    forget(spark, coded.folder)
    held_out = F.coalesce(bucket("doc_id", 10) == 0, F.lit(False)).alias("held_out")
    return out.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")
