"""Line dedup with a sharded minimal perfect hash.

Lines' keys are hashed to 128 bits; per key the documents are counted and the largest id noted. All distinct
hashes are dealt to shards of bounded size, and each shard becomes a minimal perfect hash of several levels
of bits over one half of the hashes, which indexes compact arrays: 32 bits of the other half as fingerprint,
the count and the largest id in the narrowest types that hold them. Documents probe the arrays, and what a
probe finds (enough documents, a larger id) decides.

An index of bounded size goes to the workers, and documents probe it where they are read. A larger one stays
where it is, and the documents' hashes, not their lines, go to the shards; a shard that many documents ask is
copied, and its askers are dealt over the copies. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm.common import cut, drop_memos, if_small, keyed, table, texts_of

MIN_CHARS, MIN_DOCS = 20, 3
#: Keys of a shard, about; hashes that ask one copy of a shard, about; bits for each key on a level.
SHARD_KEYS, ASKERS, ROOM = 1 << 16, 200_000, 2
#: Bytes of an index that goes to all workers, at most.
IN_PLACE_BYTES = 64 << 20
NO_ID = -(1 << 63)
MIX = 0x9E3779B97F4A7C15
ONES = np.array([bin(i).count("1") for i in range(256)], np.int32)


def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    x = keys ^ np.uint64((level + 1) * MIX % 2**64)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    return (x % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: on each level the keys that are alone in their slot stay.

    The levels' bits are packed one after the other; a key's place is the number of set bits before its own.
    """

    def __init__(self, packed: bytes, sizes: list[int]):
        self.packed, self.sizes = packed, list(sizes)
        self.bytes = np.frombuffer(packed, np.uint8)
        ones = ONES[self.bytes]
        self.before = (np.cumsum(ones) - ones).astype(np.int32)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [np.zeros(0, bool)], np.unique(keys)
        while len(left):
            size = len(left) * ROOM + 1
            slots = _slot(left, len(levels) - 1, size)
            levels.append(np.bincount(slots, minlength=size) == 1)
            left = left[~levels[-1][slots]]
        return cls(np.packbits(np.concatenate(levels)).tobytes(), [len(x) for x in levels[1:]])

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Places from 0 for keys built in; for others any place, or -1."""
        out, left, start = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for i, size in enumerate(self.sizes):
            at = start + _slot(keys[left], i, size)
            byte, bit = self.bytes[at >> 3], at & 7
            here = (byte >> (7 - bit).astype(np.uint8)) & 1 > 0
            out[left[here]] = (self.before[at >> 3] + ONES[byte >> (8 - bit).astype(np.uint8)])[here]
            left, start = left[~here], start + size
            if not len(left):
                break
        return out


def _narrow(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


@dataclass
class Shard:
    """A perfect hash and its arrays. tops: the largest id less `least` plus one, zero for none. Keys whose first half another key has too stand in `twins`."""

    places: PerfectHash
    fingerprints: np.ndarray
    counts: np.ndarray
    tops: np.ndarray
    least: int
    twins: dict[tuple[int, int], tuple[int, int]]

    #: What is stored of a shard.
    SCHEMA = "shard int, bits binary, sizes array<int>, fingerprints binary, counts binary, count_type string, tops binary, top_type string, least long, twins array<long>"

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, tops: np.ndarray) -> Shard:
        """Of distinct (h1, h2); NO_ID as largest id stands for none."""
        values, place, times = np.unique(h1, return_inverse=True, return_counts=True)
        alone = times[place] == 1
        twins = {(int(a), int(b)): (int(n), int(t)) for a, b, n, t in zip(h1[~alone], h2[~alone], counts[~alone], tops[~alone])}
        h1, h2, counts, tops = h1[alone], h2[alone], counts[alone], tops[alone]
        places = PerfectHash.build(h1.view(np.uint64))
        order = np.argsort(places.index(h1.view(np.uint64)))
        some = tops != NO_ID
        least = int(tops[some].min()) if some.any() else 0
        above = np.where(some, tops.view(np.uint64) - np.uint64(least % 2**64) + np.uint64(1), np.uint64(0))
        return cls(places, (h2.view(np.uint64) >> np.uint64(32)).astype(np.uint32)[order], _narrow(counts[order]), _narrow(above[order]), least, twins)

    def row(self) -> dict:
        flat = [x for key, value in self.twins.items() for x in (*key, *value)]
        return {
            "bits": self.places.packed, "sizes": self.places.sizes, "fingerprints": self.fingerprints.tobytes(), "counts": self.counts.tobytes(), "count_type": self.counts.dtype.str,
            "tops": self.tops.tobytes(), "top_type": self.tops.dtype.str, "least": self.least, "twins": flat,
        }

    @classmethod
    def of_row(cls, r) -> Shard:
        flat = list(map(int, r["twins"]))
        twins = {(flat[i], flat[i + 1]): (flat[i + 2], flat[i + 3]) for i in range(0, len(flat), 4)}
        return cls(
            PerfectHash(r["bits"], r["sizes"]), np.frombuffer(r["fingerprints"], np.uint32), np.frombuffer(r["counts"], r["count_type"]), np.frombuffer(r["tops"], r["top_type"]), int(r["least"]), twins
        )

    def gone(self, h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, min_docs: int) -> np.ndarray:
        """Whether lines of these hashes go from the documents of these ids (NO_ID for none)."""
        out = np.zeros(len(h1), bool)
        if len(self.fingerprints):
            at = self.places.index(h1.view(np.uint64))
            safe = np.maximum(at, 0)
            known = (at >= 0) & (self.fingerprints[safe] == (h2.view(np.uint64) >> np.uint64(32)).astype(np.uint32))
            above = self.tops[safe].astype(np.uint64)
            top = (above - np.uint64(1) + np.uint64(self.least % 2**64)).view(np.int64)
            out = known & (self.counts[safe] >= min_docs) & (above > 0) & (ids < top)
        if self.twins:
            for i, key in enumerate(zip(h1.tolist(), h2.tolist())):
                if key in self.twins:
                    n, top = self.twins[key]
                    out[i] = n >= min_docs and top != NO_ID and ids[i] < top
        return out


def line_key(line: str) -> bytes:
    """Stripped of ASCII white space at both ends, ASCII letters in lower case."""
    return line.encode("utf-8", "surrogatepass").strip().lower()


def long_keys(text: str | None, min_chars: int) -> Iterator[tuple[int, bytes]]:
    """Places and keys of the lines whose keys are long enough."""
    for j, line in enumerate((text or "").split("\n")):
        if len(line) >= min_chars:
            key = line_key(line)
            if len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= min_chars):
                yield j, key


def _halves(digests: list[int]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([x >> 64 for x in digests], np.uint64).view(np.int64), np.array([x & 0xFFFFFFFFFFFFFFFF for x in digests], np.uint64).view(np.int64)


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """_f, _r, doc_id, h1, h2, at: each distinct long key of a row of `docs` (_f, _r, doc_id, text) and its lines' places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_memos()
        for b in batches:
            rows, digests, at = [], [], []
            for i, text in enumerate(texts_of(b.column(3))):
                found: dict[bytes, list[int]] = {}
                for j, key in long_keys(text, min_chars):
                    found.setdefault(key, []).append(j)
                digests += map(xxhash.xxh3_128_intdigest, found)
                at += found.values()
                rows += [i] * len(found)
            index = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[b.column(x).take(index) for x in range(3)], *map(pa.array, _halves(digests)), pa.array(at, pa.list_(pa.int32()))], names=["_f", "_r", "doc_id", "h1", "h2", "at"]
            )

    return docs.mapInArrow(run, "_f long, _r long, doc_id long, h1 long, h2 long, at array<int>")


def _build(group: pd.DataFrame) -> pd.DataFrame:
    """The arrays of one shard."""
    made = Shard.build(*[group[c].to_numpy(np.int64) for c in ("h1", "h2", "n", "top")])
    return pd.DataFrame([{"shard": group["shard"].iloc[0], **made.row()}])


def _without(text: str, gone: list[int]) -> str:
    """The text without the lines at these rising places."""
    lines, kept, last = text.split("\n"), [], 0
    for j in gone:
        kept += lines[last:j]
        last = j + 1
    return "\n".join(kept + lines[last:])


NAMES = ["_f", "_r", "doc_id", "n_lines", "n_dropped", "kept_text"]
RESULT = "_f long, _r long, doc_id long, n_lines long, n_dropped long, kept_text string"


def _results(b: pa.RecordBatch, gone: list[list[int]]) -> pa.RecordBatch:
    """The batch's result, from the places of the lines that go from each text."""
    lengths, kept = [], []
    for text, at in zip(texts_of(b.column(3)), gone, strict=True):
        lengths.append((text or "").count("\n") + 1)
        kept.append(_without(text, at) if at else text or "")
    return pa.RecordBatch.from_arrays([*[b.column(i) for i in range(3)], pa.array(lengths, pa.int64()), pa.array(list(map(len, gone)), pa.int64()), pa.array(kept, pa.string())], names=NAMES)


def _in_place(base: DataFrame, index: DataFrame, shards: int, min_chars: int, min_docs: int) -> DataFrame:
    """Documents probe the index, of at most IN_PLACE_BYTES, where they are read."""
    shared = base.sparkSession.sparkContext.broadcast({r["shard"]: r for r in index.toArrow().to_pylist()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_memos()
        held = {n: Shard.of_row(r) for n, r in shared.value.items()}
        for b in batches:
            rows, places, digests = [], [], []
            for i, text in enumerate(texts_of(b.column(3))):
                for j, key in long_keys(text, min_chars):
                    rows.append(i)
                    places.append(j)
                    digests.append(xxhash.xxh3_128_intdigest(key))
            h1, h2 = _halves(digests)
            ids = b.column(2).fill_null(NO_ID).to_numpy(zero_copy_only=False)[np.array(rows, np.int64)]
            shard = h2 % shards  # as pmod does, never negative
            drop, order = np.zeros(len(h1), bool), np.argsort(shard, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else ():
                if int(shard[part[0]]) in held:
                    drop[part] = held[int(shard[part[0]])].gone(h1[part], h2[part], ids[part], min_docs)
            gone: list[list[int]] = [[] for _ in range(b.num_rows)]
            for k in np.flatnonzero(drop).tolist():
                gone[rows[k]].append(places[k])
            yield _results(b, gone)

    return base.mapInArrow(run, RESULT)


def _routed(base: DataFrame, index: DataFrame, shards: int, min_chars: int, min_docs: int) -> DataFrame:
    """Documents' hashes go to the shards, and the places that go come back."""
    lines = cut(line_hashes(base, min_chars).withColumn("shard", F.pmod("h2", F.lit(shards)).cast("int")), "line-hashes")
    # One narrow row for each SHARD_KEYS keys.
    asked = if_small(cut(lines.groupBy("shard").agg(F.ceil(F.count("*") / ASKERS).cast("int").alias("copies")), "line-copies"))
    asks = lines.join(asked, "shard").withColumn("copy", F.pmod(F.xxhash64("_f", "_r"), F.col("copies")).cast("int")).drop("copies")
    copies = index.join(asked, "shard").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")

    def probe(asks: pd.DataFrame, copies: pd.DataFrame) -> pd.DataFrame:
        if not len(asks) or not len(copies):
            return pd.DataFrame({"_f": pd.Series(dtype="int64"), "_r": pd.Series(dtype="int64"), "at": pd.Series(dtype="object")})
        drop = Shard.of_row(copies.iloc[0]).gone(*[asks[c].to_numpy(np.int64) for c in ("h1", "h2")], asks["doc_id"].fillna(NO_ID).to_numpy(np.int64), min_docs)
        return asks.loc[drop, ["_f", "_r", "at"]]

    asks = asks.select("_f", "_r", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "h1", "h2", "at", "shard", "copy")
    found = asks.groupBy("shard", "copy").cogroup(copies.groupBy("shard", "copy")).applyInPandas(probe, "_f long, _r long, at array<int>")
    drops = found.groupBy("_f", "_r").agg(F.array_sort(F.flatten(F.collect_list("at"))).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _results(b, [x or [] for x in b.column(4).to_pylist()])

    return base.join(drops, ["_f", "_r"], "left").select("_f", "_r", "doc_id", "text", "at").mapInArrow(run, RESULT)


def line_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per row of `docs`: _f, _r (row key), doc_id, n_lines, n_dropped, kept_text.

    A null or empty text is one empty line. Each row counts as a document, so repeated rows do; of rows
    with the same largest id all keep the line. A null id is below all others; where all holders have
    null ids nothing is dropped. Other columns are not read. An empty table gives no rows.
    """
    base = keyed(docs, F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    counted = line_hashes(base, min_chars).groupBy("h1", "h2").agg(F.count("*").alias("n"), F.coalesce(F.max("doc_id"), F.lit(NO_ID)).alias("top"))
    keys = cut(counted, "line-keys")
    shards = keys.count() // SHARD_KEYS + 1
    index = cut(keys.select(F.pmod("h2", F.lit(shards)).cast("int").alias("shard"), "h1", "h2", "n", "top").groupBy("shard").applyInPandas(_build, Shard.SCHEMA), "line-index")
    size = index.agg(F.sum(F.octet_length("bits") + F.octet_length("fingerprints") + F.octet_length("counts") + F.octet_length("tops") + 8 * F.size("twins"))).first()[0] or 0
    return (_in_place if size <= IN_PLACE_BYTES else _routed)(base, index, shards, min_chars, min_docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents),
l AS (
  SELECT r, doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT r, doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS i FROM d)),
k AS (SELECT key, max(doc_id) AS top FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT r) >= 3),
m AS (SELECT l.r, l.doc_id, l.i, l.line, coalesce(k.top IS NOT NULL AND (l.doc_id IS NULL OR l.doc_id < k.top), false) AS gone FROM l LEFT JOIN k ON l.key = k.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""
