"""SimHash near-dedup by multi-index hashing.

Fingerprints are 64 sums over XXH64 hashes of word shingles. Two fingerprints link when they differ
in at most three bits. Cut into two segments of 32 bits, linked fingerprints have a segment in which
they differ in at most one bit, so each fingerprint looks up the 33 values of that ball in the table
of each segment, and complete distances are verified.

Dense groups of near copies would give all their pairs that way. So fingerprints within two bits are
joined first through the values one bit away from both (a value has at most 65 such neighbours, each
fingerprint 65 such values), and the lookup is then asked only for links between different groups: what
asks for a segment's value meets no fingerprint of its own group there, if that has most of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm.common import cut, drop_memos, joined, keyed, release, setting, spread, table, texts_of
from quillstack.llm.components import components

SHINGLE_WORDS, MAX_BITS, SEED = 3, 3, 42
#: Shingles of a text whose bits are summed at a time.
BLOCK = 1 << 16


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Unsigned fingerprint; zero without words. The shingles of a text are all counted, repeats too."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n = len(parts) - words + 1
    digest = xxhash.xxh64_intdigest
    sums = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        pairs = zip(starts[at : min(n, at + BLOCK)].tolist(), (ends[at + words - 1 : min(n, at + BLOCK) + words - 1] - 1).tolist(), strict=True)
        hashes = np.array([digest(line[a:b], SEED) for a, b in pairs], dtype="<u8")
        sums += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * sums > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str, text_column: str, words: int) -> DataFrame:
    """_f, _r, doc_id, fp (the unsigned fingerprint's bits as a signed long), written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_memos()
        for b in batches:
            fps = np.array([fingerprint(t, words) for t in texts_of(b.column(3))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(fps)], names=["_f", "_r", "doc_id", "fp"])

    base = keyed(docs, F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return cut(spread(base, docs).mapInArrow(run, "_f long, _r long, doc_id long, fp long"), "simhash-fps")


def _near(fps: DataFrame) -> DataFrame:
    """(a, b) for fingerprints within two bits, as stars around the values one bit away."""
    bits = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)]
    hubs = fps.repartition("fp").select("fp", F.explode(F.array(*bits)).alias("hub")).repartition("hub")  # dealt once for both uses
    met = hubs.groupBy("hub").agg(F.count("*").alias("n"), F.min("fp").alias("a")).where("n > 1").select("hub", "a")
    return hubs.join(met, "hub").where("fp <> a").select("a", F.col("fp").alias("b")).distinct()


def _far(groups: DataFrame) -> DataFrame:
    """(a, b) groups that hold fingerprints within three bits, from `groups` (fp, comp)."""
    groups = groups.repartition("fp")
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    flips = [F.lit(m).cast("long") for m in [0] + [1 << i for i in range(32)]]
    segments = F.explode(F.array(*[F.struct(F.lit(s).alias("seg"), v.alias("key")) for s, v in ((0, low), (1, high))])).alias("x")
    tables = groups.select("fp", "comp", segments).select("x.*", "fp", "comp")
    asks = groups.select(
        F.col("fp").alias("fp2"), F.col("comp").alias("comp2"),
        F.explode(F.array(*[F.struct(F.lit(s).alias("seg"), v.bitwiseXOR(m).alias("key")) for s, v in ((0, low), (1, high)) for m in flips])).alias("x"),
    ).select("x.*", "fp2", "comp2")
    # The group that has most of a value's fingerprints: its members ask for the others' rows only.
    sizes = tables.groupBy("seg", "key", "comp").agg(F.count("*").alias("n"))
    tops = cut(sizes.groupBy("seg", "key").agg(F.max_by("comp", F.struct("n", "comp")).alias("top")), "simhash-tops")
    held = tables.join(tops, ["seg", "key"]).select("seg", "key", "fp", "comp", F.when(F.col("comp") == F.col("top"), 0).otherwise(1).alias("kind"))
    kinds = F.when(F.col("comp2") == F.col("top"), F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))
    asked = asks.join(tops, ["seg", "key"]).select("seg", "key", "fp2", "comp2", F.explode(kinds).alias("kind"))
    met = asked.join(held, ["seg", "key", "kind"]).where((F.col("comp") < F.col("comp2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= MAX_BITS))
    links = met.select(F.col("comp").alias("a"), F.col("comp2").alias("b")).distinct()
    with setting(groups.sparkSession, "spark.sql.requireAllClusterKeysForCoPartition", "false"):  # dealt by value once for both joins
        return cut(links, "simhash-links")


def simhash_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """One row per row of `docs`: _f, _r (row key), doc_id, fingerprint, component_id, kept.

    Texts without words (null, empty, white space) have fingerprint zero and link like others.
    component_id is the smallest id reachable over links (ids that are null are passed over); kept
    marks one row of each component, that of the smallest id and row key. Repeated rows are members
    like any others. Other columns are not read. An empty table gives no rows.
    """
    fps = fingerprints(docs, id_column, text_column, words)
    distinct = cut(fps.groupBy("fp").agg(F.count("*").alias("n")), "simhash-distinct")
    near = components(_near(distinct.select("fp")))
    groups = cut(distinct.join(near.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("comp"), "n"), "simhash-near")
    release(docs.sparkSession)
    far = components(_far(groups.select("fp", "comp"))).select(F.col("node").alias("comp"), "root")
    comps = cut(groups.join(far, "comp", "left").select("fp", F.coalesce("root", "comp").alias("comp"), "n"), "simhash-comps")
    release(docs.sparkSession)
    rows = cut(joined(fps, comps, ["fp"], "n"), "simhash-rows")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_f", "_r")
    tops = cut(rows.groupBy("comp").agg(F.count("*").alias("n"), F.min("doc_id").alias("component_id"), F.min(key).alias("top")), "simhash-roots")
    return joined(rows, tops, ["comp"], "n").select(
        "_f", "_r", "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
        ((F.col("top._f") == F.col("_f")) & (F.col("top._r") == F.col("_r"))).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
