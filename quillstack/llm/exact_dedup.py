"""Exact dedup by distributed MSD radix partitioning.

Texts are split by successive runs of bytes. The first digit is the byte length with the first bytes;
every further digit is a longer run, so a text of n bytes is done after about log8(n) levels. At each
level the groups are counted (partial counts first), groups of one leave, groups whose bytes have
ended are equal, and only the rest is read further. No digest decides equality.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm.common import BROADCAST_BYTES, cut, forget, joined, keyed, table, written

FIRST_BYTES, GROWTH = 32, 8


def _equal_groups(base: DataFrame) -> DataFrame:
    """(_f, _r, _id, gid) of every row of `base` (_f, _r, _id, body) whose body another row has too.

    Counting is by partial sums, and the rows of a large group are not gathered: they learn of it from a
    broadcast of the few large groups. What a level wrote is deleted when the next stands.
    """
    spark = base.sparkSession
    digit = [F.octet_length("body").alias("len"), F.substring("body", 1, FIRST_BYTES).alias("digit")]
    me = F.struct("_f", "_r")
    groups, old = written(
        base.select("_f", "_r", *digit).groupBy("len", "digit").agg(F.count("*").alias("n"), F.min(me).alias("gid")).where("n > 1"), "radix-groups",
    )
    rows = joined(base.select("*", *digit), groups, ["len", "digit"], "n", text=F.col("digit"))
    rest = F.expr(f"substring(body, {FIRST_BYTES + 1})").alias("rest")
    active, path = written(rows.select("_f", "_r", "_id", "gid", "len", rest), "radix-rows")
    done, seen, width = [], FIRST_BYTES, FIRST_BYTES * GROWTH
    while True:
        forget(spark, old)
        done.append(cut(active.where(F.col("len") <= seen).select("_f", "_r", "_id", "gid"), "radix-equal"))
        deeper = active.where(F.col("len") > seen).withColumn("digit", F.substring("rest", 1, width))
        if deeper.limit(1).count() == 0:
            break
        groups, old = written(
            deeper.groupBy("gid", "digit").agg(F.count("*").alias("n"), F.min(me).alias("next")).where("n > 1"), "radix-groups",
        )
        # Digits are wide by now, so fewer groups count as large.
        few = max(16, min(2_000, BROADCAST_BYTES // width))
        next_rows = joined(deeper, groups, ["gid", "digit"], "n", text=F.col("digit"), most=few).select(
            "_f", "_r", "_id", F.col("next").alias("gid"), "len", F.expr(f"substring(rest, {width + 1})").alias("rest")
        )
        active, next_path = written(next_rows, "radix-rows")
        forget(spark, path)
        path, seen, width = next_path, seen + width, width * GROWTH
    forget(spark, path)
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of `docs`: _f, _r (row key), doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; a null text counts as empty. Of equal texts the row with the
    largest id stays; a null id is below all others, and of rows with one id and one text a single one
    stays. Other columns are not read. An empty table gives no rows.
    """
    base = keyed(docs, F.col(id_column).alias("_id"), F.coalesce(F.col(text_column), F.lit("")).cast("binary").alias("body"))
    members = _equal_groups(base)
    tops = members.groupBy("gid").agg(F.count("*").alias("group_size"), F.max(F.struct("_id", "_f", "_r")).alias("top")).withColumn("n", F.col("group_size"))
    verdicts = joined(members, cut(tops, "radix-tops"), ["gid"], "n").select(
        "_f", "_r", F.col("top._id").alias("keep_id"), "group_size",
        ((F.col("top._f") == F.col("_f")) & (F.col("top._r") == F.col("_r"))).alias("kept"),
    )
    slim = base.select("_f", "_r", "_id", F.sha2("body", 256).alias("text_sha256"))
    return slim.join(verdicts, ["_f", "_r"], "left").select(
        "_f", "_r", F.col("_id").alias("doc_id"),
        F.when(F.col("group_size").isNull(), F.col("_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce("kept", F.lit(True)).alias("kept"),
        "text_sha256",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("_f", "_r")


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
