"""Mixing sources to target weights: temperature mixing and budgeted block permutations.

A source's weight is its share of tokens to an exponent between 0 and 1, normalised. The exponent is
bisected until the weights' entropy reaches a fraction of its maximum; when that would repeat a source
more than a limit allows, it is bisected again to the least exponent within the limit. A source with
weight w then gets w x budget tokens: whole passes over its rows, and the first blocks of one further
permutation of them. Only DataFrame operations are used.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstack.llm.common import WORD, cut, joined, keyed, table

#: Entropy to reach, as a fraction of the logarithm of the number of sources; passes over a source at most.
ENTROPY, MAX_PASSES, SEED = 0.95, 2.0, 17
#: Points tried in one job, and jobs; together 30 bisections.
POINTS, ROUNDS = 32, 6


def _bisect(totals: DataFrame, total: float, holds: Callable[[float, float], bool]) -> float:
    """An end of [0, 1] or the exponent where holds(entropy, largest weight per token) changes.

    `holds` is true from some exponent on. The least such point is returned.
    """
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        points = [low + (high - low) * i / POINTS for i in range(POINTS + 1)]
        at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(x).alias("a")) for i, x in enumerate(points)]))
        share = F.col("tokens") / F.lit(total)
        raised = F.exp(F.col("x.a") * F.log(share))
        rows = (
            totals.select("tokens", at.alias("x")).select("x.i", "tokens", (F.col("x.a") * F.log(share)).alias("ln"), raised.alias("v"))
            .groupBy("i").agg(F.sum("v").alias("z"), F.sum(F.col("v") * F.col("ln")).alias("vl"), F.max(F.col("v") / F.col("tokens")).alias("top"))
            .select("i", (F.log("z") - F.col("vl") / F.col("z")).alias("entropy"), (F.col("top") / F.col("z")).alias("top"))
            .collect()
        )
        first = min((r.i for r in rows if holds(r.entropy, r.top)), default=POINTS)
        if first == 0:
            return low
        low, high = points[first - 1], points[first]
    return high


def weights(totals: DataFrame, budget: float | None = None, entropy: float = ENTROPY, max_passes: float = MAX_PASSES) -> tuple[DataFrame, float]:
    """`totals` (src, tokens > 0, rows) with weight and need (tokens to take); and the exponent."""
    total, n = totals.agg(F.sum("tokens"), F.count("*")).first()
    if not n:
        return totals.withColumns({"weight": F.lit(0.0), "need": F.lit(0.0)}), 1.0
    budget = float(total) if budget is None else budget
    goal = entropy * math.log(n) if n > 1 else 0.0
    # The entropy falls with the exponent: the point before which it is at least the goal.
    exponent = _bisect(totals, total, lambda h, top: h < goal - 1e-12)
    least = _bisect(totals, total, lambda h, top: budget * top <= max_passes * (1 + 1e-12))
    exponent = max(exponent, least)
    raised = F.exp(F.lit(exponent) * F.log(F.col("tokens") / F.lit(float(total))))
    z = totals.agg(F.sum(raised)).first()[0]
    return totals.withColumn("weight", raised / F.lit(z)).withColumn("need", F.col("weight") * F.lit(budget)), exponent


def mix(
    docs: DataFrame, budget: float | None = None, entropy: float = ENTROPY, max_passes: float = MAX_PASSES, seed: int = SEED,
    id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
) -> DataFrame:
    """The rows taken, once for each pass: _f, _r, doc_id, source, n_tokens, pass, block, weight, exponent.

    Tokens are words. budget: tokens to take over all sources, those of the input by default. The last
    pass over a source takes rows in a permuted order as long as their tokens fit, so what is taken falls
    short of weight x budget by less than one row. A null source is a source of its own. Sources without
    tokens (null or empty texts only) have weight zero, and their rows are not taken; rows without tokens
    in other sources go with their block. Where not even equal shares keep to max_passes (a budget beyond
    the input), the exponent is 1. Repeated rows are taken like others; other columns are not read.
    """
    base = keyed(
        docs, F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col(source_column).cast("string")), F.lit("")).alias("src"),
        F.coalesce(F.regexp_count(F.col(text_column), F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"),
        # Copies of the table in files of the same order are mixed alike.
        F.xxhash64(F.col(id_column), F.col(text_column), F.col(source_column)).alias("what"),
    )
    rows = cut(base, "mix-rows")
    totals = cut(rows.groupBy("src").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")).where("tokens > 0"), "mix-totals")
    weighted, exponent = weights(totals, budget, entropy, max_passes)
    passes = F.floor(F.col("need") / F.col("tokens") + F.lit(1e-8))  # a whole number may be missed by rounding
    plan = cut(
        weighted.select(
            "src", "weight", "rows", F.ceil(F.sqrt("rows")).alias("blocks"), passes.alias("passes"),
            F.greatest(F.lit(0.0), F.col("need") - passes * F.col("tokens")).alias("rest"),
        ),
        "mix-plan",
    )
    # A source of n rows has about sqrt(n) blocks of sqrt(n) rows: no window below is larger than that.
    mixed = joined(rows, plan, ["src"], "rows", text=F.col("src")).withColumn("hash", F.xxhash64(F.lit(seed), "what", "_r")).withColumn(
        "block", F.pmod(F.xxhash64(F.lit(seed + 1), "what", "_r"), F.col("blocks"))
    )
    order = F.xxhash64(F.lit(seed + 2), "src", "block")
    running = W.partitionBy("src").orderBy("order", "block").rowsBetween(W.unboundedPreceding, 0)
    blocks = cut(
        mixed.groupBy("src", "block").agg(F.sum("n_tokens").alias("size"), F.first("rest").alias("rest"))
        .withColumn("order", order).withColumn("before", F.sum("size").over(running) - F.col("size"))
        .select("src", "block", "size", (F.col("rest") - F.col("before")).alias("room"))
        .where("room > 0"),
        "mix-blocks",
    )
    taken = mixed.join(blocks, ["src", "block"], "left")
    inner = W.partitionBy("src", "block").orderBy("hash", "_f", "_r").rowsBetween(W.unboundedPreceding, 0)
    whole = taken.where("room IS NULL OR room >= size").withColumn("extra", F.when(F.col("room").isNull(), 0).otherwise(1))
    partly = taken.where("room < size").withColumn("extra", F.when(F.sum("n_tokens").over(inner) <= F.col("room"), 1).otherwise(0))
    both = whole.unionByName(partly).withColumn("copies", (F.col("passes") + F.col("extra")).cast("int")).where("copies > 0")
    return both.select(
        "_f", "_r", "doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("pass"), "block", "weight", F.lit(exponent).alias("exponent")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("_f", "_r")
