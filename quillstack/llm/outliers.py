"""Quality rules: base rules, and robust multivariate outliers by minimum covariance determinant.

Each document gives a vector of transformed statistics. For every language and source, every language and
all rows, mean and covariance of the most concentrated part of the vectors are found: three starts, two
concentration steps each (distances from the present estimate, the nearest share of the rows kept,
estimated again), the start of least determinant kept, two more steps, scaling to the chi-square median
and one reweighting. A group's estimate is then drawn towards its language's, and that towards the one of
all rows, by a weight that falls smoothly with the group's rows. Documents beyond a quantile are rejected.

Only DataFrame operations are used: estimates are aggregates with partial sums, distances come from
Cholesky factors written out as columns, and the nearest share is found from counts by bins of distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstack.llm.common import SPACE, cut, joined, keyed, spread, table

#: Share of a group that a concentration step keeps; steps from each start and from the best; bins of a doubling of
#: the squared distance (a share is kept to the end of a bin); rows that weigh as much as the estimate above a group's.
SHARE, STEPS, MORE_STEPS, BINS, PRIOR = 0.75, 2, 2, 16, 30
#: Statistics and the least standard deviation of each: what varies less is no evidence against a document.
FLOORS = {"x_words": 0.4, "x_length": 0.05, "x_symbols": 0.06, "x_lines": 0.6, "x_repeats": 0.12, "x_upper": 0.06}
# Quantiles of the chi-square distribution with 6 degrees of freedom at 0.5, 0.975 and 0.999.
MEDIAN, NEAR, FAR = 5.348, 14.449, 22.458
WINDOW = 5


def statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", source_column: str = "source") -> DataFrame:
    """_f, _r, doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper of each row, written."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    base = keyed(docs, F.col(id_column).alias("doc_id"), F.col(lang_column).cast("string").alias("lang"), F.col(source_column).cast("string").alias("source"), text.alias("text"))
    trimmed = F.btrim("text", F.lit(" \t\n\x0b\f\r"))
    split = spread(base, docs).withColumn("words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE}]+")))
    hashed = split.withColumns({
        "n": F.size("words").cast("long"),
        "hashes": F.expr(f"if(size(words) <= {WINDOW}, cast(array() as array<bigint>), transform(sequence(1, size(words) - {WINDOW - 1}), i -> xxhash64(slice(words, i, {WINDOW}))))"),
        "lines": F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != ""),
    })
    # Starts of the windows found twice: the hashes in order with their places, those equal to a neighbour.
    ordered = F.expr("array_sort(transform(hashes, (h, i) -> named_struct('h', h, 'i', i)))")
    found = hashed.withColumn("repeated", F.size(F.array_distinct("hashes")) < F.size("hashes")).withColumn(
        "ordered", F.when(F.col("repeated"), ordered)
    ).withColumn(
        "starts", F.expr("array_sort(transform(filter(ordered, (x, j) -> get(ordered, j - 1).h <=> x.h OR get(ordered, j + 1).h <=> x.h), x -> x.i))")
    )
    covered = F.expr(f"aggregate(transform(starts, (x, j) -> least({WINDOW}, coalesce(get(starts, j + 1), x + {WINDOW}) - x)), 0, (a, x) -> a + x)")
    return cut(
        found.select(
            "_f", "_r", "doc_id", "lang", "source", F.col("n").alias("n_words"),
            F.length(F.regexp_replace("text", f"[{SPACE}]+", "")).cast("long").alias("word_chars"),
            (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            F.when(F.col("repeated"), covered).otherwise(0).cast("long").alias("n_repeat_words"),
            F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        ),
        "rule-statistics",
    )


def vectors() -> dict[str, Column]:
    """The transformed statistics; pseudo-counts keep short texts' ratios near the middle."""
    n, chars = F.col("n_words"), F.col("word_chars")
    return {
        "x_words": F.log1p(n), "x_length": F.log((chars + 150) / (n + 30)), "x_symbols": F.sqrt(F.col("n_symbols") / (chars + 50)),
        "x_lines": F.log1p("n_dup_lines"), "x_repeats": F.sqrt(F.col("n_repeat_words") / (n + 20)), "x_upper": F.sqrt((F.col("n_upper") + 2) / (chars + 50)),
    }


NAMES = list(FLOORS)
D = range(len(NAMES))
PAIRS = [(i, j) for i in D for j in range(i + 1)]


def _moments(rows: DataFrame, *by: str) -> DataFrame:
    """Count, sums (a0, a1 ...) and sums of products (b0_0, b1_0 ...) of the vectors by group."""
    sums = [*[f"sum({x}) AS a{i}" for i, x in enumerate(NAMES)], *[f"sum({NAMES[i]} * {NAMES[j]}) AS b{i}_{j}" for i, j in PAIRS]]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *map(F.expr, sums))


def _estimates(moments: DataFrame, *by: str) -> DataFrame:
    """Means (m0 ...) and covariances with the floors' squares added (c0_0 ...)."""
    cov = lambda i, j: f"b{i}_{j} / n - a{i} / n * a{j} / n"
    return moments.selectExpr(
        *by, "n", *[f"a{i} / n AS m{i}" for i in D],
        *[(f"greatest({cov(i, j)}, 0D) + {FLOORS[NAMES[i]] ** 2!r}D" if i == j else cov(i, j)) + f" AS c{i}_{j}" for i, j in PAIRS],
    )


def _factors(estimates: DataFrame) -> DataFrame:
    """The Cholesky factor (l0_0 ...) of each estimate, one column after the other, and the logarithm of its determinant."""
    made = []
    for j in D:
        sub = lambda i, j=j: " - ".join([f"c{i}_{j}", *[f"l{i}_{k} * l{j}_{k}" for k in range(j)]])
        made += [f"sqrt(greatest({sub(j)}, 1e-12D)) AS l{j}_{j}", *[f"({sub(i)}) / l{j}_{j} AS l{i}_{j}" for i in range(j + 1, len(NAMES))]]
    return estimates.selectExpr("*", *made, " + ".join(f"2 * ln(l{j}_{j})" for j in D) + " AS det")


def _distances(rows: DataFrame, factors: DataFrame, sizes: DataFrame) -> DataFrame:
    """`rows` with d2, the squared distance from the estimate of the row's key; one row for each start there is."""
    there = joined(rows, factors.drop("n", "det", *[f"c{i}_{j}" for i, j in PAIRS]).join(sizes, "key"), ["key"], "rows")
    scaled = [f"({' - '.join([x, f'm{i}', *[f'l{i}_{j} * z{j}' for j in range(i)]])}) / l{i}_{i} AS z{i}" for i, x in enumerate(NAMES)]
    starts = [c for c in factors.columns if c == "start"]
    return there.selectExpr(*rows.columns, *starts, *scaled, " + ".join(f"z{i} * z{i}" for i in D) + " AS d2").drop(*[f"z{i}" for i in D])


def _starts(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """The first estimates: medians, and three covariances from scaled deviations z.

    median: none between statistics; tanh: correlations of tanh(z); sign: those of z at length one. The
    latter are drawn a tenth towards none.
    """
    middle = lambda x: F.percentile_approx(x, 0.5, 10_000)
    medians = cut(rows.groupBy("key").agg(*[middle(x).alias(f"m{i}") for i, x in enumerate(NAMES)]).join(sizes, "key"), "rule-medians")
    spreads = joined(rows, medians, ["key"], "rows").groupBy("key").agg(
        *[F.first(f"m{i}").alias(f"m{i}") for i in D],
        *[F.sqrt(F.pow(1.4826 * middle(F.abs(F.col(x) - F.col(f"m{i}"))), F.lit(2)) + FLOORS[x] ** 2).alias(f"s{i}") for i, x in enumerate(NAMES)],
    )
    spreads = cut(spreads.join(sizes, "key"), "rule-spreads")
    z = joined(rows, spreads, ["key"], "rows").selectExpr(
        "key", *[f"({x} - m{i}) / s{i} AS z{i}" for i, x in enumerate(NAMES)], f"greatest(sqrt({' + '.join(f'z{i} * z{i}' for i in D)}), 1e-9D) AS norm",
        *[f"tanh(z{i}) AS t{i}" for i in D], *[f"z{i} / norm AS u{i}" for i in D],
    )
    products = z.groupBy("key").agg(*[F.expr(f"sum({v}{i} * {v}{j}) AS {v}{i}_{j}") for v in "tu" for i, j in PAIRS])
    got = spreads.join(products, "key")

    def cov(v: str, i: int, j: int) -> str:
        if i == j or not v:
            return f"{f's{i} * s{i}' if i == j else '0D'} AS c{i}_{j}"
        scale = f"sqrt({v}{i}_{i} * {v}{j}_{j})"
        return f"if({scale} > 0, 0.9D * {v}{i}_{j} / {scale} * s{i} * s{j}, 0D) AS c{i}_{j}"

    each = [got.selectExpr("key", f"{k} AS start", "rows AS n", *[f"m{i}" for i in D], *[cov(v, i, j) for i, j in PAIRS]) for k, v in enumerate(("", "t", "u"))]
    return each[0].unionAll(each[1]).unionAll(each[2])


def _bin(d2: Column) -> Column:
    return F.floor(F.log2(d2 + 0.001) * BINS).cast("int")


def _step(rows: DataFrame, factors: DataFrame, sizes: DataFrame) -> DataFrame:
    """Estimates, with their factors, of the nearest share of each key's rows by the present ones."""
    by = W.partitionBy("key", "start").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)  # a window has as many rows as there are bins
    bins = _moments(_distances(rows, factors, sizes).withColumn("bin", _bin(F.col("d2"))), "key", "start", "bin")
    kept = bins.withColumn("before", F.sum("n").over(by) - F.col("n")).join(sizes, "key").where(F.col("before") < F.ceil(SHARE * F.col("rows")))
    sums = [c for c in bins.columns if c not in ("key", "start", "bin")]
    together = kept.groupBy("key", "start").agg(*[F.sum(c).alias(c) for c in sums])
    return cut(_factors(_estimates(together, "key", "start")), "rule-factors")


def _robust(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """key, n, mean and covariance of each key of `rows` (key and the vectors), reweighted."""
    now = cut(_factors(_starts(rows, sizes)), "rule-factors")
    for _ in range(STEPS):
        now = _step(rows, now, sizes)
    best = now.groupBy("key").agg(F.min_by("start", F.struct("det", "start")).alias("start"))
    now = now.join(best, ["key", "start"])
    for _ in range(MORE_STEPS):
        now = _step(rows, now, sizes)
    at = _distances(rows, now, sizes)
    bins = at.groupBy("key", _bin(F.col("d2")).alias("bin")).agg(F.count("*").alias("n"))
    by = W.partitionBy("key").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    middle = bins.withColumn("upto", F.sum("n").over(by)).join(sizes, "key").where(F.col("upto") >= F.ceil(0.5 * F.col("rows"))).groupBy("key").agg(F.min("bin").alias("bin"))
    # Scaled so that the median distance is the chi-square median, but never closer than estimated.
    limits = cut(middle.select("key", (F.greatest(F.lit(1.0), F.pow(F.lit(2.0), (F.col("bin") + 1) / BINS) / MEDIAN) * NEAR).alias("limit")).join(sizes, "key"), "rule-limits")
    near = joined(at, limits, ["key"], "rows").where(F.col("d2") <= F.col("limit"))
    return cut(_estimates(_moments(near, "key"), "key"), "rule-estimates")


def _drawn(own: DataFrame, above: DataFrame) -> DataFrame:
    """Estimates `own` (key, up, n ...) mixed with those of their `above`: n rows of one, PRIOR rows of the other."""
    other = above.selectExpr("key AS up", *[f"m{i} AS um{i}" for i in D], *[f"c{i}_{j} AS uc{i}_{j}" for i, j in PAIRS])
    return own.join(other, "up").alias("o").selectExpr(
        "key", "n", f"n / (n + {PRIOR}D) AS w", *[f"w * o.m{i} + (1 - w) * o.um{i} AS m{i}" for i in D],
        *[f"w * c{i}_{j} + (1 - w) * uc{i}_{j} + w * (1 - w) * (o.m{i} - um{i}) * (o.m{j} - um{j}) AS c{i}_{j}" for i, j in PAIRS],
    ).drop("w")


def _robust_distances(rows: DataFrame) -> DataFrame:
    """_f, _r, d2 of `rows` (_f, _r, lang, group and the vectors), a written table."""
    levels = F.array(F.lit("*"), F.col("lang"), F.col("group"))
    each = rows.select(F.explode(levels).alias("key"), *NAMES)
    ups = rows.groupBy("lang", "group").agg(F.count("*").alias("n"))
    ups = ups.select(F.col("group").alias("key"), F.col("lang").alias("up"), "n").unionAll(ups.groupBy("lang").agg(F.sum("n")).select("lang", F.lit("*"), "sum(n)"))
    total = ups.where("up = '*'").agg(F.sum("n").alias("n")).where("n > 0").select(F.lit("*").alias("key"), F.lit("").alias("up"), "n")
    places = cut(ups.unionAll(total).withColumnRenamed("n", "rows"), "rule-places")
    own = _robust(each, places.select("key", "rows")).join(places.select("key", "up"), "key")
    top = own.where("up = ''").drop("up")
    langs = _drawn(own.where("up = '*'"), top)
    groups = _drawn(own.where("up NOT IN ('', '*')"), langs)
    at = _distances(rows.select("_f", "_r", F.col("group").alias("key"), *NAMES), cut(_factors(groups), "rule-drawn"), places.select("key", "rows"))
    return at.select("_f", "_r", "d2")


def quality_rules(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", source_column: str = "source") -> DataFrame:
    """One row per row of `docs`: _f, _r, doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance.

    Null texts count as empty, null languages and sources as groups of their own. distance is the squared
    robust distance from the row's group (language and source, drawn towards the language and all rows);
    rows that fail the base rules are in no estimate and have none. Repeated rows are judged alike; other
    columns are not read; an empty table gives no rows.
    """
    rows = statistics(docs, id_column, text_column, lang_column, source_column)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    passed = rows.where(~failed).select("_f", "_r", part("lang").alias("lang"), F.concat_ws("\x00", part("lang"), part("source")).alias("group"), *[v.alias(k) for k, v in vectors().items()])
    found = _robust_distances(cut(passed, "rule-vectors"))
    return rows.join(found, ["_f", "_r"], "left").select(
        "_f", "_r", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.coalesce("d2", F.lit(0.0)) <= FAR)).alias("kept"), F.col("d2").alias("distance"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("_f", "_r")
