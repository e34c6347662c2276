"""Page extraction over tables, routes and attempts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.functions import html as H
from quillstack.llm.common import small_batches, texts_of
from quillstack.schema import MAX_BODY


def _readable(html: str) -> Column:
    """The markup, or null for pages that are empty or too large: these keep their row and give nulls."""
    return F.when((F.col(html) != "") & (F.octet_length(html) <= MAX_BODY), F.col(html)).alias(html)


def extract_pages(pages: DataFrame, id: str = "page_id") -> DataFrame:
    """id, url, title, text, tier, score of each page; nulls where nothing was found. One Arrow pass for the whole cascade."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [H.extract(h, u) or (None, None, None, None) for h, u in zip(texts_of(b.column(2)), texts_of(b.column(1)))]
            title, text, tier, score = zip(*found) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(x, pa.string()) for x in (title, text, tier)], pa.array(score, pa.float64())], ["id", "url", "title", "text", "tier", "score"])

    small_batches(pages.sparkSession)
    return pages.select(F.col(id).cast("long").alias("id"), "url", _readable("html")).mapInArrow(run, "id long, url string, title string, text string, tier string, score double")


#: What a tier alone finds on a parsed page with an address or none; nothing is None.
TIERS = {
    "structured": lambda root, url: H.json_ld(root),
    "paragraphs": lambda root, url: (H.paragraphs_by_score(root) or None) if url and "://" in url else None,
    "body": lambda root, url: H.body_text(root),
}


def tier_texts(pages: DataFrame, id: str = "page_id", tiers: Sequence[str] = tuple(TIERS)) -> DataFrame:
    """id and what each of `tiers` alone finds on a page: structured data, paragraphs by score, the whole body; null for nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[] for _ in tiers]
            for h, u in zip(texts_of(b.column(2)), texts_of(b.column(1))):
                root = H.parse(h) if h else None
                for name, out in zip(tiers, found):
                    out.append(root and TIERS[name](root, u))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, pa.string()) for x in found]], ["id", *tiers])

    small_batches(pages.sparkSession)
    return pages.select(F.col(id).cast("long").alias("id"), "url", _readable("html")).mapInArrow(run, ", ".join(["id long", *[f"{t} string" for t in tiers]]))


def candidate_fold(candidates: Column) -> Column:
    """The chosen one of an array of struct<score, nbytes, ...>, taken in order; null for an empty array."""
    return F.aggregate(
        candidates, F.lit(None).cast("struct<score:double,nbytes:bigint,ord:int>"),
        lambda best, c: F.when(best.isNull() | (c["score"] > best["score"]) | ((c["score"] > 0.9 * best["score"]) & (c["nbytes"] > 2 * best["nbytes"])), c).otherwise(best),
    )


def resolve_attempts(attempts: Column) -> Column:
    """The outcome of an array of struct<ok boolean, text string, error string> in order: the first success, else the last attempt's error.

    A last attempt that found nothing has no error, whatever came before it.
    """
    first = F.get(F.filter(attempts, lambda a: a["ok"]), F.lit(0))
    return F.when(first.isNotNull(), F.struct(F.lit(True).alias("ok"), first["text"].alias("text"), F.lit(None).cast("string").alias("error"))).otherwise(
        F.struct(F.lit(False).alias("ok"), F.lit(None).cast("string").alias("text"), F.get(attempts, F.size(attempts) - 1)["error"].alias("error"))
    )
