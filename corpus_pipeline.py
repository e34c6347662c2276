"""From `documents` to token ids: quality filter, exact and near dedup, mixing, SentencePiece pieces.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of `docs`. Rows with null
ids or texts, repeated rows and empty tables go through as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstack.llm import exact_dedup, mixing, pieces, quality, simhash
from quillstack.llm.common import cut, rows_left, rows_picked, stable, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good; it learns from the labels of the documents given.

    A null or empty text has the score of the bias. Null ids and labels teach nothing; repeated rows are kept or
    dropped alike. Without any label all scores are one half, and nothing is kept. No rows give none.
    """
    docs = stable(docs)
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id.

    A null text equals an empty one, a null id is below all others, and of repeated rows one stays. No rows give none.
    """
    docs = stable(docs)
    return rows_left(docs, exact_dedup.exact_dedup(docs).where("NOT kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of linked fingerprints, by the operator's contract (three-word shingles, three bits).

    That of the smallest id, null ids last; of repeated rows one stays. Texts without words link to each other. No
    rows give none.
    """
    docs = stable(docs)
    return rows_left(docs, simhash.simhash_dedup(docs).where("NOT kept"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, with sources at their tempered weights; a row comes once for each pass that takes it.

    A null source is one of its own; a source of null or empty texts only is not taken. Repeated rows are taken like
    others. No rows give none.
    """
    docs = stable(docs)
    return rows_picked(docs, mixing.mix(docs))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids and round_trip of each row; a null or empty text has no pieces. No rows give none."""
    return pieces.encode(docs, pieces.PieceModel.load(pieces.MODEL_PATH)).drop("_f", "_r")


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding", to_pieces),
]

#: The classifier and the mixing exponent are not for SQL: tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
