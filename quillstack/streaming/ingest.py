"""Ingest of arriving exports: each micro-batch goes through the batch merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillstack.operators.ingest import not_done, upsert_pending
from quillstack.schema import BOOKMARK
from quillstack.sources.bookmarks import to_rows


def start(spark: SparkSession, folder: str, table_path: str, checkpoint: str, retry_failed: bool = False) -> StreamingQuery:
    """Merges CSV exports dropped in `folder` into versions of the table under `table_path`; a batch seen twice changes nothing.

    A stream has one schema: exports whose header differs from it fail the query.
    """
    exports = spark.readStream.schema(BOOKMARK).options(header=True, multiLine=True, escape='"', mode="FAILFAST", enforceSchema=False).csv(folder).select("*", F.col("_metadata.file_path").alias("_file"))

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        before = session.read.parquet(f"{table_path}/version={number}")
        fresh = not_done(to_rows(batch.na.fill("")), before, retry_failed)
        upsert_pending(before, fresh).select(*before.columns).write.mode("overwrite").parquet(f"{table_path}/version={number + 1}")

    return exports.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
