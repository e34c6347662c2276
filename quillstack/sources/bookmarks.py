"""The bookmark export, and the driver's tables seen as an archive."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.functions.text import word_count
from quillstack.schema import ARCHIVED, BOOKMARK, FAILED, PENDING, SUCCESS


def read_bookmarks(spark: SparkSession, path: str) -> DataFrame:
    """A CSV export, bound by header names, with the file of each row as `_file`. Empty fields are empty strings; a malformed row fails the load."""
    options = {"header": True, "multiLine": True, "escape": '"', "mode": "FAILFAST", "enforceSchema": False}
    header = spark.read.options(**options).csv(path).columns
    missing = [c for c in BOOKMARK.fieldNames() if c not in header]
    if missing:
        raise ValueError(f"{path}: columns {', '.join(missing)} are missing; expected {', '.join(BOOKMARK.fieldNames())}")
    raw = spark.read.options(**options).schema(", ".join(f"`{c}` string" for c in header)).csv(path)
    return raw.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in BOOKMARK.fieldNames()], F.col("_metadata.file_path").alias("_file"))


def write_bookmarks(bookmarks: DataFrame, path: str) -> None:
    """An export that `read_bookmarks` reads back as it was."""
    bookmarks.select(*BOOKMARK.fieldNames()).write.options(header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share, deleted when the JVM ends."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def to_rows(bookmarks: DataFrame) -> DataFrame:
    """url, title, folder, timestamp (null if it is no number), tags of an export, and ord: its order, by file and row.

    Files of several lines a record are read whole by one task, so the numbers of a file's rows rise.
    """
    file = F.col("_file") if "_file" in bookmarks.columns else F.lit("")
    stamp = F.when(F.col("Timestamp").rlike("^[+-]?[0-9]+$"), F.expr("try_cast(Timestamp AS bigint)"))
    return bookmarks.select(
        F.struct(file.alias("file"), F.monotonically_increasing_id().alias("row")).alias("ord"), F.col("URL").alias("url"), F.col("Title").alias("title"), F.col("Folder").alias("folder"), stamp.alias("timestamp"), F.col("Tags").alias("tags")
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as articles; the status comes from `labels`."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    status = (
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), SUCCESS).when(F.col("quality") == 1, ARCHIVED).when(F.col("quality") == 0, FAILED).otherwise(PENDING)
    )
    return docs.select(
        F.col("doc_id").alias("id"), F.concat(F.lit("https://"), "source", F.lit(".example/"), "doc_id").alias("url"),
        F.substring(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1), 1, 80).alias("title"), F.col("source").alias("folder"), F.col("lang").alias("tags"),
        status.alias("status"), F.when(status == FAILED, F.concat(F.lit("no content: "), "doc_id")).alias("error_message"), F.col("text").alias("content"), word_count(F.col("text")).alias("word_count"),
    )
