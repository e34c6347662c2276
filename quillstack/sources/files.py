"""Texts of articles as one file each, in a folder that all executors reach."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_texts(articles: DataFrame, folder: str) -> DataFrame:
    """Writes `content` of each row of `articles` (filename, content) to its file under `folder` (a URI); filename and bytes of each.

    Files are written when the result is. A task that runs again writes the same files again; rows without a
    file name or content have no file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for b in batches:
            sizes = []
            for name, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                with store.open_output_stream(f"{root}/{name}", compression=None) as f:
                    f.write(data)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], names=["filename", "bytes"])

    return articles.where("filename IS NOT NULL AND content IS NOT NULL").select("filename", "content").mapInArrow(run, "filename string, bytes long")


def read_texts(spark, folder: str) -> DataFrame:
    """filename and content of the text files of a folder."""
    held = spark.read.text(folder, wholetext=True)
    return held.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("filename"), F.col("value").alias("content"))
