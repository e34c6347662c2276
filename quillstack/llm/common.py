"""What the operators share: the shared work folder, row keys, size checks."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of every contract: runs of anything but ASCII white space.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A side of at most so many narrow rows (under 100 bytes each, so under 5 MB) may be broadcast.
BROADCAST_ROWS = 50_000
#: Bytes of the wide column of such a side, at most.
BROADCAST_BYTES = 16 << 20
#: Rows of an Arrow batch at most.
BATCH_ROWS = 1_000

#: Spark's own setting for shuffle files to go when an execution ends.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir`.

    Where it is unset, a temporary folder on a local master and the warehouse elsewhere.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local["):
        key = spark.sparkContext.applicationId
        if key not in _local_dirs:
            _local_dirs[key] = "file://" + tempfile.mkdtemp(prefix="quillstack-")
        return _local_dirs[key]
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted when the JVM ends."""
    path = f"{shared_dir(spark)}/quillstack/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a written table that no later step reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Cuts the lineage: writes `df` to the shared folder as Parquet; the table read back, and its path.

    Its shuffle files are deleted when it is written: a collection alone leaves the last ones until the next job.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    with setting(spark, SHUFFLES_GO, True):
        df.write.option("compression", "zstd").parquet(path)
    trim(spark)
    return spark.read.schema(df.schema).parquet(path), path


def trim(spark: SparkSession) -> None:
    """Gives the system back what the driver has freed beside its heap.

    The C library keeps it for each thread, so that it grows with every step. A JVM that has no command for this keeps it.
    """
    pa.default_memory_pool().release_unused()
    jvm, new_array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    of, lang = jvm.java.lang.Class.forName, jvm.java.lang
    # The server's own class is not open to py4j, so the method is taken from the interface.
    kinds, given = new_array(lang.Class, 4), new_array(lang.Object, 4)
    for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = of(kind)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    given[2], given[3] = new_array(lang.Object, 0), new_array(lang.String, 0)
    with contextlib.suppress(Py4JJavaError):
        of("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), given)


def release(spark: SparkSession) -> None:
    """Has the driver's JVM collect, so that the shuffle files of finished steps are deleted, and gives freed memory back."""
    spark.sparkContext._jvm.java.lang.System.gc()
    trim(spark)


def cut(df: DataFrame, label: str) -> DataFrame:
    return written(df, label)[0]


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: object) -> Iterator[None]:
    """A setting of the session for what runs within."""
    before = spark.conf.get(name)
    spark.conf.set(name, str(value).lower() if isinstance(value, bool) else str(value))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def batches_of(spark: SparkSession, rows: int) -> contextlib.AbstractContextManager[None]:
    """Arrow batches of `rows` narrow rows for what runs within."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def _reads_files(df: DataFrame) -> bool:
    """Whether `df` is a file table under projections and filters only, so that a row comes from one place in a file."""
    node = df._jdf.queryExecution().analyzed()
    if not node.deterministic():
        return False
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    return node.nodeName() == "LogicalRelation" and "HadoopFsRelation" in node.relation().getClass().getName()


def small_batches(spark: SparkSession) -> None:
    """Sends texts to Python workers 1,000 at a time at most, unless the session asks for fewer: batches of the
    default 10,000 long texts would fill a worker's memory. Holds for the session, as plans run later."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def spread(df: DataFrame, source: DataFrame) -> DataFrame:
    """`df`, a projection of a file table `source`, dealt over all cores if its files make fewer tasks than there are.

    Tables of a real size make more, and are left where they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if _reads_files(source) and source._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def keyed(df: DataFrame, *columns: Column) -> DataFrame:
    """`columns` of `df` under a row key (_f, _r) that stays the same when the rows are read again.

    Rows of file tables are keyed by file and position, so nothing is copied. Anything else is
    numbered and written once.
    """
    small_batches(df.sparkSession)
    if _reads_files(df) and "_metadata" not in df.columns:
        return df.select(
            F.xxhash64("_metadata.file_path").alias("_f"), F.col("_metadata.row_index").alias("_r"), *columns
        )
    return cut(df.select(F.lit(0).cast("long").alias("_f"), F.monotonically_increasing_id().alias("_r"), *columns), "keyed")


def stable(df: DataFrame) -> DataFrame:
    """`df`, written first unless it reads files only: rows then have the same key in every step that takes it."""
    return df if _reads_files(df) and "_metadata" not in df.columns else cut(df, "rows")


def rows_picked(df: DataFrame, picks: DataFrame) -> DataFrame:
    """The rows of a stable `df` under the keys (_f, _r) of `picks`, as often as they are picked, with all their columns."""
    return keyed(df, F.struct("*").alias("row")).join(picks.select("_f", "_r"), ["_f", "_r"]).select("row.*")


def rows_left(df: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of a stable `df` but those under the keys of `gone`."""
    keys = if_small(cut(gone.select("_f", "_r"), "gone"))
    return keyed(df, F.struct("*").alias("row")).join(keys, ["_f", "_r"], "left_anti").select("row.*")


def is_small(df: DataFrame, text: Column | None = None) -> bool:
    """Whether a written table has few enough rows for a broadcast, and few enough bytes in its one wide column, if it has one."""
    few = df.limit(BROADCAST_ROWS + 1)
    n, wide = few.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.lit("") if text is None else text)), F.lit(0))).first()
    return n <= BROADCAST_ROWS and wide <= BROADCAST_BYTES


def if_small(df: DataFrame, text: Column | None = None) -> DataFrame:
    """`df`, a written table, marked for broadcast when it is small; else joins shuffle."""
    return F.broadcast(df) if is_small(df, text) else df


def joined(rows: DataFrame, side: DataFrame, keys: list[str], n: str, how: str = "inner", text: Column | None = None, most: int = 2_000, keep: bool = False) -> DataFrame:
    """`rows` with the columns of a written `side` by `keys`, without a hot key; how: inner or left.

    `n` is a column of `side`: how many of `rows` have the key, or what rises with that; it is left out of the
    result unless it is to be kept. A small side is broadcast. Of a larger one the keys with most rows are
    broadcast, at most `most` of them, and the others shuffle.
    """
    given = side if keep else side.drop(n)
    if is_small(side, text):
        return rows.join(F.broadcast(given), keys, how)
    least = ladder(side, n, most)
    hot, others = F.broadcast(given.where(F.col(n) >= least)), given.where(F.coalesce(F.col(n), F.lit(0)) < least)
    rest = rows.join(F.broadcast(hot.select(*keys).distinct()), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(others, keys, how))


def ladder(df: DataFrame, column: str, most: int) -> int:
    """The least step of a ladder from which on at most `most` rows have that much in `column`."""
    steps = sorted({int(2 ** (i / 2)) for i in range(100)})
    sizes = df.agg(*[F.count_if(F.col(column) >= x) for x in steps]).first()
    return next((x for x, n in zip(steps, sizes, strict=True) if n <= most), steps[-1] * 2)


def lower_ascii(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def bucket(id_column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Memo(dict):
    """Values of short strings by `make`. Two generations of at most `limit` entries, so what is asked for often stays."""

    def __init__(self, make: Callable, limit: int):
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


_memos: dict[str, dict] = {}


def worker_memo(key: str, build: Callable[[], dict]) -> dict:
    """The memo or table that the tasks of one Python worker share for `key`; an earlier key's is dropped."""
    from quillstack.llm.common import _memos  # the module's own, not the copy that was sent with a function

    if key not in _memos:
        _memos.clear()
        _memos[key] = build()
    return _memos[key]


def drop_memos() -> None:
    """Frees what earlier operators left in this worker."""
    from quillstack.llm.common import _memos

    _memos.clear()


def texts_of(column: pa.Array) -> Iterator[str | None]:
    """The values of a column, a few hundred at a time in Python."""
    for at in range(0, len(column), 256):
        yield from column.slice(at, 256).to_pylist()
