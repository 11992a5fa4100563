"""Where intermediate tables go, and how lineage is cut.

Everything that executors must see again goes to the folder that the session's ``spark.checkpoint.dir``
names; that folder is shared by the whole cluster. Only where the setting is missing and all executors run in this
process (a local master: tests, a laptop) is a folder of this process made. Tables are written by Spark's own
committers, so a lost executor costs a retried task, never a result. What ``forget`` has not removed goes when
the process ends.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_root: str | None = None
_used: set[tuple[str, str]] = set()
MOST_BITS = 1 << 26


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder, or one of this process where none is configured."""
    global _own_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if _own_root is None:
        _own_root = tempfile.mkdtemp(prefix="termweave-")
        atexit.register(shutil.rmtree, _own_root, ignore_errors=True)
    return "file://" + _own_root


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    folder = f"{shared_root(spark)}/termweave/{spark.sparkContext.applicationId}"
    if not _used:
        atexit.register(_leave)
    _used.add((spark.sparkContext.applicationId, folder))
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def _leave() -> None:
    """Remove the folders of the session that is still there when the process ends."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        with contextlib.suppress(Exception):  # Spark may have ended before
            for app, folder in _used:
                if app == spark.sparkContext.applicationId:
                    delete_path(spark, folder)


def materialize(df: DataFrame, name: str, *parts: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder, in folders by ``parts``, and return a frame that reads it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.partitionBy(*parts).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a path that ``new_path`` gave."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def forget(df: DataFrame) -> None:
    """Remove the files of a frame made by ``materialize`` that nothing will read again."""
    spark = df.sparkSession
    tops = {"/".join(f.split("/")[: f.split("/").index("termweave") + 3]) for f in df.inputFiles() if "/termweave/" in f}
    for top in tops:
        delete_path(spark, top)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches``, at most ``rows`` at once and, by a batch's average, ``size`` bytes, so that long texts don't pile up in a worker.

    Spark itself bounds the bytes of the batches it sends.
    """
    for b in batches:
        step = max(1, min(rows, size * b.num_rows // max(1, b.nbytes)))
        for k in range(0, b.num_rows, step):
            yield b.slice(k, step)


def maybe_in(df: DataFrame, column: str, wanted: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """The rows of ``df`` whose ``column`` is in ``wanted`` (one column, in a table), and by chance a few others.

    A bit map of at most ``most_bits`` bits, which is what is broadcast, tells them without moving a row; the more is wanted
    beyond that, the more others come along. A join after this decides.
    """
    (key,) = wanted.columns
    bits = 1 << 12
    n = wanted.count()
    while bits < min(64 * n, most_bits):
        bits *= 2
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    spots = wanted.select(place(key).alias("_bit")).selectExpr("_bit div 64 as _word", "shiftleft(1L, cast(_bit % 64 as int)) as _bits")
    words = spots.groupBy("_word").agg(F.expr("bit_or(_bits)").alias("_bits"))
    held = df.withColumn("_bit", place(column)).join(F.broadcast(words), F.expr("_bit div 64 = _word"))
    return held.where("_bits & shiftleft(1L, cast(_bit % 64 as int)) != 0").select(*df.columns)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run inside get Arrow batches of at most ``rows`` rows; the session's own setting comes back after them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
