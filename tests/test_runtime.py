"""Shared folder, batches and bit maps."""

from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from termweave import runtime


def test_a_cluster_needs_a_shared_folder():
    session = lambda master, root: SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: root), sparkContext=SimpleNamespace(master=master))
    with pytest.raises(ValueError, match="checkpoint"):
        runtime.shared_root(session("spark://host:7077", None))
    assert runtime.shared_root(session("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y"
    assert runtime.shared_root(session("local[4]", None)).startswith("file://")


def test_tables_are_kept_until_they_are_forgotten(spark):
    rows = spark.range(10).withColumn("part", F.col("id") % 3)
    for parts in ((), ("part",)):
        kept = runtime.materialize(rows, "test", *parts)
        assert sorted(map(tuple, kept.select("id", "part").collect())) == sorted(map(tuple, rows.collect()))
        path = kept.inputFiles()[0]
        runtime.forget(kept)
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        assert not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def test_pieces_are_bounded_and_whole():
    b = pa.RecordBatch.from_pydict({"x": list(range(1000)), "t": ["y" * 100] * 1000})
    for rows, size in ((512, 1 << 20), (512, 5000), (1, 1), (5000, 1 << 30)):
        cut = list(runtime.pieces(iter([b, b]), rows, size))
        assert [x for p in cut for x in p.column(0).to_pylist()] == list(range(1000)) * 2
        assert all(p.num_rows <= rows and (p.num_rows == 1 or p.nbytes <= 2 * size) for p in cut)
    assert list(runtime.pieces(iter([b.slice(0, 0)]))) == []


@pytest.mark.parametrize("bits", [1 << 12, 1 << 26])
def test_a_bit_map_loses_no_row(spark, bits):
    wanted = runtime.materialize(spark.range(0, 5000, 7).toDF("key"), "wanted")
    rows = spark.range(20_000).select((F.col("id") - 5000).alias("doc"), F.lit("x").alias("t"))
    found = {r["doc"] for r in runtime.maybe_in(rows, "doc", wanted, bits).collect()}
    assert set(range(0, 5000, 7)) <= found <= set(range(-5000, 15_000))
    assert bits < 1 << 20 or len(found) < 1100
    assert runtime.maybe_in(rows, "doc", wanted.limit(0)).count() == 0


def test_batch_size_comes_back(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with pytest.raises(KeyError), runtime.arrow_rows(spark, 7):
        assert spark.conf.get(key) == "7"
        raise KeyError
    assert spark.conf.get(key) == before
