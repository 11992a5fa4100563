"""The driver contract, with the corpus operators and without them."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from termweave.plans import details as linker
from termweave.plans import queries
from termweave.runtime import materialize

SF = "/root/testdata/sf0.001"


def _plain(rows, columns):
    return sorted([tuple(round(r[c], 5) if isinstance(r[c], float) else r[c] for c in columns) for r in rows], key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(linker.Q))
def test_linker_query(spark, duck, name):
    got = linker.Q[name](spark, SF)
    if name not in linker.SQL:
        assert got.count() > 0
        return
    want = duck.execute(linker.SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert _plain([r.asDict() for r in got.collect()], columns) == _plain(want.to_dict("records"), columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_the_rest_stands_without_the_corpus_operators(tmp_path):
    root = Path(__file__).resolve().parent.parent
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "termweave", tmp_path / "termweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') or q == 'pipeline' for q in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.stdout.split() == [str(len(linker.Q)), "False"], out.stderr


def test_coherence_rank_takes_every_candidate(spark, tmp_path):
    """Of four names with the same letters the last by name is the popular one."""
    names = ["abcd", "abdc", "acbd", "dcba", "wxyz"]
    lines = [(k, 4, 1, 1) for k in range(30)] + [(k, 5, 1, 2) for k in range(30)] + [(30 + k, k + 1, 1, 1) for k in range(3)]
    tables = {
        "part": spark.createDataFrame(list(enumerate(names, 1)), "p_partkey long, p_name string"),
        "lineitem": spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int"),
        "supplier": spark.createDataFrame([(1, 1)], "s_suppkey long, s_nationkey long"),
        "nation": spark.createDataFrame([(1, "N")], "n_nationkey long, n_name string"),
    }
    for name, frame in tables.items():
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    won = {r["entity"] for r in __spark_entry__.queries()["coherence_rank"](spark, str(tmp_path)).where("mention = 'dcba' and rank = 1").collect()}
    assert won == {"dcba"}


@pytest.mark.parametrize("odd", [False, True])
def test_coherence_rank_writes_no_row_for_each_line(spark, tmp_path, monkeypatch, odd):
    """What is written has a row for each kind of order; rows are those of the joins, where keys or names are missing too."""
    names = ["abcd", "abdc", "acbd", "dcba", "wx yz", "yz wx", "abce"] + [None] * odd
    lines = [(r, (r % 10 * 7 + k * k) % 9 + 1, 1, k) for r in range(300) for k in range(r % 10 % 6 + 1)] + [(777, k % 7 + 1, k, 1) for k in range(30)]
    lines += [(None, 1, 1, 1), (None, 2, 1, 2), (900, None, 1, 1), (900, 3, 1, None), (901, None, 1, 1)] * odd
    tables = {
        "part": spark.createDataFrame(list(enumerate(names, 1)) + [(None, "abcd")] * odd, "p_partkey long, p_name string"),
        "lineitem": spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int"),
        "supplier": spark.createDataFrame([(1, 1)], "s_suppkey long, s_nationkey long"),
        "nation": spark.createDataFrame([(1, "N")], "n_nationkey long, n_name string"),
    }
    for name, frame in tables.items():
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    written = []
    monkeypatch.setattr(queries, "materialize", lambda df, *at: written.append(materialize(df, *at)) or written[-1])
    got = __spark_entry__.queries()["coherence_rank"](spark, str(tmp_path))
    rows = sorted(got.collect())
    assert len(rows) > 1000 and sum(d.count() for d in written) < 100
    monkeypatch.setattr(queries, "HELD_PARTS", 0)
    joined = __spark_entry__.queries()["coherence_rank"](spark, str(tmp_path))
    assert got.dtypes == joined.dtypes and rows == sorted(joined.collect())


def test_coherence_rank_where_parts_share_a_key(spark, tmp_path):
    """A line is one of each part of its key."""
    tables = {
        "part": spark.createDataFrame([(1, "abcd"), (1, "wxyz"), (2, "abdc")], "p_partkey long, p_name string"),
        "lineitem": spark.createDataFrame([(1, 1, 1, 1), (1, 2, 1, 2)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int"),
        "supplier": spark.createDataFrame([(1, 1)], "s_suppkey long, s_nationkey long"),
        "nation": spark.createDataFrame([(1, "N")], "n_nationkey long, n_name string"),
    }
    for name, frame in tables.items():
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    said = {(r["slot"], r["mention"]) for r in __spark_entry__.queries()["coherence_rank"](spark, str(tmp_path)).collect()}
    assert said == {(0, "abcd"), (0, "wxyz"), (1, "bdc")}
