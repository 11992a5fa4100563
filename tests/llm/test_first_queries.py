"""Each registered query against its SQL, on the smallest tables."""

import pytest

from termweave.llm import queries


def _plain(rows, columns):
    return sorted([tuple(round(r[c], 6) if isinstance(r[c], float) else r[c] for c in columns) for r in rows], key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir)
    want = duck.execute(queries.ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert _plain([r.asDict() for r in got.collect()], columns) == _plain(want.to_dict("records"), columns)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_has_rows(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0
