import math

import numpy as np
import pytest

from termweave.llm import embedding_dedup as ed

from .test_simhash import brute_components


def brute(rows, threshold=0.93):
    def good(v, label):
        return label is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    ok = [k for k, (_, v, label) in enumerate(rows) if good(v, label)]
    links = []
    for a in ok:
        for b in ok:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = ed.unit_rows(np.array([rows[a][1], rows[b][1]], float))
                if float(x @ y) >= threshold:
                    links.append((a, b))
    comp = brute_components(links, range(len(rows)))
    out = []
    for k, (i, _, _) in enumerate(rows):
        low = min((rows[j][0] for j in range(len(rows)) if comp[j] == comp[k] and rows[j][0] is not None), default=None)
        out.append((i, sum(k in x for x in links), low, i is not None and i == low))
    return sorted(out, key=str)


def test_bound_never_rules_out_a_link():
    rng = np.random.default_rng(0)
    for dim in (1, 2, 64, 1500):
        x = ed.unit_rows(rng.normal(size=(60, dim)) + 2 * rng.normal(size=(1, dim)))
        codes, scale, length, error = ed.quantise(x)
        rough = ed.int8_products(codes, codes) * (scale[:, None] * scale)
        assert (np.abs(x @ x.T - rough) <= error[:, None] + length[:, None] * error + 1e-9).all()


def test_few_pairs_are_recomputed():
    x = np.random.default_rng(1).normal(size=(2000, 64))
    i, _, tried = ed.tile_links(x, None, 0.5)
    assert tried < 5 * len(i) + 2000


@pytest.mark.parametrize("tile", [4096, 16])
def test_links_equal_brute_force(spark, sf_dir, tile):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    rows += [(900_001, [0.0] * 64, 1), (900_002, None, 1), (900_003, [float("nan")] * 64, 1), (900_004, [1.0, None], 1), (900_005, [1.0], 1), (900_006, [2.0], 1), (900_007, [-0.0, 1.0], 1), (900_008, [0.0, 1.0], 1), (900_009, [float("inf"), 1.0], 1), (900_010, [1.0, 1.0], None), (None, [1.0], 1), (900_011, [], 1), (900_012, [1e30, 1e-30], 1), (900_013, [1e-30, 0.0], 1)]
    got = ed.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), tile=tile).collect()
    assert sorted(map(tuple, got), key=str) == brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows])


def test_clashing_names_and_empty_table(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "a", 5, 6), (2, [2.0, 0.01], "a", 5, 6), (3, [0.0, 1.0], "a", 5, 6)], "vec_id long, embedding array<double>, label string, n_links int, cls int")
    assert sorted(map(tuple, ed.link_vectors(rows).collect())) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
    assert ed.link_vectors(rows.limit(0)).count() == 0
