import random

import numpy as np
import pytest
import xxhash

from termweave.llm import simhash
from termweave.llm.components import connected_components
from termweave.runtime import materialize


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(links, vertices):
    root = {v: v for v in vertices}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {v: find(v) for v in vertices}


def brute_groups(rows):
    fp = [(i, brute_fingerprint(x)) for i, x in rows]
    links = [(a, b) for a in range(len(fp)) for b in range(a) if (fp[a][1] ^ fp[b][1]).bit_count() <= 3]
    comp = brute_components(links, range(len(fp)))
    low = {}
    for k, c in comp.items():
        if fp[k][0] is not None:
            low[c] = min(low.get(c, 1 << 60), fp[k][0])
    return sorted([(i, f"{f:016x}", low.get(comp[k])) for k, (i, f) in enumerate(fp)], key=str)


def test_golay_code_is_perfect():
    weights = [bin(int(e)).count("1") for e in simhash.LEADER]
    assert len(set(simhash.LEADER.tolist())) == 2048 and max(weights) == 3
    word = np.random.default_rng(0).integers(0, 1 << 23, 2000)
    near = simhash.nearby_indices(word)
    assert set((near >= 0).sum(1).tolist()) == {1, 6}
    for flip in range(23):  # a word one error away is asked for under a key that is indexed
        asked = simhash.codeword_index(word ^ (1 << flip))
        assert (near == asked[:, None]).any(1).all()


def test_index_rows_are_not_broadcast(spark):
    """A class has 43 index rows, which Spark's estimate from the classes leaves out."""
    found = simhash.fuzzy_links(materialize(spark.createDataFrame([(f,) for f in range(8)], "fp long"), "test"))
    assert found.count() == 28
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_links_are_all_pairs_within_three_bits(spark):
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(40)]
    fps = {f ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 4))) for f in base for _ in range(20)} | {0, 1, (1 << 64) - 1}
    signed = {f - (1 << 64) if f >> 63 else f for f in fps}
    got = simhash.fuzzy_links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert {(r["src"], r["dst"]) for r in got} == want and len(got) == len(want)
    with pytest.raises(ValueError, match="3"):
        simhash.fuzzy_links(spark.createDataFrame([], "fp long"), 4)


def test_groups_equal_brute_force(spark, odd_docs, no_docs, sf_dir):
    for frame in (odd_docs, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        got = simhash.group_documents(frame).collect()
        assert sorted(map(tuple, got), key=str) == brute_groups([(r["doc_id"], r["text"]) for r in frame.collect()])
    assert simhash.group_documents(no_docs).count() == 0
    assert simhash.drop_near_duplicates(no_docs).count() == 0


def test_one_of_each_group_stays(spark, odd_docs):
    kept = simhash.drop_near_duplicates(odd_docs)
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert kept.columns == odd_docs.columns and len(ids) == len(set(ids)) and None in ids
    assert {0, 4, 5} <= set(ids) and not {1, 2, 3} & set(ids)


def test_components_equal_union_find(spark):
    rnd = random.Random(2)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(5001, 5100)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(links, "src long, dst long")).collect()}
    vertices = {v for a, b in links if a != b for v in (a, b)}
    assert got == brute_components([x for x in links if x[0] != x[1]], vertices)
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
