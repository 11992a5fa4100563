"""The pipeline against a brute-force version of each stage, stage by stage."""

import hashlib
from collections import Counter

import corpus_pipeline as cp

from . import test_bpe, test_line_dedup, test_simhash
from termweave.llm import quality, simhash


def test_stages(spark, sf_dir):
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "source_mix", "byte_bpe"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    frames = [docs]
    for _, stage in cp.STAGES[:-1]:
        frames.append(cp.materialize(stage(spark, frames[-1], sf_dir), "test"))
        assert frames[-1].columns == docs.columns
    raw, good, lines, near, mixed = [f.collect() for f in frames]
    assert sorted(good) == sorted(r for r in raw if not any(x.rejects(quality.TextView(r["text"])) for x in quality.RULES))
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower()
    n = Counter(k for r in good for k in {key(x) for x in r["text"].split("\n")})
    want = {r["doc_id"]: "\n".join(x for x in r["text"].split("\n") if not key(x) or n[key(x)] < 10) for r in good}
    assert {r["doc_id"]: r["text"] for r in lines} == want and all(r["n_chars"] == len(r["text"]) for r in lines)
    assert len(test_line_dedup.brute([(r["doc_id"], r["text"]) for r in good], 10)) == len(lines)
    groups = test_simhash.brute_groups([(r["doc_id"], r["text"]) for r in lines])
    assert {r["doc_id"] for r in near} == {i for i, _, c in groups if i == c}
    times = Counter(r["doc_id"] for r in mixed)
    assert set(times) <= {r["doc_id"] for r in near} and max(times.values()) <= 2
    other = test_bpe.library()
    ids = [(r["doc_id"], other.encode_ordinary(r["text"]), r["text"]) for r in mixed]
    want = sorted((i, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, x, t in ids)
    assert sorted(map(tuple, cp.run(spark, sf_dir).collect())) == want


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    """Every stage on null and empty texts, repeated rows and columns of its own names."""
    names = {n for n, _ in cp.STAGES}
    assert len(names) == 5
    good = "The quick brown fox jumps over the lazy dog while seven small birds sing near an old stone bridge at dawn today."
    more = spark.createDataFrame([(50, good, "a", 1, "x"), (50, good, "a", 1, "x"), (51, good, None, None, None)], odd_docs.schema)
    odd = odd_docs.unionByName(more).selectExpr("*", "cast(length(text) as int) as n_chars")
    for docs in (odd, odd.limit(0)):
        for _, stage in cp.STAGES[:-1]:
            docs = cp.materialize(stage(spark, docs, ""), "odd")
            assert docs.columns == odd.columns
        left = cp.STAGES[-1][1](spark, docs, "").collect()
        assert {r["doc_id"] for r in left} <= {50, 51}
    for _, stage in cp.STAGES:  # each on what another did not clean
        stage(spark, odd, "").count()


def test_third_stage_sends_no_index_rows_through_the_driver(spark, sf_dir, monkeypatch):
    """A fingerprint has 43 index rows on average, which Spark's estimate leaves out; where it broadcasts them the driver's memory ends."""
    plans, components = [], simhash.connected_components

    def seen(edges):
        plans.append(edges._jdf.queryExecution().executedPlan().toString())
        return components(edges)

    monkeypatch.setattr(simhash, "connected_components", seen)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert dict(cp.STAGES)["simhash_near_dedup"](spark, docs, sf_dir).count() <= docs.count()
    assert len(plans) == 1 and "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]
