import hashlib
from collections import Counter

import numpy as np

from termweave.llm import line_dedup


def brute(rows, min_docs):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    split = [(i, (x or "").split("\n")) for i, x in rows]
    n = Counter(k for _, lines in split for k in {key(x) for x in lines})
    gone = {k for k, c in n.items() if k and c >= min_docs}
    out = []
    for i, lines in split:
        kept = [x for x in lines if key(x) not in gone]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_perfect_hash_is_minimal_and_exact():
    h = np.random.default_rng(1).integers(0, 2**64, (5000, 2), dtype=np.uint64)
    h[1] = (h[0, 0], h[0, 1] + np.uint64(1))  # hashes that share a half
    p = line_dedup.PerfectHash.build(h)
    assert sorted(p.slots(h).tolist()) == list(range(5000))
    assert line_dedup.PerfectHash.build(h[:0]).slots(h).max() == -1


def test_both_ways_of_probing_equal_brute_force(spark, odd_docs, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for frame, least in ((odd_docs, 2), (docs, 10), (docs, 3)):
        want = brute([(r["doc_id"], r["text"]) for r in frame.collect()], least)
        for held in (1 << 25, -1):
            got = line_dedup.digest_lines(frame, min_docs=least, index_bytes=held).collect()
            assert sorted(map(tuple, got), key=str) == want


def test_texts_and_other_columns(spark, odd_docs, no_docs):
    for held in (1 << 25, -1):
        kept = line_dedup.drop_shared_lines(odd_docs, min_docs=2, index_bytes=held)
        assert kept.columns == odd_docs.columns
        assert {r["text"] for r in kept.where("doc_id in (10, 11)").collect()} == {""}
        assert line_dedup.drop_shared_lines(no_docs, index_bytes=held).count() == 0


def test_rows_that_repeat_a_document_count_once(spark):
    rows = [(1, "a\nx")] * 5 + [(2, "a\ny"), (None, "b"), (None, "b"), (3, "c"), (3, "c\nd")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    dropped = {(r["doc_id"], r["n_lines"], r["n_dropped"]) for r in line_dedup.digest_lines(docs, min_docs=2).collect()}
    assert dropped == {(1, 2, 1), (2, 2, 1), (None, 1, 1), (3, 1, 0), (3, 2, 0)}
    assert {r["text"] for r in line_dedup.drop_shared_lines(docs, min_docs=2).collect()} == {"x", "y", "", "c", "c\nd"}


def test_very_long_texts_in_pieces(spark):
    """More lines than a batch of the routed probe holds."""
    docs = spark.createDataFrame([(k, "\n".join(["same", *(f"{k}-{n}" for n in range(70_000))] + ["same"])) for k in range(2)], "doc_id long, text string")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], 2)
    for held in (1 << 25, -1):
        assert sorted(map(tuple, line_dedup.digest_lines(docs, min_docs=2, index_bytes=held).collect()), key=str) == want


def test_hot_shards_are_split(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(line_dedup, "PART_LINES", 7)
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 5)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], 3)
    assert sorted(map(tuple, line_dedup.digest_lines(docs, min_docs=3, index_bytes=-1).collect()), key=str) == want
