import random

import numpy as np
import pytest

from termweave.llm import substring_dedup as sd


def words(rnd, n):
    return [f"w{rnd.randrange(100000)}" for _ in range(n)]


def grams(x):
    w = x.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_line_cuts(docs, threshold=0.8, least=sd.MIN_WORDS):
    """(doc, first word) of every line in a component of similar lines, but for its first place."""
    places = []
    for i, text in docs:
        at = 0
        for line in (text or "").split("\n"):
            n = len(line.encode().split())
            if n >= least:
                places.append((i, at, grams(line)))
            at += n
    root = list(range(len(places)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in range(len(places)):
        for b in range(a):
            x, y = places[a][2], places[b][2]
            if len(x & y) >= threshold * len(x | y):
                root[max(find(a), find(b))] = min(find(a), find(b))
    first = {}
    for k, (i, at, _) in enumerate(places):
        first[find(k)] = min(first.get(find(k), (i, at)), (i, at))
    return {(i, at) for k, (i, at, _) in enumerate(places) if (i, at) != first[find(k)]}


def test_bands_meet_both_rates():
    bands, rows = sd.tune_bands()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and 1 - (1 - 0.3**rows) ** bands <= 0.25
    with pytest.raises(ValueError, match="rates"):
        sd.tune_bands(0.5, 0.9999, 0.49, 0.01)


def test_anchors_follow_the_passage_and_not_its_place():
    rnd = random.Random(7)
    for _ in range(200):
        passage = words(rnd, 51)
        found = []
        for before in (words(rnd, rnd.randint(0, 40)), words(rnd, rnd.randint(0, 40))):
            h = sd.word_hashes([w.encode() for w in before + passage + words(rnd, 40)])
            at = sd.anchors(h) - len(before)
            found.append({a for a in at.tolist() if sd.RADIUS <= a <= 51 - sd.WINDOW})
        assert found[0] == found[1]
    assert len(sd.anchors(np.zeros(500, np.uint64))) == 499


def test_sketches_never_differ_by_more_than_the_sets():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[k:], rng.integers(0, 2**64, k, dtype=np.uint64)])) for k in range(40)]
    sketch = sd.parity_sketch(sets)
    for a in range(40):
        for b in range(40):
            apart = len(np.setxor1d(sets[a], sets[b]))
            seen = int(np.bitwise_count(sketch[a] ^ sketch[b]).sum())
            assert seen <= apart and (seen - apart) % 2 == 0


def test_lines_equal_brute_force(spark, sf_dir):
    rnd = random.Random(3)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    base = words(rnd, 80)
    for k in range(30):  # a chain of edits: links need not go through the first
        base[rnd.randrange(80)] = f"edit{k}"
        docs.append((10_000 + k, "head\n" + " ".join(base) + "\n" + " ".join(words(rnd, 25))))
    found = sd.repeated_spans(spark.createDataFrame(docs, "doc_id long, text string"), recall=0.999999, within=True).collect()
    spans = {r["doc_id"]: r["spans"] for r in found}
    want = brute_line_cuts(docs)
    for i, at in want:
        assert any(s["start"] <= at < s["stop"] for s in spans[i]), (i, at)
    lines = {}
    for i, text in docs:
        at = 0
        for line in (text or "").split("\n"):
            lines[i, at] = len(line.encode().split())
            at += lines[i, at]
    assert len(want) > 40
    assert not any(spans[i] for i in spans if i >= 10_000 and not any(d == i for d, _ in want))


def test_passages_inside_lines_are_caught_and_others_left(spark):
    rnd = random.Random(11)
    passage, missed = words(rnd, 52), 0
    docs = []
    for k in range(60):
        w = words(rnd, 150)
        if k % 2:
            at = rnd.randrange(150)
            w[at:at] = passage
        docs.append((k, " ".join(w)))
    rows = {r["doc_id"]: r for r in sd.repeated_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for k in range(60):
        n = sum(s["stop"] - s["start"] for s in rows[k]["spans"])
        if k % 2 == 0 or k == 1:
            assert n == 0
        else:
            missed += n < 20
            assert n <= 52
    assert missed == 0
    kept = sd.drop_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: len(r["text"].split()) for r in kept}[3] == 202 - sum(s["stop"] - s["start"] for s in rows[3]["spans"])


def test_repeats_within_a_document(spark):
    rnd = random.Random(9)
    line, other = " ".join(words(rnd, 40)), " ".join(words(rnd, 40))
    docs = spark.createDataFrame([(1, f"{line}\n{other}\n{line}"), (2, "tick " * 600), (3, "tick tock " * 300), (4, "new " + "tick " * 500), (5, other + " " + "tock tick " * 100)], "doc_id long, text string")
    cut = lambda within: {r["doc_id"]: sum(s["stop"] - s["start"] for s in r["spans"]) for r in sd.repeated_spans(docs, within=within).collect()}
    across, all_ = cut(False), cut(True)
    assert across[1] == across[2] == across[3] == 0 and across[4] >= 490 and across[5] >= 215
    assert all_[1] == 40 and all_[2] >= 570 and all_[3] >= 570


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    rows = sd.count_repeats(odd_docs).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted({r["doc_id"] for r in odd_docs.collect()} - {None})
    kept = sd.drop_repeats(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert sd.count_repeats(no_docs).count() == sd.drop_repeats(no_docs).count() == 0


def test_large_bucket_of_variants(spark):
    rnd = random.Random(5)
    base = words(rnd, 60)
    docs = spark.createDataFrame([(k, " ".join(base[:59] + [f"x{k}"])) for k in range(40)], "doc_id long, text string")
    assert sum(r["has_repeats"] for r in sd.count_repeats(docs).collect()) == 39


def test_sets_are_those_of_the_wanted_paragraphs(spark):
    rnd = random.Random(6)
    lines = [words(rnd, 30) for _ in range(4)]
    texts = ["\n".join(" ".join(x) for x in lines), " ".join(lines[3])]
    docs = spark.createDataFrame([(7, texts[0]), (7, texts[1]), (7, texts[0]), (8, None)], "doc_id long, text string")
    known = {}
    for x in texts:
        found = sd.Lines(x)
        known |= {(a, sd.paragraph_id(found.shingles(a, n))): sorted(np.unique(found.shingles(a, n)).view(np.int64).tolist()) for a, n in found.paragraphs(20)}
    wanted = [(h, 7, a) for a, h in known if a != 30]
    got = sd._sets(docs, spark.createDataFrame([*wanted, (1, 8, 0), (2, 9, 0)], "id long, doc_id long, at long"), 20).collect()
    assert sorted((r["id"], sorted(r["set"])) for r in got) == sorted({h: (h, known[a, h]) for h, _, a in wanted}.values())


def test_slices_come_with_their_jobs(spark):
    """A job's own words are in its row, whatever rows repeat a doc_id; each slice of an earlier document comes once; other texts don't come."""
    rnd = random.Random(8)
    texts = {k: words(rnd, 40 * k) for k in (1, 2, 3)}
    docs = spark.createDataFrame([*((k, " ".join(t)) for k, t in texts.items()), (3, None), (9, "other")], "doc_id long, text string")
    job = lambda i, first, low, high, first_low, first_high, seeds: (i, first, low, high, 0, 9, 0, sd.LAST, seeds, seeds, low, high, first_low, first_high)
    jobs = [job(3, 1, 32, 64, 0, 32, [40]), job(3, 1, 64, 160, 0, 32, [70, 80]), job(2, 1, 0, 32, 0, 64, [3])]
    got = sd._slices(docs, spark.createDataFrame(jobs, sd._CUT_JOB)).collect()
    hashed = lambda k, a, b: sd.word_hashes([w.encode() for w in texts[k][a:b]]).astype(np.uint32).view(np.int32).tolist()
    own = sorted((r["doc_id"], r["first"], r["low"], r["high"], r["places"], r["words"], r["total"]) for r in got if r["own"] == 1)
    whole = [(j[0], j[1], j[2], j[3], j[8], hashed(j[0], j[2], j[3]), 40 * j[0]) for j in jobs]
    assert own == sorted([*whole, *((*x[:5], [], 0) for x in whole if x[0] == 3)])
    assert sorted((r["first"], r["first_low"], r["first_high"], r["words"], r["total"]) for r in got if r["own"] == 0) == [(1, 0, 32, hashed(1, 0, 32), 40), (1, 0, 64, hashed(1, 0, 64), 40)]


def _inside(rnd, passages):
    """Documents of one line, each passage between words of its own."""
    return [(k, " ".join(words(rnd, rnd.randint(30, 60)) + p + words(rnd, rnd.randint(30, 60))), p) for k, p in enumerate(passages)]


def _share(spark, docs):
    """For each document the share of its passage that is cut, and the words cut beyond it."""
    spans = {r["doc_id"]: r["spans"] for r in sd.repeated_spans(spark.createDataFrame([(k, t) for k, t, _ in docs], "doc_id long, text string")).collect()}
    out = {}
    for k, text, passage in docs:
        w = text.split()
        at = next(i for i in range(len(w)) if w[i : i + len(passage)] == passage)
        gone = {i for s in spans[k] for i in range(s["start"], s["stop"])}
        own = set(range(at, at + len(passage)))
        out[k] = len(gone & own) / len(own), len(gone - own)
    return out


def test_passages_are_cut_to_their_ends(spark):
    rnd = random.Random(21)
    passages = [p for n in (51, 60, 100) for _ in range(8) for p in [words(rnd, n)]]
    docs = _inside(rnd, passages + passages)
    share = _share(spark, docs)
    for k in range(len(passages)):
        assert share[k] == (0, 0)
        assert share[k + len(passages)] == (1, 0)


def test_near_copies_inside_lines_are_cut(spark):
    rnd = random.Random(22)
    passages, edited = [], []
    for n, places in ((60, (29,)), (100, (33, 66)), (60, (12,)), (100, (20, 50))):
        for _ in range(6):
            p = words(rnd, n)
            q = list(p)
            for at in places:
                q[at] = f"edit{rnd.randrange(10**6)}"
            passages.append(p)
            edited.append(q)
    docs = _inside(rnd, passages + edited)
    wrapped = [(k, "\n".join(" ".join(t.split()[i : i + 9]) for i in range(0, len(t.split()), 9)), p) for k, t, p in docs]
    for case in (docs, wrapped):
        share = _share(spark, case)
        assert sum(share[k + len(passages)][0] for k in range(len(passages))) >= 0.98 * len(passages)
        assert all(share[k + len(passages)][1] == 0 for k in range(len(passages)))
        assert all(share[k] == (0, 0) for k in range(len(passages)))


def test_alignments_follow_long_passages_and_stop_at_changes():
    rng = np.random.default_rng(8)
    x = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    y = x.copy()
    y[:100], y[2900:] = 1, 2
    assert sd.align(x, y, [(1500, 1500, 10)])[0] == [(100, 2900)]
    assert sd.align(x[:600], y[:600], [(300, 300, 10)])[1:] == (False, True)
    y[1000:1800] = 3  # a gap too wide to be a near copy
    assert sd.align(x, y, [(500, 500, 10), (2000, 2000, 10)])[0] == [(100, 1000), (1800, 2900)]


def brute_runs(docs, least):
    """For each document the words that stand in a run of ``least`` equal words or more with an earlier document."""
    out = {i: set() for i, _ in docs}
    split = [(i, t.split()) for i, t in docs]
    for i, x in split:
        for j, y in split:
            if j < i:
                where = {}
                for b in range(len(y) - 4):
                    where.setdefault(tuple(y[b : b + 5]), []).append(b)
                for a in range(len(x) - 4):
                    for b in where.get(tuple(x[a : a + 5]), []):
                        n = 0
                        while a + n < len(x) and b + n < len(y) and x[a + n] == y[b + n]:
                            n += 1
                        if n >= least and (a == 0 or b == 0 or x[a - 1] != y[b - 1]):
                            out[i] |= set(range(a, a + n))
    return out


def test_spans_equal_brute_force_on_exact_passages(spark):
    """Passages of one line, over line ends, nested, side by side and from several sources, at any place of short and long documents."""
    rnd = random.Random(31)
    passages = [words(rnd, rnd.randint(51, 160)) for _ in range(25)]
    docs = []
    for k in range(120):
        parts = []
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            if rnd.random() < 0.4:  # a part of a passage
                n = rnd.randint(51, len(p))
                at = rnd.randint(0, len(p) - n)
                p = p[at : at + n]
            parts += [words(rnd, rnd.choice([0, 3, 30, 200])), p]
        parts.append(words(rnd, rnd.choice([0, 5, 60])))
        w = [x for part in parts for x in part]
        text, at = "", 0
        while at < len(w):
            n = rnd.choice([4, 12, 40, 300])
            text += (rnd.choice([" ", "\n"]) if text else "") + " ".join(w[at : at + n])
            at += n
        docs.append((k, text))
    must, may = brute_runs(docs, 51), brute_runs(docs, 20)
    found = {r["doc_id"]: {n for s in r["spans"] for n in range(s["start"], s["stop"])} for r in sd.repeated_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    wanted = sum(map(len, must.values()))
    missed = sum(len(must[k] - found[k]) for k in found)
    # a link across a few words of a document's own joins two runs, as their shingles still reach the threshold
    beyond = sum(len(found[k] - may[k]) for k in found)
    assert wanted > 5000 and missed <= 0.005 * wanted and beyond <= 0.01 * wanted


def test_groups_larger_than_a_piece(spark, monkeypatch):
    """A line, a passage and near copies in more documents than a task holds at once give the same spans."""
    rnd = random.Random(41)
    base, passage = words(rnd, 60), words(rnd, 55)
    docs = [(k, " ".join(base[:59] + [f"x{k % 40}"]) + "\n" + " ".join(words(rnd, 10) + passage + words(rnd, 10))) for k in range(600)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(16)
    spans = lambda: {r["doc_id"]: r["spans"] for r in sd.repeated_spans(frame).collect()}
    want = spans()
    monkeypatch.setattr(sd, "PIECE", 16)
    got = spans()
    assert got == want and sum(map(bool, got.values())) == 599
