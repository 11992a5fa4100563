"""Graph operators on graphs whose scores are known."""

import math

import numpy as np
import pytest

from termweave.operators import graph, iterate
from termweave.runtime import arrow_rows, materialize

TOY = [("M", "A", 1.0), ("M", "C", 8.0), ("A", "C", 13.0), ("M", "B", 1.0)]


@pytest.fixture(scope="module")
def toy(spark):
    return spark.createDataFrame(TOY + [(b, a, w) for a, b, w in TOY], "src string, dst string, weight double")


def scores(df, *keys, value="v"):
    return {tuple(r[k] for k in keys): r[value] for r in df.collect()}


def test_seeded_simrank(spark, toy):
    seeds = spark.createDataFrame([("M", "A", 0.5), ("M", "B", 0.6)], "i string, j string, v double")
    for steps, a, b, m in ((1, 0.510057143, 0.548800000, 0.952800000), (2, 0.517252912, 0.502922362, 0.909056254)):
        s = scores(iterate.seeded_simrank(toy, seeds, steps=steps), "i", "j")
        assert (s["M", "A"], s["M", "B"], s["M", "M"]) == pytest.approx((a, b, m), abs=1e-8)
    cand = spark.createDataFrame([("M", "A"), ("M", "B")], "mention string, entity string")
    assert iterate.best_entity(iterate.seeded_simrank(toy, seeds, steps=2), cand).first()["entity"] == "A"


def test_matrix_simrank(toy):
    names = sorted({"M", "A", "B", "C"})
    w = np.zeros((4, 4))
    for a, b, x in TOY:
        w[names.index(a), names.index(b)] = w[names.index(b), names.index(a)] = x
    t = w / w.sum(0, keepdims=True)
    s = 0.2 * np.eye(4)
    for _ in range(12):
        s = 0.8 * t.T @ s @ t + 0.2 * np.eye(4)
    got = scores(iterate.matrix_simrank(toy, steps=12, every=3), "i", "j")
    for (i, j), v in got.items():
        assert v == pytest.approx(s[names.index(i), names.index(j)], abs=1e-9)


def test_relatedness_and_blend(spark, toy):
    w = scores(iterate.relatedness(toy), "src", "dst", value="wlm")
    assert w["M", "A"] == pytest.approx(0.981831, abs=1e-6) and w["M", "C"] == pytest.approx(0.104832, abs=1e-6)
    before = spark.createDataFrame([("M", "A", 0.5), ("M", "B", 0.6), ("N", "A", 0.4), ("N", "B", 0.3)], "mention string, entity string, sim double")
    after = spark.createDataFrame([("M", "A", 0.435962840), ("M", "B", 0.159172506), ("N", "A", 1.0)], "mention string, entity string, score double")
    b = scores(iterate.blend(before, after), "mention", "entity", value="sim")
    assert (b["M", "A"], b["M", "B"], b["N", "A"], b["N", "B"]) == pytest.approx((0.7, 0.506042, 0.4, 0.3), abs=1e-6)


def test_pagerank(spark):
    w = {(1, 2): math.log(3), (1, 3): math.log(2), (2, 3): math.log(2)}
    rows = [(0, str(a), str(b), x) for (a, b), x in w.items()] + [(0, str(b), str(a), x) for (a, b), x in w.items()]
    e = spark.createDataFrame(rows, "record_id long, src string, dst string, weight double")
    s = scores(iterate.personalized_pagerank(e, keys=("record_id",)), "source", "vertex")
    assert (s["1", "1"], s["2", "1"], s["3", "1"], s["1", "3"], s["3", "3"]) == pytest.approx((0.448921, 0.314739, 0.305464, 0.236339, 0.389072), abs=1e-5)


def test_idf_cosine(spark):
    m = spark.createDataFrame([("m", x) for x in "pqr"], "mention string, element string")
    c = spark.createDataFrame([("m", "c1", "p"), ("m", "c1", "q"), ("m", "c2", "q"), ("m", "c2", "s")], "mention string, entity string, element string")
    s = scores(iterate.idf_cosine(m, c), "entity", value="sim")
    assert s["c1",] == pytest.approx(0.346242, abs=1e-6) and s["c2",] == 0


def test_conditional_weights(spark):
    items = spark.createDataFrame([(1, 0, "main", "a"), (1, 1, "vice", "b"), (2, 0, "main", "a"), (2, 1, "vice", "b"), (2, 2, "vice", "c"), (3, 0, "main", "a")], "record_id long, slot int, role string, name string")
    pairs = graph.clique_pairs(items)
    for bias, pair_bias, ab, ba in ((1, 1, 0.75, 1.0), (1, 0, 0.5, 0.666667), (0, 0, 2 / 3, 1.0)):
        w = scores(graph.conditional_edges(pairs, graph.occurrences(items, bias), pair_bias), "src", "dst", value="weight")
        assert (w["a", "b"], w["b", "a"]) == pytest.approx((ab, ba), abs=1e-6)
    assert graph.isolated(spark.createDataFrame([("a",), ("z",)], "name string"), graph.both_directions(pairs)).first()["name"] == "z"
    assert graph.network_size(items.select("name").distinct(), graph.both_directions(pairs)).first()["edges"] == 6


def brute_coherence(record, weight, rounds=100, jump=0.2, steps=20):
    """``record``: for each mention its (name, score) in order. Every score of every candidate, by plain loops."""
    vertices = [(home, name, score) for home, group in enumerate(record) for name, score in group]
    n = len(vertices)
    m = np.array([[0.0 if i == j else weight(a[1], b[1]) for j, b in enumerate(vertices)] for i, a in enumerate(vertices)])
    m = np.divide(m, m.sum(1, keepdims=True), out=np.zeros_like(m), where=m.sum(1, keepdims=True) > 0)
    walks = {}
    for e in range(n):
        back = np.eye(n)[e]
        w = back
        for _ in range(steps):
            w = (1 - jump) * m.T @ w + jump * back
        walks[e] = w
    groups = [[i for i, v in enumerate(vertices) if v[0] == home] for home in range(len(record))]
    won = [g[0] for g in groups]
    for k in range(rounds):
        voters = range(n) if k == 0 else won
        pairs = [(s, e) for s in voters for e in range(n) if vertices[s][0] != vertices[e][0]]
        average = sum(walks[e][s] for s, e in pairs) / n
        total = [average * v[2] for v in vertices]
        for s, e in pairs:
            total[e] += walks[e][s] * vertices[s][2]
        now = [max(g, key=lambda e: (round(total[e], 12), -e)) for g in groups]  # noqa: B023
        if now == won:
            break
        won = now
    return [sorted(((vertices[e][1], total[e]) for e in g), key=lambda x: -round(x[1], 12)) for g in groups]


def test_coherence(spark, monkeypatch):
    import random

    rnd = random.Random(4)
    names = [f"n{k}" for k in range(9)]
    weights = {(a, b): rnd.choice([1.0, 2.0, 5.0, 9.0]) for a in names for b in names if rnd.random() < 0.5}
    rows, want = [], {}
    for r in range(12):
        record = []
        for slot in range(rnd.randrange(1, 6)):
            group = [(x, rnd.random()) for x in rnd.sample(names, rnd.randrange(1, 5))]
            sims = sorted((s for _, s in group), reverse=True)
            total = sum(sims)
            record.append([(x, s / total) for (x, _), s in zip(group, sims, strict=True)])
            rows += [(r, slot, "m", x, s / total, k + 1) for k, ((x, _), s) in enumerate(zip(group, sims, strict=True))]
        for slot, ranked in enumerate(brute_coherence(record, lambda a, b: weights.get((a, b), math.log(2)))):
            want[r, slot] = ranked
    v = spark.createDataFrame(rows, "record_id long, slot int, mention string, entity string, score double, place int")
    e = spark.createDataFrame([(a, b, w) for (a, b), w in weights.items()], "src string, dst string, weight double")
    monkeypatch.setattr(iterate, "BATCH_RECORDS", 3)
    for held, few in ((iterate.NETWORK_ROWS, 1500), (iterate.NETWORK_ROWS, 0), (0, 0)):
        monkeypatch.setattr(iterate, "NETWORK_ROWS", held)
        monkeypatch.setattr(iterate, "DENSE_VERTICES", few)
        for cells in (1 << 22, 8):
            monkeypatch.setattr(iterate, "WALK_CELLS", cells)
            got = {}
            for x in iterate.collective_rank(v, e).orderBy("record_id", "slot", "rank").collect():
                got.setdefault((x["record_id"], x["slot"]), []).append((x["entity"], x["score"]))
            assert got.keys() == want.keys()
            for k, ranked in want.items():
                assert [x for x, _ in got[k]] == [x for x, _ in ranked]
                assert [s for _, s in got[k]] == pytest.approx([s for _, s in ranked])


def test_vertices_and_training(spark):
    cand = spark.createDataFrame([(1, 0, "m", "a", 0.6), (1, 0, "m", "b", 0.6), (1, 1, "m", "a", 1.0), (2, 0, "k", "c", 0.0)], "record_id long, slot int, mention string, entity string, sim double")
    names = spark.createDataFrame([(x,) for x in "abcd"], "name string")
    edges, pop = graph.log_network(spark.createDataFrame([(1, 0, "a"), (1, 1, "a"), (1, 2, "b")], "record_id long, slot int, name string"), names)
    p = {r["name"]: r["popularity"] for r in pop.collect()}
    assert p == pytest.approx({"a": 3 / 7, "b": 2 / 7, "c": 1 / 7, "d": 1 / 7})
    assert scores(edges, "src", "dst", value="weight") == pytest.approx({("a", "a"): math.log(4), ("a", "b"): math.log(4), ("b", "a"): math.log(4)})
    v = {(r["record_id"], r["slot"], r["entity"]): (r["score"], r["place"]) for r in iterate.candidate_vertices(cand, pop).collect()}
    a, b = 1.2 * 3 / 7 + 0.6, 1.2 * 2 / 7 + 0.6
    assert v[1, 0, "a"] == (pytest.approx(a / (a + b)), 1) and v[1, 0, "b"] == (pytest.approx(b / (a + b)), 2) and v[1, 1, "a"] == (1.0, 1) and v[2, 0, "c"][0] == 1.0
    edges, pop = iterate.train_network(cand, names, rounds=2)
    assert scores(edges, "src", "dst", value="weight") == pytest.approx({("a", "a"): math.log(4)})
    assert {r["name"]: r["popularity"] for r in pop.collect()} == pytest.approx({"a": 3 / 7, "b": 1 / 7, "c": 2 / 7, "d": 1 / 7})


def test_items_are_not_broadcast_to_themselves(spark):
    items = materialize(spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "record_id long, slot int, name string"), "test")
    pairs = graph.positional_pairs(items, ordered=True)
    assert pairs.count() == 2 and "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_equal_records_are_solved_once(spark, monkeypatch):
    said = spark.createDataFrame([(r, k, m) for r, record in enumerate(["xy", "yx", "xy", "x", "xy", "x", "xyx"]) for k, m in enumerate(record)], "record_id long, slot int, mention string")
    sims = spark.createDataFrame([("x", "a", 0.5), ("x", "b", 0.5), ("y", "a", 0.6), ("y", "c", 0.7)], "mention string, entity string, sim double")
    names = spark.createDataFrame([(x,) for x in "abcd"], "name string")
    like = iterate.like_records(said, "slot", "mention").cache()
    assert sorted(map(tuple, like.collect())) == [(0, 0), (1, 1), (2, 0), (3, 3), (4, 0), (5, 3), (6, 6)]
    all_, first = (d.join(sims, "mention") for d in (said, said.join(like.where("record_id = like"), "record_id", "left_semi")))
    want, got = iterate.train_network(all_, names, rounds=2), iterate.train_network(first, names, rounds=2, like=like)
    for x, y, keys, value in zip(want, got, (("src", "dst"), ("name",)), ("weight", "popularity"), strict=True):
        assert scores(x, *keys, value=value) == pytest.approx(scores(y, *keys, value=value)) != {}
    pop = want[1]
    ranked = iterate.collective_rank(iterate.candidate_vertices(all_, pop), want[0])
    assert sorted(iterate.collective_rank(iterate.candidate_vertices(all_, pop), want[0], top=1).collect()) == sorted(ranked.where("rank = 1").collect())


def test_walks_have_a_number_for_each_name():
    rnd = np.random.default_rng(3)
    weights, name = rnd.random((3, 3)) + 0.1, np.array([0, 1, 0, 2, 1, 0])
    walks, own = iterate.Walks(name, weights, 0.2, 20), weights[np.ix_(name, name)] * (1 - np.eye(6))
    plain = now = np.eye(6)
    for _ in range(20):
        now = 0.8 * (own / own.sum(1, keepdims=True)).T @ now + 0.2 * plain
    got = walks.elsewhere(np.arange(3))
    assert got.shape == (3, 3)  # of six vertices
    assert got[np.ix_(name, name)][~np.eye(6, dtype=bool)] == pytest.approx(now[~np.eye(6, dtype=bool)])


def test_classify_relate_and_triage(spark, toy):
    cand = spark.createDataFrame([("m", "A", 0.5), ("m", "B", 0.4), ("k", "A", 0.9), ("k", "Z", 0.2), ("s", "A", 1.0)], "mention string, entity string, sim double")
    near = spark.createDataFrame([("m", "C"), ("k", "C"), ("s", "C")], "mention string, entity string")
    sims = spark.createDataFrame([("M", "C", 0.5), ("C", "M", 0.5), ("C", "C", 0.9)], "i string, j string, v double")
    got = scores(iterate.classify(cand, toy, near, sims), "mention", "entity", value="score")
    assert got == pytest.approx({("m", "A"): 0.75, ("m", "B"): 0.5})  # A has the neighbours M and C; C and itself score 1
    mean = scores(iterate.neighbour_means(cand.join(toy.withColumnRenamed("src", "entity"), "entity").where("mention = 'm'"), near, sims), "entity", "neighbour", value="score")
    assert mean == {("A", "M"): 0.5, ("A", "C"): 1.0, ("B", "M"): 0.5}
    related = iterate.relatedness(toy)
    w = scores(related, "src", "dst", value="wlm")
    assert scores(iterate.classify_related(cand, toy, near, related), "mention", "entity", value="score") == pytest.approx({("m", "A"): w["A", "C"] / 2, ("m", "B"): 0.0, ("s", "A"): w["A", "C"] / 2})
    assert {r["mention"]: r["route"] for r in iterate.triage(cand, toy, near).collect()} == {"m": "few", "k": "sure", "s": "sure"}
    low = spark.createDataFrame([("m", "A", 1e-7), ("m", "B", 0.0)], "mention string, entity string, score double")
    assert scores(iterate.blend(cand.where("mention = 'm'"), low), "entity", value="sim") == {("A",): 0.5, ("B",): 0.4}


def test_relinking_uses_the_last_winners(spark):
    items = [(r, 0, "main", "A") for r in range(3)] + [(r, 1, "vice", "C") for r in range(3)] + [(9, 0, "main", "x"), (9, 1, "vice", "C"), (10, 0, "main", "B"), (10, 1, "vice", "D"), (11, 0, "main", "x"), (11, 100, "surg", "P")]
    items = spark.createDataFrame(items, "record_id long, slot int, role string, name string")
    names = spark.createDataFrame([(x,) for x in "ABCD"], "name string")
    cand = spark.createDataFrame([("x", "A", 0.5), ("x", "B", 0.5)], "mention string, entity string, sim double")
    got = scores(iterate.relink(items, names, cand, rounds=2, steps=5), "mention", "entity", value="sim")
    assert set(got) == {("x", "A"), ("x", "B")} and got["x", "A"] >= got["x", "B"]
    known = spark.createDataFrame([("x", "A"), ("A", "B")], "name string, entity string")
    assert sorted(r["name"] for r in graph.fall_back(items, names, known).where("record_id in (9, 11)").collect()) == ["A", "A", "C", "P"]


def test_dense_and_sparse_graphs_give_the_same_scores(spark, toy, monkeypatch):
    seeds = spark.createDataFrame([("M", "A", 0.5), ("M", "B", 0.6), ("Z", "A", 0.2), ("B", "M", 0.7)], "i string, j string, v double")
    runs = {
        "simrank": lambda: scores(iterate.matrix_simrank(toy, steps=4), "i", "j"),
        "seeded": lambda: scores(iterate.seeded_simrank(toy, seeds, steps=3), "i", "j"),
        "ppr": lambda: scores(iterate.personalized_pagerank(toy, steps=6), "source", "vertex"),
    }
    dense = {k: f() for k, f in runs.items()}
    monkeypatch.setattr(iterate, "DENSE_VERTICES", 0)
    for k, f in runs.items():
        sparse = f()
        assert {x: v for x, v in sparse.items() if v} == pytest.approx(dense[k]), k


def test_default_steps_equal_plain_matrices(toy, spark):
    names = ["A", "B", "C", "M"]
    w = np.zeros((4, 4))
    for a, b, x in TOY:
        w[names.index(a), names.index(b)] = w[names.index(b), names.index(a)] = x
    t, p = w / w.sum(0, keepdims=True), w / w.sum(1, keepdims=True)
    s, walk = 0.2 * np.eye(4), np.eye(4)
    for _ in range(100):
        s = 0.8 * t.T @ s @ t + 0.2 * np.eye(4)
    for _ in range(20):
        walk = 0.8 * walk @ p + 0.2 * np.eye(4)
    got, gone = scores(iterate.matrix_simrank(toy), "i", "j"), scores(iterate.personalized_pagerank(toy), "source", "vertex")
    for i, x in enumerate(names):
        for j, y in enumerate(names):
            assert got[x, y] == pytest.approx(s[i, j]) and gone[x, y] == pytest.approx(walk[i, j])
    seeds = spark.createDataFrame([("M", "A", 0.5), ("M", "B", 0.6)], "i string, j string, v double")
    v = scores(iterate.seeded_simrank(toy, seeds), "i", "j")
    assert (v["M", "A"], v["M", "B"], v["M", "M"]) == pytest.approx((0.435962840, 0.159172506, 0.470478232), abs=1e-8)


def test_records_of_mentions_train_as_their_candidates(spark, monkeypatch):
    """Records travel as their mentions, once for all that say the same; candidates and networks beyond the bound go by joins, from the start or from a round on."""
    said = spark.createDataFrame([(r, k, m) for r, record in enumerate(["xy", "yx", "xyz", "x", "zzy", "x", "xyx", "zw"]) for k, m in enumerate(record)], "record_id long, slot int, mention string")
    sims = spark.createDataFrame([("x", "a", 0.5), ("x", "b", 0.5), ("y", "a", 0.6), ("y", "c", 0.7), ("z", "b", 0.7), ("z", "e", 0.69), ("z", "d", 0.69)], "mention string, entity string, sim double")
    names = spark.createDataFrame([(x,) for x in "abcdf"], "name string")
    want = iterate.train_network(said.join(sims, "mention"), names, rounds=2)
    edges, popularity = scores(want[0], "src", "dst", value="weight"), scores(want[1], "name", value="popularity")
    assert len(edges) >= 4 and len(popularity) >= 5
    for bound in (iterate.NETWORK_ROWS, 8, 2):
        monkeypatch.setattr(iterate, "NETWORK_ROWS", bound)
        pairs = []
        monkeypatch.setattr(iterate, "materialize", lambda df, name, *parts: pairs.append(name) or materialize(df, name, *parts))  # noqa: B023
        got = iterate.train_network(sims, names, rounds=2, said=said)
        assert scores(got[0], "src", "dst", value="weight") == pytest.approx(edges)
        assert scores(got[1], "name", value="popularity") == pytest.approx(popularity)
        assert ("train-pairs" in pairs, "train-records" in pairs) == (bound < 100, bound > 2)


@pytest.mark.parametrize("kind", ["even", "uneven", "one way", "empty"])
def test_records_are_solved_together_as_alone(kind):
    rnd = np.random.default_rng(5)
    weights = {"even": np.log(rnd.integers(900, 1500, (30, 30))), "empty": np.zeros((30, 30))}.get(kind, np.log(rnd.choice([2, 3, 50], (30, 30))))
    weights = weights if kind == "one way" else np.triu(weights) + np.triu(weights, 1).T
    record, home, name, score = (np.array(x) for x in zip(*((r, h, x, rnd.random()) for r in range(40) for h in range(r % 6 + 1) for x in rnd.permutation(30)[: 1 + r // 2]), strict=True))
    got = iterate.rank_records(record, home, score, name, lambda r, k: weights[k[:, :, None], k[:, None, :]], 0.2, 20)
    for r in range(40):
        at = record == r
        names, own = np.unique(name[at], return_inverse=True)
        assert got[at] == pytest.approx(iterate.rank_record(home[at], score[at], iterate.Walks(own, weights[np.ix_(names, names)], 0.2, 20)), abs=1e-14)


@pytest.mark.parametrize("rows", [1, 3, 10_000])
def test_kinds_of_records(spark, rows):
    """Records that go on over batches are whole, in the order of their places; kinds that do may take several rows."""
    lines = [(r, k, (r % 4 + k) % 5, r * k % 7) for r in range(40) for k in range(r % 4 + 1)] + [(50, k, k % 5, 0) for k in range(25)] + [(51, 0, None, 0), (None, 0, 1, 0)]
    frame = spark.createDataFrame(lines, "record_id long, line int, part long, more long")
    keys, numbers = np.array([3, 0, 2]), np.array([1, 0, 5])  # 1 and 4 are unknown
    known = dict(zip(keys.tolist(), numbers.tolist(), strict=True))
    want = {}
    for r, _, part, _ in sorted((x for x in lines if x[0] is not None), key=lambda x: x[:2]):
        want.setdefault(r, []).append(known.get(part, -1))
    with arrow_rows(spark, rows):
        kinds = iterate.record_kinds(frame, ["line", "part"], "part", keys, numbers).collect()
    got = {r: np.frombuffer(k["said"], np.int32).tolist() for k in kinds for r in k["ids"]}
    assert got == want and sum(len(k["ids"]) for k in kinds) == len(want)
    assert rows < 100 or len(kinds) == len({tuple(x) for x in want.values()})


def test_ranked_records_in_parts(spark, monkeypatch):
    lines = spark.createDataFrame([(r, k, k + 1) for r in range(6) for k in range(3)], "record_id long, line int, part long")
    sims = [(m, e, s) for m in "xyz" for e, s in zip("abcde", (0.9, 0.8, 0.7, 0.7, 0.65), strict=True)]
    held = iterate.HeldCandidates(iterate.held_rows(spark.createDataFrame(sims, "mention string, entity string, sim double")))
    kinds = iterate.record_kinds(lines, ["line"], "part", np.array([1, 2, 3]), np.array([0, 1, 2]))
    forms, network = np.array([[0, -1], [1, 1], [2, 2]]), iterate.HeldNetwork([("a", "b", 3.0), ("b", "a", 3.0)], math.log(2))

    def run():
        return sorted(iterate.rank_kinds(kinds, forms, held, held.scores({"a": 0.5}), network, digits=9).collect())

    whole = run()
    assert len(whole) == 6 * 3 * 5 and {r["rank"] for r in whole} == {1, 2, 3, 4, 5}
    v = spark.createDataFrame([(r, k, m, e, s) for r in range(6) for k, m in enumerate("xyz") for n, e, s in sims if n == m], "record_id long, slot int, mention string, entity string, sim double")
    net = spark.createDataFrame([("a", "b", 3.0), ("b", "a", 3.0)], "src string, dst string, weight double")
    vertices = iterate.candidate_vertices(v, spark.createDataFrame([("a", 0.5)], "name string, popularity double"))
    want = sorted(iterate.collective_rank(vertices, net).collect())
    assert [(*r[:4], r["rank"]) for r in whole] == [(*r[:4], r["rank"]) for r in want]
    assert [r["score"] for r in whole] == pytest.approx([r["score"] for r in want], abs=1e-8)
    monkeypatch.setattr(iterate, "ROW_VERTICES", 4)
    assert run() == whole
