import random
from itertools import product

import pytest

from termweave.llm import mixing


def brute_targets(sizes, weights, amount=1.5, repeats=2):
    capped = set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = amount * sum(sizes) - sum(repeats * sizes[i] for i in capped)
        share = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = {i for i in free if share[i] >= repeats * sizes[i]}
        if not over:
            return [share.get(i, repeats * sizes[i]) for i in range(len(sizes))]
        capped |= over


def test_targets_equal_repeated_sharing():
    rnd = random.Random(4)
    for _ in range(50):
        sizes = [rnd.choice([0, rnd.randint(1, 1000)]) for _ in range(rnd.randint(1, 12))]
        weights = [[3, 1, 2][i % 3] for i in range(len(sizes))]
        assert mixing.share_targets(sizes, weights) == pytest.approx(brute_targets(sizes, weights))


def test_flow_has_least_cost():
    patterns, quotas = [([0], 3), ([0, 1], 2), ([1], 1)], [4, 3]
    flows = mixing.route_words(patterns, quotas)
    taken = [sum(x.values()) for x in flows]
    assert [sum(x.get(s, 0) for x in flows) for s in (0, 1)] == quotas
    cost = lambda t: sum(k + max(0, k - size) for k, (_, size) in zip(t, patterns, strict=True))
    best = min(cost((a, b + c, d)) for a, b, c, d in product(range(7), range(5), range(5), range(3)) if a + b == 4 and c + d == 3 and b + c <= 4)
    assert cost(taken) == best


def test_each_source_gets_its_target(spark, sf_dir):
    rows = mixing.measure_mix(spark.read.parquet(f"{sf_dir}/documents.parquet").drop("n_chars")).collect()
    by = {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    for (_, target), taken in by.items():
        assert sum(taken) % int(target + 0.5) == 0  # two sources may have equal sizes and targets


def test_overlapping_sources(spark):
    docs = spark.createDataFrame([(i, "w " * 10, ["a", "b"] if i % 2 else ["a"]) for i in range(100)] + [(100, "lost words", [])], "doc_id long, text string, source array<string>")
    plan, _ = mixing.plan_mix(docs, weights=(1, 1), amount=0.5, doc_id="doc_id")
    got = {s: sum(x.get(s, 0) for x in plan.flows) for s, _, _ in plan.sources}
    assert got == {s: int(t + 0.5) for s, _, t in plan.sources}
    mixed = mixing.mix_documents(docs, weights=(1, 1), amount=0.5)
    assert mixed.columns == docs.columns and mixed.where("doc_id = 100").count() == 0
    assert abs(mixed.count() * 10 - sum(got.values())) <= 20


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    rows = mixing.measure_mix(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert sorted(map(str, mixing.measure_mix(odd_docs).collect())) == sorted(map(str, rows))
    assert mixing.mix_documents(odd_docs).columns == odd_docs.columns
    assert mixing.measure_mix(no_docs).count() == mixing.mix_documents(no_docs).count() == 0
    same = spark.createDataFrame([(7, "one two three", "a")] * 9 + [(1, "x", None)], "doc_id long, text string, source string")
    taken = [r["taken"] for r in mixing.measure_mix(same, amount=0.5).collect() if r["doc_id"] == 7]
    assert len(set(taken)) == 1


def brute_flow(patterns, quotas, repeats):
    """Words in all, and how many of them are fresh, by single words along any path."""
    flow, room, need, upto = [dict.fromkeys(s, 0) for s, _ in patterns], [0] * len(patterns), list(quotas), []
    for _ in range(repeats):
        room = [r + size for r, (_, size) in zip(room, patterns, strict=True)]
        while True:
            come = {("p", p): None for p in range(len(patterns)) if room[p]}
            open_, end = list(come), None
            while open_ and end is None:
                kind, i = open_.pop()
                if kind == "p":
                    for s in patterns[i][0]:
                        if ("s", s) not in come:
                            come["s", s] = kind, i
                            open_.append(("s", s))
                            end = ("s", s) if need[s] else end
                else:
                    for q in range(len(patterns)):
                        if flow[q].get(i) and ("p", q) not in come:
                            come["p", q] = kind, i
                            open_.append(("p", q))
            if end is None:
                break
            need[end[1]] -= 1
            while come[end] is not None:
                before = come[end]
                if end[0] == "s":
                    flow[before[1]][end[1]] += 1
                else:
                    flow[end[1]][before[1]] -= 1
                end = before
            room[end[1]] -= 1
        upto.append(sum(sum(x.values()) for x in flow))
    return upto


def test_flows_equal_single_words():
    rnd = random.Random(8)
    for _ in range(200):
        m = rnd.randint(1, 5)
        patterns = [(sorted(rnd.sample(range(m), rnd.randint(1, m))), rnd.randint(0, 6)) for _ in range(rnd.randint(1, 7))]
        quotas = [rnd.randint(0, 15) for _ in range(m)]
        flows = mixing.route_words(patterns, quotas)
        taken = [sum(x.values()) for x in flows]
        assert all(sum(x.get(s, 0) for x in flows) <= quotas[s] for s in range(m)) and all(v > 0 for x in flows for v in x.values())
        assert all(t <= 2 * size for t, (_, size) in zip(taken, patterns, strict=True))
        assert [sum(min(t, size) for t, (_, size) in zip(taken, patterns, strict=True)), sum(taken)] == brute_flow(patterns, quotas, 2)


def test_parts_of_a_network_by_themselves(spark):
    """Many patterns over many sources, in several connected parts and single sources, in one plan."""
    rnd = random.Random(9)
    names = [f"s{k:02d}" for k in range(40)]
    docs = []
    for i in range(600):
        group = rnd.randrange(8) * 5
        docs.append((i, "w " * rnd.randint(0, 30), rnd.sample(names[group : group + (4 if group < 25 else 1)], rnd.randint(1, 3 if group < 25 else 1))))
    frame = spark.createDataFrame(docs, "doc_id long, text string, source array<string>")
    plan, measured = mixing.plan_mix(frame, weights=(1, 2), amount=0.6)
    got = {}
    for x in plan.flows:
        for s, v in x.items():
            got[s] = got.get(s, 0) + v
    words_of = {}
    for _, text, source in docs:
        words_of[tuple(sorted(set(source)))] = words_of.get(tuple(sorted(set(source))), 0) + len(text.split())
    order = [n for n, _, _ in plan.sources]
    at = {n: k for k, n in enumerate(order)}
    patterns = [([at[s] for s in p], n) for p, n in sorted(words_of.items())]
    quotas = [int(t + 0.5) for _, _, t in plan.sources]
    assert sum(got.values()) == brute_flow(patterns, quotas, 2)[1]
    taken = {r["pattern"]: r["taken"] for r in mixing._taken(measured, plan).groupBy("pattern").sum("taken").withColumnRenamed("sum(taken)", "taken").collect()}
    by_pattern = {r["pattern"]: r["words"] for r in plan.flow_table.groupBy("pattern").sum("words").withColumnRenamed("sum(words)", "words").collect()}
    assert {p: t for p, t in taken.items() if t} == {p: w for p, w in by_pattern.items() if w}


def test_table_targets_equal_the_function(spark):
    rnd = random.Random(10)
    for _ in range(3):
        sizes = [rnd.choice([0, rnd.randint(1, 1000)]) for _ in range(rnd.randint(1, 12))]
        members = spark.createDataFrame([(f'["s{k:02d}"]', n) for k, n in enumerate(sizes)], "key string, size long")
        rows = mixing._sources(members, (3, 1, 2), 1.5, 2).orderBy("k").collect()
        assert [r["target"] for r in rows] == pytest.approx(mixing.share_targets(sizes, [(3, 1, 2)[k % 3] for k in range(len(sizes))]))
