from collections import Counter

from termweave.llm import quality

CLEAN = "The quick brown fox jumps over the lazy dog while seven small birds sing near an old stone bridge at dawn today."


def brute_repeated(words, k=8):
    spans = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
    times = Counter(spans)
    return len({i + j for i, s in enumerate(spans) if times[s] > 1 for j in range(k)})


def test_repeated_words_equals_brute_force():
    import random

    rnd = random.Random(1)
    for n in (0, 7, 8, 9, 16, 40, 200):
        for alphabet in (1, 2, 5):
            words = [rnd.choice([b"a", b"b", b"c", b"d", b"e"][:alphabet]) for _ in range(n)]
            assert quality.repeated_words(words) == brute_repeated(words)


def test_order_changes_time_and_not_the_verdict(spark, odd_docs):
    texts = [r["text"] for r in odd_docs.collect()] + [CLEAN]
    order, seen = quality.order_rules(texts)
    assert sorted(order) == sorted(r.name for r in quality.RULES) and len(seen) == len(order)
    by = {r.name: r for r in quality.RULES}
    for names in (order, order[::-1]):
        kept = [x for x in texts if not any(by[n].rejects(quality.TextView(x)) for n in names)]
        assert kept == [CLEAN]


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    rows = quality.measure_documents(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert next(r for r in rows if r["doc_id"] == 0).asDict() == {"doc_id": 0, "n_words": 0, "word_chars": 0, "n_symbols": 0, "n_dup_lines": 0, "n_repeat_words": 0, "base_failed": True, "kept": False}
    assert quality.filter_documents(odd_docs).columns == odd_docs.columns
    assert quality.measure_documents(no_docs).count() == quality.filter_documents(no_docs).count() == 0
    assert quality.filter_documents(spark.createDataFrame([(1, CLEAN), (2, "no")], "doc_id long, text string")).collect()[0]["doc_id"] == 1


def test_fewer_views_are_computed_than_without_the_cascade(spark, sf_dir):
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    texts += ["a " * 500 + CLEAN, "### $$$ " * 300, "x", "- y\n" * 400] * 40
    asked = Counter()

    def counting(rule):
        return quality.Rule(rule.name, lambda v: (asked.update([rule.name]), rule.rejects(v))[1])

    rules = tuple(map(counting, quality.RULES))
    order, seen = quality.order_rules(texts, rules)
    by = {r.name: r for r in rules}
    asked.clear()
    views = [quality.TextView(x) for x in texts]
    kept = [not quality.rejected(v, [by[n] for n in order]) for v in views]
    steps = [asked[n] for n in order]
    assert steps[0] == len(texts) and steps == sorted(steps, reverse=True) and steps[-1] == sum(kept)
    assert sum(steps) < 0.9 * len(texts) * len(rules)
    assert sum("word_counts" in v.__dict__ for v in views) < len(texts)
    # each rate is over what the rules before leave
    left = len(texts)
    for said in seen:
        left -= round(said["rejects"] * left)
    assert left == sum(kept)
    assert kept == [not any(r.rejects(quality.TextView(x)) for r in quality.RULES) for x in texts]


def test_rules_on_further_views():
    rejects = {r.name: lambda x, r=r: r.rejects(quality.TextView(x)) for r in quality.RULES}
    assert rejects["common_word"]("a b " * 10) and not rejects["common_word"](CLEAN)
    assert rejects["few_distinct_words"]("a b c " * 100) and not rejects["few_distinct_words"](CLEAN)
    assert rejects["letterless_words"]("1 2 3 a") and not rejects["letterless_words"]("1 é a 中 -") and not rejects["letterless_words"]("1 a")
    assert rejects["endless_word"]("é" * 1001) and not rejects["endless_word"]("é" * 1000)
    assert rejects["bullets"]("- a\n • b\n") and not rejects["bullets"]("- a\nb\n\n")
    assert rejects["ellipses"]("a...\nb") and rejects["ellipses"]("a… \nb") and not rejects["ellipses"]("a.\nb")


def test_order_given_what_is_there():
    order, _ = quality.order_rules(["x"] * 5 + [CLEAN], first=quality.BASE_RULES, known=("n_repeat_words",))
    assert sorted(order) == sorted(r.name for r in quality.MORE_RULES)
