"""Quality rules as a short-circuit cascade (operator 9).

Each rule looks at one lazily computed view of a text. On a seeded sample over all partitions the rules are put in order one by one:
next comes the one with the most rejections per second among the documents that the rules before it leave, given the views
that those have computed. A document leaves the cascade at its first rejection, so views that only later rules need are
never computed for it. The verdict is the conjunction of all rules, so the order changes how long the cascade takes and
never what it keeps.

Defined cases: a null text is an empty one (no words, hence rejected); very long texts are one pass in
linear memory plus a sort of their window hashes; repeated rows are judged one by one; extra columns pass
through; an empty table gives an empty table.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import pieces

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
_ODD = np.random.default_rng(8).integers(1, 2**63, WINDOW, dtype=np.uint64) | np.uint64(1)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more, first occurrence included."""
    m = len(words) - window + 1
    if m < 2:
        return 0
    each = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    key = each[:m] * _ODD[0]
    for k in range(1, window):
        key += each[k : k + m] * _ODD[k]
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not twice.size:
        return 0
    found: dict[tuple[bytes, ...], list[int]] = {}  # equal hashes are only candidates
    for i in np.flatnonzero(np.isin(key, twice)).tolist():
        found.setdefault(tuple(words[i : i + window]), []).append(i)
    step = np.zeros(len(words) + 1, np.int64)
    for starts in found.values():
        if len(starts) > 1:
            np.add.at(step, starts, 1)
            np.add.at(step, np.add(starts, window), -1)
    return int(np.count_nonzero(np.cumsum(step[:-1])))


class TextView:
    """The counts that rules ask for; each is computed when first asked."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode().split()  # bytes split at ASCII white space alone

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACE))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> tuple[int, int]:
        """Lines that hold a word, and how many of them equal an earlier line."""
        filled = [x for x in self.text.split("\n") if x.strip(SPACE)]
        return len(filled), len(filled) - len(set(filled))

    @property
    def n_dup_lines(self) -> int:
        return self.lines[1]

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_words(self.words)

    # views that no count of the result needs

    @cached_property
    def word_counts(self) -> Counter[bytes]:
        return Counter(self.words)

    @cached_property
    def letterless(self) -> int:
        """Words without a letter."""
        return sum(n for w, n in self.word_counts.items() if not (w.isalpha() or any(map(str.isalpha, w.decode()))))

    @cached_property
    def longest(self) -> int:
        return max((len(w.decode()) for w in self.word_counts), default=0)

    @cached_property
    def marked_lines(self) -> tuple[int, int]:
        """Lines that begin with a bullet, and lines that end with an ellipsis."""
        filled = [x.strip(SPACE) for x in self.text.split("\n")]
        return sum(x[:1] in BULLETS for x in filled if x), sum(x.endswith(ELLIPSES) for x in filled)


BULLETS = frozenset("-*+\u2022\u2023\u25cf\u25e6")
ELLIPSES = ("...", "\u2026")


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[TextView], bool]


#: base_failed is the disjunction of the first two.
BASE_RULES = (
    Rule("too_few_words", lambda v: v.n_words < 20),
    Rule("repeated_windows", lambda v: 100 * v.n_repeat_words > 30 * v.n_words),
)
#: Integer arithmetic throughout, so that any engine gives the same verdict.
MORE_RULES = (
    Rule("symbols", lambda v: 10 * v.n_symbols > 3 * v.n_words),
    Rule("word_length", lambda v: v.word_chars < 2 * v.n_words or v.word_chars > 15 * v.n_words),
    Rule("duplicate_lines", lambda v: 2 * v.n_dup_lines > v.lines[0]),
    Rule("common_word", lambda v: 10 * max(v.word_counts.values(), default=0) > 4 * v.n_words),
    Rule("few_distinct_words", lambda v: 50 * len(v.word_counts) < v.n_words),
    Rule("letterless_words", lambda v: 2 * v.letterless > v.n_words),
    Rule("endless_word", lambda v: v.longest > 1000),
    Rule("bullets", lambda v: 10 * v.marked_lines[0] > 9 * v.lines[0]),
    Rule("ellipses", lambda v: 10 * v.marked_lines[1] > 3 * v.lines[0]),
)
RULES = BASE_RULES + MORE_RULES


def order_rules(texts: list[str | None], rules: tuple[Rule, ...] = RULES, first: tuple[Rule, ...] = (), known: tuple[str, ...] = ()) -> tuple[list[str], list[dict]]:
    """Rule names in the order of the cascade on ``texts``, and what was measured when each was chosen.

    ``first`` are rules that are asked before in any case, ``known`` views that are there in any case. A rule that rejects
    none of the texts left costs its time for nothing, so such rules come last, the cheapest first.
    """
    views, rest, seen = [TextView(x) for x in texts], [r for r in rules if r not in first], []
    for v in views:
        for name in known:
            getattr(v, name)
    views = [v for v in views if not rejected(v, first)]
    while rest:
        tried = []
        for rule in rest:
            copies = [TextView(v.text) for v in views]
            for copy, view in zip(copies, views, strict=True):
                copy.__dict__.update(view.__dict__)  # with the views that are there by now
            began = time.perf_counter()
            gone = [rule.rejects(v) for v in copies]
            cost = (time.perf_counter() - began) / max(1, len(copies))
            tried.append(({"rule": rule.name, "cost_s": cost, "rejects": sum(gone) / max(1, len(copies))}, rule, [v for v, out in zip(copies, gone, strict=True) if not out]))
        said, rule, views = min(tried, key=lambda x: (-x[0]["rejects"] / max(x[0]["cost_s"], 1e-9), x[0]["cost_s"]))
        rest.remove(rule)
        seen.append(said)
    return [x["rule"] for x in seen], seen


def plan_cascade(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 400, sample_chars: int = 20_000, seed: int = 9, **given) -> list[str]:
    """The order of ``rules`` for ``docs``, estimated on about ``sample_rows`` rows drawn by ``seed`` from all partitions.

    The rows are counted, and each is drawn with the same chance, so the driver sees ``sample_rows`` of them give or take a few
    times the root. ``sample_chars`` bounds what it sees of a text; the estimate decides the order alone, and every verdict is on whole
    texts. ``given`` goes to ``order_rules``.
    """
    share = min(1.0, sample_rows / max(1, docs.count()))
    drawn = docs.select(F.substring(F.col(text), 1, sample_chars).alias("text")).sample(False, share, seed)
    return order_rules([r["text"] for r in drawn.collect()], rules, **given)[0]


def _cascade(rules: tuple[Rule, ...], order: list[str]) -> list[Rule]:
    by = {r.name: r for r in rules}
    return [by[x] for x in order]


def rejected(view: TextView, steps: Sequence[Rule]) -> bool:
    """Whether a rule rejects; the first that does is the last that is asked."""
    return any(r.rejects(view) for r in steps)


def filter_documents(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 400) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their columns as they were."""
    steps = _cascade(rules, plan_cascade(docs, text, rules, sample_rows))
    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            yield b.filter(pa.array([not rejected(TextView(x), steps) for x in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def measure_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 400) -> DataFrame:
    """One row per row of ``docs``: the counts, ``base_failed`` and ``kept``.

    The counts are asked for of every document, and with them the base rules. The cascade goes on with those that pass them, in
    its own order, and computes further views only until a rule rejects.
    """
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    steps = _cascade(rules, plan_cascade(docs, text, rules, sample_rows, first=BASE_RULES, known=counts))
    kept = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([kept.schema[0], *(T.StructField(c, T.LongType()) for c in counts), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            views = [TextView(x) for x in b.column(1).to_pylist()]
            failed = [rejected(v, BASE_RULES) for v in views]
            passed = [not f and not rejected(v, steps) for v, f in zip(views, failed, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([getattr(v, c) for v in views], pa.int64()) for c in counts), pa.array(failed, pa.bool_()), pa.array(passed, pa.bool_())], ["doc_id", *counts, "base_failed", "kept"])

    return kept.mapInArrow(measure, schema)
