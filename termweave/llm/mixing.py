"""Mixing sources to target weights by a min-cost flow over membership patterns (operator 3).

Documents are summed up by the set of sources they belong to, their pattern. The flow sends words from
patterns to source quotas; the r-th repetition of a pattern's words costs r a word, so repeats are convex and
a source draws on fresh words first. Patterns that share no source, not even by way of others, don't meet in the flow: each
connected part of the network is solved by itself on an executor, with the memory of its own patterns, and where no document has
two sources each source is a part. Within a pattern, documents follow a seeded 60-bit hash: all get the pattern's whole repetitions, and
those up to a threshold one more. The thresholds are found by refining histograms of the hash, 1,024 bins at a time for
all patterns at once, until a bin holds one value; the document at the threshold gives the words still missing, so that each
source takes its quota to the word. Sources, patterns, quotas and thresholds are tables; the driver holds none of them.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a document without
any source (empty array) is never taken; rows with equal doc_id share one hash and, at the threshold, share the
missing words in proportion to their sizes; an empty table gives an empty table; extra columns pass through.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import forget, materialize
from .components import connected_components

WORD = r"[^\x20\x09-\x0D]+"
BITS, STEP = 60, 10


def word_count(text: Column) -> Column:
    return F.greatest(F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)), F.lit(0)).cast("long")


def seeded_hash(doc_id: Column, seed: int) -> Column:
    """The first 60 bits of MD5 over ``seed:doc_id``, which any SQL engine can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), doc_id.cast("string"))), 1, BITS // 4), 16, 10).cast("long")


def share_targets(sizes: Sequence[int], weights: Sequence[float], amount: float = 1.5, repeats: int = 2) -> list[float]:
    """``amount`` times all sizes shared by weight; no target above ``repeats`` times its size, the excess reshared."""
    left, weight, targets = amount * sum(sizes), float(sum(weights)), [0.0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: (repeats * sizes[i] / weights[i], i))
    for k, i in enumerate(order):
        if left / weight < repeats * sizes[i] / weights[i]:
            for j in order[k:]:
                targets[j] = weights[j] * (left / weight)
            break
        targets[i] = float(repeats * sizes[i])
        left, weight = left - targets[i], weight - weights[i]
    return targets


def route_words(patterns: Sequence[tuple[Sequence[int], int]], quotas: Sequence[int], repeats: int = 2) -> list[dict[int, int]]:
    """Words that each pattern ``(its sources, its words)`` gives to each source, at least cost.

    Only the arcs into patterns cost anything, and a path that is added never takes words back from them. So the
    repetitions are opened one after the other, and in each round shortest paths are filled until none is left.
    """
    flow = [dict.fromkeys(sources, 0) for sources, _ in patterns]
    users: list[list[int]] = [[] for _ in quotas]
    for p, (sources, _) in enumerate(patterns):
        for s in sources:
            users[s].append(p)
    room, need = [0] * len(patterns), list(quotas)
    for _ in range(repeats):
        for p, (_, size) in enumerate(patterns):
            room[p] += size
        while _fill(patterns, flow, users, room, need):
            pass
    return [{s: v for s, v in x.items() if v} for x in flow]


def _fill(patterns, flow, users, room: list[int], need: list[int]) -> bool:
    """Fill paths of the least length from patterns with room to sources in need; whether there was one.

    A path goes from a pattern to any of its sources, and back from a source to a pattern that gives it words.
    """
    at_p, at_s = {p: 0 for p in range(len(patterns)) if room[p]}, {}
    queue, end = deque(at_p), None
    while queue:
        p = queue.popleft()
        if end is not None and at_p[p] >= end:
            break
        for s in patterns[p][0]:
            if s not in at_s:
                at_s[s] = at_p[p] + 1
                if need[s]:
                    end = at_s[s]
                for q in users[s]:
                    if q not in at_p and flow[q][s]:
                        at_p[q] = at_s[s] + 1
                        queue.append(q)
    if end is None:
        return False
    at = dict.fromkeys(at_p, 0)  # which of a pattern's sources is tried; those before are dead ends
    ways = {s: iter(users[s]) for s in at_s}
    for start in [p for p, d in at_p.items() if d == 0]:
        path, p = [], start  # (pattern, source, pattern that gives way)
        while room[start]:
            sources = patterns[p][0]
            if at[p] == len(sources):
                if not path:
                    break
                p = path.pop()[0]
                continue
            s = sources[at[p]]
            if at_s.get(s) == at_p[p] + 1:
                if need[s] and at_s[s] == end:
                    most = min(room[start], need[s], *(flow[q][t] for _, t, q in path))
                    for x, t, q in path:
                        flow[x][t] += most
                        flow[q][t] -= most
                    flow[p][s] += most
                    room[start] -= most
                    need[s] -= most
                    path, p = [], start
                    continue
                q = next((q for q in ways[s] if flow[q][s] and at_p.get(q) == at_s[s] + 1), None)
                if q is not None:
                    path.append((p, s, q))
                    p = q
                    continue
            at[p] += 1
    return True


@dataclass
class MixPlan:
    """Tables: ``source_table(k, key, source_size, target, quota)``, ``pattern_table(pattern, full, cut, need, there, source_size, target)`` and
    ``flow_table(pattern, k, words)``. ``full`` repetitions of a pattern's documents are taken, those with a hash under ``cut`` once
    more, and of the ``there`` words at ``cut`` as many as ``need``.
    """

    source_table: DataFrame
    pattern_table: DataFrame
    flow_table: DataFrame

    @property
    def sources(self) -> list[tuple[str | None, int, float]]:
        """(name, size, target) in order; for a look at small plans."""
        return [(json.loads(r["key"])[0], r["source_size"], r["target"]) for r in self.source_table.orderBy("k").collect()]

    @property
    def flows(self) -> list[dict[str | None, int]]:
        """For each pattern the words by source; for a look at small plans."""
        names, out = [n for n, _, _ in self.sources], {}
        for r in self.flow_table.orderBy("pattern", "k").collect():
            out.setdefault(r["pattern"], {})[names[r["k"]]] = r["words"]
        return list(out.values())


def _pattern(source: Column, kind: T.DataType) -> Column:
    """A text for the set of a row's sources."""
    members = source if isinstance(kind, T.ArrayType) else F.array(source)
    return F.coalesce(F.to_json(F.array_sort(F.array_distinct(members))), F.lit("[]"))


def _sources(members: DataFrame, weights: Sequence[float], amount: float, repeats: int) -> DataFrame:
    """``k, key, source_size, target, quota`` from ``members(key, size)``: one row for each source, numbered in code point order, null last."""
    name = F.get_json_object("key", "$[0]")
    order = Window.orderBy(F.col("key") == "[null]", name)  # one row a source
    sized = members.groupBy("key").agg(F.sum("size").alias("source_size")).withColumn("k", F.row_number().over(order).cast("long") - 1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("k") % len(weights) + 1).cast("int"))
    rated = sized.withColumn("weight", weight).withColumn("full_at", repeats * F.col("source_size") / F.col("weight"))
    all_ = Window.partitionBy()
    before = Window.orderBy("full_at", "k").rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(float(amount)) * F.sum("source_size").over(all_).cast("double") - repeats * F.coalesce(F.sum("source_size").over(before), F.lit(0)).cast("double")
    rest = F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    shared = rated.withColumn("level", left / rest).withColumn("capped", F.col("level") >= F.col("full_at"))
    level = F.min(F.when(~F.col("capped"), F.struct("full_at", "k", "level"))).over(all_)
    target = F.when(F.col("capped"), repeats * F.col("source_size").cast("double")).otherwise(F.col("weight") * level["level"])
    return shared.withColumn("target", target).select("k", "key", "source_size", "target", F.floor(F.col("target") + 0.5).cast("long").alias("quota"))


def _route(patterns: DataFrame, members: DataFrame, repeats: int) -> DataFrame:
    """``pattern, k, words`` from ``patterns(pattern, size)`` and ``members(pattern, k, quota)``, each connected part of the network by itself."""
    several = members.groupBy("pattern").agg(F.min("k").alias("src"), F.max("k").alias("other")).where("src != other")
    edges = materialize(several.join(members.select("pattern", "k"), "pattern").select("src", F.col("k").alias("dst")).where("src != dst").distinct(), "mix-edges")
    parts = members.select("pattern", "k", "quota").withColumn("part", F.col("k"))
    if not edges.isEmpty():
        reached = connected_components(edges)
        parts = parts.join(reached.withColumnRenamed("id", "k"), "k", "left").withColumn("part", F.coalesce("component", "part")).drop("component")
    rows = parts.groupBy("pattern").agg(F.min("part").alias("part"), F.sort_array(F.collect_list(F.struct("k", "quota"))).alias("into")).join(patterns, "pattern")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pattern")
        quotas = {x["k"]: x["quota"] for into in pdf["into"] for x in into}
        at = {k: i for i, k in enumerate(sorted(quotas))}
        flows = route_words([([at[x["k"]] for x in into], int(size)) for into, size in zip(pdf["into"], pdf["size"], strict=True)], [quotas[k] for k in sorted(quotas)], repeats)
        names = sorted(quotas)
        found = [(p, names[s], words) for p, x in zip(pdf["pattern"], flows, strict=True) for s, words in x.items()]
        return pd.DataFrame(found, columns=["pattern", "k", "words"])

    return materialize(rows.groupBy("part").applyInPandas(solve, "pattern string, k long, words long"), "mix-flows")


def plan_mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), amount: float = 1.5, repeats: int = 2, seed: int = 0, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> tuple[MixPlan, DataFrame]:
    """The plan, and the table ``(doc_id, pattern, size, u)`` it was made from.

    Sources in code point order, null last, have ``weights`` in turn.
    """
    held = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source"))
    measured = materialize(_measure(held, seed, "doc_id", "text", "source").select("doc_id", "pattern", "size", "u"), "mix")
    patterns = materialize(measured.groupBy("pattern").agg(F.sum("size").alias("size")), "mix-patterns")
    key = F.explode(F.transform(F.from_json("pattern", "array<string>"), lambda s: F.to_json(F.array(s))))
    members = materialize(patterns.select("pattern", "size", key.alias("key")), "mix-members")
    sources = materialize(_sources(members, weights, amount, repeats), "mix-sources")
    known = materialize(members.join(sources, "key").select("pattern", "k", "quota", "source_size", "target"), "mix-quotas")
    flows = _route(patterns, known, repeats)
    takes = patterns.join(flows.groupBy("pattern").agg(F.sum("words").alias("take")), "pattern", "left").withColumn("take", F.coalesce("take", F.lit(0)))
    full = F.when(F.col("size") > 0, F.expr("take div size")).otherwise(F.lit(0)).cast("long")
    rounds = materialize(takes.withColumn("full", full).withColumn("missing", F.col("take") - F.col("full") * F.col("size")).select("pattern", "full", "missing"), "mix-takes")
    cuts = _thresholds(measured, rounds.where("missing > 0").select("pattern", F.col("missing").alias("need")))
    # of a pattern of one source, as a column of the result
    single = known.groupBy("pattern").agg(F.min("source_size").alias("source_size"), F.min("target").alias("target"))
    table = rounds.join(cuts, "pattern", "left").join(single, "pattern", "left")
    table = table.select("pattern", "full", F.coalesce("cut", F.lit(-1)).cast("long").alias("cut"), F.coalesce("need", F.lit(0)).cast("long").alias("need"), F.coalesce("there", F.lit(1)).cast("long").alias("there"), "source_size", "target")
    return MixPlan(sources, materialize(table, "mix-plan"), flows), measured


def _thresholds(measured: DataFrame, missing: DataFrame) -> DataFrame:
    """``pattern, cut, need, there``: the hash at which the words in ``missing(pattern, need)`` are reached, the words missing there, and the words there."""
    open_ = materialize(missing.select("pattern", F.lit(0).cast("long").alias("first"), "need"), "mix-open")
    done: DataFrame | None = None
    upto = Window.partitionBy("pattern").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    for shift in range(BITS - STEP, -1, -STEP):
        if open_.isEmpty():
            break
        inside = measured.join(open_, "pattern").where(F.shiftright("u", shift + STEP) == F.col("first"))
        bins = inside.groupBy("pattern", F.shiftright("u", shift).alias("bin")).agg(F.sum("size").alias("size"), F.min("u").alias("low"), F.max("u").alias("high"), F.first("need").alias("need"))
        reached = bins.withColumn("upto", F.sum("size").over(upto)).where("need < upto").withColumn("need", F.col("need") - F.col("upto") + F.col("size"))
        first = F.min_by(F.struct("bin", "low", "high", "need", "size"), "bin").alias("x")
        found = materialize(reached.groupBy("pattern").agg(first).select("pattern", "x.*"), "mix-bins")
        ready = found.where("low = high").select("pattern", F.col("low").alias("cut"), "need", F.col("size").alias("there"))
        done = ready if done is None else done.unionAll(ready)
        last, open_ = open_, found.where("low != high").select("pattern", F.col("bin").alias("first"), "need")
        if last.inputFiles() and shift == BITS - STEP:
            forget(last)
    if done is None:
        return open_.select("pattern", F.col("first").alias("cut"), "need", F.col("need").alias("there"))
    return done


def _measure(docs: DataFrame, seed: int, doc_id: str, text: str, source: str) -> DataFrame:
    return docs.select("*", _pattern(F.col(source), docs.schema[source].dataType).alias("pattern"), word_count(F.col(text)).alias("size"), seeded_hash(F.col(doc_id), seed).alias("u"))


def _taken(rows: DataFrame, plan: MixPlan) -> DataFrame:
    """``rows(pattern, size, u)`` with ``taken``, and the size and the target of a pattern's source."""
    more = F.when(F.col("u") < F.col("cut"), F.col("size")).when(F.col("u") == F.col("cut"), F.expr("cast(cast(size as decimal(20,0)) * need div there as long)")).otherwise(0)
    return rows.join(plan.pattern_table, "pattern").withColumn("taken", F.col("full") * F.col("size") + more)


def measure_mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), amount: float = 1.5, repeats: int = 2, seed: int = 0, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document of one source each: ``doc_id, size, source_size, target, taken``."""
    plan, measured = plan_mix(docs, weights, amount, repeats, seed, doc_id, text, source)
    return _taken(measured, plan).select("doc_id", "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), amount: float = 1.5, repeats: int = 2, seed: int = 0, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` as mixed: each row as often as the mix takes its words, to the nearest whole document."""
    plan, measured = plan_mix(docs, weights, amount, repeats, seed, doc_id, text, source)
    forget(measured)
    names = {c: f"_mix_{c}" for c in docs.columns}
    held = docs.select(*(F.col(c).alias(x) for c, x in names.items()))  # no clash with the columns made here
    taken = _taken(_measure(held, seed, names[doc_id], names[text], names[source]), plan)
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    return taken.withColumn("copy", F.explode(F.array_repeat(F.lit(0), copies))).select(*(F.col(x).alias(c) for c, x in names.items()))
