"""Ranking, ties, hierarchy and synonyms. Ties are broken by the entity's name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _best(*keys: str):
    return Window.partitionBy(*keys).orderBy(F.desc("sim"), "entity")


def top_k(candidates: DataFrame, k: int = 10, *keys: str) -> DataFrame:
    return candidates.withColumn("rank", F.row_number().over(_best(*(keys or ("mention",))))).where(F.col("rank") <= k)


def ties_at_top(candidates: DataFrame) -> DataFrame:
    w = Window.partitionBy("mention").orderBy(F.desc("sim"))
    return candidates.withColumn("r", F.rank().over(w)).where("r = 1").drop("r")


def prune_parents(candidates: DataFrame, entities: DataFrame, parents: DataFrame) -> DataFrame:
    """Drop a three-character parent where one of its children is a candidate too; a list that this empties stays."""
    child = candidates.join(entities.select(F.col("name").alias("entity"), "l3"), "entity").select("mention", "l3").distinct()
    gone = child.join(parents.select("l3", F.col("name").alias("entity")), "l3").select("mention", "entity")
    marked = candidates.join(gone.withColumn("gone", F.lit(True)).distinct(), ["mention", "entity"], "left").withColumn("left", F.count(F.when(F.col("gone").isNull(), 1)).over(Window.partitionBy("mention")))
    return marked.where("gone is null or left = 0").select(*candidates.columns)


def prior(labels: DataFrame, entity: str = "entity") -> DataFrame:
    """``entity, prior``: the share of labelled rows."""
    counts = labels.groupBy(F.col(entity).alias("entity")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("entity", (F.col("n") / F.col("total")).alias("prior"))  # one row


def top_per_segment(candidates: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """The best candidate of each segment; of ``parts(mention, seg_no)`` those without candidates have an empty name at 0."""
    best = top_k(candidates, 1, "mention", "seg_no").drop("rank")
    if parts is None:
        return best
    return parts.select("mention", "seg_no").join(best, ["mention", "seg_no"], "left").withColumn("entity", F.coalesce("entity", F.lit(""))).withColumn("sim", F.coalesce("sim", F.lit(0.0)))


def top_by_tokens(candidates: DataFrame, segments: DataFrame, tokens: DataFrame, depth: int = 5, least: float = 0.85) -> DataFrame:
    """Of a segment's best ``depth``, the first whose tokens are all in its text, or all but one at a similarity over ``least``; else the best."""
    r = top_k(candidates, depth, "mention", "seg_no").join(segments, ["mention", "seg_no"]).join(tokens.select(F.col("name").alias("entity"), "tokens"), "entity", "left")
    missing = F.size(F.filter("tokens", lambda t: ~F.contains(F.col("seg"), t)))
    passes = F.coalesce((missing == 0) | (missing == 1) & (F.col("sim") > least), F.lit(False))
    w = Window.partitionBy("mention", "seg_no").orderBy(F.desc("passes"), "rank")
    return r.withColumn("passes", passes).withColumn("n", F.row_number().over(w)).where("n = 1").select("mention", "seg_no", "entity", "sim")


def top_1_with_prior(winners: DataFrame, priors: DataFrame, whole: str = "is_whole", gate: float = 0.90, entities: DataFrame | None = None, parents: DataFrame | None = None) -> DataFrame:
    """Of the winners of segments, the one of the highest prior; the whole's winner joins where no segment's reaches ``gate``.

    With ``entities`` and ``parents``, parents of other winners are out first.
    """
    strong = F.max(F.when(~F.col(whole), F.col("sim"))).over(Window.partitionBy("mention"))
    ok = winners.where("entity != ''").withColumn("strong", F.coalesce(strong, F.lit(0.0))).where(~F.col(whole) | (F.col("strong") < gate))
    ok = ok.groupBy("mention", "entity").agg(F.max("sim").alias("sim"))
    if entities is not None and parents is not None:
        ok = prune_parents(ok, entities, parents)
    w = Window.partitionBy("mention").orderBy(F.desc(F.coalesce("prior", F.lit(0.0))), F.desc("sim"), "entity")
    return ok.join(priors, "entity", "left").withColumn("n", F.row_number().over(w)).where("n = 1").select("mention", "entity", "sim")


def disambiguate(candidates: DataFrame, k: int, entities: DataFrame, parents: DataFrame, aliases: DataFrame) -> DataFrame:
    """``mention, place, entity``: the ``k`` best, or as many as there are.

    For k = 1 the first of those that tie at the top, parents of others left out, and its synonyms behind it.
    """
    if k != 1:
        return top_k(candidates, k).select("mention", F.col("rank").alias("place"), "entity")
    first = top_k(prune_parents(ties_at_top(candidates), entities, parents), 1).select("mention", "entity")
    more = first.join(aliases.select(F.col("a").alias("entity"), "b"), "entity").select("mention", F.col("b").alias("entity"))
    behind = more.withColumn("place", F.row_number().over(Window.partitionBy("mention").orderBy("entity")) + 1)
    return first.select("mention", F.lit(1).alias("place"), "entity").unionByName(behind.select("mention", "place", "entity"))


def show_synonyms(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """``shown``: the entity and its synonyms, joined by ``/``."""
    other = aliases.groupBy(F.col("a").alias("entity")).agg(F.sort_array(F.collect_set("b")).alias("others"))
    return rows.join(other, "entity", "left").withColumn("shown", F.concat_ws("/", "entity", F.concat_ws("/", "others"))).withColumn("shown", F.regexp_replace("shown", "/$", "")).drop("others")


def is_correct(rows: DataFrame, aliases: DataFrame, answer: str = "answer") -> DataFrame:
    """``correct``: the entity is the answer or its synonym."""
    both = aliases.select(F.col("a").alias("entity"), F.col("b").alias(answer)).distinct().withColumn("same", F.lit(True))
    return rows.join(both, ["entity", answer], "left").withColumn("correct", F.coalesce(F.col("entity") == F.col(answer), F.lit(False)) | F.coalesce("same", F.lit(False))).drop("same")


def canonical_names(rows: DataFrame, canon: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with the names in ``columns`` replaced by their canonical ones of ``canon(name, canon)``, for evaluation over synonyms."""
    for c in columns:
        rows = rows.join(canon.select(F.col("name").alias(c), F.col("canon").alias("_canon")), c, "left").withColumn(c, F.coalesce("_canon", c)).drop("_canon")
    return rows


def ties_correct(candidates: DataFrame, truth: DataFrame, canon: DataFrame | None = None) -> DataFrame:
    """``mention, truth, predicted, correct``: right if any of those that tie at the top is the truth or a synonym of it; else the first of them is what was predicted."""
    ties, asked = ties_at_top(candidates).select("mention", F.col("entity").alias("predicted")), truth.select("mention", "truth")
    if canon is not None:
        ties, asked = canonical_names(ties, canon, "predicted"), canonical_names(asked, canon, "truth")
    both = asked.join(ties, "mention", "left").withColumn("hit", F.coalesce(F.col("truth") == F.col("predicted"), F.lit(False)))
    w = Window.partitionBy("mention").orderBy(F.desc("hit"), "predicted")
    return both.withColumn("n", F.row_number().over(w)).where("n = 1").select("mention", "truth", "predicted", F.col("hit").alias("correct"))
