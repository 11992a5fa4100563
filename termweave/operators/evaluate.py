"""Evaluation of links against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accuracy(links: DataFrame) -> DataFrame:
    """``total, correct, wrong, accuracy`` of ``(truth, predicted)``; rows without truth don't count."""
    ok = F.coalesce(F.col("truth") == F.col("predicted"), F.lit(False)).cast("long")
    rows = links.where("truth is not null").agg(F.count("*").alias("total"), F.coalesce(F.sum(ok), F.lit(0)).alias("correct"))
    return rows.withColumn("wrong", F.col("total") - F.col("correct")).withColumn("accuracy", F.coalesce(F.col("correct") / F.nullif("total", F.lit(0)), F.lit(0.0)))


def per_class(links: DataFrame) -> DataFrame:
    """``entity, n_pred, n_true, tp, precision, recall, f1``; a missing side is 0."""
    pred = links.where("predicted is not null").groupBy(F.col("predicted").alias("entity")).agg(F.count("*").alias("n_pred"), F.sum(F.coalesce(F.col("truth") == F.col("predicted"), F.lit(False)).cast("long")).alias("tp"))
    true = links.where("truth is not null").groupBy(F.col("truth").alias("entity")).agg(F.count("*").alias("n_true"))
    j = pred.join(true, "entity", "full_outer").fillna(0, ["n_pred", "n_true", "tp"])
    ratio = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    j = j.withColumn("precision", ratio("tp", "n_pred")).withColumn("recall", ratio("tp", "n_true"))
    both = F.col("precision") + F.col("recall")
    return j.withColumn("f1", F.when(both == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / F.nullif(both, F.lit(0.0))))


def macro(classes: DataFrame) -> DataFrame:
    return classes.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))


def size_histogram(candidates: DataFrame, width: int = 5, bins: int = 6) -> DataFrame:
    """``bin, n``: mentions by their number of candidates; the last bin takes the rest."""
    n = candidates.groupBy("mention").agg(F.count("*").alias("c"))
    return n.groupBy(F.least(F.floor(F.col("c") / width), F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def type_histogram(candidates: DataFrame) -> DataFrame:
    return candidates.select("mention", "match_type").distinct().groupBy("match_type").agg(F.count("*").alias("n"))


def candidate_recall(labels: DataFrame, candidates: DataFrame) -> DataFrame:
    """``total, found, recall``: labels whose entity is among the candidates."""
    hit = labels.join(candidates.select("mention", "entity").distinct().withColumn("hit", F.lit(1)), ["mention", "entity"], "left")
    return hit.agg(F.count("*").alias("total"), F.coalesce(F.sum("hit"), F.lit(0)).alias("found")).withColumn("recall", F.coalesce(F.col("found") / F.nullif("total", F.lit(0)), F.lit(0.0)))


def confusion(links: DataFrame) -> DataFrame:
    return links.where("truth != predicted").groupBy("predicted", "truth").agg(F.count("*").alias("n"))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """``n_before, n_after, gained, lost`` of ``(mention, correct)`` tables."""
    j = before.select("mention", F.col("correct").alias("b")).join(after.select("mention", F.col("correct").alias("a")), "mention")
    count = lambda c: F.coalesce(F.sum(F.expr(c).cast("long")), F.lit(0))
    return j.agg(count("b").alias("n_before"), count("a").alias("n_after"), count("a and not b").alias("gained"), count("b and not a").alias("lost"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``mention, entity_before, entity_after, change``: what was gained and lost between two tables ``(mention, entity, correct)``."""
    j = before.select("mention", F.col("entity").alias("entity_before"), F.col("correct").alias("b")).join(after.select("mention", F.col("entity").alias("entity_after"), F.col("correct").alias("a")), "mention")
    change = F.when(F.col("a") & ~F.col("b"), "gained").when(F.col("b") & ~F.col("a"), "lost")
    return j.withColumn("change", change).where("change is not null").select("mention", "entity_before", "entity_after", "change")
