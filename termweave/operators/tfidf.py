"""TF-IDF weights over a corpus of token lists, and their cosine, in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def weights(tokens: DataFrame, key: str = "id", token: str = "token") -> DataFrame:
    """``id, token, weight`` from one row per occurrence: tf * (ln((1 + n) / (1 + df)) + 1), of length 1 per id."""
    tf = tokens.groupBy(F.col(key).alias("id"), F.col(token).alias("token")).agg(F.count("*").alias("tf"))
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    n = tokens.agg(F.count_distinct(key).alias("n"))
    raw = tf.join(df, "token").join(F.broadcast(n)).withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))  # n is one row
    return raw.select("id", "token", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))).alias("weight"))


def cosine(left: DataFrame, right: DataFrame) -> DataFrame:
    """``l, r, sim`` of pairs with a common token; both sides are weights of length 1."""
    a, b = left.select(F.col("id").alias("l"), "token", F.col("weight").alias("x")), right.select(F.col("id").alias("r"), "token", F.col("weight").alias("y"))
    return a.join(b, "token").groupBy("l", "r").agg(F.sum(F.col("x") * F.col("y")).alias("sim"))


def fit(tokens: DataFrame, *groups: str, key: str = "id", token: str = "token") -> DataFrame:
    """``(groups), token, idf``: what ``weigh`` needs of a corpus, for every group by itself. A table, to be kept and used again."""
    df = tokens.select(*groups, F.col(key).alias("id"), F.col(token).alias("token")).distinct()
    n = df.groupBy(*groups).agg(F.count_distinct("id").alias("n"))
    counts = df.groupBy(*groups, "token").agg(F.count("*").alias("df"))
    both = counts.join(n, list(groups)) if groups else counts.join(F.broadcast(n))  # one row
    return both.select(*groups, "token", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def weigh(tokens: DataFrame, fitted: DataFrame, *groups: str, key: str = "id", token: str = "token") -> DataFrame:
    """``(groups), id, token, weight`` of length 1 by a corpus that was fitted; tokens that it doesn't hold have no weight."""
    tf = tokens.groupBy(*groups, F.col(key).alias("id"), F.col(token).alias("token")).agg(F.count("*").alias("tf"))
    raw = tf.join(fitted, [*groups, "token"]).withColumn("w", F.col("tf") * F.col("idf"))
    size = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*groups, "id")))
    return raw.select(*groups, "id", "token", (F.col("w") / size).alias("weight"))


def keyword_similarity(texts: DataFrame, fitted: DataFrame, keywords: DataFrame) -> DataFrame:
    """``text, entity, weight_sim``: cosine of the tokens of ``texts(text, token)`` with the stored weights ``keywords(entity, token, weight)``; no row where none is common."""
    mine = weigh(texts.withColumnRenamed("text", "id"), fitted).select(F.col("id").alias("l"), "token", F.col("weight").alias("x"))
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("entity")))
    theirs = keywords.select("entity", "token", (F.col("weight") / norm).alias("y"))
    found = mine.join(theirs, "token").groupBy("l", "entity").agg(F.sum(F.col("x") * F.col("y")).alias("weight_sim"))
    return found.select(F.col("l").alias("text"), "entity", "weight_sim")
