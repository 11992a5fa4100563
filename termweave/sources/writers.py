"""Sinks. Intermediates are Parquet; the text forms are for readers outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def write_lines(df: DataFrame, path: str, columns: list[str], sep: str = " ") -> None:
    """One line per row, fields joined by ``sep``; nulls are empty."""
    df.select(F.concat_ws(sep, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)).alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, header: bool = True, quote_all: bool = False) -> None:
    df.write.mode("overwrite").csv(path, header=header, quoteAll=quote_all)


def candidate_pairs(candidates: DataFrame, k: int = 10) -> DataFrame:
    """``mention, pairs``: the k best as ``name:similarity``, best first."""
    from ..operators.rank import top_k

    pair = F.struct("rank", F.concat_ws(":", "entity", F.round("sim", 6).cast("string")).alias("pair"))
    return top_k(candidates, k).groupBy("mention").agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(pair)), lambda x: x["pair"])).alias("pairs"))


def case_bucket(has_candidates: Column, answer_among: Column) -> Column:
    """Which of three files a case goes to."""
    return F.when(~has_candidates, "no_candidates").when(answer_among, "answer_among").otherwise("answer_missing")


def write_cases(cases: DataFrame, path: str) -> None:
    """One folder per value of ``bucket``."""
    cases.write.mode("overwrite").partitionBy("bucket").parquet(path)


def adjacency_lines(edges: DataFrame) -> DataFrame:
    """``src, degree, neighbours``: each vertex once, neighbours as ``name weight`` in order."""
    pair = F.struct("dst", F.concat_ws(" ", "dst", F.col("weight").cast("string")).alias("pair"))
    return edges.groupBy("src").agg(F.count("*").alias("degree"), F.transform(F.sort_array(F.collect_list(pair)), lambda x: x["pair"]).alias("neighbours"))


def _write_in_order(parts: DataFrame, path: str) -> None:
    """``parts(place, value)`` as the lines of one file, in order: the formats below are sequences for readers outside."""
    parts.orderBy("place").select("value").coalesce(1).write.mode("overwrite").text(path)


def write_adjacency(edges: DataFrame, path: str, weighted: bool = True) -> None:
    """The text form that ``read_adjacency`` reads: a count of nodes, then for each ``node degree`` and its lines ``neighbour weight``."""
    by = adjacency_lines(edges if weighted else edges.withColumn("weight", F.lit(None).cast("double")))
    count = by.agg(F.count("*").cast("string").alias("value")).select(F.lit("").alias("place"), "value")
    block = F.concat_ws("\n", F.concat_ws(" ", "src", F.col("degree").cast("string")), F.concat_ws("\n", "neighbours"))
    _write_in_order(count.unionByName(by.select(F.concat(F.lit("1"), "src").alias("place"), block.alias("value"))), path)


def write_name_sets(neighbours: DataFrame, path: str) -> None:
    """The text form that ``read_name_sets`` reads, from ``neighbours(mention, entity)``."""
    by = neighbours.distinct().groupBy("mention").agg(F.sort_array(F.collect_list("entity")).alias("names"))
    block = F.concat(F.concat_ws(" | ", "mention", F.size("names").cast("string")), F.lit("\n"), F.concat_ws("\n", "names"), F.lit("\n"))
    _write_in_order(by.select(F.col("mention").alias("place"), block.alias("value")), path)


def write_mention_neighbours(neighbours: DataFrame, path: str) -> None:
    """One line a mention: it, four spaces, and its neighbours, each with a space behind it."""
    by = neighbours.distinct().groupBy("mention").agg(F.sort_array(F.collect_list("entity")).alias("names"))
    line = F.concat(F.col("mention"), F.lit("    "), F.concat_ws("", F.transform("names", lambda x: F.concat(x, F.lit(" ")))))
    by.select(line.alias("value")).write.mode("overwrite").text(path)


def write_similarities(sims: DataFrame, path: str) -> None:
    """For each vertex a line with its name and a colon, then its similar ones as ``name score``, the most similar first, and a blank line."""
    pair = F.struct((-F.col("v")).alias("low"), "j", F.concat_ws(" ", "j", F.format_string("%.6f", "v")).alias("said"))
    by = sims.groupBy("i").agg(F.transform(F.sort_array(F.collect_list(pair)), lambda x: x["said"]).alias("rows"))
    block = F.concat(F.col("i"), F.lit(":\n"), F.concat_ws("\n", "rows"), F.lit("\n"))
    _write_in_order(by.select(F.col("i").alias("place"), block.alias("value")), path)


def write_keywords(weights: DataFrame, path: str) -> None:
    """``code-token:weight,token:weight`` for each code, the heaviest first."""
    pair = F.struct((-F.col("weight")).alias("low"), "token", F.concat_ws(":", "token", F.col("weight").cast("string")).alias("said"))
    by = weights.groupBy("code").agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(pair)), lambda x: x["said"])).alias("said"))
    by.select(F.concat_ws("-", "code", "said").alias("value")).write.mode("overwrite").text(path)


def write_entity_tokens(tokens: DataFrame, path: str) -> None:
    """``code:token token:name`` for each row of ``tokens(code, tokens, name)``."""
    tokens.select(F.concat_ws(":", "code", F.concat_ws(" ", "tokens"), "name").alias("value")).write.mode("overwrite").text(path)


def write_results(results: DataFrame, path: str) -> None:
    """A CSV file that spreadsheets take for UTF-8 by its first character: ``mention, segments, tops, pairs``, all quoted."""
    quoted = F.concat_ws(",", *(F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in ("mention", "segments", "tops", "pairs")))
    first = F.row_number().over(Window.orderBy("mention")) == 1  # a single file
    _write_in_order(results.select(F.col("mention").alias("place"), F.concat(F.when(first, "\ufeff").otherwise(""), quoted).alias("value")), path)


def result_rows(segmented: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """``mention, segments, tops, pairs``: the segments, the best of each and the ``k`` best of all as ``name:similarity``."""
    from ..operators.candidates import flatten_segments
    from ..operators.rank import top_per_segment

    tops = top_per_segment(candidates).groupBy("mention").agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("seg_no", "entity"))), lambda x: x["entity"])).alias("tops"))
    said = segmented.select("mention", F.concat_ws(" ", "segments").alias("segments"))
    return said.join(tops, "mention", "left").join(candidate_pairs(flatten_segments(candidates), k), "mention", "left").na.fill("", ["tops", "pairs"])


def summary(cases: DataFrame) -> DataFrame:
    """One row: ``total, has_candidates, answer_among, correct, accuracy`` of ``cases(has_candidates, answer_among, correct)``."""
    n = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(c)
    rows = cases.agg(F.count("*").alias("total"), n("has_candidates"), n("answer_among"), n("correct"))
    return rows.withColumn("accuracy", F.coalesce(F.col("correct") / F.nullif("total", F.lit(0)), F.lit(0.0)))


def record_log(ranked: DataFrame, truth: DataFrame, network: DataFrame, popularity: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of ranked records: their candidates with the truth, how many tie for the first place and whether that is wrong; the weights of their pairs; the popularity of their names."""
    by = Window.partitionBy("record_id", "slot")
    top = F.max("score").over(by)
    said = ranked.join(truth, ["record_id", "slot"], "left").withColumn("is_top", F.col("score") == top)
    right = F.max(F.coalesce(F.col("is_top") & (F.col("entity") == F.col("truth")), F.lit(False))).over(by)
    lines = said.withColumn("n_top", F.sum(F.col("is_top").cast("long")).over(by)).withColumn("wrong", F.col("truth").isNotNull() & ~right).drop("is_top")
    names = ranked.select("record_id", "entity").distinct()
    pairs = names.withColumnRenamed("entity", "src").join(names.withColumnRenamed("entity", "dst"), "record_id").join(network, ["src", "dst"], "left")
    pairs = pairs.select("record_id", "src", "dst", F.coalesce("weight", F.log(F.lit(2.0))).alias("weight"))
    return lines, pairs, names.join(popularity.withColumnRenamed("name", "entity"), "entity", "left").select("record_id", "entity", "popularity")


def write_viewer(vertices: DataFrame, edges: DataFrame, path: str, interest: DataFrame | None = None) -> None:
    """Node and edge CSVs for a graph viewer, without isolated nodes; of an interest list, its edges alone."""
    if interest is not None:
        edges = edges.join(interest.select(F.col("name").alias("src")), "src", "left_semi")
    used = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    write_csv(vertices.join(used, "id", "left_semi").select(F.col("id").alias("Id"), F.col("label").alias("Label"), F.col("type").alias("Type")), f"{path}/nodes")
    write_csv(edges.select(F.col("src").alias("Source"), F.col("dst").alias("Target"), F.col("weight").alias("Weight")), f"{path}/edges")
