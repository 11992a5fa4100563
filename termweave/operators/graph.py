"""Co-occurrence graphs from long records ``item(record_id, slot, role, name)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SUFFIXES = {"main": "_main", "vice": "_vice", "surg": "_surg"}


def canonicalise(items: DataFrame, canon: DataFrame) -> DataFrame:
    return items.join(canon, "name", "left").withColumn("name", F.coalesce("canon", "name")).drop("canon")


def recognised(items: DataFrame, names: DataFrame) -> DataFrame:
    return items.join(names.select("name").distinct(), "name", "left_semi")


def occurrences(items: DataFrame, bias: int = 0) -> DataFrame:
    """``name, occ``: records that hold a name, plus ``bias``."""
    return items.groupBy("name").agg((F.count_distinct("record_id") + bias).alias("occ"))


def clique_pairs(items: DataFrame) -> DataFrame:
    """``a, b, n`` with a < b: records in which both occur."""
    d = items.select("record_id", "name").distinct()
    return d.withColumnRenamed("name", "a").join(d.withColumnRenamed("name", "b"), "record_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def star_pairs(items: DataFrame) -> DataFrame:
    """``a, b, n``: a main name with each other name of its record."""
    main = items.where("role = 'main'").select("record_id", F.col("name").alias("a")).distinct()
    rest = items.where("role != 'main'").select("record_id", F.col("name").alias("b")).distinct()
    return main.join(rest, "record_id").where("a != b").groupBy("a", "b").agg(F.count("*").alias("n"))


def positional_pairs(items: DataFrame, ordered: bool = False) -> DataFrame:
    """``a, b, n`` over places p < q of a record with repeats kept (pairs as a <= b), or over all p != q.

    Written items are far smaller than they are in memory, so Spark must not choose to broadcast them by their files.
    """
    x, y = items.select("record_id", F.col("slot").alias("p"), F.col("name").alias("x")), items.select("record_id", F.col("slot").alias("q"), F.col("name").alias("y"))
    j = x.hint("merge").join(y, "record_id").where("p != q" if ordered else "p < q")
    a, b = (F.col("x"), F.col("y")) if ordered else (F.least("x", "y"), F.greatest("x", "y"))
    return j.groupBy(a.alias("a"), b.alias("b")).agg(F.count("*").alias("n"))


def both_directions(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "n").unionAll(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"), "n"))


def conditional_edges(pairs: DataFrame, occ: DataFrame, pair_bias: int = 0) -> DataFrame:
    """``src, dst, weight`` = (pair count + bias) / occurrences of src, in both directions."""
    return both_directions(pairs).join(occ.withColumnRenamed("name", "src"), "src").select("src", "dst", ((F.col("n") + pair_bias) / F.col("occ")).alias("weight"))


def with_role_suffix(items: DataFrame, suffixes: dict[str, str] = SUFFIXES) -> DataFrame:
    suffix = F.coalesce(F.create_map(*(F.lit(x) for kv in suffixes.items() for x in kv))[F.col("role")], F.lit(""))
    return items.withColumn("name", F.concat("name", suffix))


def roll_up(items: DataFrame, codes: DataFrame, level: DataFrame) -> DataFrame:
    """Names replaced by those of their five-character group."""
    up = codes.select("name", "l4").join(level.select("l4", F.col("name").alias("up")), "l4").select("name", "up")
    return items.join(up, "name").withColumn("name", F.col("up")).drop("up")


def mention_neighbours(items: DataFrame, mentions: DataFrame) -> DataFrame:
    """``mention, entity``: the other names of the records that hold a mention."""
    m = items.join(mentions.select(F.col("mention").alias("name")).distinct(), "name", "left_semi").select("record_id", F.col("name").alias("mention"))
    return m.join(items.select("record_id", F.col("name").alias("entity")), "record_id").where("mention != entity").select("mention", "entity").distinct()


def neighbours_by_role(items: DataFrame, mentions: DataFrame) -> DataFrame:
    """``mention, role, entity``: the other names of the records that hold a mention, apart for each role they have there."""
    m = items.join(mentions.select(F.col("mention").alias("name")).distinct(), "name", "left_semi").select("record_id", F.col("name").alias("mention"))
    return m.join(items.select("record_id", "role", F.col("name").alias("entity")), "record_id").where("mention != entity").select("mention", "role", "entity").distinct()


def mixed_graph(items: DataFrame, best: DataFrame, names: DataFrame, gate: float = 0.857) -> tuple[DataFrame, DataFrame]:
    """``(vertices(name, type), edges(a, b, n))`` of mentions resolved where they can be; every name of the dictionary is a vertex."""
    resolved = resolve_mentions(items, best, gate)
    types = resolved.select("name", "type").unionAll(names.select("name", F.lit(1))).groupBy("name").agg(F.max("type").alias("type"))
    return types, positional_pairs(resolved)


def resolve_mentions(items: DataFrame, best: DataFrame, gate: float = 0.857) -> DataFrame:
    """Mixed vertices: mentions whose best candidate passes the gate become it (type 1), others stay (type 0)."""
    sure = best.where(F.col("sim") > gate).select(F.col("mention").alias("name"), "entity")
    return items.join(sure, "name", "left").withColumn("type", F.col("entity").isNotNull().cast("int")).withColumn("name", F.coalesce("entity", "name")).drop("entity")


def log_network(items: DataFrame, names: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges ``src, dst, weight = ln(n + 2)`` (every other cell is ln 2) and vertices ``name, popularity = (1 + count) / sum``.

    With ``names(name)``, a closed dictionary, its names without items count as 1 too.
    """
    return weigh_network(positional_pairs(items, ordered=True), items.select("name", F.lit(1).alias("c")), names)


def weigh_network(pairs: DataFrame, counts: DataFrame, names: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``log_network`` from ``pairs(a, b, n)`` and ``counts(name, c)``, which are summed."""
    edges = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.log(F.col("n") + F.lit(2)).alias("weight"))
    said = counts.select("name", "c")
    if names is not None:
        said = said.unionAll(names.select("name").distinct().select("name", F.lit(0)))
    counts = said.groupBy("name").agg((F.sum("c") + 1).alias("c"))
    total = counts.agg(F.sum("c").alias("total"))
    return edges, counts.join(F.broadcast(total)).select("name", (F.col("c") / F.col("total")).alias("popularity"))  # total is one row


def fall_back(items: DataFrame, names: DataFrame, known: DataFrame | None, last_slot: int = 10) -> DataFrame:
    """``items`` in which a name of the first slots that isn't in the dictionary ``names`` is what an earlier round found for it in ``known(name, entity)``."""
    if known is None:
        return items
    own = names.select("name").distinct().withColumn("own", F.lit(True))
    found = items.join(known.select("name", F.col("entity").alias("found")), "name", "left").join(own, "name", "left")
    use = (F.col("slot") <= last_slot) & F.col("own").isNull() & F.col("found").isNotNull()
    return found.select(*(F.when(use, F.col("found")).otherwise(F.col("name")).alias("name") if c == "name" else F.col(c) for c in items.columns))


def isolated(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    used = edges.select(F.col("src").alias("name")).union(edges.select("dst")).distinct()
    return vertices.join(used, "name", "left_anti")


def records_with(items: DataFrame, names: DataFrame, last_slot: int = 10) -> DataFrame:
    """Records of which one of the first slots holds a name of the list. ``items`` is read once."""
    listed = items.join(names.select("name").distinct().withColumn("_listed", F.lit(True)), "name", "left")
    hit = F.max(F.coalesce(F.col("_listed") & (F.col("slot") <= last_slot), F.lit(False))).over(Window.partitionBy("record_id"))
    return listed.withColumn("_hit", hit).where("_hit").select(*items.columns)


def network_size(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    return vertices.agg(F.count("*").alias("nodes")).join(edges.agg(F.count("*").alias("edges")))
