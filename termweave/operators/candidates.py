"""Candidate generation: from mentions to ``(mention, seg_no, entity, sim, match_type)``.

A mention comes as ``mention`` and, where it has been split, ``segments``. The dictionary of entities is closed. It is broadcast
while its rows and their bytes are under ``BROADCAST_ROWS`` and ``BROADCAST_BYTES``, which are measured. Beyond, pairs come from a join
on first letters of syllables (characters, without a table). Every tier asks that a text holds a name's characters, or that a
similarity reaches 0.57 on texts without locations; either way ``LEAST_COMMON`` of the name's syllables, or of its different characters,
begin as some of the text's do. So a name's commonest first letters that make up less than that of both need no row in the join, and
no pair is lost. A name without any pairs with all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as X
from ..runtime import materialize

# Match types and thresholds.
EXACT, SEMI, LOCATION, FUZZY = 1, 2, 3, 4
SEMI_SIM, FUZZY_SIM, PROMOTED_SIM, LOCATION_SIM, SIBLING_SIM = 0.80, 0.62, 0.68, 0.70, 0.70
SEGMENT_CONTAINS_SIM, SEGMENT_FUZZY_SIM, WHOLE_FUZZY_SIM = 0.30, 0.65, 0.70
PARENT_SIM, HIGH_CONFIDENCE = 0.1, 0.857
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
#: Under (0.70 - 0.29) / 0.71, which the location tier can do with, and under all other thresholds.
LEAST_COMMON = 0.57


def _small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` is under both bounds. At most ``rows`` + 1 rows are looked at."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
    size = F.coalesce(F.sum(sum(texts, F.lit(16))), F.lit(0))
    n, total = df.limit(rows + 1).agg(F.count("*"), size).first()
    return n <= rows and total <= BROADCAST_BYTES


def fit_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is proven small, else as it is."""
    return F.broadcast(df) if _small(df, rows) else df


def exact(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Mentions that are names."""
    names = fit_broadcast(entities.select(F.col("name").alias("entity")).distinct())
    return mentions.join(names, F.col("mention") == F.col("entity")).select("mention", "entity", F.lit(1.0).alias("sim"), F.lit(EXACT).alias("match_type"))


def unmatched(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    return mentions.join(entities, mentions["mention"] == entities["name"], "left_anti")


def _table(syllables: Column | None) -> Column:
    """Without a syllable table each character is its own syllable."""
    return syllables if syllables is not None else F.create_map().cast("map<string,string>")


def _segmented(mentions: DataFrame) -> DataFrame:
    """``mention, segments, whole``, each mention once. Whatever has no segments is one."""
    if "segments" not in mentions.columns:
        return mentions.select("mention").distinct().select("mention", F.array("mention").alias("segments"), F.col("mention").alias("whole"))
    return mentions.select("mention", "segments").dropDuplicates(["mention"]).withColumn("whole", F.concat_ws("", "segments"))


def pairs(texts: DataFrame, entities: DataFrame, rule: Column, syllables: Column | None = None) -> DataFrame:
    """``texts`` (with the column ``text``) and entities that can be similar and keep ``rule``.

    ``rule`` may use ``t_neg, t_loc`` and ``e_neg, e_loc``: whether a side is negated, and how many locations it has.
    """
    flags = lambda d, c, p: d.withColumn(f"{p}_neg", X.negation(F.col(c))).withColumn(f"{p}_loc", F.size(X.locations(F.col(c))))
    t = flags(texts, "text", "t")
    e = flags(entities.select(F.col("name").alias("entity"), "code"), "entity", "e")
    if _small(e):
        return t.join(F.broadcast(e), rule)
    table = _table(syllables)
    begins = lambda c: F.transform(X.syllables(c, table), lambda x: F.substring(x, 1, 1))
    bare = F.filter(F.split(X.strip_locations(F.col("entity")), ""), lambda x: x != "")
    signs = F.transform(bare, lambda c: F.struct(c.alias("ch"), F.substring(F.coalesce(table[c], c), 1, 1).alias("item")))
    items = e.select("entity", F.explode(signs).alias("sign")).groupBy("entity", "sign.item").agg(F.count("*").alias("times"), F.count_distinct("sign.ch").alias("kinds"))
    known = items.join(items.groupBy("item").agg(F.count("*").alias("names")), "item")
    commonest, all_ = Window.partitionBy("entity").orderBy(F.desc("names"), "item"), Window.partitionBy("entity")
    enough = lambda c: F.sum(c).over(commonest) >= LEAST_COMMON * F.sum(c).over(all_)
    asked = known.withColumn("kept", enough("times") | enough("kinds")).where("kept").select("entity", "item")
    said = t.select("text", F.explode(F.array_distinct(begins(F.col("text")))).alias("item")).distinct()
    met = said.join(asked, "item").select("text", "entity").distinct()
    none = e.join(items.select("entity").distinct(), "entity", "left_anti")
    return t.join(met, "text").join(e, "entity").where(rule).select(*t.columns, *e.columns).unionByName(t.join(none, rule)).distinct()


def _blended(sim: Column, mine: Column, entity: Column) -> Column:
    """The similarity of texts without their locations, mixed with that of the locations."""
    theirs = X.locations(entity)
    return S.location_blend(F.coalesce(X.location_share(mine, theirs), F.lit(0.0)), sim, F.size(theirs) > 0)


def link(mentions: DataFrame, entities: DataFrame, syllables: Column | None = None) -> DataFrame:
    """Candidates of single mentions, each mention once: ``mention, entity, sim, match_type``.

    The first tier counts. A mention that is a name is exact. One with a location has those names whose blend of both
    similarities is high or whose characters it holds. Others skip names with a location: contained or very similar names, with the better of the
    fuzzy ones, else fuzzy ones. A mention without candidates has one row without an entity, of the tier it came to.
    """
    table = _table(syllables)
    said = _segmented(mentions)
    named = exact(said.select(F.col("whole").alias("mention")).distinct(), entities).select(F.col("mention").alias("whole"), "entity", "sim", "match_type")
    rest = said.join(named.select("whole"), "whole", "left_anti").withColumn("text", F.col("whole"))
    both = pairs(rest, entities, (F.col("t_loc") > 0) | (F.col("e_loc") == 0), syllables)
    located = F.col("t_loc") > 0
    bare = F.transform("segments", lambda x: F.when(located, X.strip_locations(x)).otherwise(x))
    target = F.when(located, X.strip_locations(F.col("entity"))).otherwise(F.col("entity"))
    ready = both.withColumn("bare", bare).withColumn("target", target)
    scored = ready.withColumn("score", S.segments_entity("bare", "target", F.transform("bare", lambda x: X.syllables(x, table)), X.syllables(F.col("target"), table)))
    sim = F.when(located, _blended(F.col("score.sim"), X.locations(F.col("whole")), F.col("entity"))).otherwise(F.col("score.sim"))
    inside = F.when(located, X.covers(F.col("whole"), F.col("entity"))).otherwise(F.contains("whole", "entity") | F.col("score.contains"))
    found = scored.select("mention", "entity", "t_loc", sim.alias("sim"), inside.alias("inside"))
    tier = (
        F.when(located, F.when((F.col("sim") >= LOCATION_SIM) | F.col("inside"), LOCATION))
        .when(F.col("inside") | (F.col("sim") >= SEMI_SIM), SEMI)
        .when(F.col("sim") >= FUZZY_SIM, FUZZY)
    )
    best = F.min("tier").over(Window.partitionBy("mention"))
    kept = found.withColumn("tier", tier).where("tier is not null").withColumn("best", best).where((F.col("tier") == F.col("best")) | (F.col("best") == SEMI) & (F.col("sim") >= PROMOTED_SIM))
    tried = rest.select("mention", F.when(F.size(X.locations(F.col("whole"))) > 0, LOCATION).otherwise(FUZZY).alias("last"))
    hits = tried.join(kept.select("mention", "entity", "sim", "best"), "mention", "left").select("mention", "entity", "sim", F.coalesce("best", "last").alias("match_type"))
    return said.join(named, "whole").select("mention", "entity", "sim", "match_type").unionByName(hits)


def segment_candidates(segmented: DataFrame, entities: DataFrame, syllables: Column | None = None, groups: DataFrame | None = None, tfidf: DataFrame | None = None) -> DataFrame:
    """``mention, seg_no, entity, sim`` for each segment (from 0) and for the whole (their number), from ``mention, segments``.

    A whole of several segments that is a name is the only candidate set. A segment that is a name is matched by it; one with a
    location by names of a high blend or whose characters it holds. Names found so are out for the rest: other segments keep contained or
    very similar names without a location, and fuzzy ones only where nothing else matched; so does the whole with names of any kind.
    Negation flags must agree everywhere.

    ``groups(mention, l3, survives)``: the later variant, in which names of a group that doesn't survive are out but those of unknown
    groups stay, a segment that is a name is not compared with others, and located segments skip names without a location.
    ``tfidf(text, entity, weight_sim)``: another similarity of a text and a name, which counts where it is higher.
    """
    table = _table(syllables)
    said = _segmented(segmented)
    n = F.size("segments")
    all_ = F.when(n == 1, F.col("segments")).otherwise(F.concat("segments", F.array("whole")))
    parts = said.select("mention", n.alias("n"), F.posexplode(all_).alias("seg_no", "text"))
    names = fit_broadcast(entities.select(F.col("name").alias("entity")).distinct())
    hit = parts.join(names, F.col("text") == F.col("entity")).select("mention", "seg_no", "entity", F.lit(1.0).alias("sim"), (F.col("seg_no") == F.col("n")).alias("is_whole"))
    hit = materialize(hit, "segment-names")
    done = hit.where("is_whole").select("mention").distinct()
    rest = parts.join(done, "mention", "left_anti").join(hit.select("mention", "seg_no", F.lit(True).alias("named")), ["mention", "seg_no"], "left").withColumn("named", F.coalesce("named", F.lit(False)))
    is_whole = F.col("seg_no") == F.col("n")
    located = ~is_whole & (F.col("t_loc") > 0)
    rule = (F.col("t_neg") == F.col("e_neg")) & (is_whole | located | ~F.col("named") & (F.col("e_loc") == 0))
    if groups is not None:
        rule = rule & (is_whole | ~F.col("named")) & (~located | (F.col("e_loc") > 0))
    both = pairs(rest, entities, rule, syllables)
    if groups is not None:
        out = groups.where("not survives").select("mention", "l3").distinct()
        both = both.withColumn("l3", X.before_dot(F.col("code"))).join(out, ["mention", "l3"], "left_anti").drop("l3")
    bare = lambda c: F.when(located, X.strip_locations(F.col(c))).otherwise(F.col(c))
    ready = both.withColumn("bare", bare("text")).withColumn("target", bare("entity"))
    if tfidf is not None:
        ready = ready.join(tfidf.select(F.col("text").alias("bare"), "entity", "weight_sim"), ["bare", "entity"], "left")
    score = S.mention_entity(F.col("bare"), F.col("target"), X.syllables(F.col("bare"), table), X.syllables(F.col("target"), table), F.col("weight_sim") if tfidf is not None else None)
    scored = ready.withColumn("score", score)
    sim = F.when(located, _blended(F.col("score.sim"), X.locations(F.col("text")), F.col("entity"))).otherwise(F.col("score.sim"))
    inside = F.when(located, X.covers(F.col("text"), F.col("entity"))).otherwise(F.col("score.contains"))
    found = materialize(scored.select("mention", "seg_no", "entity", sim.alias("sim"), inside.alias("inside"), is_whole.alias("is_whole"), located.alias("located")), "segment-scores")
    first = found.where("located").where((F.col("sim") >= LOCATION_SIM) | F.col("inside")).select("mention", "seg_no", "entity", "sim")
    by_name = hit.join(done, "mention", "left_anti").unionAll(hit.where("is_whole")).select("mention", "seg_no", "entity", "sim")
    matched = by_name.unionAll(first).groupBy("mention", "seg_no", "entity").agg(F.max("sim").alias("sim"))
    second = found.where("not located").join(matched.select("mention", "entity").distinct(), ["mention", "entity"], "left_anti")
    enough = F.when(F.col("is_whole"), F.col("sim") > SEGMENT_CONTAINS_SIM).otherwise(F.col("sim") >= SEGMENT_CONTAINS_SIM)
    fuzzy = F.when(F.col("is_whole"), WHOLE_FUZZY_SIM).otherwise(SEGMENT_FUZZY_SIM)
    second = second.withColumn("strong", F.col("inside") & enough | (F.col("sim") >= SEMI_SIM)).where(F.col("strong") | (F.col("sim") >= fuzzy))
    any_strong = F.max("strong").over(Window.partitionBy("mention", "seg_no"))
    kept = second.withColumn("any", any_strong).where("strong or not any").select("mention", "seg_no", "entity", "sim")
    return matched.unionByName(kept)


def surviving_groups(mentions: DataFrame, parents: DataFrame, least: float = PARENT_SIM) -> DataFrame:
    """``mention, l3`` of groups whose parent name is similar enough to the mention."""
    return group_survival(mentions, parents, least).where("survives").select("mention", "l3")


def group_survival(mentions: DataFrame, parents: DataFrame, least: float = PARENT_SIM) -> DataFrame:
    """``mention, l3, survives`` of all groups with a parent name. Groups without one are in no row."""
    p = fit_broadcast(parents.select(F.substring("l3", 1, 3).alias("l3"), F.col("name").alias("parent")))
    return _segmented(mentions).join(p).select("mention", "l3", (S.char_overlap(F.col("parent"), F.col("whole")) > least).alias("survives"))


def add_siblings(candidates: DataFrame, entities: DataFrame, segmented: DataFrame | None = None, least: float = SIBLING_SIM, syllables: Column | None = None) -> DataFrame:
    """Candidates, and of the names in their five-character groups those similar to the mention's segments or contained in them."""
    table = _table(syllables)
    said = _segmented(candidates.select("mention") if segmented is None else segmented).select("mention", "segments")
    codes = entities.select("name", "l4")
    own = candidates.join(codes, candidates["entity"] == codes["name"]).select("mention", "l4").distinct()
    near = own.join(codes, "l4").select("mention", F.col("name").alias("entity")).distinct().join(said, "mention")
    score = S.segments_entity("segments", "entity", F.transform("segments", lambda x: X.syllables(x, table)), X.syllables(F.col("entity"), table))
    found = near.withColumn("score", score).where((F.col("score.sim") >= least) | F.col("score.contains")).select("mention", "entity", F.col("score.sim").alias("sim"))
    known = candidates.select("mention", "entity", "sim").join(found.select("mention", "entity"), ["mention", "entity"], "left_anti")
    return known.unionByName(found)


def add_aliases(candidates: DataFrame, aliases: DataFrame) -> DataFrame:
    """Each candidate's synonyms with its similarity; the best of what comes twice. ``aliases(a, b)`` goes both ways."""
    more = candidates.join(aliases.select(F.col("a").alias("entity"), "b"), "entity").select("mention", F.col("b").alias("entity"), "sim")
    return candidates.select("mention", "entity", "sim").unionByName(more).groupBy("mention", "entity").agg(F.max("sim").alias("sim"))


def flatten_segments(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("mention", "entity").agg(F.max("sim").alias("sim"))


def with_default(mentions: DataFrame, candidates: DataFrame, default: str) -> DataFrame:
    """Mentions without candidates get ``default`` at similarity 0."""
    return mentions.select("mention").distinct().join(candidates, "mention", "left").select("mention", F.coalesce("entity", F.lit(default)).alias("entity"), F.coalesce("sim", F.lit(0.0)).alias("sim"))


def high_confidence(candidates: DataFrame, gate: float = HIGH_CONFIDENCE) -> DataFrame:
    return candidates.where(F.col("sim") > gate)


def is_very_similar(candidates: DataFrame, gate: float = HIGH_CONFIDENCE) -> DataFrame:
    """``mention, route``: by its best candidate ``sure`` over the gate, ``open`` under it, ``none`` without one."""
    best = candidates.groupBy("mention").agg(F.max("sim").alias("best"))
    route = F.when(F.col("best").isNull(), "none").when(F.col("best") > gate, "sure").otherwise("open")
    return best.select("mention", route.alias("route"))


def get_candidates(segmented: DataFrame, entities: DataFrame, aliases: DataFrame, syllables: Column | None = None) -> DataFrame:
    """``mention, seg_no, entity, sim, is_single`` of ``segment_candidates`` with synonyms; single are mentions of one segment."""
    found = materialize(segment_candidates(segmented, entities, syllables), "candidate-sets")
    more = found.join(aliases.select(F.col("a").alias("entity"), "b"), "entity").select("mention", "seg_no", F.col("b").alias("entity"), "sim")
    all_ = found.unionByName(more).groupBy("mention", "seg_no", "entity").agg(F.max("sim").alias("sim"))
    return all_.join(_segmented(segmented).select("mention", (F.size("segments") == 1).alias("is_single")), "mention")


def record_candidates(items: DataFrame, entities: DataFrame, default: str, syllables: Column | None = None) -> DataFrame:
    """``record_id, slot, role, mention, entity, sim``: candidates of every name of a record, ``default`` at 0 where there are none."""
    names = items.select(F.col("name").alias("mention")).distinct()
    found = with_default(names, link(names, entities, syllables).where("entity is not null"), default)
    return items.withColumnRenamed("name", "mention").join(found, "mention").select("record_id", "slot", "role", "mention", "entity", "sim")


def candidate_names(mentions: DataFrame, entities: DataFrame, syllables: Column | None = None) -> DataFrame:
    """``mention, entity, sim, match_type`` of ``link``; of fuzzy mentions with the siblings of their candidates."""
    found = materialize(link(mentions, entities, syllables), "candidate-links")
    fuzzy = found.where((F.col("match_type") == FUZZY) & F.col("entity").isNotNull())
    more = add_siblings(fuzzy, entities, mentions, syllables=syllables).withColumn("match_type", F.lit(FUZZY))
    return found.join(fuzzy.select("mention").distinct(), "mention", "left_anti").unionByName(more)
