"""Queries of the linker's single operators, each over whole tables and with DuckDB SQL. They register beside those of ``queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as X
from ..operators import candidates as C
from ..operators import evaluate, graph, iterate, rank, tfidf
from ..runtime import materialize, new_path
from ..sources import readers as R
from ..sources import schemas
from ..sources import writers as W
from . import queries as B
from .queries import _BASE, _SPOKEN, SQL, Q, _query

__all__ = ["Q", "SQL"]

_TC = f"tc AS ({B._TEXT_CAND})"


# --- text ---------------------------------------------------------------------------------------------------


@_query("term_flags", f"SELECT code, name, l3, l4, split_part(code, '.', 1) AS head, l3 IN ('I20', 'I21', 'I22', 'I23', 'I24', 'I25') AS in_scope, CAST({B._NEG.format('name')} AS INTEGER) AS negated, len({B._LOCS.format('name')}) AS n_locations, {B._BARE.format('name')} AS bare, array_to_string({B._syl('name')}, ' ') AS sounds FROM term", _SPOKEN)
def term_flags(spark, sf):
    n = F.col("name")
    return B.terms(spark, sf).select(
        "code", "name", X.l3(F.col("code")).alias("l3"), X.l4(F.col("code")).alias("l4"), X.before_dot(F.col("code")).alias("head"), X.in_scope(F.col("code")).alias("in_scope"), X.negation(n).alias("negated"),
        F.size(X.locations(n)).cast("long").alias("n_locations"), X.strip_locations(n).alias("bare"), F.concat_ws(" ", X.syllables(n, B.sounds())).alias("sounds"),
    )


@_query("location_share_pairs", f"SELECT a.name AS a, b.name AS b, round(len(list_filter({B._LOCS.format('a.name')}, lambda l: list_contains({B._LOCS.format('b.name')}, l)))::DOUBLE / len({B._LOCS.format('a.name')}), 6) AS share FROM term a, term b WHERE len({B._LOCS.format('a.name')}) > 0", _SPOKEN)
def location_share_pairs(spark, sf):
    t = B.terms(spark, sf).select("name")
    share = X.location_share(X.locations(F.col("a")), X.locations(F.col("b")))
    return t.toDF("a").join(C.fit_broadcast(t.toDF("b"))).select("a", "b", F.round(share, 6).alias("share")).where("share is not null")


@_query("covers_pairs", f"SELECT mention, entity FROM ({B._SPOKEN_GRID}) WHERE contains(mention, entity) OR {B._SUBSET.format('mention', 'entity')}", _SPOKEN)
def covers_pairs(spark, sf):
    return B._spoken_grid(spark, sf).where(X.covers(F.col("mention"), F.col("entity")))


_MERGE = """st AS (
  SELECT mention, 0 AS i, CAST([] AS VARCHAR[]) AS done, '' AS held, segs FROM said UNION ALL
  SELECT mention, i + 1,
    CASE WHEN length(segs[i + 1]) >= 3 THEN list_append(done, segs[i + 1]) WHEN len(done) > 0 THEN list_append(done[1:len(done) - 1], done[len(done)] || segs[i + 1]) ELSE done END,
    CASE WHEN length(segs[i + 1]) < 3 AND len(done) = 0 THEN segs[i + 1] ELSE held END, segs
  FROM st WHERE i < len(segs)),
last AS (SELECT mention, CASE WHEN held = '' THEN done WHEN len(done) >= 2 THEN list_concat([done[1], done[2] || held], done[3:]) ELSE list_append(done, held) END AS segs FROM st WHERE i = len(segs))"""


@_query("short_segment_merge", "SELECT mention, len(segs) AS n, array_to_string(segs, '|') AS merged FROM last", f"RECURSIVE {_SPOKEN}, said AS (SELECT mention, list_concat(segments, [substr(truth, 1, 2), truth, substr(truth, 2, 2)]) AS segs FROM saying), {_MERGE}")
def short_segment_merge(spark, sf):
    more = F.array(F.substring("truth", 1, 2), F.col("truth"), F.substring("truth", 2, 2))
    s = X.merge_short(F.concat("segments", more))
    return B.sayings(spark, sf).select("mention", s.alias("s")).select("mention", F.size("s").cast("long").alias("n"), F.concat_ws("|", "s").alias("merged"))


@_query("acronyms", "SELECT p_partkey, replace(replace(p_name, 'ring', 'round thing'), 'hot', 'very hot') AS said FROM part", "")
def acronyms(spark, sf):
    table = F.array(F.struct(F.lit("ring").alias("short"), F.lit("round thing").alias("long")), F.struct(F.lit("hot").alias("short"), F.lit("very hot").alias("long")))
    return B._table(spark, sf, "part").select("p_partkey", X.expand_acronyms(F.col("p_name"), table).alias("said"))


_WIDE = "SELECT p_partkey AS id, '  ' || replace(p_name, ' ', '   ') || ' ' AS d1, CASE WHEN p_size % 3 = 0 THEN 'NA' ELSE p_brand END AS d2, CASE WHEN p_size % 2 = 0 THEN '  ' ELSE p_type END AS d3, p_type AS p1 FROM part"


@_query("unpivot_records", f"SELECT id AS record_id, slot, role, name FROM (SELECT id, s.slot, s.role, nullif(nullif(trim(regexp_replace(s.name, '\\s+', ' ', 'g')), ''), 'NA') AS name FROM (SELECT id, unnest([{{'slot': 0, 'role': 'main', 'name': d1}}, {{'slot': 1, 'role': 'vice', 'name': d2}}, {{'slot': 2, 'role': 'vice', 'name': d3}}, {{'slot': 3, 'role': 'surg', 'name': p1}}]) AS s FROM ({_WIDE}))) WHERE name IS NOT NULL", "")
def unpivot_records(spark, sf):
    wide = B._table(spark, sf, "part").selectExpr("p_partkey as id", "concat('  ', replace(p_name, ' ', '   '), ' ') as d1", "case when p_size % 3 = 0 then 'NA' else p_brand end as d2", "case when p_size % 2 = 0 then '  ' else p_type end as d3", "p_type as p1")
    return R.unpivot_records(wide, "id", "d1", ["d2", "d3"], ["p1"])


@_query("vector_cosine", "SELECT a.vec_id, round(list_cosine_similarity(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE)), 6) AS sim FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1", "")
def vector_cosine(spark, sf):
    e = B._table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    return e.join(other, "vec_id").select("vec_id", F.round(S.cosine(F.col("x"), F.col("y")), 6).alias("sim"))


# --- candidates and ranking ---------------------------------------------------------------------------------


@_query("default_entity", "SELECT m.mention, coalesce(tc.entity, 'none') AS entity, round(coalesce(tc.sim, 0), 6) AS sim FROM mention m LEFT JOIN (SELECT * FROM tc WHERE sim >= 0.9) tc ON tc.mention = m.mention", f"{_BASE}, {_TC}")
def default_entity(spark, sf):
    return C.with_default(B.mentions(spark, sf), B._text_candidates(spark, sf).where("sim >= 0.9"), "none").withColumn("sim", F.round("sim", 6))


@_query("high_confidence", "SELECT mention, entity, round(sim, 6) AS sim FROM tc WHERE sim > 0.857", f"{_BASE}, {_TC}")
def high_confidence(spark, sf):
    return C.high_confidence(B._text_candidates(spark, sf)).withColumn("sim", F.round("sim", 6))


@_query("confidence_route", "SELECT mention, CASE WHEN max(sim) > 0.857 THEN 'sure' ELSE 'open' END AS route FROM tc GROUP BY 1", f"{_BASE}, {_TC}")
def confidence_route(spark, sf):
    return C.is_very_similar(B._text_candidates(spark, sf))


_SEGC = f"segc AS (SELECT mention, seg_no, entity, sim FROM matched UNION ALL SELECT mention, seg_no, entity, sim FROM later WHERE strong OR NOT any_strong)"
_SEGMENTS = f"{_SPOKEN}, {B._PARTS}, {_SEGC}"


def _segment_candidates(spark, sf):
    return C.segment_candidates(B.sayings(spark, sf), B.terms(spark, sf), B.sounds())


@_query("flatten_segments", "SELECT mention, entity, round(max(sim), 6) AS sim FROM segc GROUP BY 1, 2", _SEGMENTS)
def flatten_segments(spark, sf):
    return C.flatten_segments(_segment_candidates(spark, sf)).withColumn("sim", F.round("sim", 6))


_TOPS = "tops AS (SELECT p.mention, p.seg_no, coalesce(entity, '') AS entity, coalesce(sim, 0) AS sim FROM (SELECT DISTINCT mention, seg_no FROM part_) p LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY mention, seg_no ORDER BY round(sim, 9) DESC, entity) AS k FROM segc) s ON s.mention = p.mention AND s.seg_no = p.seg_no AND k = 1)"


def _parts(spark, sf):
    n = F.size("segments")
    return B.sayings(spark, sf).select("mention", F.explode(F.sequence(F.lit(0), F.when(n == 1, 0).otherwise(n))).alias("seg_no"))


def _tops(spark, sf):
    return rank.top_per_segment(_segment_candidates(spark, sf).withColumn("sim", F.round("sim", 9)), _parts(spark, sf))


@_query("segment_winners", "SELECT mention, seg_no, entity, round(sim, 6) AS sim FROM tops", f"{_SEGMENTS}, {_TOPS}")
def segment_winners(spark, sf):
    return _tops(spark, sf).withColumn("sim", F.round("sim", 6))


_PRIOR = "prior AS (SELECT truth AS entity, count(*)::DOUBLE / sum(count(*)) OVER () AS prior FROM saying GROUP BY 1)"


@_query("winner_by_prior", """SELECT mention, entity, round(sim, 6) AS sim FROM (
  SELECT *, row_number() OVER (PARTITION BY mention ORDER BY coalesce(prior, 0) DESC, round(sim, 9) DESC, entity) AS k FROM (
    SELECT mention, entity, max(sim) AS sim FROM (
      SELECT t.*, t.seg_no = s.n AND s.n > 1 AS is_whole, max(CASE WHEN NOT (t.seg_no = s.n AND s.n > 1) AND entity <> '' THEN sim END) OVER (PARTITION BY t.mention) AS strong
      FROM tops t JOIN (SELECT mention, len(segments) AS n FROM saying) s ON s.mention = t.mention) WHERE entity <> '' AND (NOT is_whole OR coalesce(strong, 0) < 0.90) GROUP BY 1, 2) LEFT JOIN prior USING (entity)) WHERE k = 1""", f"{_SEGMENTS}, {_TOPS}, {_PRIOR}")
def winner_by_prior(spark, sf):
    said = B.sayings(spark, sf).select("mention", F.size("segments").alias("n"), "truth")
    tops = _tops(spark, sf).join(said.select("mention", "n"), "mention").withColumn("is_whole", (F.col("seg_no") == F.col("n")) & (F.col("n") > 1))
    return rank.top_1_with_prior(tops, rank.prior(said, "truth")).withColumn("sim", F.round("sim", 6))


@_query("winner_by_tokens", """SELECT mention, seg_no, entity, round(sim, 6) AS sim FROM (
  SELECT *, row_number() OVER (PARTITION BY mention ORDER BY passes DESC, k) AS first FROM (
    SELECT mention, 0 AS seg_no, entity, sim, k, len(list_filter(string_split(entity, ' '), lambda t: NOT contains(mention, t))) AS missing, missing = 0 OR missing = 1 AND sim > 0.85 AS passes
    FROM (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY sim DESC, entity) AS k FROM tc) WHERE k <= 5)) WHERE first = 1""", f"{_BASE}, {_TC}")
def winner_by_tokens(spark, sf):
    cand = B._text_candidates(spark, sf).withColumn("seg_no", F.lit(0))
    segments = B.mentions(spark, sf).select("mention", F.lit(0).alias("seg_no"), F.col("mention").alias("seg"))
    tokens = B.entities(spark, sf).select("name", F.split("name", " ").alias("tokens"))
    return rank.top_by_tokens(cand, segments, tokens).withColumn("sim", F.round("sim", 6))


_PAR = "par AS (SELECT l3, min(name) AS name FROM entity GROUP BY l3)"
_AL = f"al AS (SELECT a, b FROM ({B._ALIAS}) UNION SELECT b, a FROM ({B._ALIAS}))"
_GONE = "EXISTS (SELECT 1 FROM par p JOIN entity e ON e.l3 = p.l3 JOIN {0} d ON d.entity = e.name WHERE p.name = c.entity AND d.mention = c.mention AND d.entity <> c.entity)"


@_query("disambiguated", f"""SELECT mention, place, entity FROM (SELECT mention, 1 AS place, entity FROM win UNION ALL SELECT w.mention, 1 + row_number() OVER (PARTITION BY w.mention ORDER BY al.b) AS place, al.b FROM win w JOIN al ON al.a = w.entity)""",
        f"""{_BASE}, {_TC}, {_PAR}, {_AL}, ties AS (SELECT mention, entity, sim FROM (SELECT *, rank() OVER (PARTITION BY mention ORDER BY sim DESC) AS r FROM tc) WHERE r = 1),
  win AS (SELECT mention, entity FROM (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY sim DESC, entity) AS k FROM (SELECT *, count(*) FILTER (WHERE NOT gone) OVER (PARTITION BY mention) AS kept FROM (SELECT c.*, {_GONE.format('ties')} AS gone FROM ties c)) WHERE NOT gone OR kept = 0) WHERE k = 1)""")  # fmt: skip
def disambiguated(spark, sf):
    e = B.entities(spark, sf)
    parents = e.groupBy("l3").agg(F.min("name").alias("name"))
    return rank.disambiguate(B._text_candidates(spark, sf), 1, e, parents, B._aliases(spark, sf))


@_query("shown_synonyms", f"SELECT mention, entity, entity || coalesce('/' || (SELECT string_agg(b, '/' ORDER BY b) FROM al WHERE a = entity), '') AS shown FROM tc", f"{_BASE}, {_TC}, {_AL}")
def shown_synonyms(spark, sf):
    return rank.show_synonyms(B._text_candidates(spark, sf).select("mention", "entity"), B._aliases(spark, sf)).select("mention", "entity", "shown")


@_query("correct_by_synonym", "SELECT l.mention, l.truth, l.predicted, coalesce(truth = predicted, false) OR EXISTS (SELECT 1 FROM al WHERE a = predicted AND b = truth) AS correct FROM links l", f"{_BASE}, {B._LINKS}, {_AL}")
def correct_by_synonym(spark, sf):
    rows = B._links(spark, sf).withColumnRenamed("predicted", "entity")
    return rank.is_correct(rows, B._aliases(spark, sf), "truth").select("mention", "truth", F.col("entity").alias("predicted"), "correct")


_CANON = "canon AS (SELECT name, min(name) OVER (PARTITION BY l4) AS canon FROM entity)"


def _canon(spark, sf):
    e = B.entities(spark, sf)
    return e.join(e.groupBy("l4").agg(F.min("name").alias("canon")), "l4").select("name", "canon")


@_query("ties_correct", """SELECT mention, truth, predicted, coalesce(truth = predicted, false) AS correct FROM (
  SELECT *, row_number() OVER (PARTITION BY mention ORDER BY coalesce(truth = predicted, false) DESC, predicted) AS k FROM (
    SELECT m.mention, tn.canon AS truth, pn.canon AS predicted FROM mention m JOIN canon tn ON tn.name = m.truth
    LEFT JOIN (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY mention ORDER BY sim DESC) AS r FROM tc) WHERE r = 1) t ON t.mention = m.mention LEFT JOIN canon pn ON pn.name = t.entity)) WHERE k = 1""", f"{_BASE}, {_TC}, {_CANON}")
def ties_correct(spark, sf):
    return rank.ties_correct(B._text_candidates(spark, sf), B.mentions(spark, sf), _canon(spark, sf))


# --- graphs -------------------------------------------------------------------------------------------------


@_query("canonical_items", "SELECT record_id, slot, role, coalesce(c.canon, i.name) AS name FROM item i LEFT JOIN canon c ON c.name = i.name", f"{_BASE}, {_CANON}")
def canonical_items(spark, sf):
    return graph.canonicalise(B.items(spark, sf), _canon(spark, sf)).select("record_id", "slot", "role", "name")


@_query("recognised_items", "SELECT record_id, slot, role, name FROM item WHERE name IN (SELECT name FROM entity)")
def recognised_items(spark, sf):
    return graph.recognised(B.items(spark, sf), B.entities(spark, sf)).select("record_id", "slot", "role", "name")


_KNOWN = "known AS (SELECT name, min(name) OVER (PARTITION BY l4) AS entity FROM entity WHERE l3 <> 'I20'), own AS (SELECT name FROM entity WHERE l3 = 'I20')"


@_query("fall_back_items", "SELECT record_id, slot, role, CASE WHEN slot <= 10 AND i.name NOT IN (FROM own) AND k.entity IS NOT NULL THEN k.entity ELSE i.name END AS name FROM item i LEFT JOIN known k ON k.name = i.name", f"{_BASE}, {_KNOWN}")
def fall_back_items(spark, sf):
    e = B.entities(spark, sf)
    known = _canon(spark, sf).join(e.where("l3 <> 'I20'").select("name", "l4"), "name")
    first = e.where("l3 <> 'I20'").groupBy("l4").agg(F.min("name").alias("entity"))
    known = known.join(first, "l4").select("name", "entity")
    return graph.fall_back(B.items(spark, sf), e.where("l3 = 'I20'").select("name"), known).select("record_id", "slot", "role", "name")


@_query("role_neighbours", "SELECT DISTINCT x.name AS mention, y.role, y.name AS entity FROM item x JOIN item y ON x.record_id = y.record_id AND x.name <> y.name WHERE x.name IN (SELECT mention FROM mention)")
def role_neighbours(spark, sf):
    return graph.neighbours_by_role(B.items(spark, sf), B.mentions(spark, sf)).select("mention", "role", "entity")


@_query("cond_prob_half_biased", "SELECT src, dst, round(n::DOUBLE / (occ + 1), 9) AS weight FROM (SELECT a AS src, b AS dst, n FROM clique UNION ALL SELECT b, a, n FROM clique) JOIN occ ON occ.name = src", f"{_BASE}, clique AS ({B._CLIQUE}), occ AS ({B._OCC})")
def cond_prob_half_biased(spark, sf):
    n = B._names(spark, sf)
    return graph.conditional_edges(graph.clique_pairs(n), graph.occurrences(n, 1)).withColumn("weight", F.round("weight", 9))


_BEST = "best AS (SELECT name AS mention, min(name) OVER (PARTITION BY l3) AS entity, CASE WHEN length(name) % 2 = 0 THEN 0.9 ELSE 0.5 END AS sim FROM entity)"


def _best(spark, sf):
    e = B.entities(spark, sf)
    return e.join(e.groupBy("l3").agg(F.min("name").alias("entity")), "l3").select(F.col("name").alias("mention"), "entity", F.when(F.length("name") % 2 == 0, 0.9).otherwise(0.5).alias("sim"))


_RES = "res AS (SELECT record_id, slot, coalesce(b.entity, i.name) AS name, CAST(b.entity IS NOT NULL AS INTEGER) AS type FROM nm i LEFT JOIN best b ON b.mention = i.name AND b.sim > 0.857)"


@_query("mixed_graph_vertices", "SELECT name, max(type) AS type FROM (SELECT name, type FROM res UNION ALL SELECT name, 1 FROM entity) GROUP BY 1", f"{_BASE}, {_BEST}, {_RES}")
def mixed_graph_vertices(spark, sf):
    return graph.mixed_graph(B._names(spark, sf), _best(spark, sf), B.entities(spark, sf))[0]


@_query("mixed_graph_edges", "SELECT least(x.name, y.name) AS a, greatest(x.name, y.name) AS b, count(*) AS n FROM res x JOIN res y ON x.record_id = y.record_id AND x.slot < y.slot GROUP BY 1, 2", f"{_BASE}, {_BEST}, {_RES}")
def mixed_graph_edges(spark, sf):
    return graph.mixed_graph(B._names(spark, sf), _best(spark, sf), B.entities(spark, sf))[1]


@_query("network_size", "SELECT (SELECT count(*) FROM entity) AS nodes, count(*) * 2 AS edges FROM clique", f"{_BASE}, clique AS ({B._CLIQUE})")
def network_size(spark, sf):
    return graph.network_size(B.entities(spark, sf), graph.both_directions(graph.clique_pairs(B._names(spark, sf))))


@_query("known_names", "SELECT count(DISTINCT name) AS names, count(DISTINCT record_id) AS records FROM item WHERE name IN (SELECT name FROM entity)")
def known_names(spark, sf):
    return graph.recognised(B.items(spark, sf), B.entities(spark, sf)).agg(F.count_distinct("name").alias("names"), F.count_distinct("record_id").alias("records"))


# --- scores by neighbours -----------------------------------------------------------------------------------

_STAR_EDGE = f"star AS ({B._STAR}), edge AS (SELECT a AS src, b AS dst FROM star UNION SELECT b, a FROM star)"
_SIMS = "sims AS (SELECT i, j, v FROM (SELECT a.name AS i, b.name AS j, (length(a.name) * length(b.name) % 7) / 10.0 AS v FROM entity a, entity b WHERE a.name <> b.name))"
_NEAR = "near AS (SELECT DISTINCT m.mention, e.dst AS entity FROM mention m JOIN edge e ON e.src = m.truth WHERE length(e.dst) % 4 = 0)"
_ASK = f"{_BASE}, {_TC}, {_STAR_EDGE}, {_SIMS}, {_NEAR}"
_PAIRS = "np AS (SELECT DISTINCT c.mention, c.entity, e.dst AS i, n.entity AS j FROM {0} c JOIN edge e ON e.src = c.entity JOIN near n ON n.mention = c.mention), nv AS (SELECT np.*, CASE WHEN np.i = np.j THEN 1.0 ELSE s.v END AS v FROM np LEFT JOIN sims s ON s.i = np.i AND s.j = np.j)"


def _asked(spark, sf):
    """Candidates, edges, neighbours and scores between names, which stand in for those of an iteration."""
    star = graph.star_pairs(B._names(spark, sf))
    edges = materialize(graph.both_directions(star).select("src", "dst").distinct(), "query-edges")
    e = B.entities(spark, sf).select("name")
    sims = e.toDF("i").join(C.fit_broadcast(e.toDF("j")), F.col("i") != F.col("j")).withColumn("v", (F.length("i") * F.length("j") % 7) / 10.0)
    near = B.mentions(spark, sf).join(edges.withColumnRenamed("src", "truth"), "truth").where(F.length("dst") % 4 == 0).select("mention", F.col("dst").alias("entity")).distinct()
    return materialize(B._text_candidates(spark, sf), "query-candidates"), edges, materialize(near, "query-neighbours"), materialize(sims, "query-sims")


@_query("neighbour_score", "SELECT mention, entity, round(avg(v), 6) AS score FROM nv WHERE v > 0 GROUP BY 1, 2", f"{_ASK}, {_PAIRS.format('tc')}")
def neighbour_score(spark, sf):
    cand, edges, near, sims = _asked(spark, sf)
    return iterate.neighbour_score(cand.join(edges.withColumnRenamed("src", "entity"), "entity"), near, sims).withColumn("score", F.round("score", 6))


@_query("neighbour_means", "SELECT mention, entity, i AS neighbour, round(avg(v), 6) AS score FROM nv WHERE v > 0 GROUP BY 1, 2, 3", f"{_ASK}, {_PAIRS.format('tc')}")
def neighbour_means(spark, sf):
    cand, edges, near, sims = _asked(spark, sf)
    return iterate.neighbour_means(cand.join(edges.withColumnRenamed("src", "entity"), "entity"), near, sims).withColumn("score", F.round("score", 6))


_CLASSIFIED = """ns AS (SELECT mention, entity, avg(v) AS score FROM nv WHERE v > 0 GROUP BY 1, 2),
open_ AS (SELECT mention, count(*) AS n FROM tc GROUP BY 1 HAVING abs(max(sim) - 1) > 1e-5),
cl AS (SELECT ns.* FROM ns WHERE mention IN (SELECT o.mention FROM open_ o JOIN ns ON ns.mention = o.mention GROUP BY o.mention, n HAVING count(*) = n))"""


@_query("classified", "SELECT mention, entity, round(score, 6) AS score FROM cl", f"{_ASK}, {_PAIRS.format('tc')}, {_CLASSIFIED}")
def classified(spark, sf):
    return iterate.classify(*_asked(spark, sf)).withColumn("score", F.round("score", 6))


@_query("blended", "SELECT mention, entity, round(CASE WHEN whole AND top >= 1e-5 THEN sim * 0.6 + score / top * 0.4 ELSE sim END, 6) AS sim FROM (SELECT tc.*, score, max(score) OVER (PARTITION BY tc.mention) AS top, bool_and(score IS NOT NULL) OVER (PARTITION BY tc.mention) AS whole FROM tc LEFT JOIN cl ON cl.mention = tc.mention AND cl.entity = tc.entity)", f"{_ASK}, {_PAIRS.format('tc')}, {_CLASSIFIED}")
def blended(spark, sf):
    cand, edges, near, sims = _asked(spark, sf)
    return iterate.blend(cand, materialize(iterate.classify(cand, edges, near, sims), "query-scores")).withColumn("sim", F.round("sim", 6))


_WLM = "clique AS (%s), we AS (%s), nrm AS (SELECT src, sqrt(sum(weight * weight)) AS norm FROM we GROUP BY src), dot AS (SELECT x.src AS s, y.src AS d, sum(x.weight * y.weight) AS dot FROM we x JOIN we y ON x.dst = y.dst GROUP BY 1, 2), wlm AS (SELECT e.src, e.dst, coalesce(dot, 0) / (a.norm * b.norm) AS wlm FROM we e JOIN nrm a ON a.src = e.src JOIN nrm b ON b.src = e.dst LEFT JOIN dot ON s = e.src AND d = e.dst)" % (B._CLIQUE, B._SYM)


@_query("related_classes", """SELECT t.mention, t.entity, round(coalesce(total, 0) / degree, 6) AS score FROM tc t JOIN (SELECT src, count(*) AS degree FROM we GROUP BY 1) g ON g.src = t.entity
  LEFT JOIN (SELECT c.mention, c.entity, sum(wlm) AS total FROM tc c JOIN near n ON n.mention = c.mention JOIN wlm w ON w.src = c.entity AND w.dst = n.entity GROUP BY 1, 2) s ON s.mention = t.mention AND s.entity = t.entity
  WHERE NOT EXISTS (SELECT 1 FROM tc u WHERE u.mention = t.mention AND u.entity NOT IN (SELECT src FROM we))""", f"{_ASK}, {_WLM}")
def related_classes(spark, sf):
    cand, _, near, _ = _asked(spark, sf)
    edges = B._small_edges(spark, sf)
    return iterate.classify_related(cand, edges, near, materialize(iterate.relatedness(edges), "query-related")).withColumn("score", F.round("score", 6))


@_query("triage", """SELECT c.mention, CASE WHEN best >= 0.85 THEN 'sure' WHEN NOT inside THEN 'outside' WHEN coalesce(n, 0) > 3 THEN 'many' ELSE 'few' END AS route
  FROM (SELECT mention, max(sim) AS best, bool_and(entity IN (SELECT src FROM edge)) AS inside FROM tc GROUP BY 1) c LEFT JOIN (SELECT mention, count(DISTINCT entity) AS n FROM near GROUP BY 1) k ON k.mention = c.mention""", _ASK)
def triage(spark, sf):
    cand, edges, near, _ = _asked(spark, sf)
    return iterate.triage(cand, edges, near)


@_query("best_entity", "SELECT mention, entity, round(v, 6) AS v FROM (SELECT tc.mention, tc.entity, v, row_number() OVER (PARTITION BY tc.mention ORDER BY v DESC, tc.entity) AS k FROM tc JOIN sims ON sims.i = tc.mention AND sims.j = tc.entity WHERE v > 1e-6) WHERE k = 1", _ASK)
def best_entity(spark, sf):
    cand, _, _, sims = _asked(spark, sf)
    return iterate.best_entity(sims, cand).select("mention", "entity", F.round("v", 6).alias("v"))


# --- evaluation ---------------------------------------------------------------------------------------------


@_query("confusion", "SELECT predicted, truth, count(*) AS n FROM links WHERE truth <> predicted GROUP BY 1, 2", f"{_BASE}, {B._LINKS}")
def confusion(spark, sf):
    return evaluate.confusion(B._links(spark, sf))


_TWO = f"{_BASE}, {B._LINKS}, bef AS (SELECT mention, predicted AS entity, coalesce(truth = predicted, false) AS correct FROM links), aft AS (SELECT mention, truth AS entity, length(mention) % 3 > 0 AS correct FROM mention)"


def _two(spark, sf):
    before = B._links(spark, sf).select("mention", F.col("predicted").alias("entity"), F.coalesce(F.col("truth") == F.col("predicted"), F.lit(False)).alias("correct"))
    return before, B.mentions(spark, sf).select("mention", F.col("truth").alias("entity"), (F.length("mention") % 3 > 0).alias("correct"))


@_query("compared", "SELECT count(*) FILTER (WHERE b.correct) AS n_before, count(*) FILTER (WHERE a.correct) AS n_after, count(*) FILTER (WHERE a.correct AND NOT b.correct) AS gained, count(*) FILTER (WHERE b.correct AND NOT a.correct) AS lost FROM bef b JOIN aft a USING (mention)", _TWO)
def compared(spark, sf):
    return evaluate.compare(*_two(spark, sf))


@_query("changed_links", "SELECT mention, b.entity AS entity_before, a.entity AS entity_after, CASE WHEN a.correct THEN 'gained' ELSE 'lost' END AS change FROM bef b JOIN aft a USING (mention) WHERE a.correct <> b.correct", _TWO)
def changed_links(spark, sf):
    return evaluate.changes(*_two(spark, sf))


_CASES = "cases AS (SELECT m.mention, count(c.entity) > 0 AS has_candidates, coalesce(bool_or(c.entity = m.truth), false) AS answer_among, l.predicted IS NOT DISTINCT FROM m.truth AS correct FROM mention m LEFT JOIN tc c ON c.mention = m.mention JOIN links l ON l.mention = m.mention GROUP BY m.mention, l.predicted, m.truth)"


def _cases(spark, sf):
    cand = B._text_candidates(spark, sf)
    among = B._links(spark, sf).join(cand.select("mention", "entity"), "mention", "left").groupBy("mention", "truth", "predicted").agg(F.count("entity").alias("n"), F.max(F.coalesce(F.col("entity") == F.col("truth"), F.lit(False))).alias("answer_among"))
    return among.select("mention", (F.col("n") > 0).alias("has_candidates"), "answer_among", F.col("predicted").eqNullSafe(F.col("truth")).alias("correct"))


@_query("case_summary", "SELECT count(*) AS total, count(*) FILTER (WHERE has_candidates) AS has_candidates, count(*) FILTER (WHERE answer_among) AS answer_among, count(*) FILTER (WHERE correct) AS correct, round(count(*) FILTER (WHERE correct)::DOUBLE / count(*), 6) AS accuracy FROM cases", f"{_BASE}, {_TC}, {B._LINKS}, {_CASES}")
def case_summary(spark, sf):
    return W.summary(_cases(spark, sf)).withColumn("accuracy", F.round("accuracy", 6))


@_query("case_files", "SELECT mention, CASE WHEN NOT has_candidates THEN 'no_candidates' WHEN answer_among THEN 'answer_among' ELSE 'answer_missing' END AS bucket FROM cases", f"{_BASE}, {_TC}, {B._LINKS}, {_CASES}")
def case_files(spark, sf):
    path = new_path(spark, "cases")
    W.write_cases(_cases(spark, sf).withColumn("bucket", W.case_bucket(F.col("has_candidates"), F.col("answer_among"))).select("mention", "bucket"), path)
    return spark.read.parquet(path).select("mention", "bucket")


# --- text forms, written and read again ---------------------------------------------------------------------


def _named(sf_items):
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", sf_items))), lambda x: x["said"]), "\t")


@_query("records_as_text", "SELECT record_id, row_number() OVER (PARTITION BY record_id ORDER BY slot) - 1 AS slot, CASE WHEN row_number() OVER (PARTITION BY record_id ORDER BY slot) = 1 THEN 'main' ELSE 'other' END AS role, e.l3 AS code, i.name AS name FROM nm i JOIN entity e ON e.name = i.name")
def records_as_text(spark, sf):
    path = new_path(spark, "records")
    said = B._names(spark, sf).join(B.entities(spark, sf).select("name", "l3"), "name").withColumn("said", F.concat_ws("##", "l3", "name"))
    head = F.concat_ws("##", F.col("record_id").cast("string"), F.lit("record"))
    lines = said.groupBy("record_id").agg(_named("said").alias("items")).select(F.concat_ws("\t", head, "items").alias("value"))
    lines.write.text(path)
    rows = R.read_records(spark, path)
    ids = rows.where("slot = 0").select(F.col("record_id").alias("line"), F.col("code").cast("long").alias("record_id"))
    role = F.when(F.col("slot") == 1, "main").otherwise("other")
    return rows.where("slot > 0").withColumnRenamed("record_id", "line").join(ids, "line").select("record_id", (F.col("slot") - 1).cast("long").alias("slot"), role.alias("role"), "code", "name")


@_query("labels_as_text", "SELECT mention, CASE WHEN length(truth) % 2 = 0 THEN truth END AS entity FROM mention")
def labels_as_text(spark, sf):
    path = new_path(spark, "labels")
    said = B.mentions(spark, sf).select(F.concat_ws("##", "mention", F.when(F.length("truth") % 2 == 0, F.col("truth")).otherwise("NONE")).alias("value"))
    said.write.text(path)
    return R.read_labelled_records(spark, path).select("mention", "entity")


@_query("mentions_as_csv", "SELECT mention, truth AS entity FROM (SELECT array_to_string(segments, '') AS mention, min(truth) AS truth FROM saying GROUP BY 1)", _SPOKEN)
def mentions_as_csv(spark, sf):
    path = new_path(spark, "mentions")
    said = B.sayings(spark, sf).groupBy(F.concat_ws("", "segments").alias("mention")).agg(F.min("truth").alias("truth"))
    W.write_csv(said, path, header=False, quote_all=True)
    return R.read_mentions(spark, path, "UTF-8", "mention string, entity string")


@_query("pairs_as_text", "SELECT replace(a, ' ', '_') AS a, replace(b, ' ', '_') AS b FROM al", f"{_BASE}, {_AL}")
def pairs_as_text(spark, sf):
    path = new_path(spark, "pairs")
    W.write_lines(B._aliases(spark, sf).where("a < b").select(*(F.replace(F.col(c), F.lit(" "), F.lit("_")).alias(c) for c in "ab")), path, ["a", "b"])
    return R.read_pairs(spark, path)


@_query("canonical_as_text", "SELECT replace(name, ' ', '_') AS name, replace(canon, ' ', '_') AS canon FROM canon", f"{_BASE}, {_CANON}")
def canonical_as_text(spark, sf):
    path = new_path(spark, "canonical")
    e = B.entities(spark, sf).withColumn("name", F.replace(F.col("name"), F.lit(" "), F.lit("_")))
    e.groupBy("l4").agg(F.concat_ws(" ", F.sort_array(F.collect_list("name"))).alias("value")).select("value").write.text(path)
    return R.read_canonical(spark, path)


_KEYS = f"SELECT id AS code, token, round(weight, 6) AS weight FROM ({B._weights_sql('SELECT l3 AS id, unnest(string_split(name, chr(32))) AS token FROM entity')})"


@_query("keywords_as_text", _KEYS)
def keywords_as_text(spark, sf):
    path = new_path(spark, "keywords")
    tokens = B.entities(spark, sf).select(F.col("l3").alias("id"), F.explode(F.split("name", " ")).alias("token"))
    W.write_keywords(tfidf.weigh(tokens, tfidf.fit(tokens)).select(F.col("id").alias("code"), "token", "weight"), path)
    return R.read_keywords(spark, path).withColumn("weight", F.round("weight", 6))


@_query("entity_tokens_as_text", "SELECT code, array_to_string(string_split(name, ' '), '|') AS tokens, name FROM entity")
def entity_tokens_as_text(spark, sf):
    path = new_path(spark, "tokens")
    W.write_entity_tokens(B.entities(spark, sf).select("code", F.split("name", " ").alias("tokens"), "name"), path)
    return R.read_entity_tokens(spark, path).select("code", F.concat_ws("|", "tokens").alias("tokens"), "name")


@_query("adjacency_as_text", "SELECT replace(src, ' ', '_') AS src, replace(dst, ' ', '_') AS dst, round(weight, 9) AS weight FROM cond", f"{_BASE}, star AS ({B._STAR}), occ AS ({B._OCC}), cond AS ({B._COND})")
def adjacency_as_text(spark, sf):
    path = new_path(spark, "adjacency")
    plain = lambda c: F.replace(F.col(c), F.lit(" "), F.lit("_")).alias(c)
    W.write_adjacency(B._edges(spark, sf).select(plain("src"), plain("dst"), "weight"), path)
    return R.read_adjacency(spark, path).withColumn("weight", F.round("weight", 9))


@_query("name_sets_as_text", "SELECT DISTINCT x.name AS mention, y.name AS entity FROM item x JOIN item y ON x.record_id = y.record_id AND x.name <> y.name WHERE x.name IN (SELECT mention FROM mention)")
def name_sets_as_text(spark, sf):
    path = new_path(spark, "name-sets")
    W.write_name_sets(graph.mention_neighbours(B.items(spark, sf), B.mentions(spark, sf)), path)
    return R.read_name_sets(spark, path)


@_query("delimited_table", "SELECT code, name FROM entity WHERE code LIKE 'I21%'")
def delimited_table(spark, sf):
    path = new_path(spark, "entities")
    B.entities(spark, sf).select("code", "name").write.csv(path, sep="\t", header=True)
    return R.read_delimited(spark, path, header=True, schema=schemas.ENTITY).where("code like 'I21%'")


@_query("viewer_files", "SELECT 'node' AS kind, name AS a, name AS b FROM entity WHERE name IN (SELECT src FROM cond UNION SELECT dst FROM cond) UNION ALL SELECT 'edge', src, dst FROM cond", f"{_BASE}, star AS ({B._STAR}), occ AS ({B._OCC}), cond AS ({B._COND})")
def viewer_files(spark, sf):
    path = new_path(spark, "viewer")
    W.write_viewer(B.entities(spark, sf).select(F.col("name").alias("id"), F.col("name").alias("label"), F.lit(1).alias("type")), B._edges(spark, sf), path)
    nodes, edges = (spark.read.csv(f"{path}/{x}", header=True) for x in ("nodes", "edges"))
    return nodes.select(F.lit("node").alias("kind"), F.col("Id").alias("a"), F.col("Label").alias("b")).unionAll(edges.select(F.lit("edge"), "Source", "Target"))


@_query("interest_edges", "SELECT src, dst, round(weight, 6) AS weight FROM cond WHERE src IN (SELECT name FROM entity WHERE l3 = 'I21')", f"{_BASE}, star AS ({B._STAR}), occ AS ({B._OCC}), cond AS ({B._COND})")
def interest_edges(spark, sf):
    path, names = new_path(spark, "viewer"), new_path(spark, "interest")
    B.entities(spark, sf).where("l3 = 'I21'").select("name").write.text(names)
    v = B.entities(spark, sf).select(F.col("name").alias("id"), F.col("name").alias("label"), F.lit(1).alias("type"))
    W.write_viewer(v, B._edges(spark, sf), path, R.read_names(spark, names))
    return spark.read.csv(f"{path}/edges", header=True, schema="src string, dst string, weight double").withColumn("weight", F.round("weight", 6))


@_query("result_file", """SELECT s.mention, array_to_string(segments, ' ') AS segments, coalesce(string_agg(nullif(t.entity, ''), ' ' ORDER BY t.seg_no), '') AS tops FROM saying s LEFT JOIN tops t ON t.mention = s.mention GROUP BY 1, 2""", f"{_SEGMENTS}, {_TOPS}")
def result_file(spark, sf):
    path = new_path(spark, "results")
    found = materialize(_segment_candidates(spark, sf).withColumn("sim", F.round("sim", 9)), "query-segments")
    W.write_results(W.result_rows(B.sayings(spark, sf), found), path)
    rows = spark.read.csv(path, schema="mention string, segments string, tops string, pairs string")
    return rows.select(F.replace(F.col("mention"), F.lit("﻿"), F.lit("")).alias("mention"), "segments", F.coalesce("tops", F.lit("")).alias("tops"))


@_query("two_years", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01' UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01'", "")
def two_years(spark, sf):
    path = f"{sf}/orders.parquet"
    early, late = (R.read_table(spark, path, ["o_orderkey", "o_totalprice"], f"o_orderdate {op} timestamp'1995-01-01'") for op in ("<", ">="))
    return R.union_years(early, late)


@_query("first_labels", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 1000", "")
def first_labels(spark, sf):
    """A limit is what this scan is for."""
    order = ["l_orderkey", "l_linenumber", "l_partkey"]
    return R.read_table(spark, f"{sf}/lineitem.parquet", order, limit=1000, order=order)


@_query("dictionary", "SELECT max(code) AS code, name, substr(max(code), 1, 3) AS l3, substr(max(code), 1, 5) AS l4 FROM (SELECT p_brand AS code, p_name AS name FROM part WHERE p_brand IS NOT NULL) GROUP BY name", "")
def dictionary(spark, sf):
    return R.entities(B._table(spark, sf, "part").select(F.col("p_brand").alias("code"), F.col("p_name").alias("name")))


@_query("label_table", "SELECT trim(p_name) AS mention, max(trim(p_type)) AS entity FROM part GROUP BY 1", "")
def label_table(spark, sf):
    return R.labels(B._table(spark, sf, "part").select(F.concat(F.lit(" "), "p_name").alias("mention"), F.concat("p_type", F.lit(" ")).alias("entity")))


@_query("sql_over_frames", "SELECT n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1", "")
def sql_over_frames(spark, sf):
    return R.query(spark, "select n_name, count(*) as n from {supplier} join {nation} on s_nationkey = n_nationkey group by 1", supplier=B._table(spark, sf, "supplier"), nation=B._table(spark, sf, "nation"))


# --- composites ---------------------------------------------------------------------------------------------


@_query("group_weights", f"SELECT part, id, token, round(weight, 6) AS weight FROM (SELECT part, id, token, w / sqrt(sum(w * w) OVER (PARTITION BY part, id)) AS weight FROM (SELECT part, id, token, tf * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS w FROM (SELECT part, id, token, count(*) AS tf FROM tok GROUP BY ALL) JOIN (SELECT part, token, count(DISTINCT id) AS df FROM tok GROUP BY ALL) USING (part, token) JOIN (SELECT part, count(DISTINCT id) AS n FROM tok GROUP BY 1) USING (part)))", r"tok AS (SELECT lang AS part, doc_id AS id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS token FROM documents)")
def group_weights(spark, sf):
    docs = B._table(spark, sf, "documents")
    tokens = docs.select(F.col("lang").alias("part"), F.col("doc_id").alias("id"), F.explode(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))).alias("token"))
    return tfidf.weigh(tokens, tfidf.fit(tokens, "part"), "part").withColumn("weight", F.round("weight", 6))


@_query("keyword_similarity", """SELECT t.id AS text, k.id AS entity, round(sum(t.weight * k.weight), 6) AS weight_sim FROM (
    SELECT id, token, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM (SELECT id, token, count(*) * min(idf) AS w FROM (SELECT mention AS id, unnest(string_split(mention, ' ')) AS token FROM mention) JOIN idf USING (token) GROUP BY id, token)) t
  JOIN (SELECT id, token, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM (SELECT name AS id, token, count(*) * min(idf) AS w FROM (SELECT name, unnest(string_split(name, ' ')) AS token FROM entity) JOIN idf USING (token) GROUP BY 1, 2)) k USING (token) GROUP BY 1, 2""",
        f"{_BASE}, et AS (SELECT name, unnest(string_split(name, ' ')) AS token FROM entity), idf AS (SELECT token, ln((1 + (SELECT count(DISTINCT name) FROM et))::DOUBLE / (1 + count(DISTINCT name))) + 1 AS idf FROM et GROUP BY token)")
def keyword_similarity(spark, sf):
    tokens = B.entities(spark, sf).select(F.col("name").alias("id"), F.explode(F.split("name", " ")).alias("token"))
    fitted = tfidf.fit(tokens)
    said = B.mentions(spark, sf).select(F.col("mention").alias("text"), F.explode(F.split("mention", " ")).alias("token"))
    keywords = tfidf.weigh(tokens, fitted).select(F.col("id").alias("entity"), "token", "weight")
    return tfidf.keyword_similarity(said, fitted, keywords).withColumn("weight_sim", F.round("weight_sim", 6))


@_query("candidate_sets", "SELECT mention, seg_no, entity, round(max(sim), 6) AS sim, len(any_value(segments)) = 1 AS is_single FROM (SELECT mention, seg_no, entity, sim FROM segc UNION ALL SELECT mention, seg_no, al.b, sim FROM segc JOIN al ON al.a = entity) JOIN saying USING (mention) GROUP BY mention, seg_no, entity", f"{_SEGMENTS}, al0 AS (SELECT min(name) AS a, max(name) AS b FROM term GROUP BY l4 HAVING min(name) <> max(name)), al AS (SELECT a, b FROM al0 UNION SELECT b, a FROM al0)")
def candidate_sets(spark, sf):
    t = B.terms(spark, sf)
    aliases = R.both_ways(t.groupBy("l4").agg(F.min("name").alias("a"), F.max("name").alias("b")).where("a != b"))
    return C.get_candidates(B.sayings(spark, sf), t, aliases, B.sounds()).withColumn("sim", F.round("sim", 6))


@_query("group_survival", f"SELECT mention, l3, {B._overlap('parent', 'whole')} > 0.1 AS survives FROM (SELECT mention, array_to_string(segments, '') AS whole FROM saying), (SELECT l3, min(name) AS parent FROM term GROUP BY l3)", _SPOKEN)
def group_survival(spark, sf):
    return C.group_survival(B.sayings(spark, sf), B.terms(spark, sf).groupBy("l3").agg(F.min("name").alias("name")))
