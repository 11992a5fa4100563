"""Readers and writers, round trips included."""

from pyspark.sql import functions as F

from termweave.operators import candidates as C
from termweave.operators import rank, tfidf
from termweave.sources import readers as R
from termweave.sources import schemas
from termweave.sources import writers as W


def put(tmp_path, name, text, encoding="utf-8"):
    path = tmp_path / name
    path.write_bytes(text.encode(encoding))
    return f"file://{path}"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_readers(spark, tmp_path):
    assert rows(R.read_delimited(spark, put(tmp_path, "a.tsv", "code\tname\textra\nI20.0\t心绞痛\tx\n"), header=True)) == [("I20.0", "心绞痛")]
    assert rows(R.read_records(spark, put(tmp_path, "b.txt", "I21.900##急性心肌梗死\tI20.900##心绞痛\tbad\n")).drop("record_id")) == [(0, "main", "I21.900", "急性心肌梗死"), (1, "other", "I20.900", "心绞痛")]
    assert rows(R.read_labelled_records(spark, put(tmp_path, "c.txt", "m##e\tn##NONE\n")).select("mention", "entity")) == [("m", "e"), ("n", None)]
    assert rows(R.read_pairs(spark, put(tmp_path, "d.txt", "a b\nc d\n"))) == [("a", "b"), ("b", "a"), ("c", "d"), ("d", "c")]
    assert rows(R.read_canonical(spark, put(tmp_path, "e.txt", "a b  c\n\nd\n"))) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d")]
    assert rows(R.read_keywords(spark, put(tmp_path, "f.txt", "I20.001-增强:0.84,心绞痛:0.54\n"))) == [("I20.001", "增强", 0.84), ("I20.001", "心绞痛", 0.54)]
    assert R.read_entity_tokens(spark, put(tmp_path, "g.txt", "I20:a b:ab\n")).first().asDict() == {"code": "I20", "tokens": ["a", "b"], "name": "ab"}
    assert rows(R.read_names(spark, put(tmp_path, "h.txt", "x\n\n y \n"))) == [("x",), ("y",)]
    assert rows(R.read_mentions(spark, put(tmp_path, "i.csv", "心绞痛,e,c\n", "gb2312")).select("mention")) == [("心绞痛",)]
    assert rows(R.read_name_sets(spark, put(tmp_path, "j.txt", "m | 2\na\nb\n\nn | 1\nc\n"))) == [("m", "a"), ("m", "b"), ("n", "c")]


def test_tables(spark, tmp_path):
    e = spark.createDataFrame([("I20.000", "a"), ("I21.000", "a"), (None, "b"), ("I20.100", "c")], schemas.ENTITY)
    assert rows(R.entities(e)) == [("I20.100", "c", "I20", "I20.1"), ("I21.000", "a", "I21", "I21.0")]
    e.write.parquet(f"file://{tmp_path}/e")
    assert rows(R.read_table(spark, f"file://{tmp_path}/e", ["name"], F.col("code") == "I20.000")) == [("a",)]
    assert R.read_table(spark, f"file://{tmp_path}/e", limit=2).count() == 2
    assert rows(R.query(spark, "select count(*) n from {t}", t=e)) == [(4,)]
    wide = spark.createDataFrame([(1, "a  b", "NA", " ", "p")], "id long, d1 string, d2 string, d3 string, p1 string")
    assert rows(R.unpivot_records(wide, "id", "d1", ["d2", "d3"], ["p1"])) == [(1, 0, "main", "a b"), (1, 3, "surg", "p")]
    assert R.union_years(e, e).count() == 8
    assert rows(R.labels(spark.createDataFrame([(" m ", "x"), ("m", "y ")], "mention string, entity string"))) == [("m", "y")]


def test_writers(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b", 0.5), ("a", "cd", 1.0), ("cd", "a", 0.25)], schemas.EDGE)
    W.write_adjacency(edges, f"file://{tmp_path}/adj")
    assert [r["value"] for r in spark.read.text(f"file://{tmp_path}/adj").collect()] == ["2", "a 2", "b 0.5", "cd 1.0", "cd 1", "a 0.25"]
    assert rows(R.read_adjacency(spark, f"file://{tmp_path}/adj")) == rows(edges)
    assert rows(R.read_adjacency(spark, put(tmp_path, "adj.txt", "3\nx 2\ny 0.1\nz 2\n\ny 1\nx 3\nodd line here\n"))) == [("x", "y", 0.1), ("x", "z", 2.0), ("y", "x", 3.0)]
    W.write_lines(edges, f"file://{tmp_path}/lines", ["src", "weight"], ",")
    assert rows(spark.read.text(f"file://{tmp_path}/lines")) == [("a,0.5",), ("a,1.0",), ("cd,0.25",)]
    v = spark.createDataFrame([("a", "A", 1), ("b", "B", 0), ("z", "Z", 0)], "id string, label string, type int")
    W.write_viewer(v, edges, f"file://{tmp_path}/view")
    assert spark.read.csv(f"file://{tmp_path}/view/nodes", header=True).count() == 2
    cases = spark.createDataFrame([(True, True), (True, False), (False, False)], "has boolean, among boolean").withColumn("bucket", W.case_bucket(F.col("has"), F.col("among")))
    W.write_cases(cases, f"file://{tmp_path}/cases")
    assert {r["bucket"] for r in spark.read.parquet(f"file://{tmp_path}/cases").collect()} == {"answer_among", "answer_missing", "no_candidates"}
    cand = spark.createDataFrame([("m", "x", 0.5), ("m", "y", 0.75)], "mention string, entity string, sim double")
    assert rows(W.candidate_pairs(cand)) == [("m", "y:0.75 x:0.5")]


def test_segment_candidates_and_winners(spark):
    e = spark.createDataFrame([("I20.000", "abc"), ("I20.100", "abcd"), ("I21.000", "wxyz"), ("I21.100", "abcwxya")], schemas.ENTITY)
    m = spark.createDataFrame([("1", ["abc", "wxyq"]), ("2", ["ab", "cd"]), ("3", ["zzz"])], "mention string, segments array<string>")
    got = {(r["mention"], r["seg_no"], r["entity"]): round(r["sim"], 3) for r in C.segment_candidates(m, e).collect()}
    assert got["1", 0, "abc"] == 1.0 and ("1", 0, "abcd") not in got  # a segment that is a name is matched
    assert got["1", 1, "wxyz"] == 0.817 and got["1", 2, "abcwxya"] == 0.9  # means of 3/4 and 0.8833, of 6/7 and 0.9429
    assert {k for k in got if k[0] == "2"} == {("2", 2, "abcd")}  # the whole is a name
    assert not {k for k in got if k[0] == "3"}
    w = spark.createDataFrame([("m", "a", 0.7, False), ("m", "b", 0.8, False), ("m", "c", 0.9, True)], "mention string, entity string, sim double, is_whole boolean")
    p = spark.createDataFrame([("a", 0.5), ("c", 0.4)], "entity string, prior double")
    assert rank.top_1_with_prior(w, p).first()["entity"] == "a"
    aliases = spark.createDataFrame([("a", "x")], schemas.ALIAS)
    assert rank.show_synonyms(w.where("entity = 'a'"), aliases).first()["shown"] == "a/x"
    assert rank.is_correct(w.withColumn("answer", F.lit("x")), aliases).where("correct").first()["entity"] == "a"
    assert rows(C.with_default(m.select("mention"), w.withColumn("mention", F.lit("1")).select("mention", "entity", "sim").where("entity = 'a'"), "dflt")) == [("1", "a", 0.7), ("2", "dflt", 0.0), ("3", "dflt", 0.0)]


def test_tokens_decide_winners(spark):
    cand = spark.createDataFrame([("m", 0, "ab", 0.9), ("m", 0, "cd", 0.8), ("m", 1, "ef", 0.9)], "mention string, seg_no int, entity string, sim double")
    seg = spark.createDataFrame([("m", 0, "xcdx"), ("m", 1, "zz")], "mention string, seg_no int, seg string")
    tok = spark.createDataFrame([("ab", ["a", "b"]), ("cd", ["c", "d"]), ("ef", ["e"])], "name string, tokens array<string>")
    assert rows(rank.top_by_tokens(cand, seg, tok).select("seg_no", "entity")) == [(0, "cd"), (1, "ef")]


def test_tfidf_formula(spark):
    import math

    t = spark.createDataFrame([("1", "x"), ("1", "y"), ("2", "y")], "id string, token string")
    w = {(r["id"], r["token"]): r["weight"] for r in tfidf.weights(t).collect()}
    x, y = math.log(3 / 2) + 1, math.log(3 / 3) + 1
    assert abs(w["1", "x"] - x / math.hypot(x, y)) < 1e-12 and abs(w["2", "y"] - 1) < 1e-12


def test_text_sinks(spark, tmp_path):
    def lines(name):
        return [r["value"] for r in spark.read.text(f"file://{tmp_path}/{name}").collect()]

    near = spark.createDataFrame([("m", "b"), ("m", "a"), ("n", "c")], "mention string, entity string")
    W.write_name_sets(near, f"file://{tmp_path}/sets")
    assert lines("sets") == ["m | 2", "a", "b", "", "n | 1", "c", ""] and rows(R.read_name_sets(spark, f"file://{tmp_path}/sets")) == rows(near)
    W.write_mention_neighbours(near, f"file://{tmp_path}/near")
    assert sorted(lines("near")) == ["m    a b ", "n    c "]
    sims = spark.createDataFrame([("a", "b", 0.25), ("a", "c", 0.5), ("b", "a", 0.25)], "i string, j string, v double")
    W.write_similarities(sims, f"file://{tmp_path}/sims")
    assert lines("sims") == ["a:", "c 0.500000", "b 0.250000", "", "b:", "a 0.250000", ""]
    keys = spark.createDataFrame([("I20", "x", 0.5), ("I20", "y", 0.75)], schemas.KEYWORD)
    W.write_keywords(keys, f"file://{tmp_path}/keys")
    assert lines("keys") == ["I20-y:0.75,x:0.5"] and rows(R.read_keywords(spark, f"file://{tmp_path}/keys")) == rows(keys)
    tokens = spark.createDataFrame([("I20", ["a", "b"], "ab")], schemas.ENTITY_TOKENS)
    W.write_entity_tokens(tokens, f"file://{tmp_path}/tokens")
    assert lines("tokens") == ["I20:a b:ab"] and rows(R.read_entity_tokens(spark, f"file://{tmp_path}/tokens")) == rows(tokens)
    seg = spark.createDataFrame([("m", ["a", 'b"']), ("n", ["c"])], "mention string, segments array<string>")
    cand = spark.createDataFrame([("m", 0, "x", 0.5), ("m", 0, "y", 0.75), ("m", 1, "z", 1.0)], "mention string, seg_no int, entity string, sim double")
    W.write_results(W.result_rows(seg, cand), f"file://{tmp_path}/results")
    (file,) = (tmp_path / "results").glob("part-*")  # Spark's reader drops the mark
    assert file.read_text("utf-8") == '\ufeff"m","a b""","y z","z:1.0 y:0.75 x:0.5"\n"n","c","",""\n'
    W.write_csv(near, f"file://{tmp_path}/quoted", header=False, quote_all=True)
    assert sorted(lines("quoted")) == ['"m","a"', '"m","b"', '"n","c"']
    cases = spark.createDataFrame([(True, True, True), (True, True, False), (False, False, False)], "has_candidates boolean, answer_among boolean, correct boolean")
    assert W.summary(cases).first().asDict() == {"total": 3, "has_candidates": 2, "answer_among": 2, "correct": 1, "accuracy": 1 / 3}
    put(tmp_path, "cases.json", '{"mention": "m", "answer": "a", "main": ["x"], "other": []}\n')
    assert rows(R.read_cases(spark, f"file://{tmp_path}/cases.json")) == [("m", "a", ["x"], [])]


def test_mentions_end_at_a_blank_line(spark, tmp_path):
    path = put(tmp_path, "m.csv", "心绞痛,\"a,b\",c\n高血压\n\n冠心病,e,c\n", "gb2312")
    assert rows(R.read_mentions(spark, path)) == [("心绞痛", "a,b", "c"), ("高血压", None, None)]
    assert rows(R.read_mentions(spark, put(tmp_path, "u.csv", "é,x\n \ny,z\n"), "UTF-8", "mention string, entity string")) == [("é", "x")]


def test_record_log(spark):
    ranked = spark.createDataFrame([(1, 0, "m", "a", 0.5, 1), (1, 0, "m", "b", 0.5, 2), (1, 1, "n", "c", 0.9, 1), (2, 0, "m", "a", 0.1, 1)], "record_id long, slot int, mention string, entity string, score double, rank int")
    truth = spark.createDataFrame([(1, 0, "b"), (1, 1, "x")], "record_id long, slot int, truth string")
    network = spark.createDataFrame([("a", "b", 2.0)], schemas.EDGE)
    lines, pairs, names = W.record_log(ranked, truth, network, spark.createDataFrame([("a", 0.5)], "name string, popularity double"))
    got = {(r["record_id"], r["slot"], r["entity"]): (r["n_top"], r["wrong"]) for r in lines.collect()}
    assert got == {(1, 0, "a"): (2, False), (1, 0, "b"): (2, False), (1, 1, "c"): (1, True), (2, 0, "a"): (1, False)}
    weights = {(r["record_id"], r["src"], r["dst"]): r["weight"] for r in pairs.collect()}
    assert weights[1, "a", "b"] == 2.0 and abs(weights[1, "b", "a"] - 0.693147) < 1e-6 and len(weights) == 10
    assert {(r["record_id"], r["entity"], r["popularity"]) for r in names.collect()} == {(1, "a", 0.5), (1, "b", None), (1, "c", None), (2, "a", 0.5)}


def test_fitted_weights_are_used_again(spark):
    import math

    corpus = spark.createDataFrame([("g", 1, "x"), ("g", 1, "y"), ("g", 2, "y"), ("h", 3, "x")], "part string, id int, token string")
    fitted = {(r["part"], r["token"]): r["idf"] for r in tfidf.fit(corpus, "part").collect()}
    assert fitted["g", "x"] == math.log(3 / 2) + 1 and fitted["g", "y"] == 1.0 and fitted["h", "x"] == 1.0
    all_ = tfidf.fit(corpus)
    w = {(r["id"], r["token"]): r["weight"] for r in tfidf.weigh(corpus, all_).collect()}
    assert w == {(r["id"], r["token"]): r["weight"] for r in tfidf.weights(corpus).collect()}
    found = tfidf.keyword_similarity(spark.createDataFrame([("t", "x"), ("t", "new"), ("u", "new")], "text string, token string"), all_, spark.createDataFrame([("e", "x", 3.0), ("e", "y", 4.0)], "entity string, token string, weight double"))
    assert [(r["text"], r["entity"], round(r["weight_sim"], 6)) for r in found.collect()] == [("t", "e", 0.6)]


def test_winners_ties_and_synonyms(spark):
    e = spark.createDataFrame([("I20.000", "p", "I20"), ("I20.100", "c", "I20"), ("I21.000", "q", "I21")], "code string, name string, l3 string")
    parents = spark.createDataFrame([("I20", "p"), ("I21", "o")], "l3 string, name string")
    aliases = spark.createDataFrame([("c", "cc"), ("cc", "c")], schemas.ALIAS)
    cand = spark.createDataFrame([("m", "p", 0.9), ("m", "c", 0.9), ("m", "q", 0.5), ("n", "p", 0.7)], "mention string, entity string, sim double")
    assert rows(rank.disambiguate(cand, 1, e, parents, aliases)) == [("m", 1, "c"), ("m", 2, "cc"), ("n", 1, "p")]
    assert rows(rank.disambiguate(cand, 2, e, parents, aliases)) == [("m", 1, "c"), ("m", 2, "p"), ("n", 1, "p")]
    parts = spark.createDataFrame([("m", 0), ("m", 1)], "mention string, seg_no int")
    assert rows(rank.top_per_segment(spark.createDataFrame([("m", 0, "a", 0.5)], "mention string, seg_no int, entity string, sim double"), parts)) == [("m", 0, "a", 0.5), ("m", 1, "", 0.0)]
    w = spark.createDataFrame([("m", "p", 0.7, False), ("m", "c", 0.6, False), ("m", "", 0.0, True)], "mention string, entity string, sim double, is_whole boolean")
    p = spark.createDataFrame([("p", 0.5), ("c", 0.4)], "entity string, prior double")
    assert rank.top_1_with_prior(w, p).first()["entity"] == "p" and rank.top_1_with_prior(w, p, entities=e, parents=parents).first()["entity"] == "c"
    truth = spark.createDataFrame([("m", "cc"), ("n", "q"), ("o", "p")], "mention string, truth string")
    canon = spark.createDataFrame([("c", "c"), ("cc", "c")], "name string, canon string")
    assert rows(rank.ties_correct(cand, truth, canon)) == [("m", "c", "c", True), ("n", "q", "p", False), ("o", "p", None, False)]
    assert not [r for r in rank.ties_correct(cand, truth).collect() if r["correct"]]


def test_groups_and_composites(spark):
    e = spark.createDataFrame([("I20.000", "abc", "I20", "I20.0"), ("I20.100", "abd", "I20", "I20.0"), ("Q99.000", "abe", "Q99", "Q99.0")], "code string, name string, l3 string, l4 string")
    m = spark.createDataFrame([("ab", ["ab"]), ("zz", ["zz"])], "mention string, segments array<string>")
    groups = C.group_survival(m.where("mention = 'ab'"), spark.createDataFrame([("I20", "xyz")], "l3 string, name string"))
    assert rows(groups) == [("ab", "I20", False)]
    found = {r["entity"] for r in C.segment_candidates(m, e, groups=groups).where("mention = 'ab'").collect()}
    assert found == {"abe"} and {r["entity"] for r in C.segment_candidates(m, e).where("mention = 'ab'").collect()} == {"abc", "abd", "abe"}
    aliases = spark.createDataFrame([("abc", "xx")], schemas.ALIAS)
    sets = C.get_candidates(m, e, aliases)
    assert {"xx", "abc"} <= {r["entity"] for r in sets.collect()} and sets.where("not is_single").count() == 0
    assert rows(C.is_very_similar(spark.createDataFrame([("a", 0.9), ("b", 0.857), ("c", None)], "mention string, sim double"))) == [("a", "sure"), ("b", "open"), ("c", "none")]
    items = spark.createDataFrame([(1, 0, "main", "abc"), (1, 1, "vice", "zz")], schemas.ITEM)
    assert rows(C.record_candidates(items, e, "dflt").select("slot", "entity", "sim")) == [(0, "abc", 1.0), (1, "dflt", 0.0)]
    named = C.candidate_names(m.select("mention"), e)
    assert {(r["mention"], r["entity"], r["match_type"]) for r in named.where("mention = 'zz'").collect()} == {("zz", None, 4)}
