"""Text and similarity functions against published examples and plain Python."""

import pytest
from pyspark.sql import functions as F

from termweave.functions import similarity as S
from termweave.functions import text as X


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("mention", "segments", "places"), [
    ("冠心病 急性前壁心肌梗塞I21.000，高血压", ["冠心病", "急性前壁心肌梗塞", "高血压"], ["前壁"]),
    ("心肌梗塞急性 NOS", ["心肌梗塞", "急性"], []),
    ("不稳定心绞痛（劳力型）&nbsp;待查", ["不稳定心绞痛", "劳力型", "待查"], []),
    ("急性下壁、前间壁心梗", ["急性下壁", "前间壁心梗"], ["下壁", "前间壁"]),
    ("X", [], []),
])
def test_segments(spark, mention, segments, places):
    assert one(spark, X.segments(F.col("m")), m=mention) == segments
    assert one(spark, X.locations(F.col("m")), m=mention) == places


def brute_merge(segs, least=3):
    out, held = [], ""
    for x in segs:
        if len(x) >= least:
            out.append(x)
        elif out:
            out[-1] += x
        else:
            held = x
    if held and len(out) >= 2:
        out[1] += held
    elif held:
        out.append(held)
    return out


def test_short_merge(spark):
    rows = [["心梗", "冠心病", "高血压"], ["心梗", "冠心病"], [], ["ab"], ["ab", "cd"], ["abc", "d", "e", "fgh"], ["a", "b", "cde", "f", "ghi", "j"]]
    got = spark.createDataFrame([(x,) for x in rows], "s array<string>").select(X.merge_short(F.col("s")).alias("m")).collect()
    assert [r["m"] for r in got] == [brute_merge(x) for x in rows]


def test_small_functions(spark):
    assert one(spark, X.negation(F.col("m")), m="不稳定") == 1
    assert one(spark, X.covers(F.col("a"), F.col("b")), a="abcd", b="db") and not one(spark, X.covers(F.col("a"), F.col("b")), a="abcd", b="dx")
    assert one(spark, X.location_share(F.array(F.lit("a"), F.lit("a"), F.lit("b")), F.array(F.lit("a"))), m=1) == pytest.approx(2 / 3)
    assert one(spark, X.expand_acronyms(F.col("m"), F.array(F.struct(F.lit("MI").alias("short"), F.lit("心梗").alias("long")))), m="急性MI") == "急性心梗"
    assert one(spark, X.in_scope(F.col("m")), m="I21.900") and not one(spark, X.in_scope(F.col("m")), m="I10")
    assert one(spark, X.longest_match({"心绞痛", "心绞"})(F.col("m")), m="心绞痛 ab1型") == ["心绞痛", "ab1", "型"]


@pytest.mark.parametrize(("s", "t", "want"), [("axb", "ab", 0.666667), ("ab", "axb", 0.333333), ("ab", "xyzab", -0.2), ("心绞痛", "不稳定性心绞痛", -0.142857), ("急性心肌梗塞", "急性心肌梗死", 0.833333), ("", "", 1.0), ("", "ab", -1.0)])
def test_directional_edit(spark, s, t, want):
    assert one(spark, S.directional_edit(F.col("s"), F.col("t")), s=s, t=t) == pytest.approx(want, abs=1e-6)


def test_other_similarities(spark):
    assert one(spark, S.char_overlap(F.col("s"), F.col("t")), s="心绞痛", t="不稳定性心绞痛") == pytest.approx(0.428571, abs=1e-6)
    split = lambda c: F.split(F.col(c), " ")
    assert one(spark, S.phonetic_edit(split("s"), split("t")), s="ji xing xin ji geng se", t="ji xing xin ji geng si") == pytest.approx(0.916667, abs=1e-6)
    assert one(spark, S.phonetic(split("s"), split("t")), s="xin jiao tong", t="bu wen ding xing xin jiao tong") == pytest.approx(0.428571, abs=1e-6)
    for s, t, want in (("martha", "marhta", 0.961111), ("abcdefgh", "abcdefxy", 0.9), ("abxxxxxx", "abyyyyyy", 0.5), ("", "a", 0.0)):
        assert one(spark, S.jaro_winkler("s", "t"), s=s, t=t) == pytest.approx(want, abs=1e-6)
    assert one(spark, S.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))), m=1) == pytest.approx(0.707107, abs=1e-6)
    both = one(spark, S.segments_entity(F.split("s", " "), F.col("t"), F.transform(F.split("s", " "), lambda x: F.split(x, "")), F.split("t", "")), s="abc de", t="cd")
    assert both["contains"] and both["sim"] == pytest.approx(0.4)


def test_links_by_syllables_do_not_depend_on_the_size_of_the_dictionary(spark, monkeypatch):
    from pyspark.sql import functions as F

    from termweave.operators import candidates as C

    table = F.create_map(*(F.lit(x) for pair in zip("她他塔踏心新", ("ta", "ta", "ta", "ta", "xin", "xing"), strict=True) for x in pair))
    mentions = spark.createDataFrame([("她心",), ("ab",), ("塔",)], "mention string")
    entities = spark.createDataFrame([("1", "他新"), ("2", "踏"), ("3", "ba"), ("4", "zz"), ("5", "")], "code string, name string")
    rows = lambda: sorted(map(tuple, C.link(mentions, entities, table).collect()))
    small = rows()
    monkeypatch.setattr(C, "BROADCAST_ROWS", 0)
    assert rows() == small
    assert {("她心", "他新"), ("塔", "踏")} <= {r[:2] for r in small}


def test_blocking_loses_no_link(spark, monkeypatch):
    """Over random texts with repeats, locations and sounds a large dictionary gives the links of a small one."""
    import random

    from termweave.operators import candidates as C

    rnd = random.Random(3)
    letters = "心肌梗死塞痛前间壁左室急性"
    table = F.create_map(*(F.lit(x) for pair in zip(letters, "xin ji geng si se tong qian jian bi zuo shi ji xing".split(), strict=True) for x in pair))
    text = lambda: "".join(rnd.choice(letters[: rnd.choice([4, 13])]) for _ in range(rnd.randint(1, 7)))
    names = sorted({text() for _ in range(150)} | {"前壁"})
    entities = spark.createDataFrame([(str(k), x) for k, x in enumerate(names)], "code string, name string")
    said = sorted({text() for _ in range(120)} | {"心心心心心肌梗", "肌梗死"})
    mentions = spark.createDataFrame([(x, [x[:3], x[3:]] if k % 2 and len(x) > 3 else [x]) for k, x in enumerate(said)], "mention string, segments array<string>")
    rows = lambda: sorted((tuple(r) for f in (C.link, C.segment_candidates) for r in f(mentions, entities, table).collect()), key=str)
    small = rows()
    monkeypatch.setattr(C, "BROADCAST_ROWS", 0)
    assert len(small) > 300 and rows() == small
