import hashlib
import random

import numpy as np
import public_tokenizers as P
from hypothesis import given
from hypothesis import strategies as st

from termweave.llm import chat

ROWS = [
    (1, 0, "system", "be <|end|> kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "yo \\ [x] <\\"),
    (2, 0, "system", "be <|end|> kind"), (2, 1, "user", "hi"), (2, 2, "assistant", "other"),
    (3, 0, "system", "be <|end|> kind"), (3, 1, "user", "hi"), (3, 2, "assistant", "yo \\ [x] <\\"),
    (4, 5, "assistant", None), (4, 2, None, ""), (4, None, "user", "first"), (4, 2, None, "tie"),
    (None, 0, "user", "lost"), (5, 0, "user", "w " * 20000),
]


def brute(rows):
    out = []
    for c in sorted({r[0] for r in rows} - {None}):
        turns = sorted([r[1:] for r in rows if r[0] == c], key=lambda t: (t[0] is not None, t[0] or 0, t[1] is not None, t[1] or "", t[2] is not None, t[2] or ""))
        turns = [(r or "", t or "") for _, r, t in turns]
        loss = "".join(t for r, t in turns if r == "assistant")
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out.append((c, len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss), sum(len(chat.format_turn(r, t)) for r, t in turns)))
    return out


@given(st.text(alphabet="<[\\|/>]sINT ok\nend", max_size=60), st.text(alphabet="<[\\|user>\n", max_size=12))
def test_escape_is_reversible_and_leaves_no_control_string(text, role):
    unit = chat.format_turn(role, text)
    assert chat.parse_turn(unit) == (role, text)
    inside = unit[len(chat.TURN) : -len(chat.END)].replace(chat.TEXT, "", 1)
    assert not any(c in inside for c in ("<|", "</s>", "<s>", "[INST]", "[/INST]"))


def test_rows_equal_brute_force(spark):
    turns = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    got = chat.format_conversations(turns).collect()
    assert sorted(map(tuple, got)) == brute(ROWS)
    assert chat.format_conversations(turns.limit(0)).count() == 0
    clash = turns.selectExpr("*", "'x' as path", "1 as unit", "2 as start")
    assert chat.format_conversations(clash).count() == 5


def check_tree(chunks, turns):
    """Every different path's nodes once, depth first, with positions and ancestors as a walk over the tree gives them."""
    paths = {}
    for r in sorted(turns, key=lambda r: (r["conv_id"], r["turn"])):
        paths.setdefault(r["conv_id"], []).append(chat.format_turn(r["role"], r["text"]))
    prefixes = {tuple(p[:k]) for p in paths.values() for k in range(1, len(p) + 1)}
    nodes = sorted(chat.list_nodes(chunks).collect(), key=lambda r: r["start"])
    assert len(nodes) == len(prefixes)
    at, stack, seen = 0, [], set()
    for r in nodes:
        assert r["start"] == at
        at += r["n_tokens"]
        stack = stack[: r["depth"] - 1]
        assert len(stack) == r["depth"] - 1 and r["position"] == sum(x["n_tokens"] for x in stack)
        above = [t for x in stack for t in range(x["start"], x["start"] + x["n_tokens"])]
        assert [t for a in r["attends"] for t in range(a["start"], a["stop"])] == above
        stack.append(r)
        path = tuple(x["unit"] for x in stack)
        assert path in prefixes and path not in seen
        seen.add(path)


def test_shared_turns_are_emitted_once_in_depth_first_order(spark, sf_dir):
    turns = spark.createDataFrame(ROWS[:9], "conv_id long, turn long, role string, text string")
    chunks = chat.build_tree(turns)[0]
    assert chunks.count() == 2
    check_tree(chunks, turns.collect())
    real = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    check_tree(chat.build_tree(real)[0], real.collect())
    ids = chat.build_tree(turns, tokenizer=P.path("byte_bpe_50k.json"))[0]
    check_tree(ids, turns.collect())
    assert all(0 < n < len(u) for r in ids.collect() for n, u in zip(r["tokens"], r["units"], strict=True))


def test_one_tree_over_many_ranges(spark):
    rnd = random.Random(6)
    rows = []
    for c in range(300):
        for k in range(rnd.randint(1, 7)):
            rows.append((c, k, "user" if k % 2 == 0 else "assistant", "same" if k < 2 else rnd.choice("abc")))
    rows += [(1000 + c, k, "user", f"deep {min(k, 90 + c)}") for c in range(3) for k in range(120)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        chunks, leaves, convs = chat.build_tree(turns)
        check_tree(chunks, turns.collect())
        assert sorted(map(tuple, chat.read_back(chunks, leaves, convs).collect())) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_ids_and_loss_mask(spark):
    """The ids give the text back, the mask the assistants' texts; also by a vocabulary with ids of several bytes."""
    turns = spark.createDataFrame([*ROWS, (6, 0, "assistant", "é 中 <|endoftext|> 😀"), (6, 1, "assistant", "")], "conv_id long, turn long, role string, text string")
    for tokenizer in (None, P.path("byte_bpe_50k.json")):
        coder = chat.Coder(tokenizer)
        chunks, leaves, convs = chat.build_tree(turns, tokenizer=tokenizer)
        at = 0
        for r in chunks.orderBy("chunk").collect():
            assert r["chunk"] == at and len(r["ids"]) == sum(r["tokens"])
            ids, k, loss = np.array(r["ids"], np.int32), 0, []
            for unit, n in zip(r["units"], r["tokens"], strict=True):
                assert coder.decode(ids[k : k + n]) == unit
                k += n
                loss += [t for role, t in [chat.parse_turn(unit)] if role == "assistant"]
            assert [chat.unescape(coder.decode(ids[x["start"] - at : x["stop"] - at])) for x in r["loss"]] == loss
            at += k
        rows = sorted(map(tuple, chat.read_back(chunks, leaves, convs, tokenizer).collect()))
        assert rows == brute([tuple(r) for r in turns.collect()])
