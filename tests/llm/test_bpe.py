import base64
import hashlib
import random

import public_tokenizers as P
import tiktoken

from termweave.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_library(sf_dir, duck):
    rnd = random.Random(3)
    odd = ["".join(rnd.choice("ab  \n\t\r\x0b\x1c\x85\xa0　é中1٣²ⅷ!?'sStT're ll​\U0001f600́") for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    long = ["a" * 5000, " " * 3000, "ab" * 3000 + " x", "é" * 300, "x" * 64 + " " + "q" * 65, "".join(rnd.choice("abcdefghij") for _ in range(5000))]
    real = [x for (x,) in duck.execute("select text from documents").fetchall()]
    coder, other = bpe.SegmentTreeBpe(PATH, P.PATTERN), library()
    for texts in (odd, long, real):
        for x, ids in zip(texts, coder.encode(texts), strict=True):
            assert ids.tolist() == other.encode_ordinary(x)
            assert coder.decode(ids) == x.encode()


def test_trees_in_step_and_alone_agree():
    coder, rnd = bpe.SegmentTreeBpe(PATH, P.PATTERN), random.Random(1)
    for width in bpe.WIDTHS:
        pieces = [bytes(rnd.choice(b"theringao") for _ in range(rnd.randint(1, width))) for _ in range(200)]
        assert coder._merge_in_step(pieces, width) == [coder._merge_alone(x) for x in pieces]


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 10)
    coder = bpe.SegmentTreeBpe(PATH, P.PATTERN)
    for k in range(5):
        coder.encode([" ".join(f"w{k}x{i}" for i in range(50)) + " " + "y" * 100])
        assert len(coder.words) <= 60 and all(len(w) <= bpe.LONG_WORD for w in coder.words)


def test_frames(spark, odd_docs, no_docs):
    other = library()
    rows = bpe.digest_tokens(odd_docs, PATH, P.PATTERN).collect()
    want = [(r["doc_id"], other.encode_ordinary(r["text"] or ""), r["text"] or "") for r in odd_docs.collect()]
    assert sorted(map(tuple, rows), key=str) == sorted([(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(x.encode()).hexdigest()) for i, ids, x in want], key=str)
    back = bpe.decode_documents(bpe.encode_documents(odd_docs, PATH, P.PATTERN), PATH, P.PATTERN).select(odd_docs.columns).collect()
    assert sorted(map(str, back)) == sorted(str(r) for r in odd_docs.fillna("", ["text"]).collect())
    assert bpe.digest_tokens(no_docs, PATH, P.PATTERN).count() == bpe.encode_documents(no_docs, PATH, P.PATTERN).count() == 0


def test_a_column_that_is_called_like_the_result(spark):
    docs = spark.createDataFrame([(1, "two words", "x")], "doc_id long, text string, ids string")
    coded = bpe.encode_documents(docs, PATH, P.PATTERN)
    assert coded.columns == ["doc_id", "ids"] and coded.select("ids").first()["ids"] == library().encode_ordinary("two words")
    back = bpe.decode_documents(coded.selectExpr("*", "1 as text"), PATH, P.PATTERN)
    assert back.columns == ["doc_id", "text"] and back.first()["text"] == "two words"
