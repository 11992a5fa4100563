import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from termweave.llm import token_files as tf

PATH = P.path("byte_bpe_50k.json")


def brute(rows):
    library = Tokenizer.from_file(PATH)
    out, start = [], 0
    for i, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(x or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 13, 16, 17, 31, 32])
def test_packing_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 63, 64, 65, 5000):
        ids = rng.integers(0, 2**bits, n, dtype=np.uint64).astype(np.uint32)
        data = tf.pack(ids, bits)
        assert len(data) == -(-n // 64) * 8 * bits
        assert (tf.unpack(data, bits)[:n] == ids).all()


def test_file_gives_any_document(tmp_path):
    rng = np.random.default_rng(0)
    lengths = [0, 5, 4096, 1, 9000, 70]
    ids = rng.integers(0, 50257, sum(lengths)).astype(np.uint32)
    path = f"file://{tmp_path}/a/x.bin"
    tf.write_file(path, [None, 1, 2, 3, 4, 5], lengths, ids, 16)
    f = tf.PackedFile(path)
    assert f.doc_ids == [None, 1, 2, 3, 4, 5]
    for k in (4, 0, 2, 5, 1, 3):
        a = sum(lengths[:k])
        assert f.document(k).tolist() == ids[a : a + lengths[k]].tolist()


def test_encoder_equals_the_library():
    rnd = random.Random(3)
    library = Tokenizer.from_file(PATH)
    texts = ["".join(rnd.choice("ab  \n\t\r\x0b\x1c\x85\xa0　é中1٣²ⅷ!?'sStT're ll​\U0001f600́<|endoftext|>") for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    texts += ["", None, "x" * 3000, "w " * 2000, "<|endoftext|> <|endoftext|>", " a b", "a\r b c\r", "foo.\nBar baz\r\n q", "x <|endoftext|> y", "x<|endoftext|>y z.", "a\n<|endoftext|>\nb", "<|endoftext|", "w <|endoftext|>"]
    coder = tf.LibraryEncoder(PATH)
    for _ in range(2):
        for x, ids in zip(texts, coder.encode(texts), strict=True):
            assert np.frombuffer(ids, np.uint32).tolist() == library.encode(x or "", add_special_tokens=False).ids, x


def test_read_back_equals_brute_force(spark, odd_docs, no_docs, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert sorted(map(tuple, tf.pack_and_read_back(docs, PATH).collect())) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = sorted(map(tuple, tf.pack_and_read_back(odd_docs, PATH).collect()), key=lambda r: r[1])
    want = brute(rows)
    assert [r[0] for r in got] == [r[0] for r in want] and sorted(r[2:] for r in got) == sorted(r[2:] for r in want)
    assert tf.pack_and_read_back(no_docs, PATH).count() == 0
    manifest = tf.write_token_files(docs, PATH).collect()
    assert sum(r["n_docs"] for r in manifest) == docs.count()


def test_files_of_bounded_size(spark):
    """A task closes a file at the bound, and a longer text has one of its own."""
    docs = spark.createDataFrame([(i, f"word{i} " * (2000 if i == 7 else 40)) for i in range(40)], "doc_id long, text string").coalesce(1)
    manifest = tf.write_token_files(docs, PATH, file_ids=1000)
    written = manifest.orderBy("start").collect()
    assert len(written) >= 5 and any(r["seq"] for r in written) and all(r["n_ids"] <= 1000 or r["n_docs"] == 1 for r in written)
    assert [r["start"] for r in written] == [sum(x["n_ids"] for x in written[:k]) for k in range(len(written))]
    rows = sorted(map(tuple, tf.read_token_files(spark, manifest).collect()))
    assert rows == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
