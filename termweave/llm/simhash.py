"""SimHash near-duplicates found through Golay-code fuzzy hashing (operator 8).

A fingerprint has 64 bits; two are linked at 3 or fewer differing bits. Equal fingerprints are one class, so
copies are never paired. For the classes, 3 errors fall on four blocks of 16 bits, hence one block is free of
them. The other 48 bits hold two segments of 23 bits, of which one has at most 1 error. The perfect binary
Golay code maps each 23-bit word to the one codeword within 3 errors; the words within 1 error of a segment
decode to 1 codeword or to 6. A class is indexed under (free block, each of those codeword indices) and asks
under (free block, its own codeword index): 8 questions, 43 index rows on average, and any two linked
classes meet. The join tests the Hamming distance, so only true links leave it.

Defined cases: a null or empty text, or one without a word, has fingerprint zero and links like any other;
under 3 words the whole sequence is the one shingle; long texts are cut into shingles in pieces; repeated
rows share a class; rows with a null doc_id get their class's smallest id, null if it has none; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize, pieces
from .components import connected_components

SEED = 42
PIECE = 1 << 16


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit SimHash: a bit is set if over half of the shingles' XXH64 have it."""
    words = (text or "").encode().lower().split()  # bytes: ASCII white space and A-Z alone
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for a in range(0, n, PIECE):
        part = words[a : a + PIECE + width - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(width)), strict=False)) if n > 1 or len(words) == width else [b" ".join(words)]
        bits = np.frombuffer(b"".join([xxhash.xxh64_digest(g, SEED) for g in grams]), np.uint8)
        ones += np.unpackbits(bits).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


# --- the Golay code -----------------------------------------------------------------------------------------

GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, of the cyclic [23, 12] code


def _remainders() -> np.ndarray:
    """The 11 check bits of each 12-bit message."""
    x = np.arange(4096, dtype=np.int64) << 11
    for k in range(22, 10, -1):
        x ^= np.where(x >> k & 1, GENERATOR << (k - 11), 0)
    return x


CHECK = _remainders()


def _leaders() -> np.ndarray:
    """The one error pattern of weight 3 or less for each syndrome."""
    out = np.zeros(2048, np.int64)
    one = [1 << k for k in range(23)]
    for e in [*one, *(a | b for a in one for b in one if a < b), *(a | b | c for a in one for b in one if a < b for c in one if b < c)]:
        out[(e & 2047) ^ CHECK[e >> 11]] = e
    return out


LEADER = _leaders()


def codeword_index(word: np.ndarray) -> np.ndarray:
    """The 12 message bits of the codeword nearest to each 23-bit word."""
    return (word ^ LEADER[(word & 2047) ^ CHECK[word >> 11]]) >> 11


def nearby_indices(word: np.ndarray) -> np.ndarray:
    """Per row the sorted indices that words within 1 error decode to; repeats are -1."""
    flips = np.concatenate([[0], 1 << np.arange(23)])
    found = np.sort(codeword_index(word[:, None] ^ flips[None, :]), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return found


def _segments(fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of 8 key kinds: its part of the key (kind and free block), and the 23-bit segment."""
    for block in range(4):
        low = np.uint64(16 * block)
        free = fp >> low & np.uint64(0xFFFF)
        rest = fp & ((np.uint64(1) << low) - np.uint64(1)) | (fp >> low >> np.uint64(16)) << low
        for half in range(2):
            yield (np.uint64(2 * block + half) << np.uint64(28) | free << np.uint64(12)).astype(np.int64), (rest >> np.uint64(23 * half) & np.uint64(0x7FFFFF)).astype(np.int64)


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, 2048):
        fp = b.column(0).to_numpy().view(np.uint64)
        for base, word in _segments(fp):
            yield pa.RecordBatch.from_arrays([pa.array(base | codeword_index(word)), b.column(0)], ["key", "a"])


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, 2048):
        fp = b.column(0).to_numpy().view(np.uint64)
        for base, word in _segments(fp):
            near = nearby_indices(word)
            row, col = np.nonzero(near >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(base[row] | near[row, col]), pa.array(fp[row].view(np.int64))], ["key", "b"])


def fuzzy_links(classes: DataFrame, bits: int = 3) -> DataFrame:
    """``(src, dst)``: every pair of different fingerprints in ``classes(fp)`` at ``bits`` (up to 3) or fewer differing bits."""
    if not 0 <= bits <= 3:
        raise ValueError("the key scheme covers up to 3 differing bits")
    asked, indexed = classes.select("fp").mapInArrow(_asked, "key long, a long"), classes.select("fp").mapInArrow(_indexed, "key long, b long")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
    # Spark takes both sides for as small as the classes they are made from and would broadcast one, through the driver
    return asked.hint("merge").join(indexed, "key").where(near).select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def group_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, bits: int = 3) -> DataFrame:
    """One row per document: ``doc_id, fingerprint`` (16 hex digits) and ``component_id`` (smallest doc_id reached by links)."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 2048):
            fp = np.array([fingerprint(x, width) for x in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    rows = materialize(docs.mapInArrow(prints, "doc_id long, fp long"), "simhash")
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    reached = materialize(connected_components(fuzzy_links(classes, bits)), "simhash-components")
    linked = classes.join(reached, classes.fp == reached.id).select("fp", "first", "component")
    smallest = materialize(linked.groupBy("component").agg(F.min("first").alias("component_id")), "simhash-smallest")
    roots = reached.join(smallest, "component").select(F.col("id").alias("fp"), "component_id")
    owners = materialize(classes.join(roots, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")), "simhash-owners")
    return rows.join(owners, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, bits: int = 3) -> DataFrame:
    """``docs`` with one document of each group: that of the smallest doc_id.

    Rows that repeat a doc_id are repeats of one document, of which one row stays. Rows without a doc_id stay.
    """
    found = materialize(group_documents(docs, doc_id, text, width, bits), "simhash-groups")
    gone = materialize(found.where("doc_id != component_id").select(F.col("doc_id").alias(doc_id)).distinct(), "simhash-dropped")
    repeated = materialize(found.where("doc_id is not null").groupBy(F.col("doc_id").alias(doc_id)).count().where("count > 1").select(doc_id), "simhash-repeated")
    kept = docs.join(gone, doc_id, "left_anti")
    if repeated.isEmpty():
        return kept.select(docs.columns)
    return kept.join(repeated, doc_id, "left_anti").select(docs.columns).unionAll(kept.join(repeated, doc_id, "left_semi").dropDuplicates([doc_id]).select(docs.columns))
