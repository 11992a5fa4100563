"""Dropping lines that many documents share, through a sharded minimal perfect hash (operator 7).

1. Each document gives the 128-bit hashes of its distinct line keys; one grouped count (combined before the
   shuffle, so a line in every document is a few rows) leaves the hashes found in ``min_docs`` documents.
2. Those distinct hashes are split into shards of bounded size. A task builds a shard's minimal perfect hash
   (levels of bit arrays with ranks), the fingerprint array (64 other bits) and the count array. Hashes under the threshold are
   not built in, as a probe would refuse them.
3. Documents probe the arrays, and a line goes if its count reaches the threshold; no line is joined. While the whole index is under ``index_bytes`` each worker
   holds it. Beyond that, line hashes are sent to their shard (split into parts by its counts, as a hot line may be
   a third of all), where the arrays come first in the sorted stream and the lines after them probe them; only
   hits return to their documents.

Defined cases: a null or empty text is one empty line; the empty key has fewer than ``min_chars`` code points
and always stays; rows that repeat a doc_id are one document to the count, rows without one are documents of their own;
without a column ``doc_id`` each row is a document; extra columns pass through; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import materialize, pieces

STRIP = " \t\n\x0b\x0c\r"
SHARD_KEYS = 1 << 18
#: Lines that a shard's part is to meet at most, of those that it holds.
PART_LINES = 1 << 20
INDEX = "shard int, n long, total long, sizes array<long>, bits binary, prints binary, counts binary"


def line_key(line: str) -> bytes:
    """The line without ASCII white space at its ends, with A-Z in lower case."""
    return line.strip(STRIP).encode().lower()  # bytes.lower() changes A-Z alone


def hash_keys(keys: list[bytes]) -> np.ndarray:
    """Two unsigned 64-bit halves per key."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">u8").astype(np.uint64).reshape(-1, 2)


# --- the minimal perfect hash -------------------------------------------------------------------------------


def _place(h: np.ndarray, level: int, size: int) -> np.ndarray:
    x = h[:, 0] * np.uint64(2 * (0x9E3779B97F4A7C15 * (level + 1) % 2**62) + 1) ^ h[:, 1] * np.uint64(2 * (0xC2B2AE3D27D4EB4F * (level + 3) % 2**62) + 1)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return (x % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Slots 0..n-1 for n distinct hashes: a hash takes the first level at which no other has its bit."""

    def __init__(self, sizes: list[int], words: np.ndarray) -> None:
        self.sizes, self.words = sizes, words
        ones = np.bitwise_count(words).astype(np.int64)
        self.rank = np.cumsum(ones) - ones

    @classmethod
    def build(cls, h: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        sizes, parts, level = [], [], 0
        while len(h):
            size = max(64, -(-int(gamma * len(h)) // 64) * 64)
            at = _place(h, level, size)
            alone = np.bincount(at, minlength=size) == 1
            parts.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            h, level = h[~alone[at]], level + 1
        return cls(sizes, np.concatenate(parts) if parts else np.zeros(0, np.uint64))

    def slots(self, h: np.ndarray) -> np.ndarray:
        """A slot for each hash; -1, or any slot, for hashes that were not built in."""
        out, left, first = np.full(len(h), -1, np.int64), np.arange(len(h)), 0
        for level, size in enumerate(self.sizes):
            if not left.size:
                break
            at = _place(h[left], level, size) + first
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[hit]] = (self.rank[at >> 6] + below)[hit]
            left, first = left[~hit], first + size
        return out


class Shard:
    def __init__(self, sizes: list[int], bits: bytes, prints: bytes, counts: bytes) -> None:
        self.hash = PerfectHash(list(sizes), np.frombuffer(bits, np.uint64))
        self.prints, self.counts = np.frombuffer(prints, np.uint64), np.frombuffer(counts, np.int64)

    def count(self, h: np.ndarray) -> np.ndarray:
        """In how many documents each hash was found; 0 if the shard doesn't hold it."""
        if not len(self.prints):
            return np.zeros(len(h), np.int64)
        slot = self.hash.slots(h)
        known = (slot >= 0) & (self.prints[slot] == h[:, 1] ^ h[:, 0] << np.uint64(32))
        return np.where(known, self.counts[slot], 0)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    h = np.ascontiguousarray(pdf[["h1", "h2"]].to_numpy(np.int64)).view(np.uint64)
    perfect = PerfectHash.build(h)
    slot = perfect.slots(h)
    prints, counts = np.zeros(len(h), np.uint64), np.zeros(len(h), np.int64)
    prints[slot], counts[slot] = h[:, 1] ^ h[:, 0] << np.uint64(32), pdf["n_docs"].to_numpy(np.int64)
    return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "n": [len(h)], "total": [int(counts.sum())], "sizes": [perfect.sizes], "bits": [perfect.words.tobytes()], "prints": [prints.tobytes()], "counts": [counts.tobytes()]})


# --- the operator -------------------------------------------------------------------------------------------


def shared_line_index(docs: DataFrame, text: str, min_docs: int, min_chars: int, doc_id: str | None = None) -> tuple[DataFrame, int]:
    """The shards (a table in the shared folder) over the hashes of keys in ``min_docs`` documents, and their number."""
    repeated = doc_id is not None and not docs.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id)).count().where("count > 1").isEmpty()

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            found: list[bytes] = []
            owners: list[str] = []
            for i, x in zip(b.column(1).to_pylist(), b.column(0).to_pylist(), strict=True):
                own = {k for k in map(line_key, (x or "").split("\n")) if len(k) >= min_chars and (min_chars < 2 or len(k.decode()) >= min_chars)}
                found += own
                owners += [i] * len(own)
            h = hash_keys(found).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(owners, pa.string())], ["h1", "h2", "doc"])

    owner = F.coalesce(F.concat(F.lit("i"), F.col(doc_id).cast("string")), F.concat(F.lit("r"), F.monotonically_increasing_id())) if repeated else F.lit(None).cast("string")
    lines = docs.select(F.col(text).alias("text"), owner.alias("doc")).mapInArrow(keys, "h1 long, h2 long, doc string")
    lines = lines.distinct() if repeated else lines.select("h1", "h2")
    shared = materialize(lines.groupBy("h1", "h2").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_docs), "shared-lines")
    shards = max(1, -(-shared.count() // SHARD_KEYS))
    index = shared.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(_build, INDEX)
    return materialize(index, "line-index"), shards


def _rebuild(text: str | None, shared) -> tuple[int, int, str]:
    """Lines, dropped lines and the rest, given which lines are shared."""
    lines = (text or "").split("\n")
    rest = [x for x, gone in zip(lines, shared, strict=True) if not gone]
    return len(lines), len(lines) - len(rest), "\n".join(rest)


def _probe_held(docs: DataFrame, shards: int, index: DataFrame, at: int, least: int, finish, schema: T.StructType) -> DataFrame:
    """Documents probe an index that every worker holds."""
    held = docs.sparkSession.sparkContext.broadcast({r["shard"]: (list(r["sizes"]), bytes(r["bits"]), bytes(r["prints"]), bytes(r["counts"])) for r in index.collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = {k: Shard(*v) for k, v in held.value.items()}
        for b in pieces(batches):
            texts = b.column(at).to_pylist()
            split = [(x or "").split("\n") for x in texts]
            keys = [line_key(x) for lines in split for x in lines]
            h = hash_keys(keys)
            shard = h[:, 0].view(np.int64) % shards
            shared = np.zeros(len(h), bool)
            for k, s in arrays.items():
                own = np.flatnonzero(shard == k)
                shared[own] = s.count(h[own]) >= least
            flags, first, out = shared.tolist(), 0, []
            for x, lines in zip(texts, split, strict=True):
                out.append(_rebuild(x, flags[first : first + len(lines)]))
                first += len(lines)
            yield finish(b, out)

    return docs.mapInArrow(run, schema)


def _probe_routed(docs: DataFrame, shards: int, index: DataFrame, at: int, least: int, finish, schema: T.StructType) -> DataFrame:
    """Line hashes travel to their shard; only hits come back. For an index of any size."""
    row, text = "_row_of_line_dedup", docs.columns[at]
    docs = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "line-docs")
    parts = np.ones(shards, np.int64)  # a number for each shard
    for r in index.select("shard", "total").toLocalIterator():
        parts[r["shard"]] = -(-r["total"] // PART_LINES)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            for r, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = hash_keys([line_key(y) for y in (x or "").split("\n")])
                for a in range(0, len(h), 65536):
                    part = h[a : a + 65536].view(np.int64)
                    shard, at = part[:, 0] % shards, np.arange(a, a + len(part))
                    yield pa.RecordBatch.from_arrays([pa.array(shard).cast("int32"), pa.array((r + at) % parts[shard]).cast("int32"), pa.array(np.full(len(part), r)), pa.array(at), pa.array(part[:, 0]), pa.array(part[:, 1])], ["shard", "salt", row, "line", "h1", "h2"])

    sent = docs.select(row, text).mapInArrow(lines, f"shard int, salt int, {row} long, line long, h1 long, h2 long")
    arrays = index.drop("n", "total").join(index.select("shard", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("total") / PART_LINES) - 1).cast("int"))).alias("salt")), "shard")
    stream = sent.unionByName(arrays, allowMissingColumns=True).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("sizes").isNull())

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], Shard] = {}
        for b in batches:
            head = b.column("sizes")
            held = dict(list(held.items())[-1:])  # of the shards before this batch only the last can go on
            for i in np.flatnonzero(head.is_valid().to_numpy(zero_copy_only=False)).tolist():
                held[b.column("shard")[i].as_py(), b.column("salt")[i].as_py()] = Shard(*(b.column(c)[i].as_py() for c in ("sizes", "bits", "prints", "counts")))
            rest = b.filter(head.is_null()).select(["shard", "salt", row, "line", "h1", "h2"])
            col = {c: rest.column(c).to_numpy() for c in rest.schema.names}
            for key, s in held.items():
                own = np.flatnonzero((col["shard"] == key[0]) & (col["salt"] == key[1]))
                hit = own[s.count(np.column_stack([col["h1"][own], col["h2"][own]]).view(np.uint64)) >= least]
                yield pa.RecordBatch.from_arrays([pa.array(col[row][hit]), pa.array(col["line"][hit])], [row, "line"])

    hits = stream.mapInArrow(probe, f"{row} long, line long").groupBy(row).agg(F.collect_list("line").alias("_hits_of_line_dedup"))
    joined = docs.join(hits, row, "left").select(*docs.columns, "_hits_of_line_dedup").drop(row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            out = []
            for x, hit in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                gone = np.zeros((x or "").count("\n") + 1, bool)
                gone[hit or []] = True
                out.append(_rebuild(x, gone.tolist()))
            yield finish(b.select(range(b.num_columns - 1)), out)

    return joined.mapInArrow(run, schema)


def _dedup(docs: DataFrame, text: str, doc_id: str | None, min_docs: int, min_chars: int, index_bytes: int, finish, schema: T.StructType) -> DataFrame:
    index, shards = shared_line_index(docs, text, min_docs, min_chars, doc_id)
    size = index.agg(F.sum(F.length("bits") + F.length("prints") + F.length("counts"))).first()[0] or 0
    probe = _probe_held if size <= index_bytes else _probe_routed
    return probe(docs, shards, index, docs.columns.index(text), min_docs, finish, schema)


def drop_shared_lines(docs: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1, index_bytes: int = 32 << 20, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with shared lines gone from ``text``; all other columns as they were. A null text becomes empty."""
    at = docs.columns.index(text)

    def finish(b: pa.RecordBatch, out: list[tuple[int, int, str]]) -> pa.RecordBatch:
        return b.set_column(at, text, pa.array([x[2] for x in out], pa.string()))

    return _dedup(docs, text, doc_id if doc_id in docs.columns else None, min_docs, min_chars, index_bytes, finish, docs.schema)


def digest_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1, index_bytes: int = 32 << 20) -> DataFrame:
    """One row per document: ``doc_id, n_lines, n_dropped, kept_sha256``."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([docs.schema[0], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_sha256", T.StringType())])

    def finish(b: pa.RecordBatch, out: list[tuple[int, int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([hashlib.sha256(x[2].encode()).hexdigest() for x in out], pa.string())], schema.names)

    return _dedup(docs, "text", "doc_id", min_docs, min_chars, index_bytes, finish, schema)
