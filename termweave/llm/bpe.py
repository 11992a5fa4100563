"""Byte-level BPE encoding and decoding with a segment tree of pair ranks (operator 6).

A text is cut into pieces by the vocabulary's pattern, and each piece is merged by itself. The piece's byte
positions are the leaves of a segment tree; a leaf holds the rank of the pair that begins there, joined with its
position, so the root is the leftmost pair of the lowest rank. A merge changes three leaves (the pair, the symbol
that vanished, the live symbol before) and the nodes above them. Short pieces go through their trees in
step, as numpy arrays of trees of one width; longer ones (over ``WIDTHS[-1]`` bytes) one by one.

A worker keeps the ids of the words it has met, up to ``KEPT`` of them. Words are what stands between single
spaces: a space before a character that is no white space always begins a piece, so ids of a text are those of its
words in a row. Texts with any other space are cut by the pattern as a whole.

Defined cases: a null text is an empty one, of no ids; very long texts and very long pieces take n log n steps;
repeated rows and extra columns pass through; an empty table gives an empty table; bytes that no rank covers raise
KeyError when the vocabulary is read, as any byte must have a rank.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import pieces

#: Bits of an id in the key of a pair.
PAIR = 32

WIDTHS = (2, 4, 8, 16, 32, 64)
NONE = np.int64(1) << 40
KEPT = 400_000
LONG_WORD = 64
#: A space that doesn't begin a piece: white space or the end follows.
OTHER_SPACE = re.compile(r" (?:\s|$)")


class SegmentTreeBpe:
    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.token = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            self.token[r] = t
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for t, r in self.ranks.items():
            for k in range(1, len(t)):
                a, b = self.ranks.get(t[:k]), self.ranks.get(t[k:])
                if a is not None and b is not None:
                    pairs[a << PAIR | b] = r
        self.pair_rank = pairs
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_values = np.array([pairs[k] for k in sorted(pairs)], np.int64)
        self.words: dict[str, bytes] = {}

    # --- merging ---------------------------------------------------------------------------------------

    def _leaves(self, a: np.ndarray, b: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        """Leaf values of the pairs (a, b) at their positions; NONE where there is no merge."""
        key = a << PAIR | b
        k = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[k] == key) & (a >= 0) & (b >= 0), self.pair_values[k] * width + at, NONE)

    def _merge_in_step(self, pieces: list[bytes], width: int) -> list[bytes]:
        n = len(pieces)
        raw = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in pieces), np.uint8).reshape(n, width)
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        column = np.arange(width)
        ids = np.full((n, width + 1), -1, np.int64)  # column ``width`` stands for "none"
        ids[:, :width] = np.where(column < lengths[:, None], self.byte[raw], -1)
        after = np.broadcast_to(np.arange(1, width + 2), (n, width + 1)).copy()
        after = np.where(after >= lengths[:, None], width, after)
        before = np.broadcast_to(np.arange(-1, width), (n, width + 1)).copy()
        tree = np.full((n, 2 * width), NONE)
        tree[:, width:-1] = self._leaves(ids[:, : width - 1], ids[:, 1:width], column[:-1], width)
        level = width
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        live = np.flatnonzero(tree[:, 1] < NONE)
        while live.size:
            root = tree[live, 1]
            at, rank = root % width, root // width
            gone = after[live, at]
            then, prior = after[live, gone], before[live, at]
            ids[live, at], ids[live, gone] = rank, -1
            after[live, at], before[live, then] = then, at
            here = self._leaves(rank, ids[live, then], at, width)
            first = prior < 0
            back = np.where(first, at, prior)
            behind = np.where(first, here, self._leaves(ids[live, back], rank, back, width))
            tree[live, width + gone], tree[live, width + at], tree[live, width + back] = NONE, here, behind
            nodes = [width + gone, width + at, width + back]
            while True:
                nodes = [x >> 1 for x in nodes]
                if not nodes[0][0]:
                    break
                for x in nodes:
                    tree[live, x] = np.minimum(tree[live, 2 * x], tree[live, 2 * x + 1])
            live = live[tree[live, 1] < NONE]
        kept = ids[:, :width]
        alive = kept >= 0
        flat, ends = kept[alive].astype(np.uint32).tobytes(), np.cumsum(alive.sum(1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _merge_alone(self, piece: bytes) -> bytes:
        n = len(piece)
        width = 1 << max(1, (n - 1).bit_length())
        ids, after, before = self.byte[np.frombuffer(piece, np.uint8)].tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        none, rank_of = int(NONE) * width, self.pair_rank.get

        def leaf(i: int, j: int) -> int:
            r = rank_of(ids[i] << PAIR | ids[j])
            return none if r is None else r * width + i

        tree = [none] * (2 * width)
        for i in range(n - 1):
            tree[width + i] = leaf(i, i + 1)
        for x in range(width - 1, 0, -1):
            tree[x] = min(tree[2 * x], tree[2 * x + 1])
        while tree[1] < none:
            rank, at = divmod(tree[1], width)
            gone = after[at]
            then, prior = after[gone], before[at]
            ids[at], ids[gone], after[at] = rank, -1, then
            changed = [(gone, none), (at, none)]
            if then < n:
                before[then] = at
                changed[1] = (at, leaf(at, then))
            if prior >= 0:
                changed.append((prior, leaf(prior, at)))
            for i, value in changed:
                x = width + i
                tree[x] = value
                while x > 1:
                    x >>= 1
                    low = min(tree[2 * x], tree[2 * x + 1])
                    if tree[x] == low:
                        break
                    tree[x] = low
        return np.array([x for x in ids if x >= 0], np.uint32).tobytes()

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as little-endian unsigned 32-bit integers. A piece that is a token is that token."""
        out: list[bytes] = [b""] * len(pieces)
        classes: dict[int, list[int]] = {}
        for k, x in enumerate(pieces):
            r = self.ranks.get(x)
            if r is not None:
                out[k] = r.to_bytes(4, "little")
            elif x:
                classes.setdefault(next((w for w in WIDTHS if len(x) <= w), 0), []).append(k)
        for width, ks in classes.items():
            if width:
                for a in range(0, len(ks), 8192):
                    part = ks[a : a + 8192]
                    for k, ids in zip(part, self._merge_in_step([pieces[k] for k in part], width), strict=True):
                        out[k] = ids
            else:
                for k in ks:
                    out[k] = self._merge_alone(pieces[k])
        return out

    # --- texts -----------------------------------------------------------------------------------------

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.words) > KEPT:
            self.words.clear()
        words, whole, wanted = self.words, {}, set()
        split: list[list[str] | None] = []
        for k, x in enumerate(texts):
            x = x or ""
            if OTHER_SPACE.search(x):
                whole[k] = self.pattern.findall(x)
                split.append(None)
            else:
                head, *rest = x.split(" ")
                whole[k] = self.pattern.findall(head)
                split.append(rest)
                wanted.update(set(rest).difference(words))
        cut = {w: self.pattern.findall(" " + w) for w in wanted}
        pieces = list({p for x in (*cut.values(), *whole.values()) for p in x})
        ids = dict(zip(pieces, self.merge([p.encode() for p in pieces]), strict=True))
        for w, x in cut.items():
            words[w] = b"".join([ids[p] for p in x])
        out = [np.frombuffer(b"".join([ids[p] for p in whole[k]] + ([words[w] for w in rest] if rest else [])), np.uint32) for k, rest in enumerate(split)]
        for w in wanted:
            if len(w) > LONG_WORD:
                del words[w]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist()))


_coders: dict[tuple[str, str], SegmentTreeBpe] = {}


def coder(path: str, pattern: str) -> SegmentTreeBpe:
    """One coder for each vocabulary in a worker."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = SegmentTreeBpe(path, pattern)
    return _coders[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the array ``ids`` in place of ``text``, and of a column of that name."""
    at = docs.columns.index(text)
    keep = [k for k, c in enumerate(docs.columns) if c not in (text, ids)]
    schema = T.StructType([*(docs.schema[k] for k in keep), T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for b in pieces(batches, 256):
            found = bpe.encode(b.column(at).to_pylist())
            flat = np.concatenate([*found, np.zeros(0, np.uint32)]).view(np.int32)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], schema.names)

    return docs.mapInArrow(run, schema)


def decode_documents(docs: DataFrame, path: str, pattern: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``docs`` with the decoded ``text`` in place of the array ``ids``, and of a column of that name; bytes that aren't UTF-8 become U+FFFD."""
    at = docs.columns.index(ids)
    keep = [k for k, c in enumerate(docs.columns) if c not in (text, ids)]
    schema = T.StructType([*(docs.schema[k] for k in keep), T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for b in pieces(batches, 256):
            texts = [None if x is None else bpe.decode(np.array(x, np.int64)).decode("utf-8", "replace") for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(texts, pa.string())], schema.names)

    return docs.mapInArrow(run, schema)


def digest_tokens(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_tokens, ids_sha256, decoded_sha256``; the last of the decoded ids' bytes."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([docs.schema[0], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        decimal = list(map(str, range(len(bpe.token))))
        for b in pieces(batches, 256):
            found = bpe.encode(b.column(1).to_pylist())
            said = [hashlib.sha256(" ".join(map(decimal.__getitem__, x.tolist())).encode()).hexdigest() for x in found]
            back = [hashlib.sha256(bpe.decode(x)).hexdigest() for x in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array(said, pa.string()), pa.array(back, pa.string())], schema.names)

    return docs.mapInArrow(run, schema)
