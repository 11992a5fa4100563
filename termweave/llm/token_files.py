"""Token ids in bit-packed binary files (operator 2).

A file holds whole documents in ascending doc_id order. Every id takes the least number of bits that the vocabulary
needs; 64 ids fill that many 64-bit words exactly, so packing and unpacking are 64 shifts over whole numpy
columns. A table of block offsets gives random access: any range of ids reads the blocks it touches.

    magic "TWPACK01" | bits u32 | ids a block u32 | documents u64 | ids u64 | blocks u64
    block offsets u64[blocks] | doc ids i64[documents] | doc id is null u8[documents] | starts u64[documents + 1] | payload

Documents are dealt to tasks by ranges of doc_id; a task encodes its range in order and closes a file at
``file_ids`` ids. A file gets a name that no other attempt uses, and only the names that successful tasks report
enter the manifest, so a lost executor leaves at most an orphan. Starts of files come from the manifest's sums.

Defined cases: a null or empty text is the end id alone; null doc_ids come first; rows that repeat a doc_id
follow one another; a text over ``file_ids`` ids has a file of its own; extra columns are left out; an empty
table makes no file and gives an empty table.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import arrow_rows, materialize, new_path, pieces

MAGIC = b"TWPACK01"
BLOCK = 4096
FILE_IDS = 8 << 20
KEPT = 2_000_000
LONG_WORD = 64
#: A space or line end that white space or the text's end follows.
MEETING = (re.compile(r" (?:\s|\Z)"), re.compile(r"\n(?:\s|\Z)"))
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz\u00e0\u00e1\u00e2\u00e4\u00e7\u00e8\u00e9\u00ea\u00ed\u00f1\u00f3\u00f6\u00fa\u00fc\u00df")
HEAD = struct.Struct("<8sIIQQQ")


# --- packing ------------------------------------------------------------------------------------------------


def bits_for(vocabulary: int) -> int:
    """The least number of bits for ids under ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Little-endian bit packing, padded to a multiple of 64 ids with zeros."""
    rows = -(-len(ids) // 64)
    cells = np.zeros(rows * 64, np.uint64)
    cells[: len(ids)] = ids
    cells = cells.reshape(rows, 64).T.copy()
    words = np.zeros((bits, rows), np.uint64)
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        words[word] |= cells[k] << np.uint64(shift)
        if shift + bits > 64:
            words[word + 1] |= cells[k] >> np.uint64(64 - shift)
    return words.T.astype("<u8").tobytes()


def unpack(data: bytes, bits: int) -> np.ndarray:
    """The ids of ``data``, padding included, as unsigned 32-bit integers."""
    words = np.frombuffer(data, "<u8").reshape(-1, bits).T.copy()
    mask = np.uint64((1 << bits) - 1)
    cells = np.empty((64, words.shape[1]), np.uint32)
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        x = words[word] >> np.uint64(shift)
        if shift + bits > 64:
            x = x | words[word + 1] << np.uint64(64 - shift)
        cells[k] = x & mask
    return cells.T.reshape(-1)


def write_file(path: str, doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, bits: int) -> None:
    blocks = -(-len(ids) // BLOCK)
    offsets = np.arange(blocks, dtype="<u8") * (BLOCK * bits // 8)
    store, name = pafs.FileSystem.from_uri(path)
    store.create_dir(name.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(name) as out:
        out.write(HEAD.pack(MAGIC, bits, BLOCK, len(doc_ids), len(ids), blocks))
        out.write(offsets.tobytes())
        out.write(np.array([x or 0 for x in doc_ids], "<i8").tobytes())
        out.write(np.array([x is None for x in doc_ids], np.uint8).tobytes())
        out.write(np.concatenate([[0], np.cumsum(lengths)]).astype("<u8").tobytes())
        for a in range(0, len(ids), BLOCK * 256):
            out.write(pack(ids[a : a + BLOCK * 256], bits))


class PackedFile:
    """Reads a file's tables at once, and of its payload the blocks that are asked for."""

    def __init__(self, path: str) -> None:
        store, name = pafs.FileSystem.from_uri(path)
        self.file = store.open_input_file(name)
        magic, self.bits, self.block, n, self.n_ids, blocks = HEAD.unpack(self.file.read(HEAD.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a packed token file")
        self.offsets = np.frombuffer(self.file.read(8 * blocks), "<u8")
        doc_ids, null = np.frombuffer(self.file.read(8 * n), "<i8"), np.frombuffer(self.file.read(n), np.uint8)
        self.doc_ids = [None if z else x for x, z in zip(doc_ids.tolist(), null.tolist(), strict=True)]
        self.starts = np.frombuffer(self.file.read(8 * (n + 1)), "<u8").astype(np.int64)
        self.payload = self.file.tell()
        self.size = self.file.size()

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop``."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        a = self.payload + int(self.offsets[first])
        b = self.payload + int(self.offsets[last + 1]) if last + 1 < len(self.offsets) else self.size
        self.file.seek(a)
        return unpack(self.file.read(b - a), self.bits)[start - first * self.block : stop - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


# --- encoding -----------------------------------------------------------------------------------------------


class LibraryEncoder:
    """Ids of texts by the tokenizers library, which is asked once for each word met.

    At a space or line end that no white space follows, this vocabulary's pre-tokenizer begins a piece, whatever stands
    before it. So a text is its words, each with the space or the line end before it, and each has ids of its own. New words go to the library as one text; its ids part where a token begins with a space,
    or is the line end, as no word holds either elsewhere. A full stop or comma after a letter is a piece of its own, so
    such a word is asked for without it. Texts with any other space or line end go whole, and so do those with an added token, which the
    library's call turns into its id. Words met are kept in two
    generations of at most ``KEPT`` together.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        #: Tokens that the library looks for in texts before anything else.
        self.marks = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.library.encode_special_tokens = True  # it need not look where there is none
        self.begins = np.zeros(self.library.get_vocab_size(), bool)
        for token, k in self.library.get_vocab().items():
            self.begins[k] = token.startswith("\u0120")  # how byte-level vocabularies write a space
        (line,) = self.library.encode("\n", add_special_tokens=False).ids
        self.begins[line] = True
        self.points = {p: self._ask([p])[0].tobytes() for p in ".,"}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _marked(self, text: str) -> bool:
        """Whether an added token is in a text; most texts don't even have its first letter."""
        return any(m[0] in text and m in text for m in self.marks)

    def _ask(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: set[str]) -> None:
        """Ask for the ids of new words."""
        words, points = self.words, self.points
        ended = [w for w in new if w[-1:] in points and w[-2:-1] in LETTERS]
        if ended:
            new.difference_update(ended)
            new.update([w for w in [x[:-1] for x in ended] if w not in words])
        asked = list(new)
        for a in range(0, len(asked), 256):
            part = asked[a : a + 256]
            ids = self._ask(["".join([w if w[:1] == "\n" else " " + w for w in part])])[0]
            ends = np.flatnonzero(self.begins[ids]) * 4
            if len(ends) != len(part):
                raise ValueError("this vocabulary doesn't begin a piece at each space and line end")
            flat, ends = ids.tobytes(), ends.tolist()
            words.update(zip(part, [flat[x:y] for x, y in zip(ends, [*ends[1:], len(flat)], strict=True)], strict=True))
        words.update([(w, words[w[:-1]] + points[w[-1]]) for w in ended])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, four bytes each."""
        if len(self.words) > KEPT // 2:
            self.older, self.words = self.words, {}
        words, older = self.words, self.older
        whole, found = [], []
        new: set[str] = set()
        missing: list[tuple[list, list[str], int]] = []
        for x in texts:
            x = x or ""
            rest = [x] if MEETING[0].search(x) or MEETING[1].search(x) or self._marked(x) else x.replace("\n", " \n").split(" ")
            whole.append(rest.pop(0))
            ids = list(map(words.get, rest))
            k = -1
            try:
                while True:
                    k = ids.index(None, k + 1)
                    w = rest[k]
                    known = older.get(w)
                    if known is None:
                        new.add(w)
                        missing.append((ids, rest, k))
                    else:
                        ids[k] = words[w] = known
            except ValueError:
                pass
                found.append(ids)
        long = [w for w in new if len(w) > LONG_WORD]
        if new:
            self._learn(new)
        for ids, rest, k in missing:
            ids[k] = words[rest[k]]
        heads = self._ask(whole)
        marked = [k for k, x in enumerate(whole) if self._marked(x)]
        if marked:
            self.library.encode_special_tokens = False
            for k, ids in zip(marked, self._ask([whole[k] for k in marked]), strict=True):
                heads[k] = ids
            self.library.encode_special_tokens = True
        out = [h.tobytes() + b"".join(ids) for h, ids in zip(heads, found, strict=True)]
        for w in long:
            words.pop(w, None)
            words.pop(w[:-1], None)
        return out


_encoders: dict[str, LibraryEncoder] = {}


def encoder(path: str) -> LibraryEncoder:
    """One encoder for each vocabulary in a worker."""
    if path not in _encoders:
        _encoders[path] = LibraryEncoder(path)
    return _encoders[path]


# --- the operator -------------------------------------------------------------------------------------------


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, vocabulary: int | None = None, doc_id: str = "doc_id", text: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Write the files; the manifest ``(file, part, seq, n_docs, n_ids, start)`` is a table in the shared folder."""
    spark = docs.sparkSession
    if vocabulary is None:
        vocabulary = encoder(tokenizer).library.get_vocab_size()
    bits, folder = bits_for(max(vocabulary, end_id + 1)), new_path(spark, "token-files")
    end = np.uint32(end_id).tobytes()
    # the tie-break deals out rows that repeat one doc_id
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("tie", F.monotonically_increasing_id())
    ranged = keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, coder = TaskContext.get().partitionId(), encoder(tokenizer)
        keys: list[int | None] = []
        held: list[bytes] = []
        size, seq = 0, 0

        def close() -> pa.RecordBatch:
            path = f"{folder}/part-{part:06d}-{seq:05d}-{uuid.uuid4().hex}.bin"
            write_file(path, keys, [len(x) // 4 for x in held], np.frombuffer(b"".join(held), np.uint32), bits)
            return pa.RecordBatch.from_pylist([{"file": path, "part": part, "seq": seq, "n_docs": len(keys), "n_ids": size}])

        for b in pieces(batches):
            for key, ids in zip(b.column(0).to_pylist(), coder.encode(b.column(1).to_pylist()), strict=True):
                n = len(ids) // 4 + 1
                if keys and size + n > file_ids:
                    yield close()
                    keys, held, size, seq = [], [], 0, seq + 1
                keys.append(key)
                held.append(ids + end)
                size += n
        if keys:
            yield close()

    with arrow_rows(spark, 512):  # else a task holds many texts in a batch beside its memory of words
        written = materialize(ranged.mapInArrow(write, "file string, part long, seq long, n_docs long, n_ids long"), "token-file-list")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return written.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Read back what the manifest lists: ``doc_id, start, n_tokens, ids_crc32`` for each document."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                f = PackedFile(path)
                k, n = 0, len(f.doc_ids)
                while k < n:
                    stop = max(k + 1, int(np.searchsorted(f.starts, f.starts[k] + (1 << 20), "right")) - 1)
                    at = f.starts[k : stop + 1]
                    ids = f.ids(int(at[0]), int(at[-1])).astype("<u4")
                    raw, cut = memoryview(ids.tobytes()), ((at - at[0]) * 4).tolist()
                    crc = [zlib.crc32(raw[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(f.doc_ids[k:stop], pa.int64()), pa.array(at[:-1] + start), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    k = stop

    files = manifest.count()
    return manifest.select("file", "start").repartition(max(1, files)).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def pack_and_read_back(docs: DataFrame, tokenizer: str, end_id: int = 2, vocabulary: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    manifest = materialize(write_token_files(docs, tokenizer, end_id, vocabulary, doc_id, text), "token-manifest")
    return read_token_files(docs.sparkSession, manifest)
