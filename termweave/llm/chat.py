"""Chat formatting as a prefix tree with ancestor attention (operator 5).

Each turn is one unit of text in the template

    <|turn|>ROLE<|text|>TEXT<|end|>\\n

where every ``<``, ``[`` and backslash of the role and the text is followed by an added backslash. No control string of this
or any other template that begins with ``<`` or ``[`` can therefore come from a text, and dropping the
backslashes restores it.

Conversations that begin with equal turns share those nodes of a tree. A conversation's path is the row of its turns'
digests (16 bytes each), and paths in order are a depth-first order of the tree's leaves: what a path shares with the
one before it is emitted already, and the rest is its chunk. So every shared turn is emitted once, a chunk has one row
of linear size, and equal conversations are one path after a grouping. Paths are dealt by ranges; a range's first path
shares turns with the last one before it, which the driver settles from two paths for each range. A node carries the
position id of its first token (its ancestors' lengths) and the intervals of its ancestors in the emission, those side by
side joined, to which its tokens attend besides the earlier ones of its own. Tokens are code points, or the ids of a tokenizers
file for a turn's head, its escaped text and its end each by itself, so that the loss mask, the intervals of the assistants' texts, falls
on whole tokens. ``read_back`` works from ids and mask alone.

Defined cases: null roles and texts are empty; equal turn numbers are ordered by role and text, null turns come first;
rows without conv_id belong to no conversation and are left out; equal conversations share all nodes; extra
columns are left out; an empty table gives empty tables. A conversation is one row in memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import arrow_rows, forget, materialize, pieces

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
DIGEST = 16
LOSS_ROLE = "assistant"
_SPECIAL = re.compile(r"([<\[\\])")
_ESCAPED = re.compile(r"([<\[\\])\\")


def escape(x: str) -> str:
    return _SPECIAL.sub(r"\1\\", x)


def unescape(x: str) -> str:
    return _ESCAPED.sub(r"\1", x)


def format_turn(role: str | None, text: str | None) -> str:
    return f"{TURN}{escape(role or '')}{TEXT}{escape(text or '')}{END}"


def parse_turn(unit: str) -> tuple[str, str]:
    """Role and text of a unit; the markers can't occur inside either."""
    role, text = unit[len(TURN) : -len(END)].split(TEXT)
    return unescape(role), unescape(text)


class Coder:
    """Ids of texts and texts of ids: code points, or by a tokenizers file."""

    def __init__(self, tokenizer: str | None) -> None:
        self.library = None
        if tokenizer is not None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(tokenizer)

    def encode(self, text: str) -> np.ndarray:
        if self.library is None:
            return np.frombuffer(text.encode("utf-32-le"), "<i4")
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)

    def decode(self, ids: np.ndarray) -> str:
        if self.library is None:
            return ids.astype("<i4").tobytes().decode("utf-32-le")
        return self.library.decode(ids.tolist(), skip_special_tokens=False)

    def unit(self, unit: str) -> tuple[np.ndarray, int, int]:
        """A unit's ids, and where those of a text under the loss mask begin and end."""
        head, text = unit[: -len(END)].split(TEXT)
        said = [self.encode(x) for x in (head + TEXT, text, END)]
        first, n = len(said[0]), len(said[1])
        masked = unescape(head[len(TURN) :]) == LOSS_ROLE
        return np.concatenate(said), first if masked else 0, first + n if masked else 0


def _with_ids(b: pa.RecordBatch, ids: list[list[np.ndarray]]) -> pa.RecordBatch:
    """The batch with a column of ids, which stay out of Python's own lists."""
    flat = np.concatenate([x for row in ids for x in row] or [np.zeros(0, np.int32)])
    ends = np.cumsum([0, *(sum(map(len, row)) for row in ids)]).astype(np.int32)
    return pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))], [*b.schema.names, "ids"])


def _shared(a: bytes, b: bytes) -> int:
    """How many digests two paths have in common at their beginning."""
    k, n = 0, min(len(a), len(b)) // DIGEST
    while k < n and a[k * DIGEST : (k + 1) * DIGEST] == b[k * DIGEST : (k + 1) * DIGEST]:
        k += 1
    return k


def _ends(tokens: list[int], first: int) -> list[int]:
    """Where each unit begins, from ``first`` on."""
    return [first, *(first + x for x in accumulate(tokens))][: len(tokens)]


def joined(starts: list[int], tokens: list[int]) -> list[dict[str, int]]:
    """Intervals in order, with those side by side as one."""
    out: list[dict[str, int]] = []
    for s, n in zip(starts, tokens, strict=True):
        if out and out[-1]["stop"] == s:
            out[-1]["stop"] = s + n
        else:
            out.append({"start": s, "stop": s + n})
    return out


_SPANS = "array<struct<start: bigint, stop: bigint>>"


def build_tree(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", tokenizer: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(chunks, leaves, conversations)``, all tables in the shared folder.

    chunks: ``chunk`` (its offset in the depth-first emission), ``units``, their token ``ids`` and how many ``tokens`` each has,
    ``loss``, the intervals of the emission under the loss mask, ``depth`` and ``position`` of the first unit, and ``attends``, the
    intervals of the ancestors of that unit. leaves: ``leaf`` and ``parts``, the (chunk, first unit, units) that make up its path in
    order. conversations: ``conv_id, leaf``.
    """
    spark = turns.sparkSession
    rows = turns.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 256):
            units = [[format_turn(t["role"], t["text"]) for t in conv] for conv in b.column(1).to_pylist()]
            found = [b"".join(hashlib.blake2b(u.encode(), digest_size=DIGEST).digest() for u in x) for x in units]
            leaf = [hashlib.blake2b(x, digest_size=DIGEST).digest() for x in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(leaf, pa.binary()), pa.array(found, pa.binary()), pa.array(units, pa.list_(pa.string()))], ["conv_id", "leaf", "path", "units"])

    kind = convs.schema["conv_id"].dataType.simpleString()
    with arrow_rows(spark, 256):
        formatted = materialize(convs.mapInArrow(paths, f"conv_id {kind}, leaf binary, path binary, units array<string>"), "chat-formatted")
    different = formatted.groupBy("path").agg(F.first("leaf").alias("leaf"), F.first("units").alias("units"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each path against the one before it in its range, with the ids of what is new; offsets count from the range's beginning."""
        part, coder = TaskContext.get().partitionId(), Coder(tokenizer)
        last, seq, offset, least = b"", 0, 0, 0
        starts: list[int] = []
        owners: list[int] = []
        tokens: list[int] = []
        for b in pieces(batches, 256):
            out, ids = [], []
            for path, leaf, units in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                same = _shared(last, path) if seq else 0
                least = min(least, same) if seq else len(units)
                coded = [coder.unit(u) for u in units[same:]]
                tokens = tokens[:same] + [len(x) for x, _, _ in coded]
                starts = starts[:same] + _ends(tokens[same:], offset)
                owners = owners[:same] + [offset] * (len(units) - same)
                ids.append([x for x, _, _ in coded])
                out.append({"part": part, "seq": seq, "path": path, "leaf": leaf, "units": units[same:], "tokens": tokens, "marks": [m for _, *m in coded], "same": same, "least": least, "starts": starts, "owners": owners})
                offset += sum(tokens[same:])
                last, seq = path, seq + 1
            if out:
                yield _with_ids(pa.RecordBatch.from_pylist(out, emitted_schema), ids)

    ints = pa.list_(pa.int64())
    new = [("units", pa.list_(pa.string())), ("tokens", ints)]
    emitted_schema = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("path", pa.binary()), ("leaf", pa.binary()), *new, ("marks", pa.list_(ints)), ("same", pa.int64()), ("least", pa.int64()), ("starts", ints), ("owners", ints)])
    emitted_kind = "part long, seq long, path binary, leaf binary, units array<string>, tokens array<long>, marks array<array<long>>, same long, least long, starts array<long>, owners array<long>, ids array<int>"
    ordered = different.repartitionByRange("path").sortWithinPartitions("path").mapInArrow(emit, emitted_kind)
    with arrow_rows(spark, 256):
        emitted = materialize(ordered, "chat-emitted")
    inherited = spark.sparkContext.broadcast(_settle(emitted))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Global offsets, and the first paths of ranges without what they inherit."""
        for b in pieces(batches, 256):
            out, ids = [], []
            flat, marks = b.column("ids").values.to_numpy(), b.column("ids").offsets.to_numpy()
            for k, r in enumerate(b.drop_columns(["ids"]).to_pylist()):
                above = inherited.value[r["part"]]
                same, starts, owners = above.apply(r)
                tokens, skip = r["tokens"], same - r["same"]
                parts: list[dict[str, int]] = []
                for start, owner in zip(starts, owners, strict=True):
                    if parts and parts[-1]["chunk"] == owner:
                        parts[-1]["n"] += 1
                    else:
                        # a chunk's units are consecutive depths; its first is where this path meets it
                        parts.append({"chunk": owner, "at": start, "n": 1})
                ids.append([flat[marks[k] + sum(tokens[r["same"] : same]) : marks[k + 1]]])
                loss = [{"start": s + first, "stop": s + stop} for s, (first, stop) in zip(starts[same:], r["marks"][skip:], strict=True) if stop]
                out.append({
                    "leaf": r["leaf"], "chunk": starts[same], "units": r["units"][skip:], "tokens": tokens[same:], "loss": loss,
                    "depth": same + 1, "position": sum(tokens[:same]), "attends": joined(starts[:same], tokens[:same]), "parts": parts,
                })
            if out:
                yield _with_ids(pa.RecordBatch.from_pylist(out, placed_schema), ids)

    spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    parts_kind = pa.list_(pa.struct([("chunk", pa.int64()), ("at", pa.int64()), ("n", pa.int64())]))
    placed_schema = pa.schema([("leaf", pa.binary()), ("chunk", pa.int64()), *new, ("loss", spans), ("depth", pa.int64()), ("position", pa.int64()), ("attends", spans), ("parts", parts_kind)])
    placed_kind = f"leaf binary, chunk long, units array<string>, tokens array<long>, loss {_SPANS}, depth long, position long, attends {_SPANS}, parts array<struct<chunk: bigint, at: bigint, n: bigint>>, ids array<int>"
    with arrow_rows(spark, 256):
        placed = materialize(emitted.drop("path").mapInArrow(place, placed_kind), "chat-tree")
    forget(emitted)
    return placed.drop("leaf", "parts"), placed.select("leaf", "parts"), formatted.select("conv_id", "leaf")


class _Inherited:
    """What a range of paths takes over from the ranges before it."""

    def __init__(self, first: int, shared: int, taken: int, starts: list[int], owners: list[int]) -> None:
        self.first, self.shared, self.taken, self.starts, self.owners = first, shared, taken, starts, owners

    def apply(self, r) -> tuple[int, list[int], list[int]]:
        """Emitted depths, starts and owners of a path, in global offsets."""
        held = min(r["least"], self.shared)
        move = self.first - self.taken
        first_owner = self.first if self.shared else None  # the first path's chunk begins after what it inherits
        starts = self.starts[:held] + [x + move for x in r["starts"][held:]]
        owners = self.owners[:held] + [first_owner if first_owner is not None and x == 0 else x + move for x in r["owners"][held:]]
        return (self.shared if r["seq"] == 0 else r["same"]), starts, owners


def _settle(emitted: DataFrame) -> dict[int, _Inherited]:
    """For each range its offset and what its first path inherits: two rows a range on the driver."""
    ends = emitted.groupBy("part").agg(
        F.min_by(F.struct("path", "tokens"), "seq").alias("low"),
        F.max_by(F.struct("path", "tokens", "same", "least", "starts", "owners", "seq"), "seq").alias("high"),
    )
    out: dict[int, _Inherited] = {}
    last, starts, owners, offset = b"", [], [], 0
    for r in sorted(ends.collect(), key=lambda r: r["part"]):
        shared = _shared(last, bytes(r["low"]["path"]))
        taken = sum(r["low"]["tokens"][:shared])
        out[r["part"]] = own = _Inherited(offset, shared, taken, starts[:shared], owners[:shared])
        _, starts, owners = own.apply(r["high"])
        last = bytes(r["high"]["path"])
        offset = starts[-1] + r["high"]["tokens"][-1]  # the last path's chunk ends the range
    return out


def list_nodes(chunks: DataFrame) -> DataFrame:
    """One row per node in the emission: ``start, n_tokens, depth, position, attends, unit``."""
    begun = F.expr("aggregate(slice(tokens, 1, k), 0L, (a, x) -> a + x)")
    own = F.expr("array(named_struct('start', chunk, 'stop', chunk + before))")
    nodes = chunks.select("*", F.posexplode("units").alias("k", "unit")).withColumn("before", begun)
    joins = F.expr("k > 0 and size(attends) > 0 and element_at(attends, -1).stop = chunk")
    attends = (
        F.when(F.col("k") == 0, F.col("attends"))
        .when(joins, F.concat(F.expr("slice(attends, 1, size(attends) - 1)"), F.expr("array(named_struct('start', element_at(attends, -1).start, 'stop', chunk + before))")))
        .otherwise(F.concat("attends", own))
    )
    return nodes.select((F.col("chunk") + F.col("before")).alias("start"), F.expr("tokens[k]").alias("n_tokens"), (F.col("depth") + F.col("k")).alias("depth"), (F.col("position") + F.col("before")).alias("position"), attends.alias("attends"), "unit")


def read_back(chunks: DataFrame, leaves: DataFrame, conversations: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, from the ids and the loss mask of the emission alone.

    A path is read once, for however many conversations end in it, and of a chunk only the tokens on the path. A chunk that
    very many paths share is one row on its side of the join, so Spark can split the other side.
    """
    wanted = materialize(leaves.select("leaf", F.posexplode("parts").alias("p", "part")).select("leaf", "p", "part.chunk", "part.at", "part.n"), "chat-wanted")
    held = chunks.select("chunk", "ids", "tokens", "loss")
    begins = F.expr("transform(sequence(0, size(tokens) - 1), k -> chunk + aggregate(slice(tokens, 1, k), 0L, (a, x) -> a + x))")
    first = F.when(F.col("at") == F.col("chunk"), F.lit(1)).otherwise(F.array_position(begins, F.col("at")).cast("int"))
    count = F.aggregate(F.slice("tokens", first, F.col("n").cast("int")), F.lit(0).cast("long"), lambda a, x: a + x)
    cut = wanted.join(held, "chunk").withColumn("count", count)
    own = F.expr("transform(filter(loss, x -> x.start >= at and x.stop <= at + count), x -> named_struct('start', x.start - at, 'stop', x.stop - at))")
    read = cut.select("leaf", F.struct("p", F.slice("ids", (F.col("at") - F.col("chunk") + 1).cast("int"), F.col("count").cast("int")).alias("ids"), own.alias("loss")).alias("part"))
    paths = read.groupBy("leaf").agg(F.sort_array(F.collect_list("part")).alias("parts"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(tokenizer)
        for b in pieces(batches, 256):
            rows = []
            parts = b.column(1)
            ids, masks = parts.values.field("ids"), parts.values.field("loss")
            flat, id_at = ids.values.to_numpy(), ids.offsets.to_numpy()
            begin, end, mask_at = masks.values.field("start").to_numpy(), masks.values.field("stop").to_numpy(), masks.offsets.to_numpy()
            marks = parts.offsets.to_numpy()
            for leaf, lo, hi in zip(b.column(0).to_pylist(), marks[:-1], marks[1:], strict=True):
                text = coder.decode(np.concatenate([flat[id_at[k] : id_at[k + 1]] for k in range(lo, hi)]))
                turns = [parse_turn(u + END) for u in text.split(END)[:-1]]
                masked = [flat[id_at[k] + begin[m] : id_at[k] + end[m]] for k in range(lo, hi) for m in range(mask_at[k], mask_at[k + 1])]
                loss = "".join(unescape(coder.decode(x)) for x in masked)
                rows.append({
                    "leaf": leaf, "n_turns": len(turns), "turns_sha256": hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                    "loss_chars": len(loss), "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(), "formatted_chars": len(text),
                })
            if rows:
                yield pa.RecordBatch.from_pylist(rows)

    columns = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    with arrow_rows(chunks.sparkSession, 256):
        read = materialize(paths.mapInArrow(digest, f"leaf binary, {columns}"), "chat-read")
    forget(wanted)
    return conversations.join(read, "leaf").select("conv_id", *(c.split()[0] for c in columns.split(", ")))


def format_conversations(turns: DataFrame, tokenizer: str | None = None) -> DataFrame:
    return read_back(*build_tree(turns, tokenizer=tokenizer), tokenizer)
