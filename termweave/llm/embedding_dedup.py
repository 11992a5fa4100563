"""Near-duplicate vectors by int8 tile products with proven error bounds (operator 4).

Equal vectors of a label are one class, so copies are never paired. A unit vector v is stored once as v' = scale * int8 codes with
its own error e = |v - v'|. The classes of a label are dealt into tiles of about ``TILE`` rows by their number; a task gets the codes
of one pair of tiles, an eighth of the bytes of doubles, however large the label is. From v.w - v'.w' = (v - v').w + v'.(w - w') follows
|v.w - v'.w'| <= e_v + |v'| e_w, so the int8 product (exact in float32 blocks, which BLAS multiplies) tells with certainty
that a pair links or that it doesn't. Vectors that are in a pair it leaves open go to a second pass over that pair of tiles in full, which
recomputes those pairs in double precision. A task returns a row per vector of its two tiles: its links there, and the smallest class it
reaches there; link pairs are never emitted.

The work is the square of a label's classes over all tasks, which the method implies; memory and rows of a task
don't depend on it.

Defined cases: a null label or vector, an empty or zero vector, and one with a null or non-finite component link with
nothing; vectors of different lengths link with nothing; equal vectors link (cosine 1); rows with a null id count as
links of others but have null as component; extra columns are left out; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import forget, materialize, pieces
from .components import connected_components

TILE = 4096
STRIP = 512
#: Components whose product sums stay exact in float32: 127 * 127 * 1024 < 2**24.
EXACT = 1024
#: Above all rounding of the double arithmetic here.
ROUNDING = 1e-9


def usable(vector: Column) -> Column:
    """Whether a vector can link at all."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of unit rows: int8 codes, scales, lengths of the restored rows, and the errors."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    back = codes * scale[:, None]
    return codes, scale, np.sqrt((back * back).sum(1)), np.sqrt(((x - back) ** 2).sum(1))


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows over their lengths; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def int8_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 rows, as doubles or exact floats."""
    if a.shape[1] <= EXACT:
        return a.astype(np.float32) @ b.astype(np.float32).T
    return sum((a[:, k : k + EXACT].astype(np.float32) @ b[:, k : k + EXACT].astype(np.float32).T).astype(np.float64) for k in range(0, a.shape[1], EXACT))


Quantised = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def compared(x: Quantised, y: Quantised, same: bool, threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each strip of x: its first row, which pairs surely link, and which the bounds leave open. ``same``: only pairs i < j of one tile."""
    (a, sa, na, ea), (b, sb, nb, eb) = x, y
    for r in range(0, len(a), STRIP):
        s = slice(r, r + STRIP)
        product = int8_products(a[s], b) * (sa[s, None] * sb)
        error = ea[s, None] + na[s, None] * eb
        sure = product - error >= threshold + ROUNDING
        open_ = (product + error >= threshold - ROUNDING) & ~sure
        if same:
            later = np.arange(len(a))[s, None] < np.arange(len(b))
            sure &= later
            open_ &= later
        yield r, sure, open_


def recomputed(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether unit rows x[i] and y[j] reach the threshold in double precision."""
    out = np.zeros(len(i), bool)
    for k in range(0, len(i), 1 << 16):
        s = slice(k, k + (1 << 16))
        out[s] = np.einsum("ij,ij->i", x[i[s]], y[j[s]]) >= threshold
    return out


def tile_links(x: np.ndarray, y: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows i of x and j of y (of x, i < j, where y is None) with cosine of at least ``threshold``, and how many pairs were recomputed."""
    x = unit_rows(x)
    y2 = x if y is None else unit_rows(y)
    out, tried = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
    for r, sure, open_ in compared(quantise(x), quantise(y2), y is None, threshold):
        i, j = np.nonzero(sure)
        out.append((i + r, j))
        i, j = np.nonzero(open_)
        real = recomputed(x, y2, i + r, j, threshold)
        out.append((i[real] + r, j[real]))
        tried += len(i)
    return np.concatenate([p for p, _ in out]), np.concatenate([q for _, q in out]), tried


def smallest_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n vertices the smallest that links a-b reach."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            return low
        low = new


_PART = ["label", "dim", "lo", "hi"]
_FOUND = "cls long, links long, root long, open array<long>"


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """The rows of the left and of the right tile, and whether they are one tile."""
    same = table.column("lo")[0].as_py() == table.column("hi")[0].as_py()
    if same:
        return np.arange(table.num_rows), np.arange(table.num_rows), True
    return np.flatnonzero(table.column("left").to_numpy()), np.flatnonzero(table.column("right").to_numpy()), False


class _Links:
    """Links between rows of a task, summed up as they come."""

    def __init__(self, cls: np.ndarray, times: np.ndarray) -> None:
        self.cls, self.times = cls, times
        self.links = np.zeros(len(cls), np.int64)
        order = np.argsort(cls, kind="stable")  # so that the smallest position is the smallest class
        self.order, self.place = order, np.empty_like(order)
        self.place[order] = np.arange(len(order))
        self.low = np.arange(len(order))

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        if len(i):
            n = len(self.cls)
            self.links += np.bincount(i, weights=self.times[j], minlength=n).astype(np.int64) + np.bincount(j, weights=self.times[i], minlength=n).astype(np.int64)
            # what is reached so far stays linked with its root
            own = np.arange(n)
            self.low = smallest_reached(n, np.concatenate([self.place[i], own]), np.concatenate([self.place[j], self.low]))

    def rows(self, open_: np.ndarray | None = None) -> pa.Table:
        """The rows with links, and one for the classes in open pairs."""
        some = self.links > 0
        root = self.cls[self.order][self.low[self.place]]
        table = pa.table({"cls": self.cls[some], "links": self.links[some], "root": root[some], "open": pa.nulls(int(some.sum()), pa.list_(pa.int64()))})
        if open_ is None or not len(open_):
            return table
        return pa.concat_tables([table, pa.table({"cls": pa.nulls(1, pa.int64()), "links": pa.nulls(1, pa.int64()), "root": pa.nulls(1, pa.int64()), "open": pa.array([open_], pa.list_(pa.int64()))})])


def _with_part(found: pa.Table, table: pa.Table) -> pa.Table:
    for k, c in enumerate(_PART):
        found = found.add_column(k, c, pa.array([table.column(c)[0].as_py()] * found.num_rows, table.schema.field(c).type))
    return found


def _by_codes(table: pa.Table, threshold: float) -> pa.Table:
    """The sure links of a pair of tiles, and the classes in pairs left open."""
    dim = table.column("dim")[0].as_py()
    codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.int8).reshape(-1, dim)
    scale, length, error = (table.column(c).to_numpy() for c in ("scale", "length", "error"))
    left, right, same = _sides(table)
    links, open_ = _Links(table.column("cls").to_numpy(), table.column("times").to_numpy()), np.zeros(table.num_rows, bool)
    take = lambda k: (codes[k], scale[k], length[k], error[k])
    if len(left) and len(right):
        for r, sure, unsure in compared(take(left), take(right), same, threshold):
            i, j = np.nonzero(sure)
            links.add(left[i + r], right[j])
            open_[left[r : r + len(unsure)][unsure.any(1)]] = True
            open_[right[unsure.any(0)]] = True
    return _with_part(links.rows(links.cls[open_]), table)


def _in_full(table: pa.Table, threshold: float) -> pa.Table:
    """The links among the pairs that the bounds leave open, from whole vectors."""
    raw = table.column("vector").combine_chunks()
    x = unit_rows(raw.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(raw), -1))
    left, right, same = _sides(table)
    links, parts = _Links(table.column("cls").to_numpy(), table.column("times").to_numpy()), quantise(x)
    take = lambda k: tuple(p[k] for p in parts)
    if len(left) and len(right):
        for r, _, unsure in compared(take(left), take(right), same, threshold):
            i, j = np.nonzero(unsure)
            real = recomputed(x, x, left[i + r], right[j], threshold)
            links.add(left[i[real] + r], right[j[real]])
    return _with_part(links.rows(), table)


def _quantised(classes: DataFrame) -> DataFrame:
    """``label, dim, cls, times, codes, scale, length, error``: each class's vector in a byte a component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 4096):
            order = np.argsort(b.column("dim").to_numpy(), kind="stable")
            for dim in np.unique(b.column("dim").to_numpy()).tolist():
                some = b.take(pa.array(order[b.column("dim").to_numpy()[order] == dim]))
                x = some.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                codes, *rest = quantise(unit_rows(x))
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("label", "dim", "cls", "times")), pa.array([c.tobytes() for c in codes], pa.binary()), *map(pa.array, rest)], names)

    names = ["label", "dim", "cls", "times", "codes", "scale", "length", "error"]
    label = classes.schema["label"].dataType.simpleString()
    return classes.mapInArrow(run, f"label {label}, dim int, cls long, times long, codes binary, scale double, length double, error double")


def link_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93, tile: int = TILE) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    rows = rows.withColumn("usable", usable(F.col("vector")) & F.col("label").isNotNull())
    same = ["label", "vector"]
    grouped = rows.where("usable").groupBy(*same).agg(F.min("vec_id").alias("first"), F.count("*").alias("times"))
    classes = materialize(grouped.withColumn("cls", F.monotonically_increasing_id()).withColumn("dim", F.size("vector")), "vector-classes")
    counts = materialize(classes.groupBy("label", "dim").agg(F.count("*").alias("n")), "vector-counts")
    dealt = (
        _quantised(classes).join(counts, ["label", "dim"])
        .withColumn("tiles", F.ceil(F.col("n") / tile)).withColumn("at", F.pmod(F.xxhash64("cls"), "tiles"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
        .select("label", "dim", F.least("at", "other").alias("lo"), F.greatest("at", "other").alias("hi"), (F.col("at") <= F.col("other")).alias("left"), (F.col("at") >= F.col("other")).alias("right"), "cls", "times", "codes", "scale", "length", "error")
    )
    part = f"label {classes.schema['label'].dataType.simpleString()}, dim int, lo long, hi long"
    first = materialize(dealt.groupBy(*_PART).applyInArrow(lambda t: _by_codes(t, threshold), f"{part}, {_FOUND}"), "vector-links")
    wanted = first.where("open is not null").select(*_PART, F.explode("open").alias("cls"))
    full = wanted.join(classes.select("cls", "times", "vector"), "cls").join(counts, ["label", "dim"])
    at = F.pmod(F.xxhash64("cls"), F.ceil(F.col("n") / tile))
    full = full.withColumn("left", at == F.col("lo")).withColumn("right", at == F.col("hi")).drop("n")
    second = materialize(full.groupBy(*_PART).applyInArrow(lambda t: _in_full(t, threshold), f"{part}, {_FOUND}"), "vector-links")
    found = first.where("cls is not null").select("cls", "links", "root").unionAll(second.select("cls", "links", "root"))
    degrees = found.groupBy("cls").agg(F.sum("links").alias("links"))
    reached = materialize(connected_components(found.select(F.col("cls").alias("src"), F.col("root").alias("dst"))), "vector-components")
    smallest = materialize(classes.join(reached, classes.cls == reached.id).groupBy("component").agg(F.min("first").alias("component_id")), "vector-smallest")
    roots = reached.join(smallest, "component").select(F.col("id").alias("cls"), "component_id")
    known = classes.join(degrees, "cls", "left").join(roots, "cls", "left").select(*same, (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component_id", "first").alias("component_id"))
    known = materialize(known, "vector-answers")
    for done in (classes, counts, first, second, reached, smallest):
        forget(done)
    linked = rows.where("usable").join(known, same).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
