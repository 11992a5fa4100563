"""Similarities of two texts or syllable lists.

What is a table of costs (edit distances, Jaro-Winkler) and the composites that hold one run as Arrow batches: numpy fills the
tables of many pairs at once, those of like lengths together. The rest are native expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import chars

# Fixed values.
INSERT_COST, DELETE_COST, BORDER_COST = 2.0, 1.0, 2.0
LOCATION_WEIGHT, REST_WEIGHT, NO_LOCATION_FACTOR = 0.29, 0.71, 0.85
LENGTH_GAP = 4
#: Cells of a table that are filled at once.
CELLS = 1 << 20


# --- batches of pairs ---------------------------------------------------------------------------------------


def _padded(rows: list[Sequence], code: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Codes of each row's items, padded with -1, and the rows' lengths."""
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    out = np.full((len(rows), int(size.max(initial=0))), -1, np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = np.fromiter((code(x) for r in rows for x in r), np.int64, int(size.sum()))
    return out, size


def _by_length(a: list[Sequence], b: list[Sequence], work: Callable[[list, list], np.ndarray]) -> np.ndarray:
    """``work`` on pairs of like lengths together, so that padding stays small."""
    wide = np.array([max(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64)
    out, order, k = np.zeros(len(a)), np.argsort(wide, kind="stable"), 0
    while k < len(order):
        most = max(1, CELLS // (int(wide[order[min(k + 4095, len(order) - 1)]]) + 1) ** 2)
        some = order[k : k + min(4096, max(64, most))]
        out[some] = work([a[i] for i in some], [b[i] for i in some])
        k += len(some)
    return out


def _distances(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, border: float, insert: float, delete: float, cost: Callable[[int, int], np.ndarray]) -> np.ndarray:
    """Edit distances of padded rows. Where both items are equal the cell takes over its diagonal neighbour, whatever the others are."""
    last = np.arange(b.shape[1] + 1) * border + np.zeros((len(a), 1))
    out = np.where(na == 0, nb * border, 0.0)
    for i in range(a.shape[1]):
        row = np.empty_like(last)
        row[:, 0] = (i + 1) * border
        for j in range(b.shape[1]):
            other = np.minimum(np.minimum(last[:, j + 1] + delete, row[:, j] + insert), last[:, j] + cost(i, j))
            row[:, j + 1] = np.where(a[:, i] == b[:, j], last[:, j], other)
        done = na == i + 1
        out[done] = row[done, nb[done]]
        last = row
    return out


def _share(distance: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    most = np.maximum(na, nb)
    return np.where(most == 0, 1.0, 1.0 - distance / np.maximum(most, 1))


def directional_edits(s: list[str], t: list[str]) -> np.ndarray:
    def work(s: list[str], t: list[str]) -> np.ndarray:
        (a, na), (b, nb) = _padded(s, ord), _padded(t, ord)
        return _share(_distances(a, na, b, nb, BORDER_COST, INSERT_COST, DELETE_COST, lambda i, j: 1.0), na, nb)

    return _by_length(s, t, work)


def phonetic_edits(s: list[Sequence[str]], t: list[Sequence[str]]) -> np.ndarray:
    known: dict[str, int] = {}
    first: dict[str, int] = {}
    code = lambda x: known.setdefault(x, len(known))
    begins = lambda x: first.setdefault(x[:1], len(first))

    def work(s: list, t: list) -> np.ndarray:
        (a, na), (b, nb) = _padded(s, code), _padded(t, code)
        x, y = _padded(s, begins)[0], _padded(t, begins)[0]
        return _share(_distances(a, na, b, nb, 1.0, 1.0, 1.0, lambda i, j: np.where(x[:, i] == y[:, j], 0.5, 1.0)), na, nb)

    return _by_length(s, t, work)


def phonetics(s: list[Sequence[str]], t: list[Sequence[str]]) -> np.ndarray:
    """``phonetic_edits``; where the lengths differ by 4 or more, the syllables of ``t`` found in ``s`` over the larger length."""
    far = np.array([abs(len(x) - len(y)) >= LENGTH_GAP for x, y in zip(s, t, strict=True)], bool)
    out = np.zeros(len(s))
    for k in np.flatnonzero(far).tolist():
        own = set(s[k])
        out[k] = sum(x in own for x in t[k]) / max(len(s[k]), len(t[k]))
    near = np.flatnonzero(~far).tolist()
    out[near] = phonetic_edits([s[k] for k in near], [t[k] for k in near])
    return out


def overlaps(s: list[str], t: list[str]) -> np.ndarray:
    return np.array([len(set(x) & set(y)) / (max(len(set(x)), len(set(y))) or 1) for x, y in zip(s, t, strict=True)], float)


def jaro_winklers(s: list[str], t: list[str]) -> np.ndarray:
    """Each character of ``s`` in turn takes the first free equal one of ``t`` within reach, for all pairs at once."""

    def work(s: list[str], t: list[str]) -> np.ndarray:
        (a, na), (b, nb) = _padded(s, ord), _padded(t, ord)
        rows, places = np.arange(len(s)), np.arange(b.shape[1])
        reach = np.maximum(0, np.maximum(na, nb) // 2 - 1)
        free, mine = np.ones(b.shape, bool), np.zeros(a.shape, bool)
        for i in range(a.shape[1] if b.shape[1] else 0):
            fits = free & (b == a[:, i : i + 1]) & (np.abs(places - i) <= reach[:, None]) & (i < na)[:, None] & (places < nb[:, None])
            hit, at = fits.any(1), fits.argmax(1)
            free[rows[hit], at[hit]] = False
            mine[:, i] = hit
        m = mine.sum(1)
        # the matched characters of both, in order
        left, right = (np.take_along_axis(x, np.argsort(~taken, axis=1, kind="stable"), 1) for x, taken in ((a, mine), (b, ~free)))
        width = min(a.shape[1], b.shape[1])
        swaps = ((left[:, :width] != right[:, :width]) & (np.arange(width) < m[:, None])).sum(1) // 2
        some = np.maximum(m, 1)
        jaro = np.where(m > 0, (m / np.maximum(na, 1) + m / np.maximum(nb, 1) + (m - swaps) / some) / 3, 0.0)
        width = min(4, width)
        same = (a[:, :width] == b[:, :width]) & (np.arange(width) < np.minimum(na, nb)[:, None])
        prefix = np.cumprod(same, axis=1).sum(1) if width else 0
        jaro = np.where(jaro > 0.7, jaro + prefix * 0.1 * (1 - jaro), jaro)
        return np.where([x == y for x, y in zip(s, t, strict=True)], 1.0, jaro)

    return _by_length(s, t, work)


def _present(*columns: pd.Series) -> np.ndarray:
    """The rows without a null."""
    return np.flatnonzero(np.logical_and.reduce([c.notna().to_numpy() for c in columns]))


def _scored(work: Callable[..., np.ndarray], *columns: pd.Series) -> pd.Series:
    out, some = np.full(len(columns[0]), np.nan), _present(*columns)
    out[some] = work(*(list(c.iloc[some]) for c in columns))
    return pd.Series(out).where(~np.isnan(out), None).astype("Float64")


# --- columns ------------------------------------------------------------------------------------------------


@F.pandas_udf(T.DoubleType())
def directional_edit(s: pd.Series, t: pd.Series) -> pd.Series:
    """1 - d / max length, where inserts and borders cost 2, deletes and substitutions 1. Can be negative; two empty texts give 1."""
    return _scored(directional_edits, s, t)


@F.pandas_udf(T.DoubleType())
def phonetic_edit(a: pd.Series, b: pd.Series) -> pd.Series:
    """1 - unit edit distance / max length of syllable lists; syllables that begin alike substitute at half."""
    return _scored(phonetic_edits, a, b)


@F.pandas_udf(T.DoubleType())
def phonetic(mention: pd.Series, entity: pd.Series) -> pd.Series:
    """``phonetic_edit``; where the lengths differ by 4 or more, the entity's syllables found in the mention over the larger length."""
    return _scored(phonetics, mention, entity)


@F.pandas_udf(T.DoubleType())
def jaro_winkler(s: pd.Series, t: pd.Series) -> pd.Series:
    """Prefix of at most 4 at weight 0.1, which counts above a Jaro similarity of 0.7."""
    return _scored(jaro_winklers, s, t)


def char_overlap(s: Column, t: Column) -> Column:
    """Common characters over the larger of the two character sets; 0 where both are empty."""
    a, b = chars(s), chars(t)
    return F.when(F.greatest(F.size(a), F.size(b)) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b)))


def location_blend(share: Column, rest: Column, entity_has: Column) -> Column:
    return F.when(entity_has, LOCATION_WEIGHT * share + REST_WEIGHT * rest).otherwise(NO_LOCATION_FACTOR * rest)


_SCORE = T.StructType([T.StructField("sim", T.DoubleType()), T.StructField("contains", T.BooleanType())])


def _both(sims: np.ndarray, contains: list[bool], some: np.ndarray, n: int) -> pd.DataFrame:
    out = pd.DataFrame({"sim": np.full(n, np.nan), "contains": np.full(n, None)})
    out.loc[some, "sim"], out.loc[some, "contains"] = sims, contains
    return out


@F.pandas_udf(_SCORE)
def _mention_entity(mention: pd.Series, entity: pd.Series, mention_syl: pd.Series, entity_syl: pd.Series) -> pd.DataFrame:
    some = _present(mention, entity, mention_syl, entity_syl)
    m, e, x, y = (list(c.iloc[some]) for c in (mention, entity, mention_syl, entity_syl))
    sims = np.maximum(np.maximum(phonetics(x, y), overlaps(m, e)), (directional_edits(m, e) + jaro_winklers(m, e)) / 2)
    contains = [b in a or set(b) <= set(a) or set(q) <= set(p) for a, b, p, q in zip(m, e, x, y, strict=True)]
    return _both(sims, contains, some, len(mention))


def mention_entity(mention: Column, entity: Column, mention_syl: Column, entity_syl: Column, tfidf: Column | None = None) -> Column:
    """Struct ``sim, contains`` of a mention and an entity: the best of the phonetic, the weighted or character, and the mean of both edit similarities."""
    found = _mention_entity(mention, entity, mention_syl, entity_syl)
    if tfidf is None:
        return found
    return F.struct(F.greatest(found["sim"], F.coalesce(tfidf, F.lit(0.0))).alias("sim"), found["contains"].alias("contains"))


@F.pandas_udf(_SCORE)
def segments_entity(segs: pd.Series, entity: pd.Series, seg_syl: pd.Series, entity_syl: pd.Series) -> pd.DataFrame:
    """``sim, contains`` of a list of segments and an entity; ``seg_syl`` has the syllables of each segment.

    The best of the whole's character and phonetic similarities and of each segment's edit and phonetic ones, 0 at least.
    An entity is contained if its joined syllables are, or its characters, or as many different syllables as it has in all.
    """
    some = _present(segs, entity, seg_syl, entity_syl)
    s, e, x, y = (list(c.iloc[some]) for c in (segs, entity, seg_syl, entity_syl))
    whole, sounds = ["".join(a) for a in s], [[z for a in p for z in a] for p in x]
    row = np.repeat(np.arange(len(s)), [len(a) for a in s])
    flat, flat_syl = [a for p in s for a in p], [a for p in x for a in p]
    each = np.maximum(directional_edits(flat, [e[k] for k in row]), phonetics(flat_syl, [y[k] for k in row])) if len(row) else np.zeros(0)
    best = np.zeros(len(s))
    np.maximum.at(best, row, each)
    sims = np.maximum(np.maximum(overlaps(whole, e), phonetics(sounds, y)), best)
    contains = ["".join(q) in "".join(p) or set(b) <= set(a) or len(set(p) & set(q)) == len(q) for a, b, p, q in zip(whole, e, sounds, y, strict=True)]
    return _both(sims, contains, some, len(segs))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)
