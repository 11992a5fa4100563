"""Repeated passages found by paragraph MinHash banding (operator 1).

Two kinds of paragraph are compared, both as sets of five-word shingles (words end at ASCII white space):

* Lines of ``MIN_WORDS`` words or more. ``tune_bands`` picks the fewest bands that find a pair at the threshold with the
  wanted recall. Lines that collide in a band are joined, their exact Jaccard similarity is verified on whole
  shingle sets, and links make components.
* Blocks of ``WINDOW`` words that begin at content-defined anchors (a word pair whose hash is the least among its
  neighbours), for passages that begin and end inside lines. A passage has the same anchors wherever it stands. Equal
  blocks meet in every band; blocks of which one holds an edited word have a similarity of about 0.52 and meet in one of
  ``BLOCK_BANDS`` bands of ``BLOCK_ROWS`` rows with a chance of 0.61, and a passage has several. From the shingle on which two
  blocks collide, both texts are aligned to the left and the right, word by word and then across edits. The aligned span is the
  paragraph that is verified: it goes if it is a run of ``MIN_RUN`` equal words, or if its shingles reach the threshold exactly.

Of each component of lines the first place by (doc_id, place) stays. A span goes where it is aligned with an earlier
document, so of spans that are copies of each other the first stays. What repeats only its own document is cut with
``within=True`` alone.

One pass over the texts gives all band keys; one shuffle deals them out by key, sorted, and a stream over each partition
emits what collides. Unequal members of a bucket are verified against the most frequent one; after components, only buckets
that still hold several components go on, and there only pairs across components do. Before whole sets are fetched,
a pair has to pass a bound that no link fails: a 256-bit parity sketch shows at least how many shingles two sets have
apart. Texts never travel but those of documents in which a set or slice is wanted, told by a bit map of bounded size.

A hot line or passage is summed up before the shuffle: of those in a batch of documents only the first is sent on, and the others
are settled there, as they repeat it. A key that is hot all the same streams through its task in pieces of ``PIECE`` rows.

Defined cases: null and empty texts have no paragraph; rows that repeat a doc_id are that document again and no
repeats of each other; rows without doc_id are neither compared nor changed; paragraph ids are 64-bit hashes, of
which 10^9 distinct ones collide with a chance of 3 %; extra columns pass through; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import forget, materialize, maybe_in, pieces
from .components import connected_components

SHINGLE = 5
THRESHOLD = 0.8
MIN_WORDS = 20
WINDOW = 20
BLOCK_BANDS, BLOCK_ROWS = 3, 2
RADIUS = 5
MIN_RUN = 20
MARGIN = 32
#: Seeds of two documents so many words apart, in both, are one alignment's.
JOIN = 128
#: Words on both sides of a seed that its block can reach.
DEEP = WINDOW - SHINGLE
LAST = 2**62
PIECE = 1 << 20

_RNG = np.random.default_rng(20)
_ODD = _RNG.integers(0, 2**63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, 512, dtype=np.uint64)


def tune_bands(threshold: float = THRESHOLD, recall: float = 0.999, low: float = 0.3, false_rate: float = 0.25) -> tuple[int, int]:
    """(bands, rows a band): the fewest bands that find similarity ``threshold`` with ``recall`` while similarity ``low`` collides with at most ``false_rate``."""
    best = None
    for rows in range(1, 17):
        bands = max(1, int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows))))
        if 1 - (1 - low**rows) ** bands <= false_rate and (best is None or bands < best[0]):
            best = bands, rows
    if best is None:
        raise ValueError("no banding meets both rates")
    return best


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64)


def gram_hashes(h: np.ndarray, width: int, first: int = 0) -> np.ndarray:
    """One hash for each run of ``width`` words."""
    n = len(h) - width + 1
    out = h[:n] * _ODD[first]
    for k in range(1, width):
        out += h[k : k + n] * _ODD[first + k]
    return mix(out)


def anchors(h: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Places whose word pair hashes to no more than its neighbours do. Ties count, so periodic texts have anchors too."""
    if len(h) < 2:
        return np.zeros(0, np.int64)
    g = gram_hashes(h, 2, 100)
    top = np.full(radius, np.iinfo(np.uint64).max, np.uint64)
    around = np.lib.stride_tricks.sliding_window_view(np.concatenate([top, g, top]), 2 * radius + 1)
    return np.flatnonzero(g <= around.min(1))


class Lines:
    """The words of a text with their hashes, and the word ranges of its lines."""

    def __init__(self, text: str) -> None:
        split = [x.encode().split() for x in text.split("\n")]
        self.words = [w for x in split for w in x]
        self.hashes = word_hashes(self.words)
        self.grams = gram_hashes(self.hashes, SHINGLE) if len(self.words) >= SHINGLE else self.hashes[:0]
        self.ends = np.cumsum([len(x) for x in split])

    def paragraphs(self, min_words: int) -> Iterator[tuple[int, int]]:
        """(first word, words) of lines that are long enough."""
        for a, b in zip([0, *self.ends[:-1].tolist()], self.ends.tolist(), strict=True):
            if b - a >= max(SHINGLE, min_words):
                yield a, b - a

    def shingles(self, first: int, n: int) -> np.ndarray:
        """The hashed shingles of a line, in order."""
        return self.grams[first : first + n - SHINGLE + 1]


def paragraph_ids(grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One 64-bit id for each run of shingles, in order; the runs begin at ``starts`` and follow one another."""
    sizes = np.diff(np.append(starts, len(grams)))
    place = (np.arange(len(grams)) - np.repeat(starts, sizes)).astype(np.uint64)
    return mix(np.add.reduceat(mix(grams + place * _ODD[200]), starts) + sizes.astype(np.uint64) * _ODD[201])


def paragraph_id(shingles_in_order: np.ndarray) -> int:
    return int(paragraph_ids(shingles_in_order, np.zeros(1, np.int64)).view(np.int64)[0])


SKETCH = 4


def parity_sketch(sets: list[np.ndarray]) -> np.ndarray:
    """``SKETCH`` words of bits for each set of different hashes: a bit is the parity of the hashes that fall on it.

    The sketches of A and B differ in at most as many bits as A and B have hashes apart.
    """
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    flat = np.concatenate(sets)
    bit, word = np.uint64(1) << (flat & np.uint64(63)), flat >> np.uint64(6) & np.uint64(SKETCH - 1)
    return np.stack([np.bitwise_xor.reduceat(np.where(word == np.uint64(k), bit, np.uint64(0)), starts) for k in range(SKETCH)], axis=1)


def band_keys(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """One key for each set and band."""
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    flat = np.concatenate(sets)
    keys = np.zeros((len(sets), bands), np.uint64)
    for b in range(bands):
        for r in range(rows):
            k = b * rows + r
            low = np.minimum.reduceat((flat ^ _ADD[k]) * _ODD[k], starts)
            keys[:, b] = mix(keys[:, b] * np.uint64(31) + low + np.uint64(b + 1))
    return keys


#: What a row is about, in the low bits of its key. Blocks have 0, 1 and 2, for their bands.
BAND, CLASS, WORDS, CUT, HIT = range(3, 8)
KIND = 7
_NAMES = ["key", "a", "b", "info"]


def _sent(kind: int, key: np.ndarray, a: np.ndarray, b: np.ndarray | None = None, info: list[bytes] | None = None) -> pa.RecordBatch:
    columns = [key & ~np.int64(KIND) | np.int64(kind), a, np.zeros(len(key), np.int64) if b is None else b]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(info, pa.binary()) if info else pa.nulls(len(key), pa.binary())], _NAMES)


def _own(doc: np.ndarray) -> np.ndarray:
    """A key for rows that only have to get to some task."""
    return mix(doc.astype(np.uint64)).view(np.int64)


class Texts:
    """The words of several texts, hashed at once. Between two texts there are ``RADIUS`` places that belong to none."""

    def __init__(self, texts: list[str | None]) -> None:
        split = [[x.split() for x in (t or "").encode().split(b"\n")] for t in texts]
        self.counts = np.array([sum(map(len, x)) for x in split], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts + RADIUS)])[: len(split)]
        size = int((self.counts + RADIUS).sum())
        inside = np.zeros(size + 1, np.int64)
        np.add.at(inside, self.starts, 1)
        np.add.at(inside, self.starts + self.counts, -1)
        self.inside = np.cumsum(inside)[:size].astype(bool)
        self.hashes = np.zeros(size, np.uint64)
        self.hashes[self.inside] = word_hashes([w for x in split for line in x for w in line])
        self.owner = np.repeat(np.arange(len(split)), self.counts + RADIUS)
        self.grams = np.concatenate([gram_hashes(self.hashes, SHINGLE), np.zeros(SHINGLE - 1, np.uint64)]) if size >= SHINGLE else np.zeros(size, np.uint64)
        self.lines = [[len(line) for line in x] for x in split]

    def paragraphs(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(first place, words) of the lines that are long enough, over all texts."""
        n = np.array([k for x in self.lines for k in x], np.int64)
        owner = np.repeat(np.arange(len(self.lines)), [len(x) for x in self.lines])
        first = np.cumsum(n) - n + owner * RADIUS
        some = n >= max(SHINGLE, least)
        return first[some], n[some]

    def blocks(self) -> np.ndarray:
        """The places at which blocks begin, over all texts: ``anchors`` that leave room for one."""
        if not len(self.hashes):
            return np.zeros(0, np.int64)
        g = np.full(len(self.hashes), np.iinfo(np.uint64).max, np.uint64)
        pair = self.inside[:-1] & self.inside[1:]
        g[:-1][pair] = gram_hashes(self.hashes, 2, 100)[pair]
        top = np.full(RADIUS, np.iinfo(np.uint64).max, np.uint64)
        around = np.lib.stride_tricks.sliding_window_view(np.concatenate([top, g, top]), 2 * RADIUS + 1)
        left = np.repeat(self.starts + self.counts, self.counts + RADIUS) - np.arange(len(g))
        return np.flatnonzero((g <= around.min(1)) & self.inside & (left >= WINDOW) & (np.repeat(self.counts, self.counts + RADIUS) >= 2))


def _scan(docs: DataFrame, min_words: int, bands: int, rows: int, within: bool) -> DataFrame:
    """(key, a, b, info): what one pass over the texts sends on, dealt out by ``key`` afterwards, whose low bits tell the kind.

    CLASS: under a line's id its document a and first place b there; info: id, words, size, sketch, further places
    there. BAND: a line's id a under a band key. Blocks: document a, and in b the place of the shingle that collides and a tag of the
    whole block. WORDS: document a of b words. CUT: document a, place b; info: words that go. HIT: document a, place b; info: an
    earlier document and its place. Of equal lines or blocks in a batch only those of the first document are sent as CLASS or blocks.
    """

    def cut_rows(found: list[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
        if found:
            i, at, n = (np.array(x, np.int64) for x in zip(*found, strict=True))
            yield _sent(CUT, _own(i), i, at, [x.tobytes() for x in n.astype("<i8")])

    def line_rows(ids: np.ndarray, texts: Texts) -> Iterator[pa.RecordBatch]:
        first, n = texts.paragraphs(min_words)
        if not len(first):
            return
        sizes = n - SHINGLE + 1
        begin = np.cumsum(sizes) - sizes
        flat = texts.grams[np.repeat(first - begin, sizes) + np.arange(int(sizes.sum()))]
        h, owner = paragraph_ids(flat, begin).view(np.int64), texts.owner[first]
        place, doc = first - texts.starts[owner], ids[owner]
        order = np.lexsort((place, doc, h))
        starts, group = _groups(h[order])
        head = order[starts]  # of each line its first place in its first document
        sets = []
        for a, k in zip(begin[head].tolist(), sizes[head].tolist(), strict=True):
            grams = flat[a : a + k]
            sets.append(grams if len(set(grams.tolist())) == k else np.unique(grams))
        sketch, keys = parity_sketch(sets), band_keys(sets, bands, rows).view(np.int64)
        for k in range(bands):
            yield _sent(BAND, keys[:, k], h[head])
        same = doc[order] == doc[head][group]
        more = same.copy()
        more[starts] = False
        places: dict[int, list[int]] = {}
        for g, p in zip(group[more].tolist(), place[order][more].tolist(), strict=True):
            places.setdefault(g, []).append(p)
        fixed = np.column_stack([h[head].view(np.uint64), (n[head] | np.array(list(map(len, sets)), np.int64) << 32).view(np.uint64), sketch]).astype("<u8")
        info = [x.tobytes() + (np.array(places[g], "<i4").tobytes() if g in places else b"") for g, x in enumerate(fixed)]
        yield _sent(CLASS, h[head], doc[head], place[head], info)
        gone = ~same | (more if within else np.zeros(len(order), bool))
        yield from cut_rows(list(zip(doc[order][gone].tolist(), place[order][gone].tolist(), n[order][gone].tolist(), strict=True)))

    def block_rows(ids: np.ndarray, texts: Texts) -> Iterator[pa.RecordBatch]:
        begin, g = texts.blocks(), texts.grams
        if not len(begin):
            return
        owner = texts.owner[begin]
        doc, place = ids[owner], begin - texts.starts[owner]
        # four shingles side by side are the whole block
        h = mix(sum(g[begin + k * SHINGLE] * _ODD[300 + k] for k in range(WINDOW // SHINGLE)))
        tag = (h & np.uint64(0xFFFF)).astype(np.int64)
        around = begin[:, None] + np.arange(WINDOW - SHINGLE + 1)
        for band in range(BLOCK_BANDS):
            low, key = [], np.full(len(begin), band + 1, np.uint64)
            for r in range(BLOCK_ROWS):
                k = 400 + band * BLOCK_ROWS + r
                v = (g ^ _ADD[k]) * _ODD[k]
                low.append(v[around].argmin(1))
                key = mix(key * np.uint64(31) + v[begin + low[-1]])
            yield from _block_band(band, key.view(np.int64), doc, place + low[0], tag)
        if within:
            cuts, order = [], np.lexsort((place, h, doc))
            starts, _ = _groups(doc[order], h[order])
            again = np.ones(len(order), bool)
            again[starts] = False
            by: dict[int, list[int]] = {}
            for i, p in zip(doc[order][again].tolist(), place[order][again].tolist(), strict=True):
                by.setdefault(i, []).append(p)
            for i, found in by.items():
                cuts += [(i, a, b - a) for a, b in _union(sorted((p, p + WINDOW) for p in found)) if b - a >= MIN_RUN]
            yield from cut_rows(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            b = b.take(pc.sort_indices(b.column(0)))
            ids, texts = b.column(0).to_numpy(), Texts(b.column(1).to_pylist())
            yield _sent(WORDS, _own(ids), ids, texts.counts)
            yield from line_rows(ids, texts)
            yield from block_rows(ids, texts)

    return docs.mapInArrow(run, "key long, a long, b long, info binary")


def _block_band(band: int, key: np.ndarray, doc: np.ndarray, place: np.ndarray, tag: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A batch's blocks under one band key each: those of the first document that has an equal block, and the others as hits on it.

    Equal blocks meet in every band, so only the first band reports them.
    """
    order = np.argsort(mix(key.view(np.uint64) + tag.view(np.uint64)), kind="stable")  # rows come by document and place
    key, doc, place, tag = key[order], doc[order], place[order], tag[order]
    starts, group = _groups(key, tag)
    begin = starts[group]
    twice = np.zeros(len(key), bool)
    twice[1:] = (group[1:] == group[:-1]) & (doc[1:] == doc[:-1]) & (place[1:] == place[:-1])
    late = doc > doc[begin]
    own = ~late & ~twice
    yield _sent(band, key[own], doc[own], place[own] << 16 | tag[own])
    late &= ~twice
    if band == 0 and late.any():
        source = np.column_stack([doc[begin][late], place[begin][late]]).astype("<i8")
        yield _sent(HIT, _own(doc[late]), doc[late], place[late], [x.tobytes() for x in source])


_MET = "kind int, k long, a long, b long, c long, n long, size int, sketch array<long>, places array<int>"


def _met(kind: int, k=None, a=None, b=None, c=None, n=None, size=None, sketch=None, places=None) -> pa.RecordBatch:
    rows = len(a)
    kinds = [pa.int64()] * 5 + [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32())]
    columns = [pa.nulls(rows, t) if x is None else pa.array(x, t) for x, t in zip((k, a, b, c, n, size, sketch, places), kinds, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(rows, kind, np.int32)), *columns], ["kind", "k", "a", "b", "c", "n", "size", "sketch", "places"])


def _groups(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted rows: where each group of equal columns begins, and the group's number for each row."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


FIXED = 8 * (2 + SKETCH)


def _classes_met(key, a, b, info) -> Iterator[pa.RecordBatch]:
    """The first place of each line, and what repeats it in later documents."""
    blobs = [info[i] for i in range(len(info))]
    fixed = np.frombuffer(b"".join(x[:FIXED] for x in blobs), "<i8").reshape(-1, 2 + SKETCH)
    order = np.lexsort((b, a, fixed[:, 0]))
    ids, a, b, n, size = fixed[order, 0], a[order], b[order], fixed[order, 1] & 0xFFFFFFFF, (fixed[order, 1] >> 32).astype(np.int32)
    begin, group = _groups(ids)
    places = lambda i: np.frombuffer(blobs[order[i]], "<i4", offset=FIXED)
    flat = np.ascontiguousarray(fixed[order[begin], 2:]).reshape(-1)
    sketch = pa.ListArray.from_arrays(pa.array(np.arange(len(begin) + 1) * SKETCH, pa.int32()), pa.array(flat))
    yield _met(CLASS, ids[begin], a[begin], b[begin], None, n[begin], size[begin], sketch, [places(i) for i in begin.tolist()])
    late = np.flatnonzero(a > a[begin][group])
    if len(late):
        more = [places(i) for i in late.tolist()]
        times = np.array([1 + len(x) for x in more])
        all_ = np.concatenate([np.concatenate([[p], x]) for p, x in zip(b[late], more, strict=True)])
        yield _met(CUT, None, np.repeat(a[late], times), all_.astype(np.int64), None, np.repeat(n[late], times))


def _bands_met(key, a) -> Iterator[pa.RecordBatch]:
    """(k: band key, a: the line found most often, b: another line) of the buckets that hold several lines."""
    if not len(key):
        return
    run, _ = _groups(key, a)
    times = np.diff(np.append(run, len(key)))
    key, a = key[run], a[run]
    begin, group = _groups(key)
    if len(begin) == len(key):
        return
    best = np.lexsort((a, -times, key))[begin]  # the first of each group in that order
    centre = a[best][group]
    other = a != centre
    if other.any():
        yield _met(BAND, key[other], centre[other], a[other])


def _blocks_met(key, a, b) -> Iterator[pa.RecordBatch]:
    """Hits (a: document, b: place, k: an earlier document, c: its place) of blocks that collide.

    Equal blocks against the first of them; of unequal ones the first of each kind against the first of all and of the most frequent kind.
    """
    if not len(key):
        return
    place, tag = b >> 16, b & 0xFFFF
    order = np.lexsort((place, a, tag, key))
    key, doc, place, tag = key[order], a[order], place[order], tag[order]
    begin, kind = _groups(key, tag)
    late = np.flatnonzero((doc > doc[begin][kind]) & (key & KIND == 0))
    hits = [(late, begin[kind[late]])]
    start, of = _groups(key[begin])
    times = np.diff(np.append(begin, len(key)))
    several = np.flatnonzero(np.diff(np.append(start, len(begin)))[of] > 1)
    if len(several):
        g = key[begin]
        for rule in ((place[begin], doc[begin]), (place[begin], doc[begin], -times)):
            centre = np.lexsort((*rule, g))[start][of]
            x, y = begin[several], begin[centre[several]]
            later = doc[x] > doc[y]
            hits += [(x[later], y[later]), (y[~later & (doc[x] < doc[y])], x[~later & (doc[x] < doc[y])])]
    x, y = (np.concatenate(z) for z in zip(*hits, strict=True))
    if len(x):
        yield _met(HIT, doc[y], doc[x], place[x], place[y])


def _collide(sent: DataFrame) -> DataFrame:
    """What meets under the keys of ``_scan``, by kind (``_MET``)."""

    def finish(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key, a, b = (t.column(c).to_numpy() for c in _NAMES[:-1])
        begin, group = _groups(key)
        alone = (np.diff(np.append(begin, len(key))) == 1)[group]
        kind = key & KIND
        at = np.flatnonzero((kind < BAND) & ~alone)  # most keys are of one row
        yield from _blocks_met(key[at], a[at], b[at])
        at = np.flatnonzero((kind == BAND) & ~alone)
        at = at[np.lexsort((a[at], key[at]))]
        yield from _bands_met(key[at], a[at])
        at = np.flatnonzero(kind == WORDS)
        if len(at):
            yield _met(WORDS, None, a[at], None, None, b[at])
        held = lambda at: t.column("info").take(pa.array(at)).to_pylist()
        at = np.flatnonzero(kind == CLASS)
        if len(at):
            yield from _classes_met(key[at], a[at], b[at], held(at))
        at = np.flatnonzero(kind == CUT)
        if len(at):
            yield _met(CUT, None, a[at], b[at], None, np.frombuffer(b"".join(held(at)), "<i8"))
        at = np.flatnonzero(kind == HIT)
        if len(at):
            first = np.frombuffer(b"".join(held(at)), "<i8").reshape(-1, 2)
            yield _met(HIT, first[:, 0], a[at], b[at], first[:, 1])

    def heads(t: pa.Table) -> pa.Table:
        """Of a group that goes on in the next piece, the rows that the rest is compared with."""
        key, a, b = (t.column(c).to_numpy() for c in _NAMES[:-1])
        if key[0] & KIND == BAND:
            _, first, times = np.unique(a, return_index=True, return_counts=True)
            return t.take(pa.array([int(first[times.argmax()])]))
        order = np.lexsort((b, a))
        if key[0] & KIND < BAND:
            return t.take(pa.array(order[np.unique(b[order] & 0xFFFF, return_index=True)[1]]))
        return t.take(pa.array(order[:1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for b in batches:
            held.append(pa.Table.from_batches([b]))
            size += b.num_rows
            if size < PIECE // 8:
                continue
            t = pa.concat_tables(held).combine_chunks()
            begin, _ = _groups(t.column("key").to_numpy())
            last = int(begin[-1])
            if last:
                yield from finish(t.slice(0, last))
            rest = t.slice(last)
            if rest.num_rows >= PIECE:
                yield from finish(rest)
                rest = heads(rest)
            held, size = [rest], rest.num_rows
        if held:
            yield from finish(pa.concat_tables(held).combine_chunks())

    return sent.repartition("key").sortWithinPartitions("key").mapInArrow(run, _MET)


def _ranges(values: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges of ``values`` that begin at ``first``, one after the other, and where each begins there."""
    begin = np.cumsum(sizes) - sizes
    return values[np.repeat(first - begin, sizes) + np.arange(int(sizes.sum()))], begin


def _listed(values: np.ndarray, first: np.ndarray, sizes: np.ndarray, before: list, names: list[str], after: tuple = ()) -> Iterator[pa.RecordBatch]:
    """Batches of about ``PIECE`` listed values: columns ``before``, a list of each range of ``values``, columns ``after``."""
    starts, _ = _groups((np.cumsum(sizes) - sizes) // PIECE)
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(first)], strict=True):
        flat, begin = _ranges(values, first[lo:hi], sizes[lo:hi])
        lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(flat)), pa.int32()), pa.array(flat))
        yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in before), lists, *(c.slice(lo, hi - lo) for c in after)], names)


def _texts(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``docs`` joined with ``places`` on doc_id; texts of documents that aren't named stay where they are, but for a few."""
    return maybe_in(docs, "doc_id", places.select("doc_id")).join(places, "doc_id")


def _sets(docs: DataFrame, wanted: DataFrame, min_words: int) -> DataFrame:
    """(id, set) of the paragraphs in ``wanted(id, doc_id, at)``, and by chance a few others, from whole texts.

    Texts stay where they are: of the documents that may be wanted, all paragraphs pass a second bit map, of ids, and only sets travel.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            texts = Texts(b.column(0).to_pylist())
            first, n = texts.paragraphs(min_words)
            if not len(first):
                continue
            sizes = n - SHINGLE + 1
            flat, begin = _ranges(texts.grams, first, sizes)
            ids, one = np.unique(paragraph_ids(flat, begin).view(np.int64), return_index=True)
            yield from _listed(flat.view(np.int64), begin[one], sizes[one], [pa.array(ids)], ["id", "set"])

    found = maybe_in(docs, "doc_id", wanted.select("doc_id")).select("text").mapInArrow(run, "id long, set array<long>")
    once = maybe_in(found, "id", wanted.select("id")).dropDuplicates(["id"])
    return materialize(once.select("id", F.array_distinct("set").alias("set")), "passage-sets")


def _may_link(threshold: float):
    """Whether sets a and b can be similar enough: sizes, and a lower bound on the hashes they have apart.

    Jaccard >= t means |A xor B| <= (1 - t) / (1 + t) * (|A| + |B|), and sketches differ in no more bits than that.
    """
    apart = sum(F.bit_count(F.col("a_sketch")[k].bitwiseXOR(F.col("b_sketch")[k])) for k in range(SKETCH))
    small, large = F.least("a_size", "b_size"), F.greatest("a_size", "b_size")
    return (small >= threshold * large - 1e-9) & (apart <= (1 - threshold) / (1 + threshold) * (small + large) + 1e-9)


def _side(frame: DataFrame, name: str, *others: str) -> DataFrame:
    return frame.select(*others, F.col("id").alias(name), F.col("size").alias(f"{name}_size"), F.col("sketch").alias(f"{name}_sketch"))


def _verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose exact Jaccard similarity reaches the threshold."""
    left = materialize(pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b"), "passage-half")
    both = left.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    common = F.size(F.array_intersect("set_a", "set_b"))
    whole = F.size("set_a") + F.size("set_b") - F.col("common")
    out = materialize(both.withColumn("common", common).where(F.col("common") >= threshold * whole - 1e-9).select("a", "b"), "passage-verified")
    forget(left)
    return out


def _checked(docs: DataFrame, pairs: DataFrame, known: DataFrame, min_words: int, threshold: float) -> DataFrame:
    """The pairs that link, by the whole shingle sets of the paragraphs in them."""
    named = materialize(pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).distinct(), "passage-named")
    wanted = materialize(maybe_in(known.select("id", "doc_id", "at"), "id", named).join(named, "id"), "passage-wanted")
    sets = _sets(docs, wanted, min_words)
    out = _verify(pairs, sets, threshold)
    for done in (named, wanted, sets):
        forget(done)
    return out


def _similar_lines(docs: DataFrame, buckets: DataFrame, classes: DataFrame, min_words: int, threshold: float) -> DataFrame:
    """(id, component) of lines with links. ``buckets(key, a, b)``: the line found most often under a key, and another."""
    star = materialize(buckets.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "passage-star")
    named = materialize(star.select(F.col("a").alias("id")).unionAll(star.select("b")).distinct(), "passage-met")
    known = materialize(maybe_in(classes, "id", named).join(named, "id"), "passage-known")
    forget(named)

    # each member of a bucket against the one found most often, which its variants are likely to come from
    half = materialize(star.join(_side(known, "b"), "b"), "passage-star-b")
    tried = materialize(half.join(_side(known, "a"), "a").where(_may_link(threshold)).select("a", "b"), "passage-pairs")
    links = _checked(docs, tried, known, min_words, threshold)
    reached = materialize(connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "passage-components")

    # buckets that still hold several components: pairs across them that may link
    members = buckets.select("key", F.col("b").alias("id")).unionAll(buckets.select("key", "a")).distinct()
    held = materialize(members.join(reached, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component")), "passage-held")
    open_ = materialize(held.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("key"), "passage-open")
    rest = materialize(held.join(open_, "key", "left_semi").join(known.select("id", "size", "sketch"), "id"), "passage-rest")
    left, right = _side(rest, "a", "key", F.col("component").alias("c")), _side(rest, "b", "key", F.col("component").alias("d"))
    across = left.join(right, (left["key"] == right["key"]) & (F.col("c") < F.col("d")) & _may_link(threshold)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    untried = materialize(across.join(tried, ["a", "b"], "left_anti"), "passage-across")
    more = None if untried.isEmpty() else _checked(docs, untried, known, min_words, threshold)
    if more is not None and not more.isEmpty():
        last, reached = reached, materialize(connected_components(links.unionAll(more).select(F.col("a").alias("src"), F.col("b").alias("dst"))), "passage-components")
        forget(last)
    for done in (star, known, half, tried, links, held, open_, rest, untried, *([] if more is None else [more])):
        forget(done)
    return reached


class Aligned:
    """Two word sequences, as 32 bits of each word's hash, and the hashes of their shingles."""

    def __init__(self, x: np.ndarray, y: np.ndarray, gx: np.ndarray | None = None, gy: np.ndarray | None = None) -> None:
        self.x, self.y = x, y
        self.gx, self.gy = (gram_hashes(z, SHINGLE) if g is None and len(z) >= SHINGLE else z[:0] if g is None else g for z, g in ((x, gx), (y, gy)))

    def ahead(self, i: int, j: int) -> int:
        """How many words are equal from x[i] and y[j] on."""
        n = min(len(self.x) - i, len(self.y) - j)
        differ = self.x[i : i + n] != self.y[j : j + n]
        return int(differ.argmax()) if differ.any() else n

    def behind(self, i: int, j: int) -> int:
        """How many words are equal before x[i] and y[j]."""
        n = min(i, j)
        differ = (self.x[i - n : i] != self.y[j - n : j])[::-1]
        return int(differ.argmax()) if differ.any() else n

    def _nearest(self, u: np.ndarray, v: np.ndarray) -> tuple[int, int] | None:
        at: dict[int, int] = {}
        u, v = u.tolist(), v.tolist()
        for k, g in enumerate(v):
            at.setdefault(g, k)
        best = None
        for k, g in enumerate(u):
            if best is not None and k >= sum(best):
                break
            if g in at and (best is None or k + at[g] < sum(best)):
                best = k, at[g]
        return best

    def rightward(self, run: tuple[int, int, int]) -> tuple[list[tuple[int, int, int]], bool]:
        """Runs after ``run`` across edits, and whether the search met an end of x or y."""
        out, (i, j, n) = [], run
        span = n
        while True:
            i, j = i + n, j + n
            reach = max(8, span // 9)  # a gap of g words leaves a span of n words similar to 0.8 if g + 4 <= n / 9
            found = self._nearest(self.gx[i : i + reach + 1], self.gy[j : j + reach + 1])
            if found is None:
                return out, i + reach + SHINGLE > len(self.x) or j + reach + SHINGLE > len(self.y)
            a, b = i + found[0], j + found[1]
            n = self.ahead(a, b)
            span += n + a - i
            i, j = a, b
            out.append((i, j, n))

    def leftward(self, run: tuple[int, int, int]) -> tuple[list[tuple[int, int, int]], bool]:
        out, (i, j, n) = [], run
        span = n
        while True:
            reach = max(8, span // 9)
            p, q = i - SHINGLE, j - SHINGLE
            found = self._nearest(self.gx[max(0, p - reach) : p + 1][::-1], self.gy[max(0, q - reach) : q + 1][::-1]) if min(p, q) >= 0 else None
            if found is None:
                return out, p - reach < 0 or q - reach < 0
            a, b = p - found[0] + SHINGLE, q - found[1] + SHINGLE
            n = self.behind(a, b)
            span += n + i - a
            i, j = a - n, b - n
            out.append((i, j, n))


def align(x: np.ndarray, y: np.ndarray, seeds: list[tuple[int, int, int]], threshold: float = THRESHOLD, grams: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[list[tuple[int, int]], bool, bool]:
    """Ranges of x that repeat y, and whether an alignment met the first or the last words of either.

    ``seeds`` are (place in x, place in y, words), ``grams`` the hashes of the shingles of x and y. A range is a run of ``MIN_RUN`` equal words, or runs with edits between
    them whose shingles have at least the threshold in common with those of their counterpart.
    """
    out: list[tuple[int, int]] = []
    done: list[tuple[int, int]] = []
    low = high = False
    both = Aligned(x, y, *(grams or (None, None)))
    for i, j, n in sorted(seeds):
        if min(i, j) < 0 or i + n > len(x) or j + n > len(y) or any(a <= i and i + n <= b for a, b in done) or both.ahead(i, j) < n:
            continue
        back = both.behind(i, j)
        run = (i - back, j - back, back + both.ahead(i, j))
        right, near_end = both.rightward(run)
        left, near_start = both.leftward(run)
        runs = left[::-1] + [run] + right
        low, high = low or near_start, high or near_end
        done += [(a, a + k) for a, _, k in runs]
        out += [(a, a + k) for a, _, k in runs if k >= MIN_RUN]
        if len(runs) > 1:
            start, other, size = (np.array(c) for c in zip(*runs, strict=True))
            equal = np.concatenate([[0], np.cumsum(np.maximum(size - SHINGLE + 1, 0))])
            for p in range(len(runs)):
                common = equal[p + 1 :] - equal[p]
                wide = start[p:] + size[p:] - start[p]
                sets = wide + other[p:] + size[p:] - other[p] - 2 * (SHINGLE - 1)
                good = np.flatnonzero((wide >= MIN_RUN) & (common >= threshold * (sets - common) - 1e-9))
                if len(good):
                    out.append((int(start[p]), int(start[p] + wide[good[-1]])))
    return _union(sorted(out)), low, high


_JOB = "doc_id long, first long, at long, stop long, first_at long, first_stop long, floor long, ceiling long, places array<int>, first_places array<int>"
_ENDS = ("doc_id", "first", "at", "stop", "first_at", "first_stop", "floor", "ceiling")


def _jobs(hits: DataFrame, cuts: DataFrame) -> DataFrame:
    """Seeds of a document in an earlier one, those close to each other together: ``_JOB``. A seed is a shingle.

    Seeds deep inside lines of ``cuts(doc_id, at, n)``, which go anyway, are left out, and alignments go no further into such
    lines than ``MARGIN`` words: from ``floor`` to ``ceiling``.
    """
    both = hits.select("doc_id", F.col("first").alias("x"), "at", F.col("first_at").alias("y")).unionByName(cuts.select("doc_id", F.lit(None).cast("long").alias("x"), "at", F.col("n").alias("y")))
    grouped = both.groupBy("doc_id").agg(F.collect_list(F.struct("x", "at", "y")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            ends, places, sources = [], [], []
            found = b.column(1)
            x, at, y = (found.values.field(c) for c in ("x", "at", "y"))
            is_cut, x, at, y = x.is_null().to_numpy(zero_copy_only=False), x.fill_null(0).to_numpy(), at.to_numpy(), y.to_numpy()
            marks = found.offsets.to_numpy()
            for i, lo, hi in zip(b.column(0).to_pylist(), marks[:-1], marks[1:], strict=True):
                cut, first, place, source = is_cut[lo:hi], x[lo:hi], at[lo:hi], y[lo:hi]
                gone = _union(sorted(zip(place[cut].tolist(), (place[cut] + source[cut]).tolist(), strict=True)))
                first, place, source = first[~cut], place[~cut], source[~cut]
                if gone:
                    begin, end = np.array(gone).T
                    k = np.searchsorted(begin, np.maximum(place - DEEP, 0), "right") - 1
                    open_ = (k < 0) | (place + SHINGLE + DEEP > end[np.maximum(k, 0)])
                    first, place, source = first[open_], place[open_], source[open_]
                order = np.lexsort((source, place, first))
                first, place, source = first[order], place[order], source[order]
                # a job goes on while its document, and roughly its diagonal, stay
                jobs: list[list[int]] = []
                before = len(ends)
                for f, p, s in zip(first.tolist(), place.tolist(), source.tolist(), strict=True):
                    jobs = [j for j in jobs if j[0] == f and p <= j[1] + JOIN]
                    job = next((j for j in jobs if j[3] - JOIN <= s <= j[2] + JOIN), None)
                    if job is None:
                        job = [f, 0, 0, s, len(ends)]
                        jobs.insert(0, job)
                        ends.append([i, f, p, 0, s, 0, 0, LAST])
                        places.append([])
                        sources.append([])
                    own = ends[job[4]]
                    job[1], job[2], job[3] = max(job[1], p + SHINGLE), max(job[2], s + SHINGLE), min(job[3], s)
                    own[3], own[4], own[5] = job[1], job[3], job[2]
                    places[job[4]].append(p)
                    sources[job[4]].append(s)
                if gone:
                    mine = ends[before:]
                    left = np.searchsorted(begin, [e[2] for e in mine], "left") - 1  # the last line that goes and begins before the job
                    right = np.searchsorted(end, [e[3] for e in mine], "right")  # the first that ends after it
                    for e, k, m in zip(mine, left.tolist(), right.tolist(), strict=True):
                        if k >= 0:
                            e[6] = max(0, min(e[2], int(end[k])) - MARGIN)
                        if m < len(begin):
                            e[7] = max(e[3], int(begin[m])) + MARGIN
            columns = np.array(ends, np.int64).reshape(-1, 8).T
            yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c)) for c in columns), pa.array(places, pa.list_(pa.int32())), pa.array(sources, pa.list_(pa.int32()))], [*_ENDS, "places", "first_places"])

    return materialize(grouped.mapInArrow(run, _JOB), "passage-jobs")


_CUT_JOB = f"{_JOB}, low long, high long, first_low long, first_high long"
_SLICE = f"{_CUT_JOB}, words array<int>, total long, own int"
_CUT = (*_ENDS, "places", "first_places", "low", "high", "first_low", "first_high")


def _slices(docs: DataFrame, cut: DataFrame) -> DataFrame:
    """For the jobs in ``cut`` (``_CUT_JOB``) 32 bits of the hash of each word of their slices, and the ``total`` words of the text: ``_SLICE``.

    ``own`` 1: a row for each job, with the words low to high of its document. 0: one for each different (first, first_low, first_high),
    with those words of the earlier document; the other columns are null. So a job's own words needn't be brought to it afterwards.
    """
    own = cut.groupBy("doc_id").agg(F.collect_list(F.struct(*_CUT)).alias("own"))
    theirs = cut.select(F.col("first").alias("doc_id"), F.col("first_low").alias("low"), F.col("first_high").alias("high")).distinct()
    theirs = theirs.groupBy("doc_id").agg(F.collect_list(F.struct("low", "high")).alias("theirs"))
    places = materialize(own.join(theirs, "doc_id", "full"), "passage-slice-places")
    types = {c: pa.list_(pa.int32()) if c in ("places", "first_places") else pa.int64() for c in _CUT}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            said = [(t or "").encode().split() for t in b.column(1).to_pylist()]
            total, found = np.array([len(x) for x in said], np.int64), []
            least, most = total.copy(), np.zeros(len(said), np.int64)
            for c in ("own", "theirs"):
                marks = b.column(c).offsets.to_numpy()
                jobs = b.column(c).values.slice(int(marks[0]), int(marks[-1] - marks[0]))
                owner = np.repeat(np.arange(b.num_rows), np.diff(marks))
                low, high = (np.minimum(jobs.field(e).to_numpy(), total[owner]) for e in ("low", "high"))
                np.minimum.at(least, owner, low)
                np.maximum.at(most, owner, high)
                found.append((jobs, owner, low, high))
            most = np.maximum(least, most)
            flat = word_hashes([w for x, lo, hi in zip(said, least.tolist(), most.tolist(), strict=True) for w in x[lo:hi]]).astype(np.uint32).view(np.int32)
            begin = np.cumsum(most - least) - (most - least) - least  # of each text, if its hashes began with its first word
            for is_own, (jobs, owner, low, high) in zip((1, 0), found, strict=True):
                if is_own:
                    fixed = {c: jobs.field(c) for c in _CUT}
                else:
                    earlier = {"first": b.column(0).take(pa.array(owner)), "first_low": jobs.field("low"), "first_high": jobs.field("high")}
                    fixed = {c: earlier[c] if c in earlier else pa.nulls(len(owner), types[c]) for c in _CUT}
                ends = pa.array(total[owner]), pa.array(np.full(len(owner), is_own, np.int32))
                if len(owner):
                    yield from _listed(flat, begin[owner] + low, np.maximum(high - low, 0), list(fixed.values()), [*_CUT, "words", "total", "own"], ends)

    out = materialize(_texts(docs, places).select("doc_id", "text", "own", "theirs").mapInArrow(run, _SLICE), "passage-slices", "own")
    forget(places)
    return out


def _aligned(docs: DataFrame, hits: DataFrame, cuts: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, at, n) of the spans that alignments from the seeds in ``hits(doc_id, at, first, first_at)`` give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            col = {c: b.column(c).to_numpy() for c in (*_ENDS, "low", "first_low", "total", "first_total")}
            lists = {c: (b.column(c).offsets.to_numpy(), b.column(c).values.to_numpy(zero_copy_only=False)) for c in ("x", "y", "places", "first_places")}
            again, spans = np.zeros(b.num_rows, bool), []
            for c in ("x", "y"):  # shingles over the end of a list are cut off below
                marks, values = lists[c]
                values = values.view(np.uint32).astype(np.uint64)
                lists[c] = marks, values
                lists[f"g{c}"] = marks, gram_hashes(np.append(values, np.zeros(SHINGLE, np.uint64)), SHINGLE)
            for r in range(b.num_rows):
                x, y, places, sources, gx, gy = (values[marks[r] : marks[r + 1]] for marks, values in lists.values())
                gx, gy = gx[: max(0, len(x) - SHINGLE + 1)], gy[: max(0, len(y) - SHINGLE + 1)]
                low, first_low = int(col["low"][r]), int(col["first_low"][r])
                found, near_low, near_high = align(x, y, [(p, q, SHINGLE) for p, q in zip((places - low).tolist(), (sources - first_low).tolist(), strict=True)], threshold, (gx, gy))
                high, last = low + len(x), min(col["total"][r], col["ceiling"][r])
                again[r] = near_low and (low > col["floor"][r] or low == 0 < first_low) or near_high and (high < last or high == col["total"][r] and first_low + len(y) < col["first_total"][r])
                spans.append([{"at": s + low, "n": e - s} for s, e in found])
            kept = [b.column(c) for c in (*_ENDS, "places", "first_places")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(spans, pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())]))), pa.array(again)], [*_ENDS, "places", "first_places", "spans", "again"])

    jobs, wider, found = _jobs(hits, cuts), 1, None
    while found is None or not jobs.isEmpty():
        # an alignment searches a ninth of its length beyond its ends; slices begin and end at multiples of the margin, so that jobs share them
        around = (F.lit(2 * MARGIN) + F.floor((F.col("stop") - F.col("at")) / 8)) * F.lit(wider)
        down, up = (lambda c: (F.floor(F.greatest(F.col(c) - around, F.lit(0)) / MARGIN) * MARGIN).cast("long")), (lambda c: (F.ceil((F.col(c) + around) / MARGIN) * MARGIN).cast("long"))  # noqa: B023
        cut = jobs.withColumns({"low": F.greatest(down("at"), F.col("floor")), "high": F.least(up("stop"), F.col("ceiling")), "first_low": down("first_at"), "first_high": up("first_stop")})
        cut = materialize(cut, "passage-cut-jobs")
        slices = _slices(docs, cut)
        theirs = slices.where("own = 0").select("first", "first_low", "first_high", F.col("words").alias("y"), F.col("total").alias("first_total"))
        joined = slices.where("own = 1").drop("own").withColumnRenamed("words", "x").join(theirs, ["first", "first_low", "first_high"])
        step = materialize(joined.mapInArrow(run, f"{_JOB}, spans array<struct<at: bigint, n: bigint>>, again boolean"), "passage-aligned")
        spans = step.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.at", "s.n")
        for done in (cut, slices, *([jobs] if found is None else [])):
            forget(done)
        found = spans if found is None else found.unionAll(spans)
        jobs, wider = step.where("again").drop("spans", "again").dropDuplicates(["doc_id", "first", "at", "first_at"]), wider * 16
    return found


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, threshold: float = THRESHOLD, recall: float = 0.999, within: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_words, spans``, the word ranges ``(start, stop)`` to remove, in order and apart.

    ``within``: also cut what repeats an earlier place of its own document alone.
    """
    docs = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    bands, rows = tune_bands(threshold, recall)
    met = materialize(_collide(_scan(docs, min_words, bands, rows, within)), "passages", "kind")
    of = lambda kind, *columns: met.where(F.col("kind") == kind).selectExpr(*columns)
    classes = of(CLASS, "k as id", "a as doc_id", "b as at", "n", "size", "sketch", "places")
    reached = _similar_lines(docs, of(BAND, "k as key", "a", "b"), classes.select("id", "doc_id", "at", "size", "sketch"), min_words, threshold)

    # lines of a component: the first place of each line, and those that follow it in its document, but for the component's first
    linked = materialize(maybe_in(classes.select("id", "doc_id", "at", "n", "places"), "id", reached.select("id")).join(reached, "id"), "passage-linked")
    first = linked.groupBy("component").agg(F.min(F.struct("doc_id", "at")).alias("first"))
    later = F.col("doc_id") > F.col("first.doc_id")
    if within:
        later = later | (F.col("at") > F.col("first.at"))
    cut_lines = linked.join(first, "component").where(later).select("doc_id", F.explode(F.concat(F.array("at"), F.col("places").cast("array<bigint>"))).alias("at"), "n")

    cut_lines = materialize(cut_lines.unionAll(of(CUT, "a", "b", "n")).distinct(), "passage-lines")
    aligned = _aligned(docs, of(HIT, "a as doc_id", "b as at", "k as first", "c as first_at"), cut_lines, threshold)
    cuts = cut_lines.unionAll(aligned).groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("at", "n"))).alias("cuts"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[{"start": s, "stop": e} for s, e in _union([(x["at"], x["at"] + x["n"]) for x in found])] for found in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))], ["doc_id", "spans"])

    spans = cuts.mapInArrow(merge, "doc_id long, spans array<struct<start: bigint, stop: bigint>>")
    whole = of(WORDS, "a as doc_id", "n").groupBy("doc_id").agg(F.max("n").alias("n_words"))
    none = F.expr("cast(array() as array<struct<start: bigint, stop: bigint>>)")
    out = materialize(whole.join(spans, "doc_id", "left").select("doc_id", "n_words", F.coalesce("spans", none).alias("spans")), "passage-spans")
    for done in (met, reached, linked, cut_lines):
        forget(done)
    return out


def _union(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges without overlaps."""
    out: list[tuple[int, int]] = []
    for a, b in runs:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the repeated words; a line that loses all its words goes with its line end."""
    spans = repeated_spans(docs, doc_id, text, **options).where(F.size("spans") > 0).select(F.col("doc_id").alias("_passage_doc"), F.col("spans").alias("_passage_spans"))
    spans = materialize(spans, "passage-cuts")
    joined = docs.join(spans, F.col(doc_id).cast("long") == F.col("_passage_doc"), "left").select(*docs.columns, "_passage_spans")
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            texts = [x if not cuts else cut_words(x, [(c["start"], c["stop"]) for c in cuts]) for x, cuts in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True)]
            yield b.select(range(b.num_columns - 1)).set_column(at, text, pa.array(texts, pa.string()))

    return joined.mapInArrow(run, docs.schema)


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans``."""
    out, at = [], 0
    gone = [False] * (spans[-1][1] if spans else 0)
    for a, b in spans:
        gone[a:b] = [True] * (b - a)
    for line in text.split("\n"):
        raw = line.encode()
        words = raw.split()
        flags = gone[at : at + len(words)]
        at += len(words)
        if not any(flags):
            out.append(line)
        elif not all(flags) or len(flags) < len(words):
            flags += [False] * (len(words) - len(flags))
            out.append(b" ".join(w for w, f in zip(words, flags, strict=True) if not f).decode())
    return "\n".join(out)


def count_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, n_spans, removed_words, has_repeats``."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    found = repeated_spans(docs, doc_id, text)
    return found.select("doc_id", "n_words", F.size("spans").cast("long").alias("n_spans"), removed.alias("removed_words"), (F.size("spans") > 0).alias("has_repeats"))
