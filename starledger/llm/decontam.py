"""Benchmark decontamination: passages of benchmark items inside documents.

Item-sized windows of a document are fingerprinted by SimHash over weighted word shingles (weight:
occurrences). A multi-index over Hamming blocks finds every item fingerprint within the radius: of four
blocks of 16 bits, one at least differs in no more than a fourth of the radius, and all items whose block
does so are looked up. Candidates are verified by exact weighted-shingle similarity (sum of lesser
weights over sum of greater ones). Windows are laid wherever the document has a shingle of an item of
that size, and candidates without a shingle there are left out; without one, the similarity is zero, so
none is missed.

Words are runs of letters and digits, lower-cased. Items are read in blocks of bounded number and size
(an item above it is a block), each sent to the workers; documents are scanned where they are, without a shuffle. Windows are searched in
runs of bounded number, so a very long text takes time by its length and memory for one text.

An item of fewer words than a shingle has is one shingle of its own width, and a longer document has no
shingle of that width: such an item is found only where it is a document's whole text, never inside one.

Null and empty texts and items contain nothing and are found nowhere; empty tables give no rows. Equal
rows give equal rows. An item id that several rows have is one of its own in each. Of windows equally
similar to an item, the first one counts. Other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpointed, fresh, slices
from .hashing import NOT_ALNUM, shingle_hashes, word_hashes

#: Items sent to the workers at once, and characters that they may have together.
ITEM_BLOCK, ITEM_CHARS = 100_000, 1 << 25
#: Pairs of windows and block values that are looked at in one step.
STEP_PAIRS = 1 << 21
#: Ids of contaminated documents that may be broadcast.
BROADCAST_ROWS = 1 << 20
#: Shingles whose bits are counted at once.
STEP_SHINGLES = 1 << 16


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(pc.utf8_lower(column.cast(pa.large_string())), NOT_ALNUM)


def _bits(shingles: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(shingles, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def window_fingerprints(shingles: np.ndarray, size: int) -> np.ndarray:
    """SimHash of every window of ``size`` shingles: a bit is one if more shingles have it than not.

    The first window is counted in parts, the others by what comes and goes, so memory follows the number of windows.
    """
    ones = np.zeros((1, 64), np.int32)
    for start in range(0, size, STEP_SHINGLES):
        ones += _bits(shingles[start : min(size, start + STEP_SHINGLES)]).sum(axis=0, dtype=np.int32)
    moves = _bits(shingles[size:]).astype(np.int32) - _bits(shingles[: len(shingles) - size])
    counts = np.concatenate([ones, moves]).cumsum(axis=0, dtype=np.int32)
    return np.packbits(counts * 2 > size, axis=1, bitorder="little").view("<u8").ravel()


class HammingIndex:
    """Fingerprints under four blocks of 16 bits, each looked up within a fourth of the radius."""

    BLOCKS, WIDTH = 4, 16

    def __init__(self, prints: np.ndarray, radius: int) -> None:
        self.prints, self.radius, self.near = prints, radius, radius // self.BLOCKS
        self.tables = []
        for values in self._cut(prints):
            order = np.argsort(values, kind="stable")
            known, first = np.unique(values[order], return_index=True)
            self.tables.append((known, order, np.append(first, len(order))))
        every = np.arange(1 << self.WIDTH, dtype=np.uint16)
        self.ball = every[np.bitwise_count(every) <= self.near]

    def _cut(self, prints: np.ndarray) -> list[np.ndarray]:
        return [((prints >> np.uint64(self.WIDTH * i)) & np.uint64((1 << self.WIDTH) - 1)).astype(np.uint16) for i in range(self.BLOCKS)]

    def _probed(self, wanted: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``wanted`` and ``known`` of values that are near, by looking at all known values or at the whole ball, whichever is less."""
        if len(known) <= len(self.ball):
            return np.nonzero(np.bitwise_count(wanted[:, None] ^ known[None, :]) <= self.near)
        probes = wanted[:, None] ^ self.ball[None, :]
        at = np.minimum(np.searchsorted(known, probes), len(known) - 1)
        row, column = np.nonzero(known[at] == probes)
        return row, at[row, column]

    def within(self, wanted: np.ndarray) -> Iterator[tuple[int, int]]:
        """(position in ``wanted``, item) of all pairs within the radius."""
        step = max(1, STEP_PAIRS // max(1, len(self.prints), min(len(self.ball), len(self.prints))))
        for start in range(0, len(wanted), step):
            part, pairs = wanted[start : start + step], []
            for values, (known, order, first) in zip(self._cut(part), self.tables, strict=True):
                row, value = self._probed(values, known)
                size = first[value + 1] - first[value]
                place = np.arange(int(size.sum())) - np.repeat(size.cumsum() - size, size) + np.repeat(first[value], size)
                item = order[place]
                row = np.repeat(row, size)
                close = np.bitwise_count(part[row] ^ self.prints[item]) <= self.radius
                pairs.append(row[close] * len(self.prints) + item[close])
            for pair in np.unique(np.concatenate(pairs)).tolist():
                yield start + pair // len(self.prints), pair % len(self.prints)


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of lesser over sum of greater occurrence counts of two shingle sequences."""
    x, cx = np.unique(a, return_counts=True)
    y, cy = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(cx[i], cy[j]).sum())
    return both / max(1, len(a) + len(b) - both)


class Items:
    """What a worker needs of a block of items.

    A window of similarity ``least`` holds that share of an item's shingles, so any few more of them than the
    rest have one that it holds. The rarest of an item, by how many items have them, are those that it is looked
    for by; a phrase that many items share leads to none of them.
    """

    def __init__(self, shingles: list[np.ndarray], radius: int, least: float = 0.8) -> None:
        self.shingles = shingles
        sizes = np.array([len(s) for s in shingles], np.int64)
        owner = np.repeat(np.arange(len(shingles)), sizes)
        tokens = np.concatenate([*shingles, np.zeros(0, np.uint64)])
        _, same = np.unique(tokens, return_inverse=True)
        pairs = np.unique(same * np.int64(max(1, len(shingles))) + owner)
        items_with = np.bincount(pairs // max(1, len(shingles)), minlength=len(same))[same]
        rarest = np.lexsort((tokens, items_with, owner))
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)[: len(sizes)]
        enough = sizes - np.ceil(least * sizes - 1e-9).astype(np.int64) + 1
        kept = rarest[np.arange(len(tokens)) - np.repeat(begins, sizes) < np.repeat(enough, sizes)]
        owner, tokens = owner[kept], tokens[kept]
        order = np.argsort(tokens, kind="stable")
        self.owner, self.size_of = owner[order], sizes
        self.tokens, first = np.unique(tokens[order], return_index=True)
        self.first = np.append(first, len(order))
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.tokens & np.uint64((1 << 20) - 1)] = True
        self.by_size = {}
        for n in np.unique(sizes[sizes > 0]).tolist():
            held = np.flatnonzero(sizes == n)
            self.by_size[n] = held.tolist(), HammingIndex(np.concatenate([window_fingerprints(shingles[i], n) for i in held.tolist()]), radius)

    def find(self, doc: np.ndarray, least: float, at_once: int = 8192) -> dict[int, tuple[float, int]]:
        """Item -> (best similarity, first shingle of the earliest such window) of a document's shingles."""
        best: dict[int, tuple[float, int]] = {}
        if not len(self.tokens):
            return best
        places = np.flatnonzero(self.seen[doc & np.uint64((1 << 20) - 1)])
        if not len(places):
            return best
        index = np.minimum(np.searchsorted(self.tokens, doc[places]), len(self.tokens) - 1)
        same = self.tokens[index] == doc[places]
        anchors: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for place, i in zip(places[same].tolist(), index[same].tolist(), strict=True):
            for item in set(self.owner[self.first[i] : self.first[i + 1]].tolist()):
                anchors[int(self.size_of[item])].append((place, item))
        for n, held in anchors.items():
            items, hamming = self.by_size[n]
            last = max(0, len(doc) - n)
            steps = np.zeros(last + 2, np.int32)
            p, own = (np.array(x) for x in zip(*held, strict=True))
            np.add.at(steps, np.minimum(np.maximum(p - n + 1, 0), last), 1)
            np.add.at(steps, np.minimum(p, last) + 1, -1)
            starts = np.flatnonzero(steps[:-1].cumsum() > 0)
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
                for a in range(0, len(run), at_once):
                    part = run[a : a + at_once]
                    text = doc[part[0] : part[-1] + n]
                    known = set(own[(p >= part[0]) & (p < part[-1] + n)].tolist())
                    for i, k in hamming.within(window_fingerprints(text, min(n, len(text)))):
                        start, item = int(part[i]), items[k]
                        if item not in known:
                            continue
                        similarity = weighted_similarity(doc[start : start + n], self.shingles[item])
                        if similarity >= least and similarity > best.get(item, (0.0, 0))[0]:
                            best[item] = (similarity, start)
        return best


HITS = "doc_id long, item_id long, similarity double, first_word long, n_words long"


def contaminations(docs: DataFrame, benchmark: DataFrame, k: int = 5, least: float = 0.8, radius: int = 23) -> DataFrame:
    """One row for each document and benchmark item that it contains: the best window's similarity and place.

    A pair of similarity 0.8 has fingerprints about 10 of 64 bits apart (standard deviation 3), so the
    default radius of 23 leaves out fewer than one borderline pair in a hundred thousand.
    """
    found = None
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").sort("item_id", "text")
    block: list = []
    held = 0

    def search(block: list) -> DataFrame:
        words, first = _words(pa.array([r["text"] for r in block], pa.large_string()))
        shingles = [shingle_hashes(words[a:b], k) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        ids = [r["item_id"] for r in block]
        sent = docs.sparkSession.sparkContext.broadcast((ids, np.diff(first).tolist(), shingles))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, lengths, shingles = sent.value
            held = Items(shingles, radius, least)
            for whole in batches:
                rows = []
                for batch in slices(whole, "text"):
                    w, at = _words(batch.column("text"))
                    for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                        for item, (similarity, start) in held.find(shingle_hashes(w[a:b], k), least).items():
                            rows.append((doc_id, ids[item], similarity, start, lengths[item]))
                types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in HITS.split(", ")])

        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, HITS)

    for row in items.toLocalIterator():
        if block and (len(block) == ITEM_BLOCK or held + len(row["text"]) > ITEM_CHARS):
            found = search(block) if found is None else found.union(search(block))
            block, held = [], 0
        block.append(row)
        held += len(row["text"])
    if block or found is None:
        found = search(block) if found is None else found.union(search(block))
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = 5, least: float = 0.8, radius: int = 23) -> DataFrame:
    """``docs`` without the documents that contain a benchmark item; all columns stay."""
    (name,) = fresh(docs, "_hit")
    hit = checkpointed(contaminations(docs, benchmark, k, least, radius).select(F.col("doc_id").alias(name)).distinct())
    return docs.join(broadcast_if_small(hit, hit.count(), BROADCAST_ROWS), F.col("doc_id") == F.col(name), "left_anti")
