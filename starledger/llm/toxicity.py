"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of lexicon words and stems, nearness of second-person words to
them, rates of capitals, punctuation, digits and of words broken up by signs. The lexicon is a short
fixed list and what the training labels show: words and word beginnings that occur in toxic texts
and hardly elsewhere, in many different contexts (so that copies of one text prove nothing).

The classifier, and the lexicon with it, are fitted on at most ``train_rows`` labelled rows, taken by
a hash of their id, held-out rows never among them. Every text is scored, in one pass that moves no
text between machines. Null and empty texts get the score of all-zero features. With no labelled row
or one class only, every score is the share of toxic labels (0 without labels). Several labels of one
id count as toxic if one does. Labels of texts that aren't there, and other columns, are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_text, slices

# Words of insult and of the second person.
INSULTS = "idiot moron stupid scum trash loser clown pathetic worthless disgusting dumb jerk fool imbecile bastard".split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch euer sie tu te toi ton ta tes vous votre vos usted ustedes vosotros ti tus".split()
# End of fixed values.
FEATURES = ("word_density", "stem_density", "hits", "kinds", "closest_hits", "second_person_nearness", "second_person_density", "capitals", "shouted_words", "punctuation", "exclamations", "symbols", "digits", "broken_words", "broken_hits")
WORD = re.compile(r"[^\W\d_]+")
BROKEN = re.compile(r"[^\W\d_]+(?:[0-9@$!*.+_-]+[^\W\d_]+)+")
#: Lengths of word beginnings.
STEMS = (3, 4, 5, 6, 7, 8)
_SHOUTED = re.compile(r"\b[A-Z]{3,}\b")
_LEET = str.maketrans("013457@$!+", "oieastasit", ".*_-")
_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = 1
_KIND[[ord(c) for c in ".,;:?'\"()-"]] = 2
_KIND[ord("!")] = 3
_KIND[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 4
_KIND[48:58] = 5
_LETTER, _SIGN = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_SIGN[[ord(c) for c in "0123456789@$!*.+_-"]] = True


@dataclass
class Lexicon:
    words: frozenset = frozenset(INSULTS)
    stems: frozenset = frozenset()

    def codes(self) -> dict:
        """A lookup from word to 1 (listed word), 2 (listed stem), 4 (second person) or 0, which learns words as it meets them."""
        words, stems, second = self.words, self.stems, frozenset(SECOND_PERSON)

        class Codes(dict):
            def __missing__(self, word: str) -> int:
                code = 1 if word in words else 2 if any(word[:k] in stems for k in STEMS if len(word) >= k) else 4 if word in second else 0
                if len(self) > 100_000:
                    self.clear()
                self[word] = code
                return code

        return Codes()


def features(text: str, codes: dict) -> np.ndarray:
    """The FEATURES of a text."""
    out = np.zeros(len(FEATURES), np.float32)
    if not text:
        return out
    words = WORD.findall(text.lower())
    n = max(1, len(words))
    code = np.fromiter(map(codes.__getitem__, words), np.uint8, len(words))
    at = np.flatnonzero((code == 1) | (code == 2))
    second = np.flatnonzero(code == 4)
    raw = np.frombuffer(text.encode(), np.uint8)
    kind = _KIND[raw]
    kinds = np.bincount(kind, minlength=6)
    capital, letter, sign = kind == 1, _LETTER[raw], _SIGN[raw]
    size = max(1, len(text))
    out[0] = 100 * np.count_nonzero(code == 1) / n
    out[1] = 100 * np.count_nonzero(code == 2) / n
    out[2] = np.log1p(len(at))
    out[3] = len({words[i] for i in at.tolist()})
    if len(at) > 1:
        out[4] = 1 / np.diff(at).min()
    if len(at) and len(second):
        i = np.searchsorted(second, at)
        gap = np.minimum(np.abs(at - second[np.minimum(i, len(second) - 1)]), np.abs(at - second[np.maximum(i - 1, 0)]))
        out[5] = 1 / gap.min()
    out[6] = 100 * len(second) / n
    out[7] = kinds[1] / size
    if (capital[2:] & capital[1:-1] & capital[:-2]).any():
        out[8] = len(_SHOUTED.findall(text)) / n
    out[9], out[10], out[11], out[12] = (kinds[2:6] / size).tolist()
    if (letter[:-1] & sign[1:]).any() and (sign[:-1] & letter[1:]).any():
        broken = BROKEN.findall(text)
        out[13] = len(broken) / n
        out[14] = sum(codes[x.lower().translate(_LEET)] in (1, 2) for x in broken)
    return out


@dataclass
class Model:
    """Boosted regression trees of fixed depth on the log-odds, then a monotone step function."""

    edges: list[np.ndarray]
    base: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # by node in heap order: feature, threshold bin; then the leaves
    depth: int = 3
    raw: np.ndarray = field(default_factory=lambda: np.zeros(0))
    share: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, rows, out = self.bins(x), np.arange(len(x)), np.full(len(x), self.base)
        for split, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, split[node]] > cut[node])
            out += leaf[node - len(split)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities; a thousandth of the uncalibrated one orders rows of one step. Without trees, the share."""
        m = self.margin(x)
        if len(self.raw) and not self.trees:
            return np.full(len(x), self.share[0])
        p = 1 / (1 + np.exp(-m))
        return p if not len(self.raw) else 0.999 * np.interp(m, self.raw, self.share) + 0.001 * p


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: float = 1.0) -> Model:
    """Histogram gradient boosting of the logistic loss (second order, L2 penalty ``least``)."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1], method="nearest")) for j in range(x.shape[1])]
    rate0 = min(max(y.mean(), 1e-3), 1 - 1e-3)
    model = Model(edges, float(np.log(rate0 / (1 - rate0))), depth=depth)
    b = model.bins(x)
    width = max(len(e) for e in edges) + 1
    margin, inner = np.full(len(x), model.base), 2**depth - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(x), np.int64)
        split, cut = np.zeros(inner, np.int64), np.full(inner, width)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            gain_of, cut_of = [], []
            for j in range(x.shape[1]):
                key = (node - first) * width + b[:, j]
                gl, hl = (np.bincount(key, w, count * width).reshape(count, width).cumsum(axis=1) for w in (g, h))
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + least) + (gt - gl) ** 2 / (ht - hl + least) - gt**2 / (ht + least)
                gain_of.append(gain.max(axis=1))
                cut_of.append(gain.argmax(axis=1))
            gains, best = np.stack(gain_of), np.stack(gain_of).argmax(axis=0)
            for k in range(count):
                if gains[best[k], k] > 1e-9:
                    split[first + k], cut[first + k] = best[k], cut_of[best[k]][k]
            node = 2 * node + 1 + (b[np.arange(len(x)), split[node]] > cut[node])
        at = node - inner
        leaf = rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + least)
        model.trees.append((split, cut, leaf))
        margin += leaf[at]
    return model


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over distinct margins: increasing mean margins and the rising share of ones there."""
    values, at, rows = np.unique(raw, return_inverse=True, return_counts=True)
    ones = np.bincount(at, y, len(values))
    blocks: list[list[float]] = []  # sum of y, rows, sum of margins
    for m, n, v in zip(values.tolist(), rows.tolist(), ones.tolist(), strict=True):
        blocks.append([v, n, m * n])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def _one_class(y: np.ndarray) -> bool:
    return not len(y) or y.min() == y.max()


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Trees on four fifths of the rows; calibration on the other fifth, if both have both classes. No rows or one class only: a constant model."""
    if _one_class(y):
        share = float(y.mean()) if len(y) else 0.0
        return Model([np.zeros(1)] * x.shape[1], 0.0, raw=np.zeros(1), share=np.full(1, share))
    apart = np.arange(len(y)) % 5 == 4
    if _one_class(y[apart]) or _one_class(y[~apart]):
        return boost(x, y)
    model = boost(x[~apart], y[~apart])
    model.raw, model.share = isotonic(model.margin(x[apart]), y[apart])
    return model


def _terms(words: list[str]) -> Iterator[tuple[str, int]]:
    for i, w in enumerate(words):
        yield f"w:{w}", i
        for k in STEMS:
            if len(w) >= k:
                yield f"s:{w[:k]}", i


def learn_lexicon(train: DataFrame, least_texts: int = 7, least_odds: float = 20.0, least_contexts: int = 6) -> Lexicon:
    """Fixed insults and the terms that set toxic training texts apart. ``train``: text, toxic; bounded by the caller.

    Terms are counted in toxic texts first; only those in ``least_texts`` of them are then
    counted in the others, so workers hold few terms at a time. Their number is bounded by the sample's.
    """

    def count(known: frozenset | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole, "text", 1 << 18):
                    texts = Counter()
                    for text in batch.column("text").to_pylist():
                        terms = {t for t, _ in _terms(WORD.findall((text or "").lower()))}
                        texts.update(terms if known is None else terms & known)
                    yield pa.RecordBatch.from_arrays([pa.array(list(texts), pa.string()), pa.array(list(texts.values()), pa.int64())], ["term", "texts"])

        return run

    def counted(rows: DataFrame, known: frozenset | None = None) -> DataFrame:
        return rows.mapInArrow(count(known), "term string, texts long").groupBy("term").agg(F.sum("texts").alias("texts"))

    sizes = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return Lexicon()
    pos = {r["term"]: r["texts"] for r in counted(train.where("toxic = 1")).where(F.col("texts") >= least_texts).collect()}
    neg = {r["term"]: r["texts"] for r in counted(train.where("toxic = 0"), frozenset(pos)).collect()}
    likely = frozenset(t for t, n in pos.items() if (n + 0.5) / (sizes[1] + 1) >= least_odds * (neg.get(t, 0) + 0.5) / (sizes[0] + 1))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text", 1 << 18)):
            seen = set()
            for text in batch.column("text").to_pylist():
                words = WORD.findall((text or "").lower())
                seen.update((t, words[i - 1] if i else "") for t, i in _terms(words) if t in likely)
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in seen], pa.string()), pa.array([c for _, c in seen], pa.string())], ["term", "context"])

    if not likely:
        return Lexicon()
    varied = train.where("toxic = 1").mapInArrow(contexts, "term string, context string").groupBy("term").agg(F.countDistinct("context").alias("contexts")).where(F.col("contexts") >= least_contexts)
    terms = [r["term"] for r in varied.collect()]
    return Lexicon(frozenset(INSULTS) | {t[2:] for t in terms if t[0] == "w"}, frozenset(t[2:] for t in terms if t[0] == "s"))


def training_rows(docs: DataFrame, labels: DataFrame, train_rows: int) -> DataFrame:
    """At most ``train_rows`` labelled texts outside the held-out fold, equal texts once, by their smallest id: doc_id, text, toxic."""
    chosen = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
        .where(crc32_text("doc_id") % 5 != 0)
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(train_rows)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id")  # at most train_rows rows of 12 bytes are sent
    return found.groupBy("text", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "text", "toxic")


def train(docs: DataFrame, labels: DataFrame, train_rows: int = 20_000) -> tuple[Lexicon, Model]:
    """Lexicon and model from a bounded sample of labelled rows."""
    from .common import checkpointed

    rows = checkpointed(training_rows(docs, labels, train_rows))
    lexicon = learn_lexicon(rows.select("text", "toxic"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = lexicon.codes()
        for batch in batches:
            x = [features(t, codes).tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(x, pa.list_(pa.float32()))], ["doc_id", "toxic", "x"])

    # Rows in an order of their own, so neither files nor partitions decide which are set apart for calibration.
    got = rows.mapInArrow(measure, "doc_id long, toxic int, x array<float>").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic", "x").toPandas()
    x = np.array(got["x"].tolist(), np.float64).reshape(len(got), len(FEATURES))
    return lexicon, fit(x, got["toxic"].to_numpy(np.float64))


def score_texts(docs: DataFrame, lexicon: Lexicon, model: Model) -> DataFrame:
    """``docs`` with a double column ``score``, one pass over whole texts."""
    schema = docs.drop("score").withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = lexicon.codes()
        for whole in batches:
            for batch in slices(whole, "text"):
                x = np.stack([features(t or "", codes) for t in batch.column("text").to_pylist()]).astype(np.float64)
                kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "score"]
                yield pa.RecordBatch.from_arrays([c for _, c in kept] + [pa.array(model.score(x), pa.float64())], [n for n, _ in kept] + ["score"])

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = 20_000) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    lexicon, model = train(docs, labels, train_rows)
    scored = score_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), lexicon, model).select("doc_id", "score")
    return scored.select("doc_id", F.coalesce(crc32_text("doc_id") % 5 == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
