"""Importance resampling to a target distribution over hashed word n-grams.

Every run of 1 to n words of a text is a feature, hashed to a bucket. A bucket's gain compares its share in
the target texts with its share in the documents, smoothed by one; a document's weight is the mean gain of
its features, and its score adds Gumbel noise fixed by its id, so the highest scores are a draw without
replacement in proportion to the weights.

Scale: documents are counted and weighed where they are read. Texts of more than ``CHUNK_BYTES`` are cut at
word boundaries into chunks that are dealt out over all tasks: a chunk owns the runs that begin in it and
carries the next n-1 words, so each run counts once; counts and weights of chunks are summed by document.
A task sends one number for each bucket it met. The gains (one number for each bucket, a parameter) go to
all tasks. The draw is a range-partitioned sort of ids and scores.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, ranked, slices
from .crc import gram_sums

#: Bytes of text that a chunk owns; texts up to this size are one chunk and stay where they are.
CHUNK_BYTES = 1 << 16

_SEPARATOR = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")
_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_CHUNK = "id long, row long, chunk int, own long, text string"


def cut(text: bytes, n: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(owned bytes, chunk): cuts at the first word boundary from ``size`` bytes on, each with the next n-1 words behind it."""
    at = 0
    while at < len(text):
        found = _SEPARATOR.search(text, at + size)
        end = carry = found.start() if found else len(text)
        for _ in range(n - 1):
            word = _WORD.search(text, carry)
            if not word:
                break
            carry = word.end()
        yield end - at, text[at:carry]
        at = end


def _cut_rows(n: int, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
                for i, (own, chunk) in enumerate(cut(text.as_py(), n, size)):
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([row], pa.int64()), pa.array([i], pa.int32()), pa.array([own], pa.int64()), pa.array([chunk], pa.binary()).cast(pa.string())], ["id", "row", "chunk", "own", "text"])

    return run


def chunks(docs: DataFrame, key: str, text: str, n: int, size: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(id, row, chunk, own, text) of the texts of one chunk, left in place, and of all others, dealt out by row and chunk."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    long = F.coalesce(F.octet_length("text") > size, F.lit(False))
    whole = rows.where(~long).select("id", "row", F.lit(0).alias("chunk"), F.lit(None).cast("long").alias("own"), "text")
    return whole, rows.where(long).mapInArrow(_cut_rows(n, size), _CHUNK).repartition("row", "chunk")


def _own(batch: pa.RecordBatch) -> np.ndarray:
    """Owned bytes by row; a text of one chunk owns all."""
    return batch.column(batch.schema.get_field_index("own")).fill_null(1 << 62 >> 1).to_numpy(zero_copy_only=False)


def bucket_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 2, buckets: int = 10_000, size: int = CHUNK_BYTES) -> DataFrame:
    """(bucket, count) of the features of all texts; buckets that no feature meets are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                for sums in gram_sums(part.column(part.schema.get_field_index("text")), n, _own(part))[0]:
                    total += np.bincount(sums % np.uint32(buckets), minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], ["bucket", "count"])

    found = [part.select("own", "text").mapInArrow(run, "bucket int, count long") for part in chunks(docs, key, text, n, size)]
    return found[0].unionByName(found[1]).groupBy("bucket").agg(F.sum("count").alias("count"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """For each bucket, 1000 times the logarithm of its smoothed share in the target over that in the documents, rounded down."""

    def dense(counts: DataFrame) -> list[int]:
        out = [0] * buckets
        for bucket, count in counts.collect():  # one row for each bucket at most
            out[bucket] = count
        return out

    s, t = dense(docs), dense(target)
    all_s, all_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return np.array([math.floor(1000 * math.log((y + 1) * all_s / ((x + 1) * all_t))) for x, y in zip(s, t)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", n: int = 2, size: int = CHUNK_BYTES) -> DataFrame:
    """(id, n_words, n_features, weight) of each row: the number of its features and their mean gain, rounded down (0 without features)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sums, firsts, words = gram_sums(part.column(part.schema.get_field_index("text")), n, _own(part))
                features, total = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
                for run_sums, first in zip(sums, firsts):
                    upto = np.concatenate([[0], np.cumsum(gain[run_sums % np.uint32(len(gain))])])
                    features += np.diff(first)
                    total += np.diff(upto[first])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(words.astype(np.int64)), pa.array(features), pa.array(total)], ["id", "row", "n_words", "n_features", "total"])

    whole, parts = (c.select("id", "row", "own", "text").mapInArrow(run, "id long, row long, n_words long, n_features long, total long") for c in chunks(docs, key, text, n, size))
    parts = parts.groupBy("id", "row").agg(*[F.sum(c).alias(c) for c in ("n_words", "n_features", "total")])
    mean = F.when(F.col("n_features") > 0, F.floor(F.col("total") / F.col("n_features"))).otherwise(F.lit(0))
    return whole.unionByName(parts).select("id", "n_words", "n_features", mean.cast("long").alias("weight"))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_key: str = "item_id", n: int = 2, buckets: int = 10_000, percent: int = 25, least_words: int = 20, seed: int = 7, size: int = CHUNK_BYTES) -> DataFrame:
    """For each row of ``docs``: ``key``, n_features, weight, score and, of those drawn, the rank of its score (1, 2, 3, ...).

    Of the rows with at least ``least_words`` words, ``percent`` of a hundred (rounded down) are drawn, by
    score and among equal scores by the smaller id. Null and empty texts have no features and weight 0. Rows
    without an id share one noise, and come after the others of their score. Repeated rows each count and are
    each drawn. Other columns are ignored. An empty table gives no rows; without target texts all
    buckets of equal count weigh alike. A text of any length costs a task no more than its row and a chunk.
    """
    gain = gains(bucket_counts(docs, key, text, n, buckets, size), bucket_counts(target, target_key, text, n, buckets, size), buckets)
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    score = (F.col("weight") + F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0)))).cast("long")
    scored = checkpointed(weights(docs, gain, key, text, n, size).withColumn("score", score))
    eligible = F.col("n_words") >= least_words
    drawn = percent * scored.where(eligible).count() // 100
    places = ranked(scored.where(eligible), [F.col("score").desc(), F.col("id").asc_nulls_last()], "place")
    rest = scored.where(~eligible).withColumn("place", F.lit(None).cast("long"))
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    return places.unionByName(rest).select(F.col("id").alias(key), "n_features", "weight", "score", rank.alias("rank"))


def oracle(docs: str = "documents", target: str = "benchmark") -> str:
    """DuckDB SQL for ``resample`` with its defaults; each distinct feature's CRC-32 is worked out byte by byte."""
    words = lambda source, key: f"SELECT {key} AS k, list_transform(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x) AS w FROM {source}"
    grams = lambda name: f"SELECT k, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM {name}"
    return f"""
WITH RECURSIVE bits(b, c, i) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i + 1 FROM bits WHERE i < 8),
tab AS (SELECT list(c ORDER BY b) AS tab FROM bits WHERE i = 8),
dw AS ({words(docs, "doc_id")}), tw AS ({words(target, "item_id")}),
df AS ({grams("dw")}), tf AS ({grams("tw")}),
dc AS (SELECT k, g, count(*) AS n FROM df GROUP BY ALL), tc AS (SELECT g, count(*) AS n FROM tf GROUP BY ALL),
gs AS (SELECT g, hex(encode(g)) AS h FROM (SELECT DISTINCT g FROM dc UNION SELECT g FROM tc)),
gb AS (SELECT g, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, len(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT)), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) % 10000 AS b FROM gs, tab),
s AS (SELECT b, sum(n)::DOUBLE AS s FROM dc JOIN gb USING (g) GROUP BY b),
t AS (SELECT b, sum(n)::DOUBLE AS t FROM tc JOIN gb USING (g) GROUP BY b),
sums AS (SELECT coalesce((SELECT sum(s) FROM s), 0) + 10000 AS ss, coalesce((SELECT sum(t) FROM t), 0) + 10000 AS tt),
gain AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1) * ss / ((s + 1) * tt)))::BIGINT AS gain FROM s LEFT JOIN t USING (b), sums),
w AS (SELECT k, sum(n) AS n, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM dc JOIN gb USING (g) JOIN gain USING (b) GROUP BY k),
d AS (SELECT doc_id, len(dw.w) AS words, coalesce(w.n, 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM {docs} JOIN dw ON doc_id = dw.k LEFT JOIN w ON doc_id = w.k),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM d WHERE words >= 20)
SELECT d.doc_id, n_features, weight, score, CASE WHEN place <= 25 * (SELECT count(*) FROM r) // 100 THEN place END AS rank
FROM d LEFT JOIN r ON d.doc_id = r.doc_id
"""
