"""Cost-balanced packing of documents into training sequences.

Each document becomes token ids and an end id. Whole sequences are cut off its front; what is left
goes to a pool. A full pool is packed: pieces in descending length, each to the sequence of lowest
estimated cost (linear plus quadratic attention cost) that still has room for it; a piece that fits
nowhere is cut to fill the lowest-cost sequences with room. As many sequences are opened as the
pool's tokens need, so a pool loses less than one sequence to padding.

One pass without a shuffle: a task packs what it reads, holds one pool and one document at a time,
and names its sequences by its partition, so a repeated task gives the same rows. Null texts are
empty (one end id). Equal rows are documents of their own.

Ids come from the byte-level BPE ranks file, which holds the same vocabulary as the JSON file; the
tests hold it against the JSON file read by ``tokenizers``. The strings of that file's added tokens
stand for those tokens in a text, as in that library's default. Texts are encoded in parts cut before
white space that follows a non-space, where no token of this vocabulary's pattern reaches across.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

_CUT = re.compile(r"(?<=\S)(?=\s)")
#: Characters encoded at once.
_PART = 1 << 18

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def load_encoder(path: str):
    """A function from text to a uint32 array of ids, for a ``.tiktoken`` ranks file or a ``.json`` tokenizer."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    added, whole = {}, Path(path).with_suffix(".json")
    if whole.exists():
        added = {t["content"]: t["id"] for t in json.loads(whole.read_text(encoding="utf-8"))["added_tokens"]}
    encoding = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def ids(part: str) -> list[int]:
        if any(t in part for t in added):
            return encoding.encode(part, allowed_special="all")
        return encoding.encode_ordinary(part)

    def encode(text: str) -> np.ndarray:
        out, at = [], 0
        while len(text) - at > _PART:
            cut = _CUT.search(text, at + _PART)
            if not cut:
                break
            out.append(np.array(ids(text[at : cut.start()]), np.uint32))
            at = cut.start()
        out.append(np.array(ids(text[at:] if at else text), np.uint32))
        return np.concatenate(out)

    return encode


def assign(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1.0 / 1024) -> list[list[tuple[int, int, int]]]:
    """Cost-balanced packing of pieces shorter than ``capacity``.

    Returns for each sequence the placed (piece, start in the piece, length), in order; offsets follow
    from the lengths. Ties go to the earlier piece and the earlier sequence.
    """
    total = sum(lengths)
    count = -(-total // capacity)
    room, cost = np.full(count, capacity, np.int64), np.zeros(count)
    placed: list[list[tuple[int, int, int]]] = [[] for _ in range(count)]

    def put(piece: int, start: int, length: int, at: int) -> None:
        placed[at].append((piece, start, length))
        room[at] -= length
        cost[at] += linear * length + quadratic * length * length

    for piece in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, left = 0, lengths[piece]
        while left:
            open_cost = np.where(room >= left, cost, np.inf)
            at = int(open_cost.argmin())
            if open_cost[at] == np.inf:
                at = int(np.where(room > 0, cost, np.inf).argmin())
            taken = min(left, int(room[at]))
            put(piece, start, taken, at)
            start, left = start + taken, left - taken
    return placed


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 1024, end_id: int = 0, pool_tokens: int = 1 << 20, linear: float = 1.0, quadratic: float = 1.0 / 1024) -> DataFrame:
    """One row per piece of a document: which ids it holds, and its place in which sequence.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. ``pool_tokens`` bounds what a
    task holds. ``sequence_id`` is unique over all tasks.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoder(path)
        made, base = 0, TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        pool: list[tuple] = []
        held = 0

        def row(doc_id, start, ids, tokens, sequence, offset):
            return doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), tokens, base + sequence, offset

        def flush() -> None:
            nonlocal made, pool, held
            for sequence in assign([len(p[2]) for p in pool], capacity, linear, quadratic):
                offset = 0
                for piece, start, length in sequence:
                    doc_id, first, ids, tokens = pool[piece]
                    rows.append(row(doc_id, first + start, ids[start : start + length], tokens, made, offset))
                    offset += length
                made += 1
            pool, held = [], 0

        def out() -> pa.RecordBatch:
            nonlocal rows
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [c.split()[0] for c in SCHEMA.split(", ")])

        for whole in batches:
            for batch in slices(whole, "text"):
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    ids = np.append(encode(text or ""), np.uint32(end_id))
                    whole_part = len(ids) - len(ids) % capacity
                    for at in range(0, whole_part, capacity):
                        rows.append(row(doc_id, at, ids[at : at + capacity], len(ids), made, 0))
                        made += 1
                    if whole_part < len(ids):
                        pool.append((doc_id, whole_part, ids[whole_part:].copy(), len(ids)))
                        held += len(ids) - whole_part
                    if held >= pool_tokens:
                        flush()
                yield out()
        if pool:
            flush()
        if rows:
            yield out()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
