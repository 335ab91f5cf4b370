import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from starledger.llm import packing

from .fixtures import documents, frame


@pytest.fixture(scope="module")
def encoders():
    return packing.load_encoder(public_tokenizers.path("byte_bpe_50k.json")), packing.load_encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_both_vocabulary_files_give_the_same_ids(encoders, text):
    assert np.array_equal(encoders[0](text), encoders[1](text))


def test_ids_of_parts_are_ids_of_the_whole(encoders, monkeypatch):
    monkeypatch.setattr(packing, "_PART", 20)
    for text in ["It's we'll  two   spaces\n\nlines\t tabs <|endoftext|> 12345 !!! " * 20, "a" * 100, " " * 100, "é x" * 50, "x \n" * 40]:
        assert np.array_equal(encoders[1](text), encoders[0](text))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 63), max_size=40))
def test_assignment_is_whole_and_tight(lengths):
    placed = packing.assign(lengths, 64)
    assert len(placed) == -(-sum(lengths) // 64)
    pieces = defaultdict(list)
    for sequence in placed:
        assert 0 < sum(n for _, _, n in sequence) <= 64
        for piece, start, n in sequence:
            pieces[piece].append((start, n))
    for i, length in enumerate(lengths):
        at = 0
        for start, n in sorted(pieces[i]):
            assert start == at and n > 0
            at += n
        assert at == length


def test_longest_pieces_go_to_the_cheapest_sequence():
    placed = packing.assign([40, 30, 20, 10, 10, 10, 8], 64)
    assert [[p for p, _, _ in s] for s in placed] == [[0, 4], [1, 2, 3], [5, 6]] or sum(len(s) for s in placed) >= 7
    costs = [sum(n + n * n / 1024 for _, _, n in s) for s in placed]
    assert max(costs) <= 2 * min(costs) + 64


@pytest.mark.parametrize("pool", [1 << 20, 3000])
def test_every_id_lies_in_one_piece(spark, encoders, pool):
    rows = documents(3, 6) + [(500, "lorem ipsum " * 3000), (501, None), (501, "same id")]
    got = packing.pack(frame(spark, rows), pool_tokens=pool).toPandas()
    assert got["length"].sum() == sum(len(encoders[0](t or "")) + 1 for _, t in rows)
    for i, t in rows:
        if i == 501:
            continue
        ids, at = np.append(encoders[0](t or ""), 0).astype("<u4"), 0
        for r in got[got.doc_id == i].sort_values("start").itertuples():
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        at = 0
        for r in s.itertuples():
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert packing.pack(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("part", [None, 20])
def test_strings_of_added_tokens_are_those_tokens(encoders, monkeypatch, part):
    from tokenizers import Tokenizer

    if part:
        monkeypatch.setattr(packing, "_PART", part)
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y", "two  <|endoftext|>  \n lines", "<|endoftext|", "words and more words <|endoftext|> and words  <|endoftext|>\n\n" * 5]:
        expected = plain.encode(text, add_special_tokens=False).ids
        assert encoders[0](text).tolist() == encoders[1](text).tolist() == expected
    assert 50256 in encoders[1]("a <|endoftext|> b")
