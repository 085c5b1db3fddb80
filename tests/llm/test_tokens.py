"""Packing and token files: exact round trips against the tokenizer library."""

from __future__ import annotations

import random
import sys
import zlib

import numpy as np
import pytest
from fixtures import empty, frame, texts
from hypothesis import given
from hypothesis import strategies as st

from cladeflow.llm.eliasfano import EliasFano, encode
from cladeflow.llm.packing import CapacityTree, first_fit_decreasing, pack_documents
from cladeflow.llm.token_output import read_token_files, token_output, write_token_files
from cladeflow.llm.tokens import Encoder, encoder, vocabulary

ODD = [
    "", " ", "  ", "\n", "a  b", " a", "a ", "don't we'll I'm", "a\n\n b", "x\t y", "1 23 456", "naïve 😀😀 東京",
    "<|endoftext|> and <|endoftext|>", "a <|endoftext|> b", "x<|endoftext|>", " <|endoftext|>\n\n<|endoftext", "tab\tnew\r\nline", " nbsp  em", "trailing \n", "'s 's", "___ -- !!", "é" * 50,
]


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    return lambda text: t.encode(text, add_special_tokens=False).ids


@given(st.text(alphabet=st.sampled_from("ab 'st\n\té1😀 \r-"), max_size=40))
def test_encoder_equals_library(text):
    assert np.frombuffer(encoder(vocabulary())(text), "<u4").tolist() == library_ids(text)


_library = None


def library_ids(text):
    global _library
    _library = _library or library()
    return _library(text)


@pytest.mark.parametrize("text", ODD)
def test_encoder_on_odd_texts(text):
    assert np.frombuffer(encoder(vocabulary())(text), "<u4").tolist() == library_ids(text)


def test_encoder_keeps_few_bytes():
    draw, encode = random.Random(3), Encoder(vocabulary())
    words = ["".join(draw.choices("abcdefghij", k=9)) for _ in range(600_000)] + [f"{i}" * 500 for i in range(10_000, 20_000)]
    for at in range(0, len(words), 5000):
        encode(" ".join(words[at : at + 5000]))
    caches = [c for cache in (encode.pretokens, encode.first, encode.later) for c in (cache, getattr(cache, "before", {}))]
    assert sum(sys.getsizeof(c) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in c.items()) for c in caches) < 160 << 20
    for text in (" ".join(words[:50]), words[-1], " ".join(words[599_990:600_001]) + ", 12."):
        assert np.frombuffer(encode(text), "<u4").tolist() == library_ids(text)


@given(st.lists(st.integers(0, 10_000), max_size=300))
def test_elias_fano_round_trip(values):
    values = sorted(values)
    read = EliasFano(encode(np.array(values, np.int64)))
    assert read.values().tolist() == values
    assert [read[i] for i in range(len(values))] == values


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(1).integers(1, 900, 10_000))
    assert len(encode(values)) < 10_000 * 12 / 8 + 1000


@given(st.lists(st.integers(1, 50), max_size=60))
def test_first_fit_decreasing_equals_plain_loop(lengths):
    bins, offsets = first_fit_decreasing(lengths, 50)
    rooms: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at = next((b for b, room in enumerate(rooms) if room >= lengths[i]), len(rooms))
        if at == len(rooms):
            rooms.append(50)
        assert (bins[i], offsets[i]) == (at, 50 - rooms[at])
        rooms[at] -= lengths[i]


def test_capacity_tree_of_one_bin():
    assert CapacityTree(1, 10).place(10) == (0, 10)


def test_packing_is_whole(spark):
    rows = texts(2)
    got = pack_documents(frame(spark, rows), vocabulary(), capacity=64, group_docs=20).toPandas()
    full = [(d, library_ids(t or "") + [1]) for d, t in rows]
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert got["length"].sum() == sum(len(ids) for _, ids in full)
    known = dict(full)
    for r in got.dropna(subset=["doc_id"]).itertuples():
        ids = known[int(r.doc_id)]
        assert r.ids_crc32 == crc(ids[r.start : r.start + r.length]) and r.doc_tokens == len(ids)
    for _, piece in got.groupby("sequence_id"):
        piece = piece.sort_values("offset")
        assert piece["offset"].tolist() == [0, *piece["length"].cumsum().tolist()[:-1]]
        assert piece["length"].sum() <= 64
    waste = 1 - got["length"].sum() / (64 * got["sequence_id"].nunique())
    assert waste < 0.1


def test_token_files_round_trip(spark, tmp_path):
    rows = [r for r in texts(4) if r[0] is not None]
    random.Random(1).shuffle(rows)
    folder = str(tmp_path / "tokens")
    write_token_files(frame(spark, rows), folder, vocabulary(), 2)
    got = sorted(tuple(r) for r in read_token_files(spark, folder).collect())
    at, want = 0, []
    for d, t in sorted(rows, key=lambda r: r[0]):
        ids = library_ids(t or "") + [2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == sorted(want)


def test_rows_without_id_come_first(spark):
    rows = [(5, "five"), (None, "none"), (1, "one one"), (None, "none")]
    got = token_output(frame(spark, rows), vocabulary()).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, 1, 5]


def test_empty_table(spark):
    assert pack_documents(empty(spark), vocabulary()).count() == 0
    assert token_output(empty(spark), vocabulary()).count() == 0
