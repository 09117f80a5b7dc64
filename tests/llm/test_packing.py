import zlib
from functools import lru_cache

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keystrata.llm import packing

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")
TEXTS = ["It's we'll DON'T 'S ''s!", "naïve ÇA ß ſ İstanbul", "x² ½ ٣ 1234 ⅷ", "a\x1cb\x85c d \t\n e", "é é", "日本語 text 🙂🙂", "<|endoftext|> <|startoftext|>", "a <|endoftext|> b<|ENDOFTEXT|>c < |endoftext|>", "_a_b__ ...!!! $$$%%%", "", None, "ˈˇ˘ ǅ ŉ", "ªº ¼", "word " * 5000]


@lru_cache(1)
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def ids(text):
    t = library()
    return [*t.encode(text or "", add_special_tokens=False).ids, 0]


def test_words_encode_as_the_library_does():
    coder = packing.Encoder(PATH)
    assert coder.by_word
    for text, coded in zip(TEXTS, coder.encode([t or "" for t in TEXTS]), strict=True):
        assert np.frombuffer(coded, "<u4").tolist() == ids(text)[:-1], text


def test_fresh_words_are_encoded_as_one_text(monkeypatch):
    coder, calls = packing.Encoder(PATH), []
    encode = coder._library
    monkeypatch.setattr(coder, "_library", lambda texts: calls.append(len(texts)) or encode(texts))
    text = " ".join(f"w{k} it's ({k})-é" for k in range(300))
    assert np.frombuffer(next(coder.encode([text])), "<u4").tolist() == ids(text)[:-1]
    assert calls == [1]


def test_words_without_a_mark_of_their_end():
    """Where ids don't tell where words end, each word is encoded alone."""
    coder = packing.Encoder(PATH)
    coder.ends[:] = False
    assert np.frombuffer(next(coder.encode(["some words, it's"])), "<u4").tolist() == ids("some words, it's")[:-1]


def test_added_tokens_keep_their_ids():
    coded = next(packing.Encoder(PATH).encode(["a <|endoftext|> b"]))
    assert np.frombuffer(coded, "<u4").tolist() == [320, 49407, 321]


def test_every_latin_character():
    coder = packing.Encoder(PATH)
    text = " ".join(f"a{chr(c)}B{chr(c)} {chr(c)}" for c in range(1, 0x300))
    assert np.frombuffer(next(coder.encode([text])), "<u4").tolist() == ids(text)[:-1]
    for c in range(1, 0x300):
        one = f"x{chr(c)}Y 1{chr(c)}'s"
        assert np.frombuffer(next(coder.encode([one])), "<u4").tolist() == ids(one)[:-1], hex(c)


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 5)
    coder = packing.Encoder(PATH)
    for text in ("a b c d", "e f g h", "a e i o u y z"):
        assert np.frombuffer(next(coder.encode([text])), "<u4").tolist() == ids(text)[:-1]


def test_packed_documents(make):
    docs = [(i, t) for i, t in enumerate(TEXTS * 6)]
    out = packing.pack_documents(make(docs, ("length", "offset")), PATH).collect()
    brute.check_packing([(r.doc_id, r.piece, r.start, r.length, r.sequence_id, r.offset) for r in out], {i: len(ids(t)) for i, t in docs}, 2048)
    for r in out:
        part = ids(docs[r.doc_id][1])[r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.asarray(part, "<u4").tobytes())


def test_ids_travel_with_pieces(make):
    rows = packing.pack_documents(make([(1, "hello world " * 40)]), PATH, capacity=32, with_ids=True).orderBy("piece").collect()
    assert np.frombuffer(b"".join(bytes(r.ids) for r in rows), "<u4").tolist() == ids("hello world " * 40)


def test_empty_table_null_and_repeated_ids(make):
    assert packing.pack_documents(make([(1, "a")]).limit(0), PATH).count() == 0
    rows = packing.pack_documents(make([(None, "a"), (None, "a"), (7, "b"), (7, "b")]), PATH).collect()
    assert sorted((r.sequence_id, r.offset) for r in rows) == [(0, 0), (0, 2), (0, 4), (0, 6)]


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), max_size=12), st.integers(40, 60))
def test_fullest_combination(counts, room):
    best = {0}
    for length, n in counts.items():
        best = {a + k * length for a in best for k in range(n + 1) if a + k * length <= room}
    found = packing.fullest(counts, room)
    assert sum(k * v for k, v in found.items()) == max(best)
    assert all(v <= counts[k] for k, v in found.items())


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 90), min_size=1, max_size=15))
def test_plan_places_all(counts):
    rows = packing.plan(counts, 50)
    bins = {}
    for length, n in counts.items():
        own = [r for r in rows.tolist() if r[0] == length]
        for rank in range(n):
            _, first, each, base, offset = max((r for r in own if r[1] <= rank), key=lambda r: r[1])
            bins.setdefault(base + (rank - first) // each, []).append((offset + (rank - first) % each * length, length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 50


def test_few_bins_for_perfect_fits():
    counts = {30: 100, 20: 100, 25: 40, 10: 60, 40: 60}
    assert len({r[3] for r in packing.plan(counts, 50).tolist()}) and packing.plan(counts, 50)[:, 3].max() < 180
