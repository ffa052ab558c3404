"""BPE (3), token counts (4), packing (6): against the libraries, and round trips."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from groundwork.llm import bpe, counts, packing, pieces
from groundwork.llm.common import pick
from groundwork.llm.pieces import library, split
from tests.llm.conftest import EDGES

RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(RANKS).rank, special_tokens={})


ALPHABET = "abst'revlmd  \n\t 12é$%中  _-\x85²½\x1c\U00013879\U00010d40\ua7cb\0"


@settings(max_examples=300, deadline=None)
@given(st.text(ALPHABET, max_size=40))
def test_pieces_and_ids_equal_the_library(text):
    c = bpe.coder(RANKS)
    ids = c.encode(text)
    assert ids == reference().encode_ordinary(text)
    assert c.decode(ids) == text.encode()
    assert "".join(split(text)) == text
    expected = library(JSON).encode(text, add_special_tokens=False).ids
    assert counts.counter(JSON).count([text]) == [len(expected)]
    assert [x.tolist() for x in packing.ids_of(JSON).batch([text])] == [expected]


def test_classes_of_all_code_points_equal_the_libraries():
    """Each code point after a letter, a digit and a sign; both libraries have newer tables than Python may have."""
    every = np.array([c for c in pieces.PLANES if not 0xD800 <= c < 0xE000 and c not in (10, 39)])
    cut = library(JSON).pre_tokenizer.pre_tokenize_str
    ranks = {bytes([b]): b for b in range(256)}
    ranks |= {bytes([p, b]): 256 + 256 * k + b for k, p in enumerate(b"a1!") for b in range(256)}  # a first token of two bytes: one piece
    pair = tiktoken.Encoding("pairs", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for before, kind in (("a", pieces.LETTER), ("1", pieces.NUMBER)):
        want = pieces.classes()[every] == kind
        line = "\n".join(before + chr(c) for c in every)
        ids = np.array(pair.encode_ordinary(line))
        begins = np.cumsum([0, *(1 + (ids >= 256))])[:-1]
        second = np.cumsum([0, *(2 + len(chr(c).encode()) for c in every)])[:-1] + 1
        assert (~np.isin(second, begins) == want).all()
        for at in range(0, len(every), 4096):
            begins = [i for _, (i, _) in cut("\n".join(before + chr(c) for c in every[at : at + 4096]))]
            assert (~np.isin(3 * np.arange(len(want[at : at + 4096])) + 1, begins) == want[at : at + 4096]).all()
    beyond = "".join(chr(c) for c in range(0x40000, 0x110000) if not 0xE0000 <= c < 0xF0000)
    assert all(len(cut("!" + beyond[at : at + 4096])) == 1 for at in range(0, len(beyond), 4096))


def test_letters_newer_than_python_keep_their_ids():
    for text in ("m\U00013879'd", "\U00013879's x", "1\U00010d40 \U00010d41a", "\ua7cb'll"):
        ids = bpe.coder(RANKS).encode(text)
        expected = library(JSON).encode(text, add_special_tokens=False).ids
        assert ids == reference().encode_ordinary(text) == expected
        assert counts.counter(JSON).count([text]) == [len(expected)]
        assert [x.tolist() for x in packing.ids_of(JSON).batch([text, "", text])] == [expected, [], expected]


def told(log):
    """An encoding that is known: a piece's code points, doubled."""

    def encode(some):
        log.extend(some)
        return np.array([2 * ord(c) for x in some for c in x], np.uint32), np.array([*map(len, some)], np.int64)

    return encode


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text(ALPHABET, max_size=30), max_size=5), max_size=4), st.sampled_from([4, 1000]), st.sampled_from([2, 64]), st.sampled_from([3, 1 << 18]))
def test_store_gives_what_it_was_told(batches, most, chars, block):
    s = pieces.Store(told([]), most=most, chars=chars)
    s.BLOCK = block
    for texts in batches:
        values, edges = s.encoded(texts)
        assert [values[i:j].tolist() for i, j in zip(edges, edges[1:])] == [[2 * ord(c) for c in t] for t in texts]
        assert len(s.stamp) <= most + block and (np.diff(s.key.astype(object)) > 0).all()


def test_store_compares_pieces_of_one_hash(monkeypatch):
    """All pieces share one hash: each but the first is encoded anew, and right."""
    s = pieces.Store(told([]))
    s.places[:] = 0
    for texts in (["ab cd", "", " cd x"], ["x cd", "ab"]):
        values, edges = s.encoded(texts)
        assert [values[i:j].tolist() for i, j in zip(edges, edges[1:])] == [[2 * ord(c) for c in t] for t in texts]


def test_store_remembers():
    log: list = []
    s = pieces.Store(told(log), most=6)
    for text in ("a b c", "a b c", " d a", " b c" * 50):
        s.encoded([text])
    assert log.count(" b") == log.count("a") == 1


def test_long_pieces():
    c, r = bpe.coder(RANKS), reference()
    for text in ("a" * 5000, "ab" * 700, " " * 999 + "x", "=" * 3000, "the" * 300):
        assert c.encode(text) == r.encode_ordinary(text)


def test_chunk_maps_compose_like_a_plain_run():
    random.seed(2)
    text = "".join(random.choice(ALPHABET) for _ in range(5000))
    cp = np.append(np.frombuffer(text.encode("utf-32-le"), np.uint32), 0x110000).astype(np.uint32)
    pieces = split(text)
    assert np.flatnonzero(counts.cuts(cp)).tolist() == np.cumsum([0, *map(len, pieces)])[:-1].tolist()


def test_counter_forgets_without_changing_counts():
    c = counts.Counter(JSON, most=50, held=50)
    texts = [f"unusual{i} wording{i * 7}" for i in range(60)]
    assert c.count(texts) == [len(library(JSON).encode(t, add_special_tokens=False).ids) for t in texts]


def long_pieces():
    """One piece each, of up to a megabyte: runs, periods that no chunk divides, and what never repeats."""
    draw = random.Random(9)
    return {
        "run": "a" * 1_000_000, "period": "abcabdabe" * 20_000, "signs": "=-" * 30_000, "random": "".join(draw.choices("etaoinshrdlu", k=60_000)), "syllables": "".join(draw.choices(["the", "ing", "tion", "x"], k=80_000)),
        "wide": "".join(chr(draw.randrange(0x4E00, 0x9FFF)) for _ in range(20_000)), "edge": "b" * (2 * counts.SPAN + 1), "two": "c" * 512 + "'" + "d" * 700,
    }


@pytest.mark.parametrize("held", [counts.ARCS_HELD, 30])
def test_long_pieces_are_counted_by_chunk_maps(held):
    c = counts.Counter(JSON, held=held)
    for name, text in long_pieces().items():
        assert c.count([text]) == [len(library(JSON).encode(text, add_special_tokens=False).ids)], name
        assert c.arcs <= held + 4 * counts.BATCH and len(c.keys) < 16 * (held + 4 * counts.BATCH)


def test_chunk_maps_give_what_a_run_from_the_first_byte_gives():
    c = counts.Counter(JSON)
    draw = random.Random(4)
    data = np.frombuffer("".join(draw.choices(["ab", "abc", "a", "the", "q"], k=4000)).encode(), np.uint8)
    for begin in range(0, 5 * counts.SPAN, 177):
        state = int(c.lanes(data, np.array([0]), np.array([begin]), np.array([0]))[0][0])
        for n in (1, counts.SPAN - 1, counts.SPAN, 5 * counts.SPAN + 3):
            run = c.lanes(data, np.array([begin]), np.array([n]), np.array([state]))
            assert c.chunked(data[begin : begin + n], state) == (run[0][0], run[1][0])


def test_digests_and_counts_of_edges(edges, clashing, empty):
    r, lib = reference(), library(JSON)
    for docs in (edges, pick(clashing, "doc_id", "text")):
        got = sorted(map(tuple, bpe.digests(pick(docs, "doc_id", "text"), RANKS).collect()), key=str)
        want = []
        for d, t, *_ in EDGES:
            ids = r.encode_ordinary(t or "")
            want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
        assert got == sorted(want, key=str)
        got = sorted(map(tuple, counts.count_tokens(pick(docs, "doc_id", "text"), JSON).collect()), key=str)
        n = [len(lib.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in EDGES]
        assert got == sorted([(d, len((t or "").encode()), k, k > 1024) for (d, t, *_), k in zip(EDGES, n)], key=str)
    assert bpe.digests(pick(empty, "doc_id", "text"), RANKS).count() == 0
    assert counts.count_tokens(pick(empty, "doc_id", "text"), JSON).count() == 0


def check_packing(rows, texts, capacity=2048):
    """Every id in one piece; sequences gapless; crcs those of the library's ids."""
    lib, by_doc, by_seq = library(JSON), defaultdict(list), defaultdict(list)
    for x in rows:
        by_doc[x.doc_id].append(x)
        by_seq[x.sequence_id].append(x)
    for d, copies in texts.items():
        want = []
        for t in copies:
            ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
            want += [(a, min(capacity, len(ids) - a), zlib.crc32(ids[a : a + capacity].tobytes()), len(ids)) for a in range(0, len(ids), capacity)]
        assert sorted((x.start, x.length, x.ids_crc32, x.doc_tokens) for x in by_doc[d]) == sorted(want)
    for pieces in by_seq.values():
        at = 0
        for x in sorted(pieces, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert at <= capacity
    return sum(x.length for x in rows) / (capacity * len(by_seq))


def test_packing_of_edges(edges, clashing, empty):
    texts = defaultdict(list)
    for d, t, *_ in EDGES:
        texts[d].append(t)
    for docs in (edges, pick(clashing, "doc_id", "text")):
        check_packing(packing.pack(pick(docs, "doc_id", "text"), JSON).collect(), texts)
    assert packing.pack(pick(empty, "doc_id", "text"), JSON).count() == 0


def test_packing_fills_well(sample):
    texts = defaultdict(list)
    for r in sample.collect():
        texts[r.doc_id].append(r.text)
    assert check_packing(packing.pack(pick(sample, "doc_id", "text"), JSON).collect(), texts) > 0.9


def test_first_fit_decreasing_equals_the_plain_rule():
    lengths = np.random.default_rng(1).integers(1, 2049, 300)
    bins, offsets = packing.first_fit_decreasing(lengths, 2048)
    loads: list[int] = []
    for k in np.argsort(-lengths, kind="stable"):
        b = next((i for i, x in enumerate(loads) if x + lengths[k] <= 2048), len(loads))
        if b == len(loads):
            loads.append(0)
        assert (bins[k], offsets[k]) == (b, loads[b])
        loads[b] += int(lengths[k])
