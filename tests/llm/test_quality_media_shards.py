"""Quality rules (7), media (9), sharding (10)."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from groundwork.llm import jpeg, quality, sharding
from groundwork.llm.common import pick
from tests.llm.conftest import EDGES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def covered(words, n):
    grams = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = set()
    for i in range(len(words) - n + 1):
        if grams[tuple(words[i : i + n])] > 1:
            out.update(range(i, i + n))
    return out


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    chars, seen, dup, dup_chars = sum(map(len, words)), set(), 0, 0
    for line in text.split("\n"):
        own = WORD.findall(line)
        if own:
            if line in seen:
                dup, dup_chars = dup + 1, dup_chars + sum(map(len, own))
            seen.add(line)
    repeat = len(covered(words, 8))
    failed = len(words) < 20 or 100 * repeat > 30 * len(words)
    shares = {n: sum(len(words[i]) for i in covered(words, n)) / max(1, chars) for n in quality.NGRAM_LIMITS}
    kept = not failed and dup_chars / max(1, chars) <= quality.LINE_LIMIT and all(shares[n] <= v for n, v in quality.NGRAM_LIMITS.items())
    return len(words), chars, sum(c in "#*$%&|<>" for c in text), dup, repeat, failed, kept


def row(x):
    return x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], x["base_failed"], x["kept"]


def test_rules_equal_brute_force(sample):
    got = {r.doc_id: row(r) for r in quality.rules(pick(sample, "doc_id", "text")).collect()}
    assert got == {r.doc_id: brute(r.text) for r in sample.collect()}


@pytest.mark.parametrize("text", ["", "a b " * 50, "one line of some words here\n" * 9, "x\n\nx\n \n", "p q r s t u v w " * 2 + " ".join(map(str, range(100)))])
def test_rules_of_small_texts(text):
    assert row(quality.measure(text)) == brute(text)


def test_equal_hashes_are_compared_word_by_word(monkeypatch):
    monkeypatch.setattr(quality, "splitmix", lambda x: np.zeros(len(x), np.uint64))
    ids = np.arange(40)
    ids[30:38] = ids[2:10]
    assert np.flatnonzero(quality.repeated(ids, 8)).tolist() == [*range(2, 10), *range(30, 38)]


def test_rules_and_filter_of_edges(edges, clashing, empty):
    for docs in (edges, clashing):
        got = sorted(((r.doc_id, *row(r)) for r in quality.rules(pick(docs, "doc_id", "text")).collect()), key=str)
        assert got == sorted([(d, *brute(t)) for d, t, *_ in EDGES], key=str)
    kept = quality.keep(clashing)
    assert kept.columns == clashing.columns
    assert sorted((r[0] for r in kept.select(kept.columns[:1]).collect() if r[0]), key=str) == sorted((d for d, t, *_ in EDGES if d and brute(t)[-1]), key=str)
    assert quality.rules(pick(empty, "doc_id", "text")).count() == 0 and quality.keep(empty).count() == 0


def test_media_round_trip(edges, clashing, empty):
    for docs in (edges, pick(clashing, "doc_id", "text")):
        rows = jpeg.media(pick(docs, "doc_id", "text"), keep_files=True).collect()
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(d) for d, *_ in EDGES)
        texts = defaultdict(set)
        for d, t, *_ in EDGES:
            texts[d].add((t or "").encode())
        for r in rows:
            back = jpeg.payload(jpeg.Image.read([bytes(r.file)])[0])
            raw = back[: r.n_bytes]
            assert raw in texts[r.doc_id] and len(back) % 64 == 0 and len(back) - r.n_bytes < 64 + 64 * (not raw) and not any(back[r.n_bytes :])
            assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]))
            assert (r.media_bytes, r.media_sha256) == (len(r.file), hashlib.sha256(r.file).hexdigest())
    assert jpeg.media(pick(empty, "doc_id", "text")).count() == 0


def test_decoder_reads_other_tables_and_long_intervals():
    """A file without restart markers, with longer codes, runs of zeros and an end of block."""
    blocks = [[5, 0, 0, -3, *[0] * 60], [2, *[0] * 20, 7, *[0] * 42], [2, *[0] * 62, 1], [-9, *[0] * 63]]
    dc, ac = {0: "00", 2: "01", 3: "10", 4: "110"}, {0x00: "00", 0x22: "01", 0x43: "100", 0xF0: "101", 0xE1: "1100"}
    value = lambda v: "" if not v else format(v if v > 0 else v + (1 << abs(v).bit_length()) - 1, f"0{abs(v).bit_length()}b")
    bits, level = "", 0
    for b in blocks:
        d, level = b[0] - level, b[0]
        bits += dc[abs(d).bit_length()] + value(d)
        run, last = 0, max([i for i, v in enumerate(b) if v and i], default=0)
        for i in range(1, last + 1):
            if not b[i]:
                run += 1
                continue
            while run > 15:
                bits, run = bits + ac[0xF0], run - 16
            bits, run = bits + ac[run << 4 | abs(b[i]).bit_length()] + value(b[i]), 0
        bits += ac[0] if last < 63 else ""
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")
    file = b"\xff\xd8" + jpeg.segment(0xDB, b"\0" + bytes([16]) + b"\1" * 63) + jpeg.segment(0xC0, bytes([8, 0, 16, 0, 16, 1, 1, 0x11, 0])) + jpeg.huffman(0, dc) + jpeg.huffman(0x10, ac) + jpeg.segment(0xDA, b"\1\1\0\0\x3f\0") + scan + b"\xff\xd9"
    image = jpeg.Image.read([file])[0]
    assert image.blocks.tolist() == blocks
    assert image.thumbnail().tolist() == [[138, 132], [132, 110]]


def test_encoder_is_wide_for_long_payloads():
    p = np.random.default_rng(3).integers(0, 256, 64 * 8191 * 2, dtype=np.uint8).tobytes()
    f = jpeg.encode(p)
    image = jpeg.Image.read([f])[0]
    assert jpeg.payload(image) == p and max(image.width, image.height) <= 65535


def test_minimax_cuts_equal_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(40):
        sizes, k = rng.integers(0, 30, rng.integers(1, 12)).tolist(), int(rng.integers(1, 5))
        best = {0: 0}  # atoms placed -> least largest shard, over all partitions
        for _ in range(k):
            best = {j: min([max(best[i], sum(sizes[i:j])) for i in best if i <= j], default=0) for j in range(len(sizes) + 1)}
        cuts = [0, *sharding.minimax_cuts(sizes, k), len(sizes)]
        assert len(cuts) - 1 <= k and max(sum(sizes[a:b]) for a, b in zip(cuts, cuts[1:])) == best[len(sizes)]


def loads_of(sizes, k):
    big, cuts = sharding.plan(sizes, k)
    edges = [0, *cuts, len(sizes)]
    return [sizes[a] for a in big], [sum(s for i, s in enumerate(sizes[a:b], a) if i not in big) for a, b in zip(edges, edges[1:])]


def test_plan_is_no_larger_than_contiguous_shards_and_uses_all():
    rng = np.random.default_rng(6)
    for _ in range(400):
        sizes, k = (rng.integers(0, 30, rng.integers(1, 14)) ** int(rng.integers(1, 4))).tolist(), int(rng.integers(1, 7))
        edges = [0, *sharding.minimax_cuts(sizes, k), len(sizes)]
        alone, others = loads_of(sizes, k)
        assert len(alone) + len(others) <= k and sum(alone) + sum(others) == sum(sizes)
        assert max(alone + others) <= max(sum(sizes[a:b]) for a, b in zip(edges, edges[1:]))
        assert sum(x > 0 for x in alone + others) == min(k, sum(x > 0 for x in sizes))


@pytest.mark.parametrize("share", [0.03, 0.05, 0.1, 1 / 3])
def test_a_large_group_leaves_the_other_shards_near_equal(share):
    sizes = np.random.default_rng(7).integers(500, 1500, sharding.ATOMS).tolist()
    sizes[30_000] = int(sum(sizes) * share / (1 - share))
    alone, others = loads_of(sizes, 40)
    assert alone == [sizes[30_000]] and len(others) == 39
    assert max(others) - min(others) < 0.05 * max(others)


def test_a_group_of_a_third_of_all_rows(spark):
    texts = [(i, "copy " * 20 if i % 3 == 0 else f"text {i} " * 10) for i in range(6000)]
    rows = sharding.shard(spark.createDataFrame(texts, "doc_id long, text string").repartition(5)).collect()
    loads = check_shards(rows, texts)
    copies = {r.shard for r in rows if r.doc_id % 3 == 0}
    others = [load for s, load in loads.items() if s not in copies]
    assert len(loads) == 40 and len(copies) == 1 and max(others) < 1.1 * min(others)


def check_shards(rows, texts):
    groups, slots, loads = defaultdict(set), defaultdict(list), Counter()
    for r in rows:
        assert 0 <= r.shard < 40 and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
        groups[r.text_crc32, r.size].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(g) == 1 for g in groups.values())
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=str) == sorted(((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in texts), key=str)
    return loads


def test_shards_of_edges(edges, clashing, empty):
    for docs in (edges, pick(clashing, "doc_id", "text")):
        check_shards(sharding.shard(pick(docs, "doc_id", "text")).collect(), [(d, t) for d, t, *_ in EDGES])
    assert sharding.shard(pick(empty, "doc_id", "text")).count() == 0


def test_shards_are_near_equal(sample):
    rows = sharding.shard(pick(sample, "doc_id", "text")).collect()
    loads = check_shards(rows, [(r.doc_id, r.text) for r in sample.collect()])
    group = Counter()
    for r in rows:
        group[r.text_crc32, r.size] += r.size
    assert max(loads.values()) <= sum(loads.values()) / 40 + max(group.values())
