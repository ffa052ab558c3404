"""Licences (1), language model (2), language ID (5), near duplicates (8), the pipeline."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
import xxhash

from groundwork.llm import language, licenses, lm, simhash
from groundwork.llm.common import pick
from tests.llm.conftest import EDGES

LOWER = {i: i + 32 for i in range(65, 91)}
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]


def base(text):
    w = re.findall(licenses.WORD, (text or "").translate(LOWER))
    found = [(i, label) for label, p in PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(found), min([i for i, _ in found], default=None), max([i for i, _ in found], default=None), ",".join(sorted({x for _, x in found}))


def test_licences_equal_brute_force(edges, clashing, empty, sample):
    for docs, rows in ((edges, EDGES), (clashing, EDGES), (sample, sample.collect())):
        got = licenses.scan(pick(docs, "doc_id", "text")).collect()
        assert sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], key=str) == sorted([(r[0], *base(r[1])) for r in rows], key=str)
        assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert licenses.scan(pick(empty, "doc_id", "text")).count() == 0


def test_licences_verify_mandatory_phrases(spark):
    texts = ["licensed under the apache license", "licensed under the Apache License, Version 2.0", "under cc by nc 5 0", "Licensed under CC BY-NC 4.0.", "Permission is hereby granted, free of charge, to any person", "mit " * 3000 + "license"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.labels for r in licenses.scan(docs).orderBy("doc_id").collect()] == ["apache", "apache,apache-2.0", "", "cc-by-nc-4.0", "mit", "mit"]


def aligned(text):
    """Labels and score by plain loops over every template and place."""
    bodies = [body.split() for _, body, _ in licenses.TEMPLATES]
    w = re.findall(licenses.WORD, (text or "").translate(LOWER))
    labels, best = set(), 0.0
    for (label, _, phrases), body in zip(licenses.TEMPLATES, bodies):
        idf = [math.log((1 + len(bodies)) / (1 + sum(x in b for b in bodies))) + 0.01 for x in body]
        rare = sorted(range(len(body)), key=lambda i: (-idf[i], i))[: licenses.RARE]
        for at in range(len(w)):
            same = [at + i < len(w) and w[at + i] == x for i, x in enumerate(body)]
            enough = sum(idf[i] for i in rare if same[i]) >= licenses.ENOUGH * sum(idf[i] for i in rare)
            places = [next(i for i in range(len(body)) if body[i : i + len(p.split())] == p.split()) for p in phrases]
            if enough and all(all(same[i : i + len(p.split())]) for i, p in zip(places, phrases)):
                labels.add(label)
                best = max(best, sum(x for x, y in zip(idf, same) if y) / sum(idf))
    return ",".join(sorted(labels)), best


def test_licences_find_whole_notices(spark):
    changed = licenses.MIT.replace("merge", "weave").replace("sublicense", "lend")
    bsd = f"{licenses.BSD_HEAD}\n{licenses.BSD_TAIL}"
    texts = [f"Copyright 2020 someone\n\n{t}\n\nmore words" for t in (licenses.MIT, changed, licenses.ISC, bsd, bsd.replace(licenses.BSD_TAIL, f"{licenses.BSD_NAMES} {licenses.BSD_TAIL}"), licenses.APACHE, licenses.GPL, licenses.MPL, licenses.UNLICENSE, licenses.ZLIB)]
    texts += [licenses.MIT[:300], licenses.APACHE * 2, licenses.GPL.replace("version 3", "version 2").replace("any later", "no later"), " ".join(reversed(licenses.MIT.split())), "permission charge obtaining sublicense merge", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = licenses.scan(docs).orderBy("doc_id").collect()
    want = [aligned(t) for t in texts]
    assert [r.labels for r in got] == [x for x, _ in want]
    assert all(abs(r.score - x) < 1e-6 for r, (_, x) in zip(got, want))
    own = ["mit-notice", "mit-notice", "isc", "bsd-2-clause", "bsd-3-clause", "apache-2.0-notice", "gpl-3.0-or-later", "mpl-2.0-notice", "unlicense", "zlib"]
    assert all(x in r.labels.split(",") for x, r in zip(own, got)) and not {"bsd-3-clause"} & set(got[3].labels.split(","))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


@pytest.mark.parametrize("sent", [50_000, 3])
def test_language_model_counts_equal_brute_force(edges, sample, sent):
    for docs, rows in ((edges, EDGES), (sample, sample.collect())):
        train = Counter()
        for r in rows:
            if zlib.crc32(str(r[0] if r[0] is not None else "").encode()) % 7 != 2:
                train.update([*words(r[1]), "\0end"])
        n, v = sum(train.values()), len(train)
        want = []
        for r in rows:
            key = str(r[0]) if r[0] is not None else ""
            toks = [*words(r[1]), "\0end"]
            want.append((r[0], zlib.crc32(key.encode()) % 7 == 2, len(toks), sum(train[w] > 0 for w in toks), n, sum(math.log10((train[w] + 1) / (n + v + 1)) for w in toks)))
        got = lm.score(pick(docs, "doc_id", "text"), classes=64 if sent == 50_000 else 4, sent=sent).collect()
        a, b = sorted(got, key=lambda r: (str(r.doc_id), r.n_tokens)), sorted(want, key=lambda r: (str(r[0]), r[2]))
        assert [tuple(x)[:5] for x in a] == [x[:5] for x in b]
        assert all(abs(x.base_score - y[5]) < 1e-6 * max(1, abs(y[5])) and x.score < 0 for x, y in zip(a, b))


def test_language_model_beats_the_base_on_held_out_texts(sample):
    got = [r for r in lm.score(pick(sample, "doc_id", "text"), classes=128).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_language_model_is_normalised():
    rng = np.random.default_rng(1)
    p = lm.Parameters(*(x.astype(np.float32) for x in lm.start(rng.random(20) + 0.1, d=6)))
    n = lm.Normaliser(p)
    every = np.arange(20)
    for a, b in ((0, 0), (3, 7), (19, 1)):
        assert abs((10.0 ** n(np.full(20, a), np.full(20, b), every)).sum() - 1) < 1e-5


def test_language_model_scores_equal_plain_loops(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, int(rng.integers(0, 30))) if x < 60)) for i in range(60)] + [(60, None), (61, "never seen words"), (62, "w1 " + "w" * 80)]
    own, sent = 4, 15

    def fixed(docs, known, unigram):
        p = lm.start(unigram, seed=3)
        return lm.Parameters(*(x.astype(np.float32) for x in p._replace(first=p.first * 9, last=p.last * 9)))

    monkeypatch.setattr(lm, "train", fixed)
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), classes=own + 2, sent=sent).collect()}
    counts, ends = Counter(), 0
    for i, text in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(words(text))
            ends += 1
    ranked = sorted((w for w in counts if len(w) <= lm.SENT_CHARS), key=lambda w: (-counts[w], w))[:sent]
    cls = {w: i + 2 if i < own else own + 2 + int(math.log2((i + 1) / (own + 1))) for i, w in enumerate(ranked)}
    assert max(cls.values()) == own + 3  # two bands
    members = {k: [w for w in counts if cls.get(w, 0) == k] for k in range(own + 4)}
    size = [sum(counts[w] for w in members[0]) + 1, ends + 1, *(sum(counts[w] for w in members[k]) for k in range(2, own + 4))]
    first, last, scale, bias = fixed(None, None, np.array(size) / sum(size))

    def share(w, k):
        if 1 <= k < own + 2:
            return 1.0
        return (counts[w] + 1) / (sum(counts[x] + 1 for x in members[k]) + (k == 0))

    def logs(a, b):
        hidden = first[a] * scale[0] + first[b] * scale[1]
        scores = [float(hidden @ last[k] + bias[k]) for k in range(len(bias))]
        total = sum(math.exp(x) for x in scores)
        return [math.exp(x) / total for x in scores]

    for i, text in rows:
        a, b, want = 1, 1, 0.0
        for w in [*words(text), None]:
            k = 1 if w is None else cls.get(w, 0)
            want += math.log10(logs(a, b)[k] * (1.0 if w is None else share(w, k)))
            a, b = k, a
        assert abs(got[i] - want) < 1e-3 * max(1, abs(want))
    everything = sum(logs(2, 3)[cls.get(w, 0)] * share(w, cls.get(w, 0)) for w in counts) + logs(2, 3)[1] + logs(2, 3)[0] * share("unseen", 0)
    assert abs(everything - 1) < 1e-6  # all words, the end, and one place for words not seen


def test_noise_contrastive_step_equals_numeric_gradients():
    rng = np.random.default_rng(2)
    k, d, n = 7, 3, 5
    unigram = rng.random(k) + 0.1
    unigram /= unigram.sum()
    p = lm.Parameters(rng.normal(0, 1, (k, d)), rng.normal(0, 1, (k, d)), rng.normal(1, 0.3, (2, d)), rng.normal(0, 1, k))
    a, b, word = (rng.integers(0, k, n) for _ in range(3))
    noise = np.searchsorted(np.cumsum(unigram), np.random.default_rng(8).random(lm.NOISE)).clip(0, k - 1)

    def objective(q):
        total = 0.0
        for x, y, w in zip(a, b, word):
            hidden = q.first[x] * q.scale[0] + q.first[y] * q.scale[1]
            told = lambda v: hidden @ q.last[v] + q.bias[v] - math.log(lm.NOISE * unigram[v])
            total += -math.log1p(math.exp(-told(w))) - sum(math.log1p(math.exp(told(v))) for v in noise)
        return total / n

    copy = lm.Parameters(*(x.astype(np.float64) for x in p))
    trainer = lm.Trainer(copy, lm.Parameters(*(np.full(x.shape, 0.05) for x in p)), unigram, seed=8)
    trainer.step(a, b, word)
    for name in p._fields:
        before = getattr(p, name)
        for at in np.ndindex(before.shape):
            up, down = (p._replace(**{name: before + e * (np.arange(before.size).reshape(before.shape) == np.ravel_multi_index(at, before.shape))}) for e in (1e-5, -1e-5))
            g = 100 * (objective(up) - objective(down)) / 2e-5
            assert abs(getattr(trainer.p, name)[at] - (before[at] + lm.RATE * g / math.sqrt(0.05 + g * g))) < 1e-4


def test_training_rounds_start_from_the_average(sample):
    texts = pick(sample, "doc_id", "text").limit(200).cache()
    known, sizes, _ = lm.vocabulary([("the", 50), ("of", 20)], 1000, 100, 200, 4)
    once = lm.train(texts, known, sizes / sizes.sum(), rounds=1)
    again = lm.train(texts, known, sizes / sizes.sum(), rounds=3)
    assert all(np.isfinite(x).all() for x in (*once, *again)) and not np.allclose(once.last, again.last)


def test_language_model_without_training_texts(spark, empty):
    ids = [i for i in range(300) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    docs = spark.createDataFrame([(i, "some words") for i in ids], "doc_id long, text string")
    assert [(r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.score(docs).collect()] == [(0, 0, 0.0, 0.0)] * 3
    assert lm.score(pick(empty, "doc_id", "text")).count() == 0


def test_language_held_out_accuracy(sample):
    truth = {r.doc_id: r.lang for r in sample.collect()}
    got = language.identify(sample).collect()
    held = [r for r in got if r.held_out and truth[r.doc_id]]
    assert len(got) == len(truth) and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95


def test_language_of_edges(edges, clashing, empty):
    for docs in (edges, clashing):
        got = language.identify(docs).collect()
        assert len(got) == len(EDGES) and all(0 <= r.score <= 1 for r in got)
        none = {r.doc_id for r in got if r.lang_pred == "und"}
        assert none == {2, 3, 4, 10}
    assert language.identify(empty).count() == 0
    assert {r.lang_pred for r in language.predict(pick(edges, "doc_id", "text"), None).collect()} == {"und"}


def fingerprint(text, n=4):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 42) for i in range(max(1, len(w) - n + 1))] if w else []
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in hs) > len(hs))


def classes(fps, bits=4):
    names = list(fps)
    up = {d: d for d in names}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            if bin(fps[a] ^ fps[b]).count("1") <= bits:
                up[max(root(a), root(b))] = min(root(a), root(b))
    return {d: root(d) for d in names}


def test_near_duplicates_equal_brute_force(sample):
    fps = {r.doc_id: fingerprint(r.text) for r in sample.collect()}
    want = classes(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(pick(sample, "doc_id", "text")).collect()}
    assert got == {d: (f"{fps[d]:016x}", want[d]) for d in fps}


@pytest.mark.parametrize("dense", [8, 0])
def test_grid_loses_no_link(monkeypatch, dense):
    """Clusters of every distance; each link within four bits is kept or joined by a path."""
    monkeypatch.setattr(simhash, "DENSE", dense)
    rng = np.random.default_rng(7)
    points = set()
    for _ in range(25):
        x = int(rng.integers(0, 2**63)) << 1 | int(rng.integers(0, 2))
        for _ in range(12):
            points.add(x)
            for k in rng.integers(0, 64, rng.integers(1, 6)):
                x ^= 1 << int(k)
    points = sorted(points)
    fps = np.array(points, np.uint64).view(np.int64)
    who, where = simhash.cells(fps)
    order = np.argsort(where, kind="stable")
    links = simhash.cell_links(where[order], fps[who[order]], 4)
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 4 for a, b in links) and len(links) < len(points)
    own = {int(p): int(p) for p in fps}

    def root(x):
        while own[x] != x:
            x = own[x]
        return x

    for a, b in links:
        own[max(root(a), root(b))] = min(root(a), root(b))
    want = classes({int(p): int(p) & (2**64 - 1) for p in fps})
    assert {p: root(p) for p in own} == want


def test_crowded_cells_are_split_without_loss(spark, monkeypatch):
    """Points that share half their bits crowd one cell; finer cells by the other half lose no link."""
    rng = np.random.default_rng(5)
    points = {0x55555555 << 32 * h | int(x) << 32 * (1 - h) for h in (0, 1) for x in rng.integers(0, 2**32, 700)}
    for x in list(points)[::4]:
        for _ in range(3):
            for k in rng.integers(0, 64, rng.integers(1, 5)):
                x ^= 1 << int(k)
            points.add(x)
    fps = np.array(sorted(points), np.uint64).view(np.int64).tolist()
    monkeypatch.setattr(simhash, "HELD", 256)
    monkeypatch.setattr(simhash, "CROWDED", 128)
    links = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()]
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 4 for a, b in links)
    own = {p: p for p in fps}

    def root(x):
        while own[x] != x:
            x = own[x]
        return x

    for a, b in links:
        own[max(root(a), root(b))] = min(root(a), root(b))
    assert {p: root(p) for p in own} == classes({p: p & (2**64 - 1) for p in fps})


def test_a_crowded_cell_is_not_held():
    """Of 200,000 points in one cell no more than HELD and a batch are kept; all others leave as they come."""
    import pyarrow as pa

    fp = np.sort((0x55555555 << 32 | np.random.default_rng(3).integers(0, 2**32, 200_000)).astype(np.int64))
    cell = np.full(len(fp), 1 << 32 | 77, np.int64)  # a cell of the upper half
    batches = (pa.RecordBatch.from_arrays([pa.array(cell[i : i + 10_000]), pa.array(fp[i : i + 10_000])], ["cell", "fp"]) for i in range(0, len(fp), 10_000))
    sizes, seen = [], 0
    for batch in simhash.meeting(4, 1000, 4096)(batches):
        assert set(batch.column(0).to_pylist()) == {simhash.LATER}
        sizes.append(batch.num_rows)
        seen += batch.num_rows
    assert seen == len(fp) and max(sizes) <= 2 * 4096
    finer, _ = simhash.split_cells(cell, fp)
    assert np.unique(finer, return_counts=True)[1].max() < len(fp) / 50


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 140)] + [(-5, 3), (7, 7)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: -5 for i in [*range(1, 41), -5]}, **{k: 100 for k in range(100, 140)}}


def test_near_duplicates_of_edges(edges, clashing, empty):
    for docs in (edges, pick(clashing, "doc_id", "text")):
        got = simhash.near_duplicates(pick(docs, "doc_id", "text")).collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, *_ in EDGES)
        by = {r.doc_id: r for r in got}
        assert by[2].component_id == by[3].component_id == by[4].component_id == 2 and by[2].fingerprint == "0" * 16
        assert by[1].component_id == 1
    assert simhash.near_duplicates(pick(empty, "doc_id", "text")).count() == 0


def test_first_of_each_keeps_one_row_of_a_class(edges, empty):
    kept = simhash.first_of_each(edges)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == edges.columns and sorted(map(str, ids)) == sorted(map(str, [1, 2, None, 5, 6, 7, 8, 9, 10]))
    assert simhash.first_of_each(empty).count() == 0


def test_first_of_each_tells_rows_of_one_id_or_none_apart(spark):
    import random

    draw = random.Random(3)
    a, b, c, d = (" ".join(draw.choices("one two three four five six seven eight nine ten".split(), k=80)) for _ in range(4))
    rows = [(1, a), (2, a), (2, b), (3, c), (3, d), (3, d), (5, d), (None, c), (None, "x y"), (None, "x y"), (None, "X  y"), (None, "z"), (4, None), (None, "")]
    got = simhash.first_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    left = Counter((r.doc_id, r.text if r.text is None else " ".join(r.text.lower().split())) for r in got)
    assert left == Counter([(1, a), (2, b), (3, c), (3, d), (None, "x y"), (None, "z"), (4, None)])


def test_language_filter_without_labels_keeps_texts_with_a_letter(spark, edges):
    from pyspark.sql import functions as F

    import corpus_pipeline

    docs = edges.withColumn("lang", F.lit(None).cast("string"))
    got = [r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()]
    assert sorted(map(str, got)) == sorted(str(d) for d, t, *_ in EDGES if any(map(str.isalpha, t or "")))
    assert None in got and len(got) == 8


def similar_classes(texts, n=5, similarity=0.8):
    """Classes that pairs of Jaccard similarity on distinct n-word shingles connect; texts by name."""
    sets = {}
    for d, text in texts.items():
        w = words(text)
        sets[d] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    up = {d: d for d in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    names = list(texts)
    for i, a in enumerate(names):
        for b in names[:i]:
            common = len(sets[a] & sets[b])
            if common >= similarity * (len(sets[a]) + len(sets[b]) - common):
                up[max(root(a), root(b))] = min(root(a), root(b))
    return {d: root(d) for d in names}


def test_near_copies_equal_brute_force(spark):
    """Texts with words changed, dropped or added so that pairs lie on both sides of the limit."""
    import random

    draw = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(40):
        first = draw.choices(vocabulary, k=draw.randint(3, 200))
        for _ in range(5):
            copy = list(first)
            for _ in range(draw.randint(0, 5)):
                copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
            texts.append(" ".join(copy + draw.choices(vocabulary, k=draw.choice([0, 0, 3]))))
    want = {d for d, c in similar_classes(dict(enumerate(texts))).items() if c == d}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in simhash.first_of_each(docs).collect()} == want and len(want) < 150


def templated(seed: int, share: float, texts: int = 220, copies: int = 120, length: int = 400) -> list[str]:
    """Texts that share a template, the rest their own, and copies of some with a few words changed."""
    import random

    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    shared = draw.choices(vocabulary, k=int(share * length))
    out = [" ".join(shared[: len(shared) // 2] + draw.choices(vocabulary, k=length - len(shared)) + shared[len(shared) // 2 :]) for _ in range(texts)]
    for k in range(copies):
        w = out[k % texts].split()
        for _ in range(draw.randint(3, 7)):
            w[draw.randrange(len(w))] = draw.choice(vocabulary)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("share, often, sent", [(0.75, simhash.OFTEN, simhash.KEYS_SENT), (0.85, simhash.OFTEN, 0), (0.75, 1 << 30, simhash.KEYS_SENT)])
def test_near_copies_that_share_a_template_equal_brute_force(spark, monkeypatch, share, often, sent):
    """The template's shingles are hot keys of texts that are not linked; no link is lost, whether they are known to be common or not, keys are sent or joined."""
    monkeypatch.setattr(simhash, "OFTEN", often)
    monkeypatch.setattr(simhash, "KEYS_SENT", sent)
    texts = dict(enumerate(templated(int(100 * share), share)))
    want = {d for d, c in similar_classes(texts).items() if c == d}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert (len(simhash.common_shingles(docs)) > 50) == (often == 64)
    assert {r.doc_id for r in simhash.first_of_each(docs).collect()} == want and 200 < len(want) < 300


def test_families_of_copies_equal_brute_force(spark):
    """Families in which each text is like some others only, chains and crowds, beside texts that hold a passage of theirs."""
    import random

    draw = random.Random(8)
    vocabulary = [f"w{i}" for i in range(2000)]
    texts = []
    for size in (150, 40, 12):
        words_now = draw.choices(vocabulary, k=120)
        for _ in range(size):
            words_now = list(words_now)
            words_now[draw.randrange(120)] = draw.choice(vocabulary)
            if draw.random() < 0.3:
                words_now[draw.randrange(100) :][:3] = draw.choices(vocabulary, k=2)
            texts.append(" ".join(words_now))
        texts += [" ".join(words_now[:60] + draw.choices(vocabulary, k=100)) for _ in range(30)]
    named = dict(enumerate(texts))
    want = {d for d, c in similar_classes(named).items() if c == d}
    docs = spark.createDataFrame(list(named.items()), "doc_id long, text string").repartition(4)
    assert {r.doc_id for r in simhash.first_of_each(docs).collect()} == want


@pytest.mark.parametrize("texts", [200, 400])
def test_a_crowd_of_copies_at_the_limit_is_not_compared_in_pairs(spark, monkeypatch, texts):
    """Variants of one text, many too different to be linked: the pairs verified stay a few a text, and no link is lost."""
    import random

    draw = random.Random(texts)
    vocabulary = [f"w{i}" for i in range(5000)]
    first = draw.choices(vocabulary, k=150)
    named = {0: " ".join(first)}
    for k in range(1, texts):
        words_now = list(first)
        for at in draw.sample(range(150), draw.randint(2, 6)):
            words_now[at] = draw.choice(vocabulary)
        named[k] = " ".join(words_now[: draw.choice([150, 150, 145])])
    counted, verified = [], simhash.verified

    def counting(pairs, *more):
        counted.append(pairs.count())
        return verified(pairs, *more)

    monkeypatch.setattr(simhash, "verified", counting)
    want = {d for d, c in similar_classes(named).items() if c == d}
    docs = spark.createDataFrame(list(named.items()), "doc_id long, text string").repartition(4)
    assert {r.doc_id for r in simhash.first_of_each(docs).collect()} == want and 0.3 * texts < len(want) < 0.9 * texts
    assert sum(counted) < 12 * texts


def test_differences_from_a_hub_of_similar_sets_meet():
    """Two similar sets of which one at least is not similar to the hub share a key among the first that they show, and pass the bounds of the join."""
    draw = np.random.default_rng(12)
    told = simhash.differing(0.8, SimpleNamespace(value=None))
    met = 0
    for _ in range(3000):
        hub = np.unique(draw.integers(0, 1 << 60, int(draw.integers(1, 60))).astype(np.uint64))
        some = lambda of, most: np.unique(np.concatenate([of[draw.random(len(of)) > draw.choice([0, 0.1, 0.3])], draw.integers(0, 1 << 60, int(draw.integers(0, most))).astype(np.uint64)]))
        x = some(hub, 30)
        y = some(x, 4)
        if not len(x) or not len(y) or not simhash.jaccard(0.8)(len(x), x, len(y), y):
            continue
        rows = [dict(zip([f.split()[0] for f in simhash.FARTHER.split(", ")], told(name, b"hub-hub-hub-hub-", (len(hub), hub), (len(k), k)))) for name, k in ((b"x", x), (b"y", y))]
        low, high = sorted(rows, key=lambda r: r["excess"])
        assert sum(((low[p] ^ high[p]) & (1 << 64) - 1).bit_count() for p in simhash.PARITY) <= len(np.setxor1d(x, y))
        if low["near"] and high["near"]:
            continue
        met += 1
        assert not high["near"]
        shown, ahead = high["keys"].tolist(), low["keys"][: low["ahead"]].tolist()
        shared = [(shown.index(k), q) for q, k in enumerate(ahead) if k in shown]
        assert any(min(high["size"] - p, low["size"] - q) >= (low["excess"] + high["excess"]) / 2 - simhash.LEEWAY for p, q in shared)
    assert met > 100


def test_prefixes_of_similar_sets_meet():
    """Any two sets of similarity 0.8 share a prefix shingle, and their first shared one passes the position bound, common shingles or not."""
    draw = np.random.default_rng(6)
    for _ in range(400):
        n = int(draw.integers(1, 60))
        a = np.unique(draw.integers(0, 1 << 60, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[draw.random(len(a)) > 0.12], draw.integers(0, 1 << 60, int(draw.integers(0, 8))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if not both or both < 0.8 * (len(a) + len(b) - both):
            continue
        common = np.sort(draw.choice(np.union1d(a, b), int(draw.integers(0, len(a))), replace=False))
        x, y = simhash.prefix(a, 0.8, common).tolist(), simhash.prefix(b, 0.8, common).tolist()
        first = [(i, y.index(v)) for i, v in enumerate(x) if v in y][0]
        assert simhash.bounded(0.8, SimpleNamespace(value=common))(len(a), np.array(x, np.uint64), len(b), np.array(y, np.uint64))
        assert min(len(a) - first[0], len(b) - first[1]) >= 0.8 / 1.8 * (len(a) + len(b)) - 1e-9


def test_the_bound_of_two_prefixes_is_never_below_what_they_share():
    draw = np.random.default_rng(7)
    dropped = 0
    for _ in range(500):
        pool = np.unique(draw.integers(0, 1 << 40, 60).astype(np.uint64) << np.uint64(20))
        a, b = (np.sort(draw.choice(pool, int(draw.integers(1, len(pool))), replace=False)) for _ in range(2))
        common = np.sort(draw.choice(pool, int(draw.integers(0, 40)), replace=False))
        both = len(np.intersect1d(a, b))
        for limit in (0.5, 0.8, both / (len(a) + len(b) - both) or 0.1):
            fits = simhash.bounded(limit, SimpleNamespace(value=common))(len(a), simhash.prefix(a, limit, common), len(b), simhash.prefix(b, limit, common))
            assert fits or both < limit * (len(a) + len(b) - both)
            dropped += not fits
    assert dropped > 100


def test_common_shingles_are_counted_over_all_tasks(spark):
    """A text a task: no task meets the template twice, yet each of its shingles is counted once for each text."""
    shared = " ".join(f"t{i}" for i in range(20))
    rows = [(k, f"{shared} " + " ".join(f"own{k}x{i}" for i in range(12))) for k in range(80)]
    common = simhash.common_shingles(spark.createDataFrame(spark.sparkContext.parallelize(rows, 80), "doc_id long, text string"))
    assert len(common) == 16 and set(common.of(np.unique(simhash.shingle_hashes(shared, 5)[1])).tolist()) == {80}
    assert not common.of(simhash.shingle_hashes("own1x0 own1x1 own1x2 own1x3 own1x4", 5)[1]).any()


def test_prefixes_by_counts_of_similar_sets_meet():
    """As with common shingles that are not told apart: rarer ones come first, similar sets share a prefix shingle and their prefixes do not rule them out."""
    draw = np.random.default_rng(9)
    met = 0
    for _ in range(400):
        n = int(draw.integers(1, 60))
        a = np.unique(draw.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[draw.random(len(a)) > 0.12], draw.integers(0, 1 << 63, int(draw.integers(0, 8))).astype(np.uint64)]))
        some = draw.choice(np.union1d(a, b), int(draw.integers(0, len(a))), replace=False) >> np.uint64(simhash.DROPPED)
        common = simhash.Counts(some, draw.integers(9, 40, len(some)))
        both = len(np.intersect1d(a, b))
        x, y = simhash.prefix(a, 0.8, common), simhash.prefix(b, 0.8, common)
        assert np.all(np.diff(common.of(x)) >= 0)
        if both and both >= 0.8 * (len(a) + len(b) - both):
            met += 1
            assert len(np.intersect1d(x, y)) and simhash.bounded(0.8, SimpleNamespace(value=common))(len(a), x, len(b), y)
    assert met > 50


def test_first_of_each_loses_no_class_where_ids_repeat(spark, clashing):
    draw = np.random.default_rng(4)
    a, b, d = (" ".join(f"v{i}" for i in draw.integers(0, 500, 90)) for _ in range(3))
    near = lambda x: x.rsplit(" ", 1)[0] + " changed"
    rows = [(3, a, "x"), (7, a, "x"), (7, b, "x"), (9, near(b), "x"), (11, d, "x"), (11, near(a), "x"), (None, d + " !", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    assert Counter((r.doc_id, r.text) for r in simhash.first_of_each(docs).collect()) == Counter([(3, a), (7, b), (11, d)])
    assert simhash.first_of_each(clashing).columns == clashing.columns


def test_pipeline_equals_its_stages_by_brute_force(spark, sample, tmp_path):
    import corpus_pipeline
    from tests.llm.test_quality_media_shards import brute

    docs = sample
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.materialize(stage(spark, docs, ""), name)
        assert after.schema == docs.schema or after.columns == docs.columns
        rows = docs.collect()
        if name == "quality_rules":
            want = {r.doc_id for r in rows if brute(r.text)[-1]}
        elif name == "language_id":
            want = {r.doc_id for r in rows}  # all these are plain text of a known language
        else:
            want = {d for d, c in similar_classes({r.doc_id: r.text for r in rows}).items() if d == c}
        assert {r.doc_id for r in after.collect()} == want
        docs = after
    from tests.conftest import SF

    out = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == want


def test_pipeline_of_edges(spark, edges, clashing, empty):
    """What each stage keeps of nulls, empty, very long and repeated texts, with and without clashing columns."""
    import corpus_pipeline
    from tests.llm.test_quality_media_shards import brute

    for docs in (edges, clashing):
        kept = []
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, "")
            assert after.columns == docs.columns
            kept.append(Counter(r.doc_id for r in after.collect()))
        assert kept[0] == Counter(d for d, t, *_ in EDGES if brute(t)[-1])
        assert set(kept[1]) <= {d for d, t, *_ in EDGES if any(map(str.isalpha, t or ""))} and kept[1][1] in (0, 2)
        assert kept[2] == Counter([1, 2, None, 5, 6, 7, 8, 9, 10])  # one of two equal rows; one of null, empty and white space
        packed = corpus_pipeline.pack(spark, docs, "").collect()
        assert {r.doc_id for r in packed} == {d for d, *_ in EDGES} and sum(r.start == 0 for r in packed) == len(EDGES)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_language_filter_rejects(spark):
    """Texts without letters go; labelled prose of a learned language stays."""
    draw = np.random.default_rng(2)
    en, fr = "the of and with from this have river stone house".split(), "le la et avec pour cette rivière maison été dans".split()
    rows = [(i, " ".join(draw.choice(en if i % 2 else fr, 60)), "en" if i % 2 else "fr") for i in range(200)] + [(900, "12345 67890 -- 22", None), (901, None, "en"), (902, "", "fr")]
    import corpus_pipeline

    got = {r.doc_id for r in corpus_pipeline.language_id(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "").collect()}
    assert not got & {900, 901, 902} and len(got) >= 198


def plain_subwords(word):
    w = f"<{word}>"
    out = []
    for k in (1, 2, 3):
        for i in range(len(w) - k + 1):
            code = 0
            for c in w[i : i + k]:
                code = (code * 0x110001 + ord(c) + 1) % 2**64
            x = (code + 0x9E3779B97F4A7C15) % 2**64
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
            x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
            out.append((x ^ x >> 31) % language.BUCKETS)
    return [*out, zlib.crc32(word.encode()) % language.BUCKETS]


def test_language_prediction_equals_plain_loops():
    rng = np.random.default_rng(9)
    model = language.Model(["a", "b", "c"], rng.normal(size=(language.BUCKETS, 3)).astype(np.float32), rng.normal(size=3).astype(np.float32), 0.7, 0.0)
    texts = ["Hello wide world", "ÉTÉ", "x", "a b " * 50, "12 34", "", None]
    for (got, score), text in zip(language.Predictor(model)(texts), texts):
        if not text or not any(map(str.isalpha, text)):
            assert (got, score) == ("und", 0.0)
            continue
        buckets = [b for w in text.lower().split() for b in plain_subwords(w)]
        z = [(sum(float(model.table[b, k]) for b in buckets) / len(buckets) + float(model.bias[k])) / 0.7 for k in range(3)]
        p = [math.exp(x - max(z)) for x in z]
        assert got == "abc"[z.index(max(z))] and abs(score - max(p) / sum(p)) < 1e-5


def test_language_fit_equals_plain_loops(monkeypatch):
    """One step of the trainer against loops over texts, subwords and numbers."""
    for name, value in (("EPOCHS", 1), ("STEPS", 0), ("BATCH", 4), ("BUCKETS", 16)):
        monkeypatch.setattr(language, name, value)
    texts = [(np.array([1, 5]), np.array([0.25, 0.75])), (np.array([5]), np.array([1.0])), (np.array([2, 3, 5]), np.array([0.2, 0.2, 0.6]))]
    answers, k, d = np.array([0, 1, 1]), 2, language.WIDTH
    draw = np.random.default_rng(7)
    embed = draw.normal(0, 0.1, (16, d)).astype(np.float32).astype(float)
    weight = draw.normal(0, 0.1, (d, k)).astype(np.float32).astype(float)
    g_embed, g_weight, g_bias = np.zeros((16, d)), np.zeros((d, k)), np.zeros(k)
    for (rows, share), y in zip(texts, answers):
        mean = [sum(share[j] * embed[r, i] for j, r in enumerate(rows)) for i in range(d)]
        z = [sum(mean[i] * weight[i, c] for i in range(d)) for c in range(k)]
        e = [math.exp(x - max(z)) for x in z]
        miss = [e[c] / sum(e) - (c == y) for c in range(k)]
        for c in range(k):
            g_bias[c] += miss[c]
            for i in range(d):
                g_weight[i, c] += mean[i] * miss[c]
        for j, r in enumerate(rows):
            for i in range(d):
                g_embed[r, i] += share[j] * sum(miss[c] * weight[i, c] for c in range(k))
    new_weight = weight - language.RATE * g_weight / np.sqrt(1e-6 + g_weight**2)
    new_bias = -language.RATE * g_bias / np.sqrt(1e-2 + g_bias**2)
    new_embed = embed.copy()
    for r in (1, 2, 3, 5):
        new_embed[r] -= language.RATE * g_embed[r] / np.sqrt(1e-8 + (g_embed[r] ** 2).sum())
    table, bias = language.fit(texts, answers, k)
    assert np.allclose(bias, new_bias, atol=1e-4) and np.allclose(table, new_embed @ new_weight, atol=1e-3)


@pytest.mark.parametrize("name", ["op1_licenses", "op7_quality_rules"])
def test_queries_equal_their_twins(spark, name):
    import duckdb

    from groundwork.llm import queries
    from tests.conftest import SF
    from tests.test_oracles import value

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = con.execute(queries.ORACLES[name])
    at = [[d[0] for d in found.description].index(c) for c in columns]
    assert sorted(tuple(value(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(value(r[i]) for i in at) for r in found.fetchall())
