"""Byte-level BPE: encode by a segment tree over byte positions, decode by table.

Method: each leaf of the tree stands for a byte position and holds the rank of the pair that starts
there; inner nodes hold the leftmost minimum below. The root names the next merge; a merge changes
three leaves (the merged pair, the one before it and the swallowed one) and repairs their paths,
so it costs O(log n). Short pieces run as a forest: one numpy array holds the trees of all pieces
of a size, and each round merges once in every live tree. Long pieces run one tree each.

Defined results: null and empty texts have no ids (sha-256 of nothing); repeated rows repeat their
results; extra columns are ignored; an empty table gives an empty result. No text is cut.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from groundwork.llm.common import per_text
from groundwork.llm.pieces import Store

FAR = np.int64(1) << 60
FOREST = 256  # bytes; longer pieces get a tree of their own


class Ranks:
    """A rank file with every pair of tokens that makes a token."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
        self.token = [b""] * (max(self.rank.values()) + 1)
        for t, r in self.rank.items():
            self.token[r] = t
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        get, keys, made = self.rank.get, [], []
        for t, r in self.rank.items():
            for i in range(1, len(t)):
                a, b = get(t[:i]), get(t[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    made.append(r)
        order = np.argsort(keys := np.array(keys, np.int64))
        self.keys, self.made = keys[order], np.array(made, np.int64)[order]
        self.pair = dict(zip(keys.tolist(), made))
        self.text = [str(i) for i in range(len(self.token))]

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, FAR if it makes no token."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], FAR)


@functools.lru_cache(2)
def ranks(path: str) -> Ranks:
    return Ranks(path)


def forest(r: Ranks, pieces: list[bytes]) -> list[list[int]]:
    """Ids of pieces of 2 to FOREST bytes: trees of one width side by side."""
    length = np.fromiter(map(len, pieces), np.int64, len(pieces))
    width = 1 << int(length.max() - 1).bit_length()
    n = len(pieces)
    flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
    ids = r.byte[flat]
    place = np.arange(width)
    real = place[None, :] < (length - 1)[:, None]
    tree = np.full((n, 2 * width), FAR, np.int64)
    rank = r.pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
    tree[:, width : 2 * width - 1] = np.where(real[:, :-1] & (rank < FAR), rank * width + place[:-1], FAR)
    w = width
    while w > 1:
        tree[:, w // 2 : w] = np.minimum(tree[:, w : 2 * w : 2], tree[:, w + 1 : 2 * w : 2])
        w //= 2
    after = np.tile(place + 1, (n, 1))
    before = np.tile(place - 1, (n, 1))
    live = place[None, :] < length[:, None]
    rows = np.flatnonzero(tree[:, 1] < FAR)
    while len(rows):
        best = tree[rows, 1]
        at, new = best % width, best // width
        gone = after[rows, at]
        right = after[rows, gone]
        left = before[rows, at]
        ids[rows, at] = new
        live[rows, gone] = False
        after[rows, at] = right
        has_r, has_l = right < length[rows], left >= 0
        before[rows[has_r], right[has_r]] = at[has_r]
        rank_r = np.where(has_r, r.pairs(new, ids[rows, np.where(has_r, right, 0)]), FAR)
        rank_l = np.where(has_l, r.pairs(ids[rows, np.where(has_l, left, 0)], new), FAR)
        tree[rows, width + gone] = FAR
        tree[rows, width + at] = np.where(rank_r < FAR, rank_r * width + at, FAR)
        lrows, lat = rows[has_l], left[has_l]
        tree[lrows, width + lat] = np.where(rank_l[has_l] < FAR, rank_l[has_l] * width + lat, FAR)
        row3, node = np.concatenate([rows, rows, lrows]), np.concatenate([width + at, width + gone, width + lat])
        node = node >> 1
        for _ in range(width.bit_length() - 1):
            tree[row3, node] = np.minimum(tree[row3, 2 * node], tree[row3, 2 * node + 1])
            node = node >> 1
        rows = rows[tree[rows, 1] < FAR]
    flat_ids, ends = ids[live].tolist(), np.cumsum(live.sum(axis=1)).tolist()
    return [flat_ids[i:j] for i, j in zip([0, *ends[:-1]], ends)]


def single(r: Ranks, piece: bytes) -> list[int]:
    """Ids of one long piece, by one tree in plain lists."""
    n = len(piece)
    width = 1 << (n - 1).bit_length()
    far, pair = int(FAR), r.pair
    ids = [int(r.byte[b]) for b in piece]
    tree = [far] * (2 * width)
    for i in range(n - 1):
        k = pair.get(ids[i] << 32 | ids[i + 1])
        if k is not None:
            tree[width + i] = k * width + i
    for i in range(width - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\1" * n)

    def put(at: int, left: int, right: int) -> None:
        k = pair.get(ids[left] << 32 | ids[right]) if left >= 0 and right < n else None
        tree[width + at] = far if k is None else k * width + at
        node = (width + at) >> 1
        while node:
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
            node >>= 1

    while tree[1] < far:
        new, at = divmod(tree[1], width)
        gone = after[at]
        right, left = after[gone], before[at]
        ids[at], live[gone], after[at] = new, 0, right
        if right < n:
            before[right] = at
        put(gone, -1, n)
        put(at, at, right)
        if left >= 0:
            put(left, left, at)
    return [i for i, x in zip(ids, live) if x]


def encode_pieces(r: Ranks, pieces: list[str]) -> list[tuple[int, ...]]:
    """Ids of each piece, those of one width together."""
    out: list = [None] * len(pieces)
    sized: dict[int, list[tuple[int, bytes]]] = {}
    for k, piece in enumerate(pieces):
        raw = piece.encode()
        whole = r.rank.get(raw)
        if whole is not None:
            out[k] = (whole,)
        elif len(raw) > FOREST:
            out[k] = tuple(single(r, raw))
        else:
            sized.setdefault((len(raw) - 1).bit_length(), []).append((k, raw))
    for group in sized.values():
        for i in range(0, len(group), 8192):
            some = group[i : i + 8192]
            for (k, _), ids in zip(some, forest(r, [raw for _, raw in some])):
                out[k] = tuple(ids)
    return out


class Coder:
    """encode(text) and decode(ids) for one rank file; remembers pieces within a bound."""

    def __init__(self, path: str):
        self.ranks = ranks(path)
        self.store = Store(self.flat)

    def flat(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = encode_pieces(self.ranks, pieces)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum())), size

    def encode_batch(self, texts: list[str]) -> Iterator[list[int]]:
        flat, edges = self.store.encoded(texts)
        for i, j in zip(edges.tolist(), edges[1:].tolist()):
            yield flat[i:j].tolist()

    def encode(self, text: str) -> list[int]:
        return next(self.encode_batch([text]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.ranks.token.__getitem__, ids))


@functools.lru_cache(2)
def coder(path: str) -> Coder:
    return Coder(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs (doc_id, text) -> doc_id, ids array<int>, decoded binary."""

    def run(parts):
        c = coder(path)
        for doc_id, text in parts:
            ids = list(c.encode_batch([t or "" for t in text]))
            yield {"doc_id": doc_id, "ids": ids, "decoded": [c.decode(x) for x in ids]}

    return per_text(docs, run, "doc_id long, ids array<int>, decoded binary")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """The same ids and bytes as encode(), digested where they are made, so they never leave the worker."""

    def run(parts):
        c = coder(path)
        name = c.ranks.text.__getitem__
        for doc_id, text in parts:
            n, ids_sha, decoded_sha = [], [], []
            for ids in c.encode_batch([t or "" for t in text]):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(name, ids)).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield {"doc_id": doc_id, "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": decoded_sha}

    return per_text(docs, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
