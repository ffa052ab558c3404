"""Packing into sequences: first-fit decreasing with a tournament tree, in randomised groups of documents.

A document's ids plus an end id are cut at the capacity: full pieces are sequences of their own,
the rest of each document is packed. Rests are dealt at random into groups of about GROUP rests (the
number of groups follows the row count), so no task holds more than a group; inside a group the
rests go by falling length into the first sequence with room, found by a tree whose inner nodes
hold the largest room below. Ids never leave the worker; only piece lengths are shuffled.

Defined results: a null or empty text is the end id alone; repeated rows are packed each; a null
doc_id is packed too; extra columns are ignored; an empty table gives an empty result. Ties in
length keep the order of partition and row. No text is cut short: each id lies in one piece.
"""

from __future__ import annotations

import functools
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.llm.common import per_text, splitmix
from groundwork.llm.pieces import Store, library, ranges

GROUP = 4096
BULK, LINE = 16_384, 256  # pieces encoded at a time, pieces a line
REMEMBERED = 500_000  # pieces, about 100 bytes each
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, grp long, ord long, sequence_id long, offset long"


class Ids:
    """Ids by the tokenizers library, piece by piece, as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        self.tokenizer = library(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = {t.content: np.array([k], "<u4") for k, t in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.feed = feed[0] if len(feed) == 1 else None
        self.store = Store(self.library_ids, REMEMBERED)

    def library_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces and how many each has. Pieces without a line feed are encoded LINE together, each ended by one, whose id tells them apart."""
        plain = np.array([self.feed is not None and not any(map(str.isspace, x[1:])) and (x[0] != " " or len(x) > 1) and not (x[0] != " " and x[0].isspace()) for x in pieces], bool)
        ids, size = [], np.zeros(len(pieces), np.int64)
        for whole in (True, False):
            which = np.flatnonzero(plain == whole)
            for at in range(0, len(which), BULK):
                part = which[at : at + BULK]
                some = [pieces[k] for k in part.tolist()]
                if whole:
                    flat, _ = self.flat(["\n".join([*some[i : i + LINE], ""]) for i in range(0, len(some), LINE)])
                    ends = np.flatnonzero(flat == self.feed)
                    if len(ends) != len(some):
                        raise ValueError("a piece of this tokenizer holds the line feed's id")
                    size[part] = np.diff(ends, prepend=-1) - 1
                    flat = np.delete(flat, ends)
                else:
                    flat, size[part] = self.flat(some)
                ids.append(flat)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        begin = np.empty(len(pieces), np.int64)
        begin[order] = np.cumsum(size[order]) - size[order]
        return np.concatenate([np.empty(0, "<u4"), *ids])[ranges(begin, size)], size

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), "<u4", int(size.sum())), size

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        parts = [self.cut.split(t) if self.cut else [t] for t in texts]  # every other part is a special string
        flat, edges = self.store.encoded([x for p in parts for x in p[::2]])
        plain = iter(np.split(flat, edges[1:-1]))
        return [next(plain) if len(p) == 1 else np.concatenate([self.special[x] if k % 2 else next(plain) for k, x in enumerate(p)]) for p in parts]


@functools.lru_cache(2)
def ids_of(path: str) -> Ids:
    return Ids(path)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; equal lengths keep their order."""
    n = len(lengths)
    width = 1 << max(0, (n - 1).bit_length())
    room = [capacity] * (2 * width)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k in np.argsort(-lengths, kind="stable").tolist():
        size, node = int(lengths[k]), 1
        while node < width:
            node *= 2
            if room[node] < size:
                node += 1
        bins[k], offsets[k] = node - width, capacity - room[node]
        room[node] -= size
        node >>= 1
        while node:
            room[node] = max(room[2 * node], room[2 * node + 1])
            node >>= 1
    return bins, offsets


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, group: int = GROUP) -> DataFrame:
    """docs (doc_id, text) -> a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    groups = max(1, -(-docs.count() // group))

    def cut(parts):
        from pyspark import TaskContext

        task, row, full = TaskContext.get().partitionId(), 0, 0
        c = ids_of(path)
        for doc_id, text in parts:
            out = {k.split()[0]: [] for k in PIECES.split(", ")}
            dealt = (splitmix(np.uint64(task << 40) + np.arange(row, row + len(doc_id), dtype=np.uint64)) % np.uint64(groups)).tolist()
            for d, ids, where in zip(doc_id, c.batch([t or "" for t in text]), dealt):
                ids = np.append(ids, np.uint32(end_id))
                n = len(ids)
                for at in range(0, n, capacity):
                    size = min(capacity, n - at)
                    whole = size == capacity
                    values = (d, at, size, zlib.crc32(ids[at : at + size]), n, None if whole else where, task << 40 | row, 1 << 62 | task << 40 | full if whole else None, 0 if whole else None)
                    for column, v in zip(out.values(), values):
                        column.append(v)
                    full += whole
                row += 1
            yield out

    pieces = per_text(docs, cut, PIECES)

    # One pass over the texts: full pieces and rests go through the same exchange, told apart by their group.
    key = F.coalesce("grp", F.pmod("sequence_id", F.lit(groups)) - groups)  # negative for full pieces, dealt evenly

    def fill(keys, table):
        if keys[0].as_py() < 0:
            return table
        table = table.sort_by("ord")
        bins, offsets = first_fit_decreasing(table["length"].to_numpy(), capacity)
        for name, values in (("sequence_id", bins + (keys[0].as_py() << 20)), ("offset", offsets)):
            table = table.set_column(table.column_names.index(name), name, pa.array(values, pa.int64()))
        return table

    packed = pieces.groupBy(key.alias("k")).applyInArrow(fill, PIECES)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
