"""Pre-token pieces of byte-level BPE: the split by letters, numbers, other signs and white space, on whole arrays."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable

import numpy as np

from groundwork.llm.common import splitmix

OTHER, LETTER, NUMBER, SPACE = range(4)

#: The code points with Unicode's White_Space property.
WHITE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


#: The code points above plane 3 and outside plane 14 are unassigned or private in every Unicode version.
PLANES = (*range(0x40000), *range(0xE0000, 0xF0000))


@functools.lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point, as the tokenizers library tells them, so that its Unicode version counts and not Python's.

    One string of all code points is split by the library; each run of one class is told by whether
    its last character stays in one piece with a letter, or with a digit, before it.
    """
    from tokenizers import pre_tokenizers

    cut = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    table = np.full(0x110000, OTHER, np.uint8)
    known = [c for c in PLANES if not 0xD800 <= c < 0xE000]
    place, line = np.array(known), "".join(map(chr, known))
    for _, (i, j) in cut(line):
        one = lambda before: len(cut(before + line[j - 1])) == 1  # noqa: E731, B023
        table[place[i:j]] = LETTER if one("a") else NUMBER if one("1") else OTHER
    table[list(WHITE)] = SPACE
    return table


END = 0x110000  # stands after each text where many are split at once


@functools.lru_cache(1)
def classes_and_end() -> np.ndarray:
    return np.append(classes(), np.uint8(SPACE + 1))


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def starts(cp: np.ndarray) -> np.ndarray:
    """Where pieces begin: as the pattern's alternatives would cut, worked out from runs of one class. END stands apart.

    A run of white space before something else gives up its last character; if that is a blank, it
    begins the next piece. A lone apostrophe that begins a piece takes s, t, m, d, re, ve or ll with it.
    """
    n = len(cp)
    if not n:
        return np.empty(0, np.int64)
    kind = classes_and_end()[cp]
    cut = np.zeros(n + 3, bool)
    cut[0] = True
    cut[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] > SPACE)
    first = np.flatnonzero(cut)
    after = first[1:][(kind[first[:-1]] == SPACE) & (kind[first[1:]] <= SPACE)]
    cut[after - 1] = True
    cut[after[cp[after - 1] == 32]] = False
    quote = np.flatnonzero((cp[:-1] == 39) & cut[: n - 1] & (kind[1:] == LETTER))
    if len(quote):
        a = cp[quote + 1]
        b = np.where(quote + 2 < n, cp[np.minimum(quote + 2, n - 1)], 0)
        short = np.isin(a, [ord(c) for c in "stmd"])
        long = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        cut[quote[short | long] + 1] = False
        cut[quote[short] + 2] = True
        cut[quote[long] + 3] = True
    return np.flatnonzero(cut[:n])


def split(text: str) -> list[str]:
    at = starts(points(text)).tolist()
    return [text[i:j] for i, j in zip(at, [*at[1:], len(text)])]


_stores: list["Store"] = []


def forget() -> None:
    """Empty all stores of this worker: for operators that do not use them but follow others that did."""
    for s in _stores:
        s.clear()


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indexes begin, begin + 1, ... of each range, one after another."""
    before = np.cumsum(size) - size
    return np.repeat(begin - before, size) + np.arange(int(size.sum()))


@functools.lru_cache(1)
def letters_hashed() -> np.ndarray:
    out = splitmix(np.arange(END + 1, dtype=np.uint64))
    out[END] = 0
    return out


class Store:
    """The values (ids, or a count) of pieces met before, as arrays, so that texts are encoded without a Python object a piece.

    A piece is found by a 64-bit hash of its code points and then compared with the code points kept
    for it; a piece that differs from them, or is too long to be worth its place, is encoded anew each
    time. Where more than `most` pieces are held, the half that was not met for longest is forgotten,
    so a worker's memory is bounded (about 100 bytes a piece).
    """

    BLOCK = 1 << 17  # pieces worked on at a time

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 400_000, chars: int = 64, cut: Callable = starts, dtype=np.uint32):
        self.encode, self.most, self.chars, self.cut, self.dtype = encode, most, chars, cut, dtype
        self.places = splitmix(np.arange(chars, dtype=np.uint64) + np.uint64(1 << 32)) | np.uint64(1)
        self.clear()
        _stores.append(self)

    def clear(self) -> None:
        long = lambda: np.empty(0, np.int64)
        self.key, self.entry = np.empty(0, np.uint64), long()  # sorted hashes; which entry each belongs to
        self.stamp, self.value, self.count, self.begin, self.length = long(), long(), long(), long(), long()  # of each entry
        self.values, self.letters = np.empty(0, self.dtype), np.empty(0, np.uint32)
        self.now = 0

    def halve(self) -> None:
        kept = np.sort(np.argsort(-self.stamp, kind="stable")[: self.most // 2])
        new = np.full(len(self.stamp), -1, np.int64)
        new[kept] = np.arange(len(kept))
        entry = new[self.entry]
        self.key, self.entry = self.key[entry >= 0], entry[entry >= 0]
        self.values, self.letters = self.values[ranges(self.value[kept], self.count[kept])], self.letters[ranges(self.begin[kept], self.length[kept])]
        self.stamp, self.count, self.length = self.stamp[kept], self.count[kept], self.length[kept]
        self.value, self.begin = np.cumsum(self.count) - self.count, np.cumsum(self.length) - self.length

    def append(self, pieces: list[str]) -> np.ndarray:
        """Entries of these pieces, at the end."""
        values, count = self.encode(pieces)
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        first = len(self.stamp)
        self.value = np.concatenate([self.value, len(self.values) + np.cumsum(count) - count])
        self.begin = np.concatenate([self.begin, len(self.letters) + np.cumsum(length) - length])
        self.count, self.length = np.concatenate([self.count, count]), np.concatenate([self.length, length])
        self.values = np.concatenate([self.values, np.asarray(values, self.dtype)])
        self.letters = np.concatenate([self.letters, points("".join(pieces))])
        self.stamp = np.concatenate([self.stamp, np.full(len(pieces), self.now)])
        return np.arange(first, len(self.stamp))

    def block(self, line: str, cp: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the pieces cp[begin : begin + size], in order, and how many each has."""
        self.now += 1
        low, high = int(begin[0]), int(begin[-1] + size[-1])
        some, offset = cp[low:high], begin - low
        place = np.arange(high - low) - np.repeat(offset, np.diff(offset, append=high - low))
        own = np.add.reduceat(letters_hashed()[some] * self.places[np.minimum(place, self.chars - 1)], offset)
        del place
        short = np.flatnonzero(size <= self.chars)
        keys, first, back = np.unique(own[short], return_index=True, return_inverse=True)
        at = np.searchsorted(self.key, keys)
        found = np.zeros(len(keys), bool)
        if len(self.key):
            found = self.key[np.minimum(at, len(self.key) - 1)] == keys
        entry = np.empty(len(keys), np.int64)
        entry[found] = self.entry[at[found]]
        text = lambda k: line[begin[k] : begin[k] + size[k]]
        if not found.all():
            new = np.flatnonzero(~found)
            entry[new] = self.append([text(k) for k in short[first[new]].tolist()])
            self.key, self.entry = np.insert(self.key, at[new], keys[new]), np.insert(self.entry, at[new], entry[new])
        self.stamp[entry] = self.now
        mine = np.full(len(begin), -1, np.int64)
        mine[short] = entry[back]
        same = self.length[mine[short]] == size[short]
        held, asked = mine[short[same]], short[same]
        n = size[asked]
        if len(asked):
            unlike = self.letters[ranges(self.begin[held], n)] != some[ranges(offset[asked], n)]
            if unlike.any():
                same[np.flatnonzero(same)[np.logical_or.reduceat(unlike, np.cumsum(n) - n)]] = False
        mine[short[~same]] = -1
        once = np.flatnonzero(mine < 0)
        kept = len(self.stamp), len(self.values), len(self.letters)
        if len(once):
            mine[once] = self.append([text(k) for k in once.tolist()])
        count = self.count[mine]
        out = self.values[ranges(self.value[mine], count)]
        if len(once):
            self.stamp, self.value, self.count, self.begin, self.length = (x[: kept[0]] for x in (self.stamp, self.value, self.count, self.begin, self.length))
            self.values, self.letters = self.values[: kept[1]], self.letters[: kept[2]]
        if len(self.stamp) > self.most:
            self.halve()
        return out, count

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Values of all pieces of all texts, and the edges between texts."""
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        line = "\0".join([*texts, ""])
        cp = points(line).copy()
        cp[ends] = END
        mark = np.zeros(len(cp), bool)
        mark[self.cut(cp)] = True
        mark[ends] = True
        at = np.flatnonzero(mark)
        size, real = np.diff(at, append=len(cp)), cp[at] != END
        begin, size = at[real], size[real]
        del mark, at, real
        found = [self.block(line, cp, begin[i : i + self.BLOCK], size[i : i + self.BLOCK]) for i in range(0, len(begin), self.BLOCK)]
        values = np.concatenate([np.empty(0, self.dtype), *(v for v, _ in found)])
        upto = np.cumsum(np.concatenate([[0], *(n for _, n in found)]).astype(np.int64))
        return values, upto[np.concatenate([[0], np.searchsorted(begin, ends)])]


@functools.lru_cache(4)
def library(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)
