"""Token counts by compiled finite-state transducers.

Two deterministic machines are compiled from the tokenizer file:

* the cutter reads code points by class and marks where pieces begin (its marks lag by one place
  where the pattern looks ahead). A chunk of text maps each of the few states to a state, so chunk
  maps are made side by side and composed by a parallel prefix scan, which gives every chunk its
  true first state; one more pass marks the cuts.
* the counter reads a piece's bytes. Its state knows, for each suffix that a token may still
  extend, which token ends just before it and how many tokens lie behind; each transition is
  annotated with the tokens it emits, which may be none or less than none where a longer token
  swallows others. Pieces are read side by side, a byte of each at a step. A long piece is cut into
  chunks; each chunk's map from the states that it may begin in to (state, tokens) is made side by
  side with the others', and the maps are composed by a parallel prefix scan. A chunk's first states
  are a guess, from the bytes before it, and whatever the maps of the chunk before it lead to, so
  the maps are closed and the count is exact. States are compiled when first met and kept within a
  bound, like those of a lazy automaton; forgetting them changes no count.

Strings of added special tokens inside a text count as one token, the library's default.

Defined results: null and empty texts have no bytes and no tokens; repeated rows repeat their
results; extra columns are ignored; an empty table gives an empty result. No text is cut.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
from pyspark.sql import DataFrame

from groundwork.llm.common import per_text
from groundwork.llm.pieces import LETTER, NUMBER, OTHER, SPACE, Store, classes

# States of the cutter.
START, IN_L, IN_N, IN_O, BLANK, WHITE, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, DONE = STATES = range(11)
# Classes it reads.
C_L, C_STMD, C_R, C_V, C_E, C_LL, C_N, C_QUOTE, C_O, C_BLANK, C_WHITE, C_END = READS = range(12)
HERE, BEFORE = 1, 2  # marks: a piece begins at this place, at the one before
CHUNK = 64
SPAN, WARM = 256, 32  # bytes of a chunk of a long piece, and bytes before it that its first state is guessed from
BATCH, ARCS_HELD = 1 << 16, 300_000  # bytes counted at a time, which may compile a transition each; transitions kept from one batch to the next


@functools.lru_cache(1)
def read_classes() -> np.ndarray:
    table = np.empty(0x110001, np.uint8)
    by_class = np.zeros(4, np.uint8)
    by_class[[OTHER, LETTER, NUMBER, SPACE]] = C_O, C_L, C_N, C_WHITE
    table[:-1] = by_class[classes()]
    for chars, c in (("stmd", C_STMD), ("r", C_R), ("v", C_V), ("e", C_E), ("l", C_LL), ("'", C_QUOTE), (" ", C_BLANK)):
        table[[ord(x) for x in chars]] = c
    table[-1] = C_END
    return table


def step(state: int, c: int) -> tuple[int, int]:
    """The cutter's next state and its marks."""
    letter = c in (C_L, C_STMD, C_R, C_V, C_E, C_LL)
    if c == C_END:
        return START, BEFORE if state in (QUOTE_R, QUOTE_V, QUOTE_L) else 0
    if state in (QUOTE_R, QUOTE_V, QUOTE_L):
        if (state == QUOTE_L and c == C_LL) or (state != QUOTE_L and c == C_E):
            return DONE, 0
        after, marks = step(IN_L, c)
        return after, marks | BEFORE
    if state == QUOTE and letter:
        return {C_STMD: DONE, C_R: QUOTE_R, C_V: QUOTE_V, C_LL: QUOTE_L}.get(c, IN_L), 0 if c in (C_STMD, C_R, C_V, C_LL) else HERE
    plain = IN_L if letter else {C_N: IN_N, C_QUOTE: IN_O, C_O: IN_O, C_BLANK: BLANK, C_WHITE: WHITE}[c]
    white = plain in (BLANK, WHITE)
    if state in (BLANK, WHITE):
        if white:
            return plain, 0
        if state == BLANK:
            return plain, BEFORE
        return QUOTE if c == C_QUOTE else plain, BEFORE | HERE
    same = plain == (IN_O if state == QUOTE else state)
    if same:
        return plain, 0
    return QUOTE if c == C_QUOTE else plain, HERE


@functools.lru_cache(1)
def cutter() -> tuple[np.ndarray, np.ndarray]:
    """Tables by class * states + state: next state, marks."""
    made = [step(s, c) for c in READS for s in STATES]
    return np.array([x[0] for x in made], np.uint8), np.array([x[1] for x in made], np.uint8)


def scan(maps: np.ndarray, counts: np.ndarray | None = None):
    """Prefix compositions of chunk maps (chunk, state): out[i] is maps[i] after ... after maps[0]; counts are added along the way."""
    maps, gap = maps.copy(), 1
    while gap < len(maps):
        way = maps[:-gap].astype(np.intp)
        if counts is not None:
            counts = np.concatenate([counts[:gap], counts[:-gap] + np.take_along_axis(counts[gap:], way, axis=1)])
        maps[gap:] = np.take_along_axis(maps[gap:], way, axis=1)
        gap *= 2
    return maps if counts is None else (maps, counts)


def cuts(cp: np.ndarray) -> np.ndarray:
    """Marks of piece starts over code points; 0x110000 ends a text."""
    after, marks = cutter()
    n = len(cp)
    k = -(-n // CHUNK)
    reads = np.full(k * CHUNK, C_END, np.uint8)
    reads[:n] = read_classes()[cp]
    reads = (reads.astype(np.uint8) * len(STATES)).reshape(k, CHUNK).T.copy()
    state = np.tile(np.arange(len(STATES), dtype=np.uint8), (k, 1))
    for c in reads:
        state = after[c[:, None] + state]
    first = np.zeros(k, np.uint8)
    first[1:] = scan(state)[:-1, START]
    out = np.zeros((CHUNK, k), np.uint8)
    for i, c in enumerate(reads):
        at = c + first
        out[i] = marks[at]
        first = after[at]
    out = out.T.ravel()
    begins = (out & HERE).astype(bool)
    begins[:-1] |= (out[1:] & BEFORE).astype(bool)
    return begins[:n]


#: The printable bytes that byte-level vocabularies write as themselves; the others follow from 256 on.
PLAIN = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


MIX = np.uint64(0x9E3779B97F4A7C15)


class Counter:
    """The counting transducer of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str, most: int = 300_000, held: int = ARCS_HELD):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        if told["pre_tokenizer"]["type"] != "ByteLevel" or told["pre_tokenizer"]["add_prefix_space"] or told["normalizer"] or told["model"]["type"] != "BPE":
            raise ValueError("only plain byte-level BPE files are compiled")
        rest = [b for b in range(256) if b not in set(PLAIN)]
        byte = {chr(b): b for b in PLAIN} | {chr(256 + i): b for i, b in enumerate(rest)}
        raw = lambda s: bytes(byte[c] for c in s)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in told["model"]["merges"]]
        self.rank: dict[tuple[bytes, bytes], int] = {}
        self.made = {bytes([b]): (-1, b"", b"") for b in range(256)}  # token -> rank, parts
        for k, (a, b) in enumerate(pairs):
            a, b = raw(a), raw(b)
            self.rank.setdefault((a, b), k)
            self.made.setdefault(a + b, (k, a, b))
        self.prefixes = {t[:i] for t in self.made for i in range(1, len(t))}
        special = sorted((x["content"] for x in told["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.most, self.held = most, held
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.reset()
        self.store = Store(self.count_pieces, cut=lambda cp: np.flatnonzero(cuts(cp)), dtype=np.int64)

    def reset(self) -> None:
        #: A state: for each suffix that may grow into a token, (suffix, the token before it, tokens up to there less all so far).
        self.states: list[tuple] = [((b"", b"", 0),)]
        self.number = {self.states[0]: 0}
        self.room(1 << 12)

    def room(self, size: int) -> None:
        """An empty table of transitions, found by a hash of state << 8 | byte: that key or -1, the next state, tokens emitted."""
        self.keys, self.after, self.emits = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int16)
        self.arcs, self.shift = 0, 64 - size.bit_length() + 1

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Where these transitions are in the table, or the free place where they would go."""
        at = ((keys.astype(np.uint64) * MIX) >> np.uint64(self.shift)).astype(np.int64)
        found = self.keys[at]
        far = np.flatnonzero((found != keys) & (found >= 0))
        while far.size:
            at[far] = (at[far] + 1) & (len(self.keys) - 1)
            found = self.keys[at[far]]
            far = far[(found != keys[far]) & (found >= 0)]
        return at

    def adjacent(self, a: bytes, b: bytes) -> bool:
        """Whether tokens a and b stay apart when their bytes are encoded: no pair across the border merges in time.

        A part on a's right edge or b's left edge lives until the merge that swallows it. A pair
        across merges if its rank comes before both ends; at equal rank the left merge goes first.
        """
        key = (a, b)
        if (found := self.fits.get(key)) is None:
            found, end_a, x = True, 1 << 40, a
            while x and found:
                end_b, y = 1 << 40, b
                while y:
                    k = self.rank.get((x, y))
                    if k is not None and k < end_a and k <= end_b:
                        found = False
                        break
                    end_b, y = self.made[y][0], self.made[y][1]
                end_a, x = self.made[x][0], self.made[x][2]
            if len(self.fits) > self.most:
                self.fits.clear()
            self.fits[key] = found
        return found

    def arc(self, state: int, byte: int) -> tuple[int, int]:
        """Compile one transition: next state, tokens emitted."""
        live, c, chosen = self.states[state], bytes([byte]), None
        for suffix, before, behind in live:
            token = suffix + c
            if token in self.made and (not before or self.adjacent(before, token)):
                chosen = (token, behind + 1)
                break
        token, emitted = chosen  # one always fits: the byte itself if nothing longer does
        after = tuple((s + c, u, d - emitted) for s, u, d in live if s + c in self.prefixes) + ((b"", token, 0),)
        if (to := self.number.get(after)) is None:
            to = self.number[after] = len(self.states)
            self.states.append(after)
        return to, emitted

    def compile(self, keys: np.ndarray) -> None:
        """Add these transitions to the table."""
        made = [self.arc(key >> 8, key & 255) for key in keys.tolist()]
        if 2 * (self.arcs + len(made)) > len(self.keys):
            old = self.keys >= 0
            kept = self.keys[old], self.after[old], self.emits[old]
            self.room(1 << (4 * (len(kept[0]) + len(made))).bit_length())
            self.put(*kept)
        self.put(keys, *(np.array(x) for x in zip(*made)))

    def put(self, keys: np.ndarray, after: np.ndarray, emits: np.ndarray) -> None:
        self.arcs += len(keys)
        while len(keys):
            at = self.places(keys)
            _, first = np.unique(at, return_index=True)  # of those that want one place the first has it now
            self.keys[at[first]], self.after[at[first]], self.emits[at[first]] = keys[first], after[first], emits[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, after, emits = keys[rest], after[rest], emits[rest]

    def lanes(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs over data[begin : begin + size] from these states, side by side: last states, tokens emitted."""
        order = np.argsort(-size, kind="stable")
        begin, falling, now = begin[order], -size[order], state[order].astype(np.int64)
        total = np.zeros(len(order), np.int64)
        for i in range(int(size.max(initial=0))):
            n = int(np.searchsorted(falling, -i))  # lanes longer than i
            key = now[:n] << 8 | data[begin[:n] + i]
            at = self.places(key)
            if (new := np.flatnonzero(self.keys[at] < 0)).size:
                self.compile(np.unique(key[new]))
                at = self.places(key)
            total[:n] += self.emits[at]
            now[:n] = self.after[at]
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return now[back], total[back]

    def forget_states(self, kept: int = 0) -> int:
        """Forget the states where their transitions are too many, but for one, and give its new number."""
        if self.arcs <= self.held:
            return kept
        live = self.states[kept]
        self.reset()
        if live not in self.number:
            self.number[live] = len(self.states)
            self.states.append(live)
        return self.number[live]

    def chunked(self, data: np.ndarray, state: int) -> tuple[int, int]:
        """The state after data, begun in this one, and the tokens emitted: by chunk maps and their prefix scan."""
        n = len(data)
        k = -(-n // SPAN)
        begins = np.arange(k) * SPAN
        warm = np.minimum(begins, WARM)
        guess, _ = self.lanes(data, begins - warm, warm, np.zeros(k, np.int64))
        guess[0] = state
        known, ends, counts = (np.empty(0, np.int64) for _ in range(3))  # by chunk << 32 | first state
        new = np.unique(np.arange(k) << 32 | guess)
        while len(new):
            chunk = new >> 32
            end, count = self.lanes(data, begins[chunk], np.minimum(n - begins[chunk], SPAN), new & 0xFFFFFFFF)
            known, ends, counts = np.concatenate([known, new]), np.concatenate([ends, end]), np.concatenate([counts, count])
            inner = chunk < k - 1
            new = np.setdiff1d((chunk[inner] + 1) << 32 | end[inner], known)
        order = np.argsort(known)
        known, ends, counts = known[order], ends[order], counts[order]
        chunk = known >> 32
        first = np.searchsorted(chunk, np.arange(k))
        place = np.arange(len(known)) - first[chunk]
        maps, sums = np.zeros((k, int(place.max()) + 1), np.int64), np.zeros((k, int(place.max()) + 1), np.int64)
        inner = chunk < k - 1
        maps[chunk[inner], place[inner]] = np.searchsorted(known, (chunk[inner] + 1) << 32 | ends[inner]) - first[chunk[inner] + 1]
        sums[chunk, place] = counts
        maps, sums = scan(maps, sums)  # chunk 0 begins in one state alone, so its column tells all
        return int(ends[first[-1] + (maps[-2, 0] if k > 1 else 0)]), int(sums[-1, 0])

    def count_long(self, data: np.ndarray) -> int:
        state, total = 0, 0
        for at in range(0, len(data), BATCH):
            state, n = self.chunked(data[at : at + BATCH], self.forget_states(state))
            total += n
        return total

    def count_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [p.encode() for p in pieces]
        data, size = np.frombuffer(b"".join(raw), np.uint8), np.fromiter(map(len, raw), np.int64, len(raw))
        begin, out = np.cumsum(size) - size, np.zeros(len(pieces), np.int64)
        short = np.flatnonzero(size <= 2 * SPAN)
        batch = (np.cumsum(size[short]) - size[short]) // BATCH
        for some in np.split(short, np.flatnonzero(np.diff(batch)) + 1):
            self.forget_states()
            out[some] = self.lanes(data, begin[some], size[some], np.zeros(len(some), np.int64))[1]
        for i in np.flatnonzero(size > 2 * SPAN).tolist():
            out[i] = self.count_long(data[begin[i] : begin[i] + size[i]])
        return out, np.ones(len(pieces), np.int64)

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; its special strings count one each."""
        parts = [self.special.split(t) if self.special else [t] for t in texts]
        values, edges = self.store.encoded([x for p in parts for x in p])
        sums = np.concatenate([[0], np.cumsum(values)])[edges]
        last = np.cumsum([0, *map(len, parts)])
        return (sums[last[1:]] - sums[last[:-1]] + np.diff(last) - 1).tolist()


@functools.lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, n_tokens, over_limit."""

    def run(parts):
        c = counter(path)
        for doc_id, text in parts:
            text = [t or "" for t in text]
            n = c.count(text)
            yield {"doc_id": doc_id, "n_bytes": [len(t.encode()) for t in text], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return per_text(docs, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
