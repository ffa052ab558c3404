"""Quality rules by repetition coverage.

Words are interned per text; rolling hashes of several n-gram lengths run over the ids in numpy.
The characters inside n-grams found twice or more, and inside repeated lines, are measured as
shares of the characters in words; a text is rejected if a share passes its limit. Windows that
the 64-bit hashes call equal are compared word by word, so no count rests on a hash.

Defined results: a null or empty text has no words and is rejected by the base rule; repeated rows
repeat their results; extra columns are ignored; an empty table gives an empty result. Texts are
read whole; cost is linear in the text for each n-gram length.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from groundwork.llm.common import map_arrow, per_text, slices, splitmix
from groundwork.llm.pieces import forget

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
BASE_WINDOW = 8
#: Largest share of a text's word characters inside repeated n-grams of each length, and inside repeated lines.
NGRAM_LIMITS = {3: 0.5, 5: 0.35, 7: 0.3, 10: 0.3}
LINE_LIMIT = 0.3
FACTOR = 0x9E3779B97F4A7C15


def repeated(ids: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in an n-word window found twice or more, first places included."""
    covered = np.zeros(len(ids), bool)
    k = len(ids) - n + 1
    if k < 2:
        return covered
    mixed, roll = splitmix(ids.astype(np.uint64)), np.zeros(k, np.uint64)
    for i in range(n):
        roll = roll * np.uint64(FACTOR) + mixed[i : i + k]
    order = np.argsort(roll, kind="stable")
    key = roll[order]
    same = np.zeros(k + 1, bool)
    same[1:k] = key[1:] == key[:-1]
    if not same.any():
        return covered
    a, b = order[np.flatnonzero(same[:k])], order[np.flatnonzero(same[:k]) - 1]
    if any((ids[a + i] != ids[b + i]).any() for i in range(n)):  # unequal windows met in one hash
        seen: dict[tuple, list[int]] = {}
        for i in range(k):
            seen.setdefault(tuple(ids[i : i + n].tolist()), []).append(i)
        twice = np.array([i for x in seen.values() if len(x) > 1 for i in x], np.int64)
    else:
        twice = order[same[:k] | same[1:]]
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + n, -1)
    return np.cumsum(edge)[:-1] > 0


def measure(text: str | None) -> dict:
    """All counts, shares and verdicts of one text."""
    text = text or ""
    words = WORD.findall(text)
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    chars = np.fromiter(map(len, words), np.int64, len(words))
    word_chars = int(chars.sum())
    seen: set[str] = set()
    n_dup, dup_chars = 0, 0
    for line in text.split("\n"):
        if line in seen:
            n_dup += 1
            dup_chars += sum(map(len, WORD.findall(line)))
        elif WORD.search(line):
            seen.add(line)
    n_repeat = int(repeated(ids, BASE_WINDOW).sum())
    base_failed = len(words) < 20 or 100 * n_repeat > 30 * len(words)
    shares = {n: float(chars[repeated(ids, n)].sum() / max(1, word_chars)) for n in NGRAM_LIMITS}
    line_share = dup_chars / max(1, word_chars)
    kept = not base_failed and line_share <= LINE_LIMIT and all(shares[n] <= most for n, most in NGRAM_LIMITS.items())
    return {"n_words": len(words), "word_chars": word_chars, "n_symbols": sum(map(text.count, SYMBOLS)), "n_dup_lines": n_dup, "n_repeat_words": n_repeat, "base_failed": base_failed, "kept": kept, "line_share": line_share} | {f"share_{n}": x for n, x in shares.items()}


RULES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, line_share double" + "".join(f", share_{n} double" for n in NGRAM_LIMITS)


def rules(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> counts, shares and verdicts."""

    def run(parts):
        for doc_id, text in parts:
            found = [measure(t) for t in text]
            yield {"doc_id": doc_id} | {k: [x[k] for x in found] for k in found[0]}

    return per_text(docs, run, RULES)


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that the rules keep. A null doc_id is no reason to go."""
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        forget()
        for batch in batches:
            mask = [measure(t)["kept"] for part in slices([batch.select([at])]) for t in part[0]]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return map_arrow(docs, run, docs.schema)
