"""Language identification by averaged hashed subword embeddings and a linear softmax.

A word's subwords are its one- to three-letter runs, marked at its ends, and the word itself, each
hashed into one of BUCKETS rows of an embedding table. A text is the mean of its subwords' rows; a
linear softmax gives the language. Both are trained by stochastic gradient descent in numpy, in
one task, on a bounded sample: about PER_LANGUAGE labelled training rows of each language, chosen
by a hash where they are read, so that only the sample goes to that task. A part of the sample is kept aside to fit a temperature and the score below which a
filter rejects. For prediction the table and the softmax multiply out to one score row a bucket.

Defined results: a null text, or one without a letter, is `und` with score 0, and so is every text
where there is nothing to learn from; a null doc_id counts as the empty string where rows are set
aside; repeated rows repeat their results; extra columns are ignored; an empty table gives an
empty result. Texts are read whole.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.llm.common import map_arrow, per_text, pick, slices, splitmix
from groundwork.llm.pieces import forget

BUCKETS, WIDTH, PER_LANGUAGE = 1 << 16, 16, 800
EPOCHS, STEPS, BATCH, RATE, ASIDE = 6, 400, 32, 0.2, 5  # at least EPOCHS and STEPS; one in ASIDE sampled texts calibrates
UNKNOWN = "und"


class Subwords(NamedTuple):
    """Subwords of many words, each written <word>: by length, which letters begin one and its bucket; and each whole word's bucket."""

    starts: np.ndarray
    sizes: np.ndarray
    runs: list[tuple[np.ndarray, np.ndarray]]
    whole: np.ndarray

    def all(self) -> np.ndarray:
        return np.concatenate([*(b[m] for m, b in self.runs), self.whole])


def subwords(words: list[str]) -> Subwords:
    letters = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(length)
    left = np.repeat(ends, length) - np.arange(len(letters))  # letters from here to the word's end
    runs, code = [], np.zeros(len(letters), np.uint64)
    for k in (1, 2, 3):
        code = code * np.uint64(0x110000 + 1) + np.pad(letters, (0, k))[k - 1 : k - 1 + len(letters)] + np.uint64(1)
        runs.append((left >= k, (splitmix(code) & np.uint64(BUCKETS - 1)).astype(np.int64)))
    whole = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.int64, len(words)) & (BUCKETS - 1)
    return Subwords(ends - length, 3 * length - 2, runs, whole)


class Model(NamedTuple):
    languages: list
    table: np.ndarray  # (BUCKETS, languages)
    bias: np.ndarray
    heat: float
    least: float


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(texts: list[tuple[np.ndarray, np.ndarray]], answers: np.ndarray, k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """SGD over texts given as (buckets, shares); the table already multiplied by the softmax, and the bias."""
    draw = np.random.default_rng(seed)
    embed = draw.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    weight, bias = draw.normal(0, 0.1, (WIDTH, k)).astype(np.float32), np.zeros(k, np.float32)
    squares = [np.full_like(weight, 1e-6), np.full_like(bias, 1e-2), np.full(BUCKETS, 1e-8, np.float32)]  # AdaGrad, a rate for each bucket
    epochs = max(EPOCHS, -(-STEPS * BATCH // len(texts)))  # a small sample is gone over more often
    for epoch in range(epochs):
        order, rate = draw.permutation(len(texts)), RATE * (1 - epoch / epochs)
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            rows = np.concatenate([texts[i][0] for i in some])
            share = np.concatenate([texts[i][1] for i in some]).astype(np.float32)
            sizes = np.array([len(texts[i][0]) for i in some])
            mean = np.add.reduceat(embed[rows] * share[:, None], np.cumsum(sizes) - sizes, axis=0)
            miss = softmax(mean @ weight + bias)
            miss[np.arange(len(some)), answers[some]] -= 1
            back = np.repeat(miss @ weight.T, sizes, axis=0) * share[:, None]
            step = np.zeros_like(embed)
            np.add.at(step, rows, back)
            seen = np.unique(rows)
            for x, g, q in ((weight, mean.T @ miss, squares[0]), (bias, miss.sum(axis=0), squares[1])):
                q += g * g
                x -= rate * g / np.sqrt(q)
            squares[2][seen] += (step[seen] ** 2).sum(axis=1)
            embed[seen] -= rate * step[seen] / np.sqrt(squares[2][seen])[:, None]
    return embed @ weight, bias


def train(docs: DataFrame, chosen=None, per_language: int = PER_LANGUAGE) -> Model | None:
    """Fit on docs (doc_id, text, lang); `chosen` says which rows may be learned from."""
    rows = docs.filter("lang is not null and text is not null")
    if chosen is not None:
        rows = rows.filter(chosen)
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not counts:
        return None
    names = sorted(counts)
    chance = F.create_map(*[F.lit(v) for k in names for v in (k, min(1.0, per_language / counts[k]))])
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.crc32(F.col("text").cast("binary"))), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.filter(draw < chance[F.col("lang")]).select("text", "lang").repartition(1).sortWithinPartitions("lang", F.xxhash64("text"), "text")

    def learn(batches):
        import pyarrow as pa

        texts, answers = [], []
        for text, lang in slices(batches):
            for t, x in zip(text, lang):
                found = t.lower().split()
                if found:
                    at, n = np.unique(subwords(found).all(), return_counts=True)
                    texts.append((at.astype(np.int32), (n / n.sum()).astype(np.float32)))
                    answers.append(names.index(x))
        answer = np.array(answers, np.int64)
        aside = np.arange(len(texts)) % ASIDE == ASIDE - 1
        own = [t for t, x in zip(texts, aside) if not x] or texts
        table, bias = fit(own, answer[~aside] if (~aside).any() else answer, len(names)) if texts else (np.zeros((BUCKETS, len(names))), np.zeros(len(names)))
        tests = [t for t, x in zip(texts, aside) if x]
        heat, least = 1.0, 0.0
        if tests:
            logits, truth = np.stack([s.astype(np.float64) @ table[b] + bias for b, s in tests]), answer[aside]
            loss = lambda h: -np.log(np.maximum(softmax(logits / h)[np.arange(len(truth)), truth], 1e-12)).mean()
            heat = min((float(2.0**p) for p in np.arange(-4, 3.1, 0.25)), key=loss)
            best = softmax(logits / heat)
            right = best.argmax(axis=1) == truth
            least = float(min(0.5, np.quantile(best.max(axis=1)[right], 0.001))) if right.any() else 0.0
        yield pa.RecordBatch.from_arrays([pa.array([table.astype(np.float32).tobytes()]), pa.array([bias.astype(np.float32).tobytes()]), pa.array([heat]), pa.array([least])], ["t", "b", "h", "l"])

    r = map_arrow(sample, learn, "t binary, b binary, h double, l double").first()
    return Model(names, np.frombuffer(r["t"], np.float32).reshape(BUCKETS, -1), np.frombuffer(r["b"], np.float32), r["h"], r["l"])


class Predictor:
    """Predicts texts in bulk. Sums of subword scores are kept by word, as rows of one array within a bound."""

    def __init__(self, model: Model | None, most: int = 300_000, letters: int = 64):
        self.model, self.most, self.letters = model, most, letters
        self.reset()

    def reset(self) -> None:
        self.place: dict[str, int] = {}
        self.rows = np.zeros((0, 1 + (len(self.model.languages) if self.model else 0)), np.float32)  # scores, and the number of subwords
        self.used = 0

    def learn(self, words: list[str]) -> None:
        found = subwords(words)
        by_letter = np.zeros((len(found.runs[0][0]), self.rows.shape[1] - 1), np.float32)
        for begins, bucket in found.runs:
            by_letter[begins] += self.model.table[bucket[begins]]
        sums, sizes = np.add.reduceat(by_letter, found.starts, axis=0) + self.model.table[found.whole], found.sizes
        if self.used + len(words) > len(self.rows):
            self.rows = np.concatenate([self.rows[: self.used], np.zeros((len(words) + self.used, self.rows.shape[1]), np.float32)])
        self.rows[self.used : self.used + len(words), :-1] = sums
        self.rows[self.used : self.used + len(words), -1] = sizes
        self.place.update(zip(words, range(self.used, self.used + len(words))))
        self.used += len(words)

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        read = [bool(self.model and t and any(map(str.isalpha, t))) for t in texts]
        lists = [t.lower().split() if ok else [] for t, ok in zip(texts, read)]
        new = list(set().union(*lists).difference(self.place)) if lists else []
        if self.used + len(new) > self.most:
            self.reset()
            new = list(set().union(*lists))
        for at in range(0, len(new), 4096):
            self.learn(new[at : at + 4096])
        out = []
        for ok, words in zip(read, lists):
            if not ok:
                out.append((UNKNOWN, 0.0))
                continue
            total = self.rows[np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))].sum(axis=0, dtype=np.float64)
            p = softmax((total[:-1] / total[-1] + self.model.bias) / self.model.heat)
            best = int(p.argmax())
            out.append((self.model.languages[best], float(p[best])))
        for w in [w for w in new if len(w) > self.letters]:
            del self.place[w]
        return out


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, lang_pred, score."""

    def run(parts):
        p = Predictor(model)
        for doc_id, text in parts:
            found = p(text)
            yield {"doc_id": doc_id, "lang_pred": [x for x, _ in found], "score": [y for _, y in found]}

    return per_text(docs, run, "doc_id long, lang_pred string, score double")


def keep(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs, with all their columns, whose language is told with at least the calibrated score.

    Without a model, all that have a letter: nothing was learned by which to reject them.
    """
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        forget()
        p = Predictor(model)
        for batch in batches:
            if model is None:
                yield batch.filter(pa.array([any(map(str.isalpha, t or "")) for part in slices([batch.select([at])]) for t in part[0]], pa.bool_()))
                continue
            found = [x for part in slices([batch.select([at])]) for x in p(part[0])]
            yield batch.filter(pa.array([x != UNKNOWN and y >= model.least for x, y in found], pa.bool_()))

    return map_arrow(docs, run, docs.schema)


def remainder(by: int):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % by


def identify(docs: DataFrame, by: int = 4, held: int = 2) -> DataFrame:
    """docs (doc_id, text, lang) -> doc_id, held_out, lang_pred, score; learned from the rows not held out."""
    docs = pick(docs, "doc_id", "text", "lang")
    model = train(docs, remainder(by) != held)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", (remainder(by) == held).alias("held_out"), "lang_pred", "score")
