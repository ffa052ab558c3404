"""Language-model scoring: a log-bilinear model trained with noise-contrastive estimation.

Counts of all training tokens are gathered in full (pre-aggregated in each task, then shuffled).
The CLASSES - 2 most frequent words have classes of their own. The words after them share classes
by frequency: each band holds the ranks up to twice those before it, so there are more bands the
more words a corpus has, up to the SENT most frequent words. One class holds all words beyond, one
the end. The model predicts a class from the two before it: each context word's vector is scaled by
a vector of its place, the sum is multiplied with the vectors of all classes, and a softmax over
these batched products gives normalised probabilities. Training runs over all training texts, in
ROUNDS parts dealt by hash: in each round every task starts from the same parameters and makes
AdaGrad steps on the NCE loss with shared noise words over its texts of that part; the tasks'
parameters and squared gradients are averaged by weight, in a fixed number of groups, and start the
next round. A word of a band has its class's probability times (c + 1) over the band's sum of that,
c its count; a word beyond has (c + 1) / (N' + V' + 1), N' and V' the tokens and words beyond, so that
the model is a distribution over all words.

Scoring reads each text once. Words among the SENT most frequent (a bounded table) are looked up in
place; the others go, counted by text, to a join with the full counts.

Words of equal count are ranked by their bytes. Noise and first steps are seeded by the task, so
scores depend a little on how the files are split into tasks; counts and base scores do not.

Defined results: a null or empty text is the end token alone; with no training text every base
probability is 1 / (0 + 1 * (0 + 1)) = 1 and so is the model's; a null doc_id counts as the empty
string where rows are set aside; repeated rows are scored each; extra columns are ignored; an
empty table gives an empty result. Texts are read whole.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import repeat
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.llm.common import map_arrow, materialize, per_text, slices
from groundwork.llm.simhash import LOWERED

CLASSES, WIDTH, SENT, SENT_CHARS = 1024, 24, 50_000, 64
NOISE, BATCH, RATE, GROUPS, ROUNDS = 64, 4096, 0.15, 16, 4
REST, END = 0, 1  # classes of words that are not sent to tasks, and of the end; contexts before the first word are END
FLUSH = 200_000


def tokens(text: str | None) -> list[bytes]:
    """Words in order, as UTF-8, A-Z lower-cased; bytes split at blank and 09-0D alone."""
    return (text or "").encode().translate(LOWERED).split()


class Parameters(NamedTuple):
    first: np.ndarray  # vectors of context classes
    last: np.ndarray  # vectors of predicted classes
    scale: np.ndarray  # (2, WIDTH): place vectors, of the word before and of the one before that
    bias: np.ndarray

    def pack(self) -> bytes:
        return np.concatenate([x.ravel() for x in self]).astype(np.float32).tobytes()

    @classmethod
    def unpack(cls, raw: bytes, k: int, d: int = WIDTH) -> "Parameters":
        x, at, out = np.frombuffer(raw, np.float32), 0, []
        for shape in ((k, d), (k, d), (2, d), (k,)):
            n = math.prod(shape)
            out.append(x[at : at + n].reshape(shape).copy())
            at += n
        return cls(*out)


def start(unigram: np.ndarray, d: int = WIDTH, seed: int = 11) -> Parameters:
    draw, k = np.random.default_rng(seed), len(unigram)
    return Parameters(draw.normal(0, 0.1, (k, d)), draw.normal(0, 0.1, (k, d)), np.ones((2, d)), np.log(unigram))


def gathered(rows: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
    """Sums of values (n, width) by row number: rows are sorted, runs of equal ones added up."""
    out = np.zeros((k, values.shape[1]), values.dtype)
    order = np.argsort(rows.astype(np.uint16) if k <= 1 << 16 else rows, kind="stable")
    sorted_rows = rows[order]
    first = np.flatnonzero(np.append(True, sorted_rows[1:] != sorted_rows[:-1]))
    out[sorted_rows[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


class Trainer:
    """AdaGrad on the NCE loss over batches of (before, before that, word)."""

    def __init__(self, p: Parameters, square: Parameters, unigram: np.ndarray, seed: int):
        self.p, self.square = p, square
        self.draw, self.n = np.random.default_rng(seed), 0
        self.cumulated = np.cumsum(unigram) / unigram.sum()
        self.offset = np.log(NOISE * unigram / unigram.sum()).astype(np.float32)

    def step(self, a: np.ndarray, b: np.ndarray, word: np.ndarray) -> None:
        first, last, scale, bias = self.p
        noise = np.searchsorted(self.cumulated, self.draw.random(NOISE)).clip(0, len(bias) - 1)
        va, vb = first[a], first[b]
        hidden = va * scale[0] + vb * scale[1]
        hit = (hidden * last[word]).sum(axis=1) + bias[word] - self.offset[word]
        false = hidden @ last[noise].T + bias[noise] - self.offset[noise]
        up = 1 / (1 + np.exp(np.clip(hit, -30, 30)))  # 1 - sigmoid, ascent for data
        down = 1 / (1 + np.exp(np.clip(-false, -30, 30)))  # sigmoid, descent for noise
        back = up[:, None] * last[word] - down @ last[noise]
        g_first = gathered(a, back, len(bias)) * scale[0] + gathered(b, back, len(bias)) * scale[1]
        g_last = gathered(word, up[:, None] * hidden, len(bias)) - gathered(noise, down.T @ hidden, len(bias))
        g_bias = np.bincount(word, up, len(bias)) - np.bincount(noise, down.sum(axis=0), len(bias))
        g_scale = np.stack([(back * va).sum(axis=0), (back * vb).sum(axis=0)])
        for x, g, q in zip(self.p, (g_first, g_last, g_scale, g_bias), self.square):
            g /= len(word)
            g *= 100
            q += g * g
            x += RATE * g / np.sqrt(q)
        self.n += len(word)


def context(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes one and two places before each of a text's classes."""
    a, b = np.full_like(ids, END), np.full_like(ids, END)
    a[1:], b[2:] = ids[:-1], ids[:-2]
    return a, b


class Normaliser:
    """log10 probabilities of classes; the normalising sum of each context is worked out once."""

    def __init__(self, p: Parameters):
        self.p, k = p, len(p.bias)
        self.sums = np.full(k * k, np.nan, np.float32)

    def __call__(self, a: np.ndarray, b: np.ndarray, word: np.ndarray) -> np.ndarray:
        first, last, scale, bias = self.p
        key = a * len(bias) + b
        new = np.unique(key[np.isnan(self.sums[key])])
        for at in range(0, len(new), BATCH):
            some = new[at : at + BATCH]
            scores = (first[some // len(bias)] * scale[0] + first[some % len(bias)] * scale[1]) @ last.T + bias
            top = scores.max(axis=1, keepdims=True)
            self.sums[some] = (np.log(np.exp(scores - top).sum(axis=1)) + top[:, 0]).astype(np.float32)
        own = np.empty(len(word))
        for at in range(0, len(word), 1 << 16):
            s = slice(at, at + (1 << 16))
            own[s] = ((first[a[s]] * scale[0] + first[b[s]] * scale[1]) * last[word[s]]).sum(axis=1) + bias[word[s]]
        return (own - self.sums[key]) / math.log(10)


def count_tokens(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> token, c: all words of all texts, without ends."""

    def run(parts):
        seen: Counter = Counter()

        def rows():
            return {"token": [w.decode() for w in seen], "c": list(seen.values())}

        for _, text in parts:
            for t in text:
                seen.update(tokens(t))
                if len(seen) > FLUSH:
                    yield rows()
                    seen.clear()
        yield rows()

    return per_text(docs, run, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


COUNT = 44  # bits of a count in a word's code; its class lies above


def class_ids(known: dict[bytes, int], words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Classes and counts of words, from their codes; class REST and count 0 where a word was not sent."""
    code = np.fromiter(map(known.get, words, repeat(REST)), np.int64, len(words))
    return code >> COUNT, code & ((1 << COUNT) - 1)


class Vocabulary(NamedTuple):
    known: dict[bytes, int]  # word -> class and count in one number, of words that are sent to tasks
    sizes: np.ndarray  # training tokens of each class, one more for the rest and the end
    shares: np.ndarray  # of each class, log10 of what a word's count + 1 is divided by; 0 where the word is the class


def vocabulary(frequent: list[tuple[str, int]], words: int, distinct: int, ends: int, classes: int = CLASSES) -> Vocabulary:
    """frequent: (token, count) of the words sent, most frequent first; words, distinct: training tokens without ends, and different ones."""
    counts = np.array([c for _, c in frequent], np.float64)
    own = classes - 2
    at = np.arange(len(frequent))
    cls = np.where(at < own, at + 2, own + 2 + np.floor(np.log2((at + 1) / (own + 1))).clip(0).astype(np.int64))
    k = int(cls.max(initial=END)) + 1
    sums, plus = np.bincount(cls, counts, k), np.bincount(cls, counts + 1, k)
    beyond = words - counts.sum()
    sums[REST], sums[END] = beyond + 1, ends + 1
    plus[REST] = beyond + distinct - len(frequent) + 1
    plus[END : own + 2] = 1
    return Vocabulary({w.encode(): int(i) << COUNT | c for (w, c), i in zip(frequent, cls)}, sums, np.log10(plus))


def train(docs: DataFrame, known: dict[bytes, int], unigram: np.ndarray, rounds: int = ROUNDS) -> Parameters:
    """Parameter averaging over all tasks; docs (doc_id, text) are training texts."""
    p, k = start(unigram), len(unigram)
    raw = p.pack() + Parameters(*(np.full(x.shape, 0.05) for x in p)).pack()
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds))

    for turn in range(rounds):

        def learn(batches, raw=raw, turn=turn):
            import pyarrow as pa
            from pyspark import TaskContext

            task = TaskContext.get().partitionId()
            trainer = Trainer(*(Parameters.unpack(x, k) for x in (raw[: len(raw) // 2], raw[len(raw) // 2 :])), unigram, seed=task * rounds + turn)
            order, held, n = np.random.default_rng(task * rounds + turn), [], 0

            def flush():
                a, b, word = (np.concatenate(x) for x in zip(*held))
                mixed = order.permutation(len(word))
                for at in range(0, len(mixed), BATCH):
                    some = mixed[at : at + BATCH]
                    trainer.step(a[some], b[some], word[some])

            for _, text in slices(batches):
                for t in text:
                    ids = np.append(class_ids(known, tokens(t))[0], END)
                    held.append((*context(ids), ids))
                    n += len(ids)
                if n > 1 << 19:
                    flush()
                    held, n = [], 0
            if held:
                flush()
            yield pa.RecordBatch.from_arrays([pa.array([task % GROUPS]), pa.array([trainer.p.pack() + trainer.square.pack()], pa.binary()), pa.array([float(trainer.n)])], ["grp", "p", "n"])

        def average(key, table):
            import pyarrow as pa

            total, weight = np.zeros(len(raw) // 4), 0.0
            for batch in table.to_batches(max_chunksize=64):
                for x, n in zip(batch["p"].to_pylist(), batch["n"].to_pylist()):
                    total += np.frombuffer(x, np.float32).astype(np.float64) * n
                    weight += n
            mean = (total / max(weight, 1.0)).astype(np.float32).tobytes()
            return pa.table({"grp": pa.array([key[0].as_py()]), "p": pa.array([mean], pa.binary()), "n": pa.array([weight])})

        form = "grp long, p binary, n double"
        rows = map_arrow(docs.filter(part == turn), learn, form).groupBy("grp").applyInArrow(average, form).orderBy("grp").collect()  # at most GROUPS rows
        total = sum(r["n"] for r in rows)
        if total:
            mean = sum(np.frombuffer(r["p"], np.float32).astype(np.float64) * (r["n"] / total) for r in rows)
            raw = mean.astype(np.float32).tobytes()
    return Parameters.unpack(raw[: len(raw) // 2], k)


def most_frequent(counts: DataFrame, n: int) -> list:
    """The n most frequent tokens, ties by token. Counts are first told by power of two, so that a sort sees a few times n rows, not n of each task."""
    power = F.floor(F.log2(F.col("c").cast("double"))).cast("int")
    sizes = sorted(((r["p"], r["n"]) for r in counts.groupBy(power.alias("p")).agg(F.count("*").alias("n")).collect()), reverse=True)  # at most 64 rows
    least, seen = 0, 0
    for p, size in sizes:
        least, seen = p, seen + size
        if seen >= n:
            break
    return counts.filter(power >= least).repartition(1 + seen // 200_000).orderBy(F.desc("c"), "token").limit(n).collect()


PART = "doc_id long, row long, n_tokens long, near_known long, near_base double, near_score double, far array<struct<token:string,n:long>>"


def score(docs: DataFrame, by: int = 7, held: int = 2, classes: int = CLASSES, sent: int = SENT) -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rest = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % by
    training = docs.filter(rest != held)
    counts = materialize(count_tokens(training), "counts")
    ends = training.count()
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = total["n"] + ends, total["v"] + (ends > 0)
    frequent = [(r["token"], r["c"]) for r in most_frequent(counts.filter(F.length("token") <= SENT_CHARS), sent)]
    known, sizes, shares = vocabulary(frequent, total["n"], total["v"], ends, classes)
    parameters = train(training, known, sizes / sizes.sum()) if ends else None
    last_own = classes - 1
    base_log, rest_log = math.log10(n + v + 1), float(shares[REST])

    def run(parts):
        from pyspark import TaskContext

        task, row = TaskContext.get().partitionId(), 0
        normal = Normaliser(parameters) if parameters else None
        for doc_id, text in parts:
            out = {k.split()[0]: [] for k in ("doc_id", "row", "n_tokens", "near_known", "near_base", "near_score", "far")}
            lists = [tokens(t) for t in text]
            found = [class_ids(known, w) for w in lists]
            ids = [np.append(x, END) for x, _ in found]
            edges = np.cumsum([len(x) for x in ids])
            a, b = (np.concatenate(x) for x in zip(*(context(x) for x in ids)))
            logs = normal(a, b, np.concatenate(ids)) if normal else np.zeros(len(a))
            for d, words, (cls, c), x in zip(doc_id, lists, found, np.split(logs, edges[:-1])):
                far = Counter(w for w, k in zip(words, c) if not k)
                here = c[c > 0]
                near = np.log10(np.append(here, ends) + 1.0).sum() - (len(here) + 1) * base_log
                shared = cls > last_own
                values = (d, task << 40 | row, len(words) + 1, len(here) + (ends > 0), near, x.sum() + (np.log10(c[shared] + 1.0) - shares[cls[shared]]).sum(), [{"token": w.decode(), "n": k} for w, k in far.items()])
                for column, value in zip(out.values(), values):
                    column.append(value)
                row += 1
            yield out

    texts = materialize(per_text(docs, run, PART), "texts")
    far = texts.select("row", F.explode("far").alias("x")).select("row", "x.token", "x.n")
    met = far.join(counts, "token", "left").select("row", "n", F.coalesce("c", F.lit(0)).alias("c"))
    log = F.log10(F.col("c") + 1.0) * F.col("n")
    sums = met.groupBy("row").agg(F.sum(log).alias("logs"), F.sum("n").alias("far_n"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("far_known"))
    zero = lambda x: F.coalesce(x, F.lit(0))
    return texts.drop("far").join(sums, "row", "left").select(
        "doc_id", (rest == held).alias("held_out"), "n_tokens", (F.col("near_known") + zero("far_known")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("near_base") + zero("logs") - zero("far_n") * base_log).alias("base_score"), (F.col("near_score") + zero("logs") - zero("far_n") * rest_log).alias("score"),
    )
