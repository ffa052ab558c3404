"""Vector code compression: product codes by Lloyd rounds with exponion search, in exact integers.

A vector's components become integers, its parts are coded by the nearest entry of their
position's codebook. The search starts at the part's entry of the round before: an entry as near as
that one lies, by the triangle inequality, within twice its distance of that entry, so only the
start of the entry's list of neighbours, sorted by distance, is scanned, as far as the squared
distance between entries is at most four times the part's own. All is compared in integers, ties
go to the lower index, so the result is that of a full search. Codes travel with their rows from
round to round through tables in the shared folder. Each task sums its parts by entry before
anything is shuffled; the codebooks alone, of a fixed size, go to the driver and to the tasks.

Defined results: vectors that are null or hold a null or a value that is not finite are left out,
and so are those of another width than the one of smallest id (rows without an id come last, ties
by vector); a width that the number of parts does not divide is filled up with zeros; repeated rows
are coded each; with fewer rows than entries there are fewer entries; integers are held within
+-sqrt(2^60 / width) / 2, beyond which no long could hold an error; extra columns are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.llm.common import map_arrow, materialize, pick, release

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
HELD = 1 << 20  # components that a task works on at a time
MOST_SENT = 100_000  # labels that may be broadcast (about 3 MB); more are joined by shuffle
RESULT = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


class Books:
    """Codebooks (part, entry, position), and each entry's neighbours in order of distance, then index."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        apart = ((entries[:, :, None, :] - entries[:, None, :, :]) ** 2).sum(axis=3)
        self.order = np.argsort(apart, axis=2, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, axis=2)

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x (row, part, position), start (row, part) -> the nearest entries and their squared distances, by exponion search."""
        part = np.arange(x.shape[1])
        at, least = start.copy(), ((x - self.entries[part, start]) ** 2).sum(axis=2)
        within = (self.apart[part, start] <= 4 * least[:, :, None]).sum(axis=2)  # neighbours inside the radius
        for k in range(int(within.max(initial=0))):
            i, j = np.nonzero(within > k)
            c = self.order[j, start[i, j], k]
            d = ((x[i, j] - self.entries[j, c]) ** 2).sum(axis=1)
            better = (d < least[i, j]) | ((d == least[i, j]) & (c < at[i, j]))
            i, j = i[better], j[better]
            at[i, j], least[i, j] = c[better], d[better]
        return at, least

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def integers(values: np.ndarray, width: int, parts: int = PARTS) -> np.ndarray:
    """Rows of one width, flat -> (row, part, position): floor(SCALE * x), filled up to equal parts."""
    most = math.isqrt((1 << 60) // max(width, 1)) // 2
    whole = np.clip(np.floor(SCALE * values.astype(np.float64)), -most, most).astype(np.int64).reshape(-1, width) if width else np.zeros((len(values), 0), np.int64)
    return np.pad(whole, ((0, 0), (0, -width % parts))).reshape(len(whole), parts, -(-width // parts))


def kept(rows: DataFrame) -> DataFrame:
    """rows (vec_id, vector, label) without vectors that are null or hold a null or a value that is not finite."""
    x = rows.withColumn("vector", F.col("vector").cast("array<double>"))
    return x.filter(F.col("vector").isNotNull() & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))


def coded(rows: DataFrame, books: Books, width: int, first: bool) -> DataFrame:
    """rows (vec_id, label, x, code) with codes by these codebooks, and errors; at first x are vectors and there are no codes."""
    parts, entries, step = books.entries.shape

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            size = max(1, HELD // max(1, parts * step))
            for at in range(0, batch.num_rows, size):
                some = batch.slice(at, size)
                n = some.num_rows
                if first:
                    flat = some.column(2).flatten().to_numpy(zero_copy_only=False)
                    x, start = integers(flat if width else np.zeros(n), width, parts), np.zeros((n, parts), np.int64)
                else:
                    x = np.frombuffer(b"".join(some.column(2).to_pylist()), np.int32).astype(np.int64).reshape(n, parts, step)
                    start = np.frombuffer(b"".join(some.column(3).to_pylist()), np.uint16).astype(np.int64).reshape(n, parts)
                code, least = books.nearest(x, start)
                x, code = x.astype(np.int32), code.astype(np.uint16)
                yield pa.RecordBatch.from_arrays([
                    some.column(0), some.column(1), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in code], pa.binary()), pa.array(least.sum(axis=1), pa.int64()),
                ], ["vec_id", "label", "x", "code", "error"])

    kind = dict(rows.dtypes)["label"]
    return map_arrow(rows, run, f"vec_id long, label {kind}, x binary, code binary, error long")


def centred(rows: DataFrame, books: Books) -> Books:
    """The codebooks with each used entry replaced by the floor of its parts' mean; rows (x, code)."""
    parts, entries, step = books.entries.shape

    def run(batches):
        import pyarrow as pa

        n, total = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, step), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32).astype(np.int64).reshape(batch.num_rows * parts, step)
                code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).astype(np.int64).reshape(-1, parts)
                which = (code + np.arange(parts) * entries).ravel()
                order = np.argsort(which, kind="stable")
                used, begin = np.unique(which[order], return_index=True)
                n[used] += np.diff(np.append(begin, len(which)))
                if step:
                    total[used] += np.add.reduceat(x[order], begin, axis=0)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))], ["entry", "n", "total"])

    sums = map_arrow(rows.select("x", "code"), run, "entry long, n long, total array<long>")
    found = books.entries.copy().reshape(parts * entries, step)
    columns = [F.sum(F.get("total", F.lit(i))).alias(f"s{i}") for i in range(step)]
    for entry, n, *total in sums.groupBy("entry").agg(F.sum("n").alias("n"), *columns).collect():  # one row an entry
        found[entry] = [t // n for t in total]
    return Books(found.reshape(parts, entries, step))


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Books] | None:
    """rows (vec_id, vector, label) -> (vec_id, label, code: 16-bit entries, error) and the final codebooks; None if no row is kept."""
    good, order = kept(rows), [F.asc_nulls_last("vec_id"), "vector"]
    top = good.orderBy(*order).select("vector").limit(1).collect()
    if not top:
        return None
    width = len(top[0]["vector"])
    good = good.filter(F.size("vector") == width)
    seeds = [r["vector"] for r in good.orderBy(*order).select("vector").limit(entries).collect()]
    books = Books(np.ascontiguousarray(integers(np.array(seeds).ravel() if width else np.zeros(len(seeds)), width, parts).transpose(1, 0, 2)))
    now = materialize(coded(good.select("vec_id", "label", "vector", F.lit(None).cast("binary").alias("code")), books, width, True), "codes")
    for _ in range(rounds):
        books = centred(now, books)
        after = materialize(coded(now.select("vec_id", "label", "x", "code"), books, width, False), "codes")
        release(rows.sparkSession, now)
        now = after
    return now.select("vec_id", "label", "code", "error"), books


def digests(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """rows (vec_id, embedding, label) -> vec_id, code, error, label_error, codebooks_sha256."""
    found = compress(pick(rows, "vec_id", vector, "label").toDF("vec_id", "vector", "label"))
    if found is None:
        return rows.sparkSession.createDataFrame([], RESULT)
    codes, books = found
    labels = materialize(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "of")
    sent = F.broadcast(labels) if labels.count() <= MOST_SENT else labels
    digits = F.regexp_replace(F.lower(F.hex("code")), "(..)..", "$1")  # little-endian 16-bit entries under 256
    return codes.join(sent, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", digits.alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
