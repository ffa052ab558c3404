"""SimHash near duplicates by a segment-popcount embedding.

Distinct fingerprints are points whose coordinates are the bit counts of 32 two-bit segments. The
Manhattan distance of two points never exceeds the Hamming distance of their fingerprints, so
fingerprints within four bits lie within two in the first 16 coordinates or within one in the last
16. A unit grid serves both ranges: a point enters its own cell of the first half and the cells
one step up or down, and its own cell of the last half and those one step up; two points in range
meet in a cell. In each cell the exact distance is checked and a spanning forest of the links is
kept, so a dense cell gives no more links than points; a crowded cell is split by the bits of the
other half. Components come from rounds of joins that hang every neighbour under the smallest one,
written to the shared folder round by round.

Near copies by similarity (first_of_each) lie beyond that reach: what the grid links is verified
first, and an exact join by prefixes of the texts' sets of shingles finds all other links.

Defined results: null and empty texts, and texts of white space, have fingerprint zero and are one
class; fewer words than a shingle make one shingle; repeated rows repeat their results; a null
doc_id never names a class that has another member with an id; extra columns are ignored; an empty
table gives an empty result. No cap on cells, partners or texts.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from groundwork.llm.common import map_arrow, materialize, numbered, per_text, pick, release, slices, splitmix
from groundwork.llm.pieces import forget

SHINGLE, SEED, BITS = 4, 42, 4
HELD, CROWDED = 1 << 18, 1 << 15  # rows held at a time; points of a cell beyond which it is split
LINK, LATER = 0, 1
DENSE = 8  # points; fuller cells are searched from link to link, so that they give no more links than points
LOWERED = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
FIELDS = np.uint64(0x5555555555555555)
HALF = np.uint64(0xFFFFFFFF)


def shingle_hashes(text: str | None, n: int) -> tuple[bytes, np.ndarray]:
    """A text's words joined by blanks, and the hash of each shingle, repeats included."""
    import xxhash

    words = (text or "").encode().translate(LOWERED).split()
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if not words:
        return joined, np.empty(0, np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[:-1]]
    hashes = [digest(joined[i : j - 1], SEED) for i, j in zip(starts, ends[n - 1 :])] if len(words) >= n else [digest(joined, SEED)]
    return joined, np.array(hashes, np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The 64-bit SimHash; each bit set in more than half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = hashes[at : at + (1 << 16)].astype(">u8")
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    return majority(shingle_hashes(text, n)[1])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """docs (doc_id, text, longs...) -> doc_id, fp (the 64 bits as a signed long), longs..."""
    longs = docs.columns[2:]

    def run(parts):
        forget()
        for doc_id, text, *more in parts:
            yield {"doc_id": doc_id, "fp": [signed(fingerprint(t, n)) for t in text], **dict(zip(longs, more))}

    return per_text(docs, run, ", ".join(f"{c} long" for c in ("doc_id", "fp", *longs)))


def cells(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells that each point enters: (index of the point, cell)."""
    x = fps.astype(np.uint64)
    counts = (x & FIELDS) + ((x >> np.uint64(1)) & FIELDS)
    first, last, one = counts & HALF, counts >> np.uint64(32), np.uint64(1)
    mark = np.uint64(1) << np.uint64(32)
    every = np.arange(len(x))
    who, where = [every, every], [first, last | mark]
    for i in range(16):
        unit = one << np.uint64(2 * i)
        for half, tag, ways in ((first, np.uint64(0), (1, -1)), (last, mark, (1,))):
            field = (half >> np.uint64(2 * i)) & np.uint64(3)
            for way in ways:
                ok = np.flatnonzero(field < 2 if way > 0 else field > 0)
                who.append(ok)
                where.append((half[ok] + unit if way > 0 else half[ok] - unit) | tag)
    return np.concatenate(who), np.concatenate(where).astype(np.int64)


def distance(a, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def from_link_to_link(points: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among many points: points already reached are not looked at again."""
    links, rest = [], np.arange(len(points))
    while len(rest):
        reached, rest = [int(rest[0])], rest[1:]
        while reached and len(rest):
            at = reached.pop()
            near = distance(points[rest], points[at]) <= bits
            if near.any():
                found = rest[near].tolist()
                links += [(at, k) for k in found]
                reached += found
                rest = rest[~near]
    return links


def forest(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Of the links a-b those that join two trees."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    kept = []
    for x, y in zip(a, b):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[rx] = ry
            kept.append((x, y))
    return kept


def cell_links(cell: np.ndarray, fp: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links within cells; rows lie in order of cell, each cell whole."""
    if not len(cell):
        return []
    points = fp.astype(np.uint64)
    edge = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
    size = np.diff(edge)
    a, b = [], []
    for k in np.flatnonzero(size > DENSE).tolist():
        for i, j in from_link_to_link(points[edge[k] : edge[k + 1]], bits):
            a.append(edge[k] + i)
            b.append(edge[k] + j)
    small = np.flatnonzero((size > 1) & (size <= DENSE))
    for gap in range(1, int(size[small].max(initial=1))):
        run = small[size[small] > gap]
        n = size[run] - gap
        i = np.repeat(edge[run], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        near = i[distance(points[i], points[i + gap]) <= bits]
        a += near.tolist()
        b += (near + gap).tolist()
    return forest(fp[a].tolist(), fp[b].tolist()) if a else []


def spread(batches):
    """fp -> (cell, fp), a row for each cell that a point enters."""
    import pyarrow as pa

    for batch in batches:
        fp = batch.column(0).to_numpy()
        who, where = cells(fp)
        for at in range(0, len(who), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(where[at : at + (1 << 16)]), pa.array(fp[who[at : at + (1 << 16)]])], ["cell", "fp"])


def split_cells(cell: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Finer cells of points that share a cell: points within four bits agree on all bits of one of five parts of the other half."""
    x = fp.astype(np.uint64)
    other = np.where(cell >> 32 != 0, x & HALF, x >> np.uint64(32))
    own, step = splitmix(cell.astype(np.uint64)), np.uint64(32)
    edges = np.linspace(0, 32, BITS + 2).astype(int).tolist()
    parts = [(other >> np.uint64(i)) & np.uint64((1 << (j - i)) - 1) for i, j in zip(edges, edges[1:])]
    return np.concatenate([splitmix(own ^ (part + np.uint64(k) * (np.uint64(1) << step))).astype(np.int64) for k, part in enumerate(parts)]), np.tile(fp, len(parts))


def meeting(bits: int, most: int | None, most_held: int):
    """Rows (cell, fp) in order of cell -> (kind, a, b): links of kind LINK; where a cell has more than `most` points, its rows themselves, of kind LATER."""

    def meet(batches):
        import pyarrow as pa

        def rows(kind, a, b):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int64)), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["kind", "a", "b"])

        def linked(cell, fp):
            found = cell_links(cell, fp, bits)
            return rows(LINK, [x for x, _ in found], [y for _, y in found])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        n, dense = 0, None
        for batch in batches:
            for at in range(0, batch.num_rows, most_held):
                cell, fp = (batch.column(i).slice(at, most_held).to_numpy() for i in (0, 1))
                if dense is not None:
                    k = int(np.searchsorted(cell, dense, side="right"))
                    if k:
                        yield rows(LATER, cell[:k], fp[:k])
                    if k == len(cell):
                        continue
                    cell, fp, dense = cell[k:], fp[k:], None
                held.append((cell, fp))
                n += len(cell)
                if n < most_held:
                    continue
                cell, fp = (np.concatenate(x) for x in zip(*held))
                whole = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on
                if whole:
                    yield linked(cell[:whole], fp[:whole])
                cell, fp = cell[whole:], fp[whole:]
                held, n = [(cell, fp)], len(cell)
                if most is not None and n > most:
                    yield rows(LATER, cell, fp)
                    held, n, dense = [], 0, cell[-1]
        if held:
            yield linked(*(np.concatenate(x) for x in zip(*held)))

    return meet


def links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """fps (fp, distinct) -> a, b: links that span each class of fingerprints within `bits` bits, each checked exactly.

    A worker holds HELD rows and one cell. Cells of more than CROWDED points are not searched whole:
    their points go to finer cells, by the bits of the other half.
    """
    if bits > BITS:
        raise ValueError(f"the grid's reach is {BITS} bits")
    form = "kind long, a long, b long"

    def searched(rows: DataFrame, most: int | None) -> DataFrame:
        return map_arrow(rows.repartition("cell").sortWithinPartitions("cell", "fp"), meeting(bits, most, HELD), form)

    first = materialize(searched(map_arrow(fps.select("fp"), spread, "cell long, fp long"), CROWDED), "met")
    found, later = first.filter(F.col("kind") == LINK).select("a", "b"), first.filter(F.col("kind") == LATER).select("a", "b")
    if later.isEmpty():
        return found

    def finer(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 16):
                cell, fp = split_cells(*(batch.column(i).slice(at, 1 << 16).to_numpy() for i in (0, 1)))
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(fp)], ["cell", "fp"])

    return found.union(searched(map_arrow(later, finer, "cell long, fp long"), None).select("a", "b"))


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> node, root: every node that has a link, with the smallest node of its class.

    Each round hangs larger neighbours under the smallest one (large star), then all smaller ones
    too (small star), until nothing moves; rounds follow the logarithm of a class's width. A star is
    one exchange: a window, which Spark spills, finds the smallest neighbour.
    """
    spark = edges.sparkSession
    least = F.min("b").over(Window.partitionBy("a"))
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        both = now.union(now.select("b", "a"))
        large = both.withColumn("m", F.least(least, "a")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = large.withColumn("m", least).select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("x")).select("x.a", F.col("x.m").alias("b"))
        seen = Observation()
        after = materialize(small.filter("a <> b").distinct().observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), "links")
        release(spark, now)
        now, found = after, seen.get
        if found == state:
            break
        state = found
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())


def classes(marks: DataFrame, bits: int = BITS) -> DataFrame:
    """marks (doc_id, fp) -> fp, component_id: for each distinct fingerprint the smallest doc_id of its class."""
    fps = materialize(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    member = components(links(fps, bits))
    rooted = materialize(member.join(fps, member.node == fps.fp).select("fp", "root", "least"), "members")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    joined = rooted.join(named, "root").select("fp", "component_id")
    return fps.join(joined, "fp", "left").select("fp", F.when(F.col("component_id").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, n: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """docs (doc_id, text) -> doc_id, fingerprint, component_id."""
    marks = materialize(fingerprints(docs, n), "marks")
    found = marks.join(classes(marks, bits), "fp")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ---- Near copies by similarity: at 0.8 two texts lie some ten bits apart, beyond the grid's reach.

WORDS, SIMILAR = 5, 0.8  # words a shingle; Jaccard similarity
STARS, CHEAP = 1, 8  # most rounds of stars, of which each finds few links in a crowd; pairs a posting up to which all are verified at once, also of one key
WINDOW, OFTEN, COMMON = 1 << 20, 64, 1 << 20  # shingles that a task packs at once; a shingle is common in more than an eighth of OFTEN texts; the most that are sent, the most frequent first
BUCKETS, DROPPED = 1 << 10, 22  # shingles are counted by their first 42 bits: ten name a bucket, 32 are sent
KEYS_SENT = 1 << 22  # shared keys that are sent to tasks (32 MB); more are joined by shuffle
SKETCH = "doc_id long, hash long, fp long, node binary, n long, keys array<long>"


class Counts:
    """How many texts have each common shingle; others count as 0. Only the first 42 bits of a hash tell, so the order is one of hashes."""

    def __init__(self, keys: np.ndarray, m: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.m = keys[order].astype(np.uint64), m[order]

    def __len__(self) -> int:
        return len(self.keys)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(hashes), np.int64)
        own = hashes >> np.uint64(DROPPED)
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        return np.where(self.keys[at] == own, self.m[at], 0)


def ranks(hashes: np.ndarray, common) -> np.ndarray:
    """Shingles go by this, then by hash; common is Counts, or an array of hashes that all go last."""
    if common is None:
        return np.zeros(len(hashes), np.int64)
    return common.of(hashes) if isinstance(common, Counts) else np.isin(hashes, common, assume_unique=True).astype(np.int64)


def prefix(distinct: np.ndarray, similarity: float, common=None) -> np.ndarray:
    """The first shingles of a set in the order (how common, hash), of which similar sets must share one."""
    rank = ranks(distinct, common)
    if rank.any():
        distinct = distinct[np.argsort(rank, kind="stable")]
    return distinct[: len(distinct) - math.ceil(similarity * len(distinct) - 1e-9) + 1]


def sketches(docs: DataFrame, n: int = WORDS, similarity: float = SIMILAR, common=None) -> DataFrame:
    """docs (doc_id, text, hash) -> SKETCH: node names a sequence of words by 128 bits, n is its number of distinct shingles, keys its prefix."""

    def run(parts):
        import xxhash

        forget()
        for doc_id, text, own in parts:
            out = {"doc_id": doc_id, "hash": own, "fp": [], "node": [], "n": [], "keys": []}
            for t in text:
                joined, hashes = shingle_hashes(t, n)
                distinct = np.unique(hashes)
                out["fp"].append(signed(majority(hashes)))
                out["node"].append(xxhash.xxh128_digest(joined))
                out["n"].append(len(distinct))
                out["keys"].append(prefix(distinct, similarity, common.value if common else None).astype(np.int64))
            yield out

    return per_text(docs, run, SKETCH)


def packed(sets):
    """Arrays of hashes -> (bucket, low): WINDOW hashes at a time, the 32 bits that follow a bucket's ten as one string a bucket."""
    import pyarrow as pa

    def strings():
        some = np.sort(np.concatenate(held) >> np.uint64(DROPPED))
        edges = np.searchsorted(some, np.arange(BUCKETS + 1, dtype=np.uint64) << np.uint64(32))
        full = np.flatnonzero(np.diff(edges))
        low = some.astype("<u4")
        return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([low[edges[k] : edges[k + 1]].tobytes() for k in full.tolist()], pa.binary())], ["bucket", "low"])

    held, size = [], 0
    for hashes in sets:
        for at in range(0, len(hashes), WINDOW):
            held.append(hashes[at : at + WINDOW])
            size += len(held[-1])
            if size >= WINDOW:
                yield strings()
                held, size = [], 0
    if size:
        yield strings()


def met(rows: DataFrame, more_than: int) -> DataFrame:
    """Rows (bucket, low) of packed() -> key, m: the hashes, by their first 42 bits, that are met more often than that. A task holds one bucket."""

    def run(batches):
        import pyarrow as pa

        def told():
            some = np.sort(np.concatenate(held))
            first = np.flatnonzero(np.append(True, some[1:] != some[:-1]))
            m = np.diff(np.append(first, len(some)))
            often = m > more_than
            key, m = some[first[often]].astype(np.int64) | at << 32, m[often]
            for k in range(0, len(key), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(key[k : k + (1 << 16)]), pa.array(m[k : k + (1 << 16)])], ["key", "m"])

        at, held = None, []
        for batch in batches:
            for bucket, low in zip(batch.column(0).to_pylist(), batch.column(1)):
                if held and bucket != at:
                    yield from told()
                    held = []
                at = bucket
                held.append(np.frombuffer(low.as_py(), "<u4"))
        if held:
            yield from told()

    return map_arrow(rows.repartition("bucket").sortWithinPartitions("bucket"), run, "key long, m long")


def common_shingles(docs: DataFrame, n: int = WORDS) -> Counts:
    """Shingles that many texts share, counted over all texts: they only put the order right, so those beyond COMMON cost time, not links."""

    def run(batches):
        import xxhash

        def sets():
            seen = set()  # of this task, whose rows are a file's part
            for (text,) in slices(batches):
                for t in text:
                    joined, hashes = shingle_hashes(t, n)
                    node = xxhash.xxh128_digest(joined)
                    if node not in seen:
                        seen.add(node)
                        yield np.unique(hashes)

        forget()
        yield from packed(sets())

    spark = docs.sparkSession
    counts = materialize(met(map_arrow(pick(docs, "text"), run, "bucket int, low binary"), OFTEN // 8), "common")
    least, total = 1 << 62, 0
    for m, keys in sorted(map(tuple, counts.groupBy("m").agg(F.count("*")).collect()), reverse=True):
        total += keys
        if total > COMMON:
            break
        least = m
    sent = counts.filter(F.col("m") >= least).toArrow()
    release(spark, counts)
    return Counts(*(sent.column(i).to_numpy() for i in (0, 1)))


def longs(keys: DataFrame) -> np.ndarray:
    """One column of longs, which are few, as sorted unsigned numbers."""
    return np.sort(keys.toArrow().column(0).to_numpy().astype(np.uint64))


def whole_sets(docs: DataFrame, n: int) -> DataFrame:
    """docs (text) -> node, n, keys: all distinct shingles of each sequence of words, once."""

    def run(parts):
        import xxhash

        forget()
        seen = set()  # of this task, whose rows are a file's part
        for (text,) in parts:
            out = {"node": [], "n": [], "keys": []}
            for t in text:
                joined, hashes = shingle_hashes(t, n)
                node = xxhash.xxh128_digest(joined)
                if node not in seen:
                    seen.add(node)
                    keys = np.unique(hashes).astype(np.int64)
                    for name, x in (("node", node), ("n", len(keys)), ("keys", keys)):
                        out[name].append(x)
            yield out

    return per_text(docs, run, "node binary, n long, keys array<long>").groupBy("node").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))


def postings(nodes: DataFrame) -> DataFrame:
    """nodes (own..., keys) -> key, pos, own... of the shingles that several lists of keys have (and of few that only their first 42 bits share)."""
    spark, own = nodes.sparkSession, nodes.columns[:-1]

    def run(batches):
        yield from packed(k.view(np.uint64) for (keys,) in sets_of(batches) for k in keys)

    keys = materialize(met(map_arrow(nodes.select("keys"), run, "bucket int, low binary"), 1).select("key"), "shared-keys")
    if keys.count() <= KEYS_SENT:
        sent = spark.sparkContext.broadcast(longs(keys))
        found = materialize(of_keys(nodes, sent), "postings")
        sent.destroy()
    else:
        flat = nodes.select(*own, F.posexplode("keys").alias("pos", "key")).withColumn("first", F.shiftrightunsigned("key", DROPPED))
        found = materialize(flat.join(keys.toDF("first"), "first").select("key", "pos", *own), "postings")
    release(spark, keys)
    return found


def of_keys(nodes: DataFrame, sent) -> DataFrame:
    """The postings of the keys with these first bits alone."""
    own = nodes.schema[:-1]

    def run(batches):
        import pyarrow as pa

        wanted = sent.value
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            flat = flat[offsets[0] : offsets[-1]]
            size = np.diff(offsets)
            row = np.repeat(np.arange(batch.num_rows), size)
            first = flat.view(np.uint64) >> np.uint64(DROPPED)
            place = np.searchsorted(wanted, first)
            kept = np.flatnonzero(wanted[np.minimum(place, len(wanted) - 1)] == first) if len(wanted) else np.empty(0, np.int64)
            pos = kept - np.repeat(np.cumsum(size) - size, size)[kept]
            for at in range(0, len(kept), 1 << 16):
                k, p = kept[at : at + (1 << 16)], pos[at : at + (1 << 16)]
                rows = pa.array(row[k])
                yield pa.RecordBatch.from_arrays([pa.array(flat[k]), pa.array(p.astype(np.int32)), *(c.take(rows) for c in batch.columns[:-1])], ["key", "pos", *names])

    names = [f.name for f in own]
    return map_arrow(nodes, run, ", ".join(["key long", "pos int", *(f"{f.name} {f.dataType.simpleString()}" for f in own)]))


def open_postings(cells: DataFrame, member: DataFrame) -> DataFrame:
    """Postings of the keys whose nodes are not all of one class yet: with each node's class, m nodes of the key, and whether it is outside the key's largest class."""
    own = ["key", "pos", "n", "node"]
    mine = cells.select(own).join(member, "node", "left").select(*own, F.coalesce("root", "node").alias("class")).repartition("key")
    key = Window.partitionBy("key")
    sized = mine.withColumn("c", F.count("*").over(Window.partitionBy("key", "class"))).withColumn("most", F.max(F.struct("c", "class")).over(key)).withColumn("m", F.count("*").over(key))
    opened = sized.filter("most.c < m").select(*own, "class", "m", (F.col("m") - F.col("most.c")).alias("outside"), (F.col("class") != F.col("most.class")).alias("out"))
    opened = materialize(opened, "open-postings")
    release(cells.sparkSession, cells)
    return opened


def may_be_similar(similarity: float):
    """Whether two postings (pos, n) of one key leave enough shingles to share, if this is the first that the two sets share."""
    shorter, longer = F.least("n", "x.n"), F.greatest("n", "x.n")
    needed = F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("n") + F.col("x.n")) - 1e-9)
    return (shorter >= F.lit(similarity) * longer - 1e-9) & (F.least(F.col("n") - F.col("pos"), F.col("x.n") - F.col("x.pos")) >= needed)


def paired(left: DataFrame, right: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes, of left and right postings of one key and different classes, that may be similar."""
    me = F.struct("node", "n", "pos", "class").alias("x")
    met = left.join(right.select("key", me), "key").filter((F.col("class") != F.col("x.class")) & may_be_similar(similarity))
    return met.select(F.least("node", "x.node").alias("a"), F.greatest("node", "x.node").alias("b")).distinct()


def compared(pairs: DataFrame, sets: DataFrame, fits) -> DataFrame:
    """Of pairs (a, b) of nodes those that fit; sets (node, n, keys), fits(n, keys, n, keys)."""
    return beside(pairs, sets, lambda a, b, one, other: (a, b) if fits(*one, *other) else None, "a binary, b binary")


def beside(pairs: DataFrame, sets: DataFrame, told, form: str) -> DataFrame:
    """What told(a, b, (n, keys) of b, (n, keys) of a) says of each pair (a, b) of nodes, rows of this form or None; sets (node, n, keys).

    A node's keys are read once a task of GROUP partners, not once a pair, and then stay while the partners' come in.
    They come in pieces, so that a batch of rows is small however long texts are.
    """
    partners = F.count("*").over(Window.partitionBy("b"))
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("a"), F.ceil(partners / GROUP)).alias("part"))
    partners = dealt.join(sets, dealt.a == sets.node).select("b", "part", F.lit(1).alias("kind"), "a", "n", "keys")
    centres = dealt.select("b", "part").distinct().join(sets, F.col("b") == sets.node).select("b", "part", F.lit(0).alias("kind"), F.col("b").alias("a"), "n", "keys")

    schema = _parse_datatype_string(form)
    arrow = to_arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        centre, at, held = None, None, []

        def complete() -> list:
            """What is told of the pair that is complete; a complete centre is kept."""
            nonlocal centre
            if at is None:
                return []
            own = at[3], np.concatenate(held).view(np.uint64)
            if not at[1]:
                centre = own
                return []
            row = told(at[2], at[0], centre, own)
            return [] if row is None else [row]

        def sent(found):
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], f.type) for i, f in enumerate(arrow)], schema=arrow)

        for b, _, kind, a, n, _, keys in sets_of(batches):
            found = []
            for row, own in zip(zip(b, kind, a, n), keys):
                if row != at:
                    found += complete()
                    at, held = row, []
                held.append(own)
            yield sent(found)
        yield sent(complete())

    cut = F.transform(F.sequence(F.lit(0), F.size("keys") - 1, F.lit(PIECE)), lambda i: F.slice("keys", i + 1, F.lit(PIECE)))
    together = centres.union(partners).select("b", "part", "kind", "a", "n", F.posexplode(cut).alias("piece", "keys"))
    return map_arrow(together.repartition("b", "part").sortWithinPartitions("b", "part", "kind", "a", "piece"), run, form)


def bounded(similarity: float, common):
    """Whether two sets may be similar, told from their prefixes: what lies before the nearer end of the two is known, the rest may all be shared."""

    def fits(n: int, x: np.ndarray, m: int, y: np.ndarray) -> bool:
        order = [ranks(k, common.value) for k in (x, y)]
        rank, last = min((int(r[-1]), int(k[-1])) for k, r in zip((x, y), order))
        before = [int(((r < rank) | (r == rank) & (k <= np.uint64(last))).sum()) for k, r in zip((x, y), order)]
        most = len(np.intersect1d(x, y, assume_unique=True)) + min(n - before[0], m - before[1])
        return most >= similarity / (1 + similarity) * (n + m) - 1e-9

    return fits


def jaccard(similarity: float):
    def fits(n: int, x: np.ndarray, m: int, y: np.ndarray) -> bool:
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both >= similarity * (n + m - both) - 1e-9

    return fits


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, common, similarity: float = SIMILAR, n: int = WORDS) -> DataFrame:
    """Of pairs (a, b) of nodes those whose distinct shingles have that Jaccard similarity: where pairs are more than nodes, first those that their prefixes leave possible, then by whole sets."""
    spark = docs.sparkSession
    likely = pairs = materialize(pairs, "pairs")
    if pairs.count() > nodes.count():
        likely = materialize(compared(pairs, nodes.filter("n > 0").select("node", "n", "keys"), bounded(similarity, common)), "likely")
        release(spark, pairs)
    sets = sets_behind(likely, docs, nodes, n)
    near = materialize(compared(likely, sets, jaccard(similarity)), "near")
    for done in (likely, sets):
        release(spark, done)
    return near


def sets_behind(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """The whole sets of the nodes that pairs (a, b) name."""
    needed = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "hash"), "node").select("hash"), "needed")
    sent = F.broadcast(needed) if needed.count() <= MOST_SENT else needed
    texts = pick(docs, "text").withColumn("hash", F.xxhash64("text")).join(sent, "hash", "left_semi").select("text")
    sets = materialize(whole_sets(texts, n), "sets")
    release(docs.sparkSession, needed)
    return sets


PARITY = [f"parity{i}" for i in range(8)]
FARTHER = f"a binary, b binary, n long, size long, excess double, near boolean, ahead int, {', '.join(f'{p} long' for p in PARITY)}, keys array<long>"
LEEWAY = 1e-6  # of bounds, which then let more pairs through, never fewer


def differing(similarity: float, common):
    """Rows of FARTHER: how a node a differs from its hub b, as the shingles that one of the two has, in an order that all nodes of the hub share.

    Sets of n and m shingles are similar if at most c(n + m) of them lie in one alone, c = (1 - s) / (1 + s).
    If x and y differ from the hub in d(x) and d(y) shingles, d(x) + d(y) - c(n + m) over two of these must
    be the same ones: half the sum of both excesses, d - cn. That is over zero unless both are similar to the hub,
    so differences meet by prefixes in turn: nodes that share most of a text, and with it many keys, differ
    from the hub each in its own shingles. These come first; then those the hub has alone, last its own.
    Of a pair the node with the smaller excess need only show its first `ahead` shingles; keys has these,
    and if the other may have a smaller excess, all that can be shared with that. Each shingle flips one of
    512 bits of parity: two nodes differ in as many shingles at least as in bits.
    """
    c = (1 - similarity) / (1 + similarity)
    fits = jaccard(similarity)

    def told(a: bytes, b: bytes, hub: tuple[int, np.ndarray], own: tuple[int, np.ndarray]):
        (m, x), (n, y) = hub, own
        mine, lost = np.setdiff1d(y, x, assume_unique=True), np.setdiff1d(x, y, assume_unique=True)
        mine, lost = mine[np.argsort(ranks(mine, common.value), kind="stable")], lost[np.argsort(-ranks(lost, common.value), kind="stable")]
        size = len(mine) + len(lost)
        excess, reach, near = size - c * n, c * m, fits(m, x, n, y)

        def first(shared: float) -> int:
            return max(0, size - max(1, math.ceil(shared - LEEWAY)) + 1)

        ahead = first(max(excess, (excess + reach) / 2))
        far = 0 if near else first(excess - c * n / similarity)
        keys = np.concatenate([mine, lost])[: max(ahead, far)]
        bits = np.bincount((splitmix(np.concatenate([mine, lost])) >> np.uint64(55)).astype(np.int64), minlength=64 * len(PARITY)) & 1
        parity = np.packbits(bits.astype(np.uint8)).view(np.int64).tolist()
        return a, b, n, size, excess, near, ahead, *parity, splitmix(keys ^ np.frombuffer(b[:8], np.uint64)).view(np.int64)

    return told


def hubs(cells: DataFrame, similarity: float) -> DataFrame:
    """Open postings -> a, b: nodes with the hub of each of their keys, the node that has the key foremost, so the fewest shingles of its own before.

    Nodes of one key are told apart by length, and are in reach of two lengths, so that a hub is about as long as its nodes and similar ones meet.
    """
    long = F.floor(F.log("n") / (1.01 * math.log(1 / similarity)))
    reached = cells.select("key", "node", "pos", long.alias("long")).union(cells.select("key", "node", "pos", long + 1))
    hub = F.min(F.struct("pos", F.xxhash64("node").alias("draw"), "node")).over(Window.partitionBy("key", "long"))
    return reached.select(F.col("node").alias("a"), hub["node"].alias("b")).distinct().filter("a <> b")


def crowded(cells: DataFrame, member: DataFrame, docs: DataFrame, nodes: DataFrame, common, similarity: float, n: int) -> tuple[DataFrame, DataFrame]:
    """Of open postings whose keys bring many together: links to hubs, and pairs (a, b) that may be similar by how they differ from a hub they share."""
    spark = docs.sparkSession
    star = materialize(hubs(cells, similarity), "hubs")
    sets = sets_behind(star, docs, nodes, n)
    told = materialize(beside(star, sets, differing(similarity, common), FARTHER), "farther")
    for done in (star, sets):
        release(spark, done)
    link = told.filter("near").select("a", "b")
    class_of = member.select(F.col("node").alias("a"), F.col("root").alias("class"))
    hub_class = class_of.toDF("b", "hub_class")
    named = told.join(class_of, "a", "left").join(hub_class, "b", "left").withColumn("class", F.coalesce("class", "a")).withColumn("inside", F.col("near") | (F.col("class") == F.coalesce("hub_class", "b")))
    own = ["b", "a", "n", "size", "excess", "near", "ahead", "class", "inside", *PARITY]
    met = postings(named.select(*own, "keys"))
    me = F.struct(*own, "pos").alias("x")
    shared = (F.col("excess") + F.col("x.excess")) / 2 - LEEWAY
    unlike = sum(F.bit_count(F.col(p).bitwiseXOR(F.col(f"x.{p}"))) for p in PARITY)
    c = (1 - similarity) / (1 + similarity)
    fit = (F.col("class") != F.col("x.class")) & (unlike <= c * (F.col("n") + F.col("x.n")) + LEEWAY) & ~(F.col("inside") & F.col("x.inside")) & (F.col("x.excess") <= F.col("excess")) & (F.least(F.col("size") - F.col("pos"), F.col("x.size") - F.col("x.pos")) >= shared)
    pairs = met.filter("not near").join(met.filter("pos < ahead").select("key", "b", me), ["key", "b"]).filter(fit)
    return link, pairs.select(F.least("a", "x.a").alias("a"), F.greatest("a", "x.a").alias("b")).distinct()


def sets_of(batches):
    """Arrow batches whose last column holds lists of longs -> the other columns as lists, that one as arrays."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            some = batch.slice(at, 1024)
            lists = some.column(some.num_columns - 1)
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            yield [*(c.to_pylist() for c in some.columns[:-1]), [flat[i:j].copy() for i, j in zip(offsets, offsets[1:])]]  # copies: a batch is not held by what is kept of it


GROUP, PIECE = 1024, 128  # partners of a node that one task verifies; keys of a set in one row


def gridded(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that the grid links or that have one fingerprint, each fingerprint standing for its least node."""
    first = materialize(nodes.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("m")), "prints")
    same = nodes.join(first.filter("m > 1"), "fp").select("node", F.col("first").alias("other"))
    a, b = first.select(F.col("fp").alias("a"), F.col("first").alias("node")), first.select(F.col("fp").alias("b"), F.col("first").alias("other"))
    linked = links(first.select("fp")).join(a, "a").join(b, "b").select("node", "other")
    return same.union(linked).filter("node <> other").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def similar(docs: DataFrame, nodes: DataFrame, common, n: int = WORDS, similarity: float = SIMILAR) -> DataFrame:
    """node, root: classes of the nodes that links of that similarity connect, without those that have none; nodes (node, fp, n, keys, hash).

    An exact join by prefixes: similar sets share a shingle among their first ones in a fixed order,
    which puts common shingles last, as words of a template, so that keys bring few together. What
    the grid links is verified first. Then, while the nodes that share a key are many and of several
    classes, one of each key that is not in the key's largest class is compared with all of other
    classes; and in the end, all that are not in the largest class with all of other classes. Where
    those are more than CHEAP of a key, all its nodes are compared with a hub, and with each other
    by how they differ from it. So no link between classes is lost, and a family of copies gives
    stars, not all pairs, also where many of its texts are just too different to be linked.
    """
    member = components(verified(gridded(nodes), docs, nodes, common, similarity, n))
    cells = postings(nodes.select("n", "node", "keys"))
    for draw in range(STARS + 1):
        cells = open_postings(cells, member)
        of = cells.agg(F.count("*").alias("n"), F.sum(F.when(F.col("out"), F.col("m"))).alias("pairs")).first()
        last = (of["pairs"] or 0) <= CHEAP * of["n"] or draw == STARS
        centre = cells.filter("out").groupBy("key").agg(F.min_by(F.struct("node", "n", "pos", "class"), F.xxhash64("node", F.lit(draw))).alias("c")).select("key", "c.*")
        few, pairs = (cells.filter(F.col("outside") <= CHEAP), None) if last else (cells, centre)
        pairs = paired(few.filter("out") if last else pairs, few, similarity)
        linked, crowd = member.toDF("a", "b"), ()
        if last and not (many := cells.filter(F.col("outside") > CHEAP)).isEmpty():
            crowd = link, more = crowded(many, member, docs, nodes, common, similarity, n)
            pairs, linked = pairs.union(more).distinct(), linked.union(link)
        member = components(linked.union(verified(pairs, docs, nodes, common, similarity, n)))
        if last:
            for done in (cells, *crowd):
                release(docs.sparkSession, done)
            return member


MOST_SENT = 500_000  # ids that may be broadcast (about 16 MB); more are joined by shuffle


def first_of_each(docs: DataFrame, n: int = WORDS, similarity: float = SIMILAR) -> DataFrame:
    """One row of each class of near copies, with all columns: that of the smallest doc_id, or without one if no row of the class has an id.

    Near copies have at least that Jaccard similarity on distinct shingles of n words, checked
    exactly; classes are what links of near copies connect. Texts of the same words are copies;
    null and empty texts and those of white space are one class. Rows are told apart by id and a
    hash of the text, so rows of one id and different texts are held or removed each by its own
    class. Ties in id go by hash; repeated rows leave one; extra columns may have any names; an
    empty table gives an empty result.
    """
    key, body = f"_c{docs.columns.index('doc_id')}", f"_c{docs.columns.index('text')}"  # by place: names of other columns may clash
    sent = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, n))
    marks = materialize(sketches(pick(docs, "doc_id", "text").withColumn("hash", F.xxhash64("text")), n, similarity, sent), "marks")
    nodes = materialize(marks.groupBy("node").agg(*(F.first(c).alias(c) for c in ("fp", "n", "keys")), F.min("hash").alias("hash")), "nodes")
    member = similar(docs, nodes, sent, n, similarity)
    sent.destroy()  # all that needed it is written
    found = marks.select("doc_id", "hash", "node").join(member, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash"))
    first = found.groupBy("root").agg(least.alias("least"), F.count("*").alias("n")).filter("n > 1").select("root", F.col("least.doc_id").alias("id"), F.col("least.hash").alias("own"))
    gone = materialize(found.join(first, "root").filter("not (doc_id <=> id and hash = own)").select("doc_id", "hash").distinct(), "gone")
    few = gone.count() <= MOST_SENT
    rows = numbered(docs).withColumn("hash", F.xxhash64(body))

    def among(some: DataFrame):
        return F.col(key).eqNullSafe(some["doc_id"]) & (rows["hash"] == some["hash"])

    left = rows.join(F.broadcast(gone) if few else gone, among(gone), "left_anti")
    twice = materialize(marks.groupBy("doc_id", "hash").count().filter("count > 1").select("doc_id", "hash"), "twice")
    for done in (marks, nodes):
        release(docs.sparkSession, done)
    if not twice.isEmpty():
        left = left.join(twice, among(twice), "left_anti").union(left.join(twice, among(twice), "left_semi").dropDuplicates([key, "hash"]))
    return left.drop("hash").toDF(*docs.columns)
