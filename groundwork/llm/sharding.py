"""Shards by the least largest size: a minimax contiguous partition of ordered atomic groups.

Equal texts hash alike, so they share an atom: one of ATOMS ranges of the text's MD5, in order. The
atoms' byte sums, of a fixed number whatever the input, go to the driver; binary search over the
capacity, each step checked greedily, finds the smallest at which the atoms fill no more shards
than asked, and the cuts lie there. An atom over a fair share of what the larger ones leave has a
shard of its own; the others are searched with the shards that are left, and while a shard is
unused the fullest one that can be split is. Everything else stays distributed: a narrow table of (size,
crc, atom, task) is written once to the shared folder, and slots are counted from it per (shard,
task) and then offset, so that no shard, text or key is sorted in one task.

Law: bytes. Defined results: null and empty texts have size 16 and crc 0 and form one group;
repeated rows each take a slot; a null doc_id is kept; extra columns are ignored; an empty table
gives an empty result. A group larger than a fair share stays whole in a shard of its own.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundwork.llm.common import materialize

ATOMS = 1 << 16


def filled(sizes: Sequence[int], capacity: int) -> list[int]:
    """Greedy filling: the first atom of each shard."""
    cuts, load = [0], 0
    for k, size in enumerate(sizes):
        if load + size > capacity and load:
            cuts.append(k)
            load = 0
        load += size
    return cuts


def minimax_cuts(sizes: Sequence[int], shards: int) -> list[int]:
    """First atoms of the shards after the first, at the smallest capacity that needs no more than `shards`."""
    low, high = max([0, *sizes, -(-sum(sizes) // shards)]), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        if len(filled(sizes, middle)) <= shards:
            high = middle
        else:
            low = middle + 1
    return filled(sizes, low)[1:]


def over_fair_share(sizes: Sequence[int], shards: int) -> list[int]:
    """Atoms larger than a fair share of the rest, largest first; one shard at least is left to the rest."""
    rest, big = sum(sizes), []
    for k in sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True):
        if sizes[k] * (shards - len(big)) <= rest:
            break
        big.append(k)
        rest -= sizes[k]
    return big


def halved(sizes: Sequence[int], cuts: Sequence[int], shards: int) -> list[int]:
    """cuts, and more of them: the fullest shard that has two atoms is split until no shard is unused."""
    total, atoms = [0], [0]
    for size in sizes:
        total.append(total[-1] + size)
        atoms.append(atoms[-1] + (size > 0))
    edges = [0, *cuts, len(sizes)]
    heap = [(total[a] - total[b], a, b) for a, b in zip(edges, edges[1:]) if atoms[b] - atoms[a] > 1]
    heapq.heapify(heap)
    found = [*cuts]
    while heap and len(found) < shards - 1:
        _, a, b = heapq.heappop(heap)
        cut = a + minimax_cuts(sizes[a:b], 2)[0]
        found.append(cut)
        for x, y in ((a, cut), (cut, b)):
            if atoms[y] - atoms[x] > 1:
                heapq.heappush(heap, (total[x] - total[y], x, y))
    return sorted(found)


def plan(sizes: Sequence[int], shards: int) -> tuple[list[int], list[int]]:
    """Atoms that have the first shards for themselves, and the first atoms of the shards after those and the next."""
    tried = []
    for big in {(), tuple(over_fair_share(sizes, shards))}:
        rest = [*sizes]
        for k in big:
            rest[k] = 0
        cuts = minimax_cuts(rest, shards - len(big))
        edges = [0, *cuts, len(rest)]
        largest = max([sum(rest[a:b]) for a, b in zip(edges, edges[1:])] + [sizes[k] for k in big])
        tried.append((largest, -len(big), [*big], halved(rest, cuts, shards - len(big))))
    return min(tried)[2:]


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """docs (doc_id, text) -> doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce("text", F.lit(""))
    narrow = materialize(
        docs.select(
            "doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
            F.conv(F.substring(F.md5(text.cast("binary")), 1, 4), 16, 10).cast("int").alias("atom"),
            F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("row"),
        ),
        "shard-rows",
    )
    sizes = [0] * ATOMS
    for atom, size in narrow.groupBy("atom").agg(F.sum("size").alias("size")).collect():  # at most ATOMS rows
        sizes[atom] = size
    big, cuts = (F.array(*map(F.lit, x)).cast("array<int>") for x in plan(sizes, shards))
    own = F.array_position(big, F.col("atom")).cast("int")
    placed = narrow.withColumn("shard", F.when(own > 0, own - 1).otherwise(F.size(big) + F.size(F.filter(cuts, lambda c: c <= F.col("atom")))))
    runs = placed.groupBy("shard", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select("shard", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("shard", "task").orderBy("row"))
    return (
        placed.withColumn("own", own)
        .join(offsets, ["shard", "task"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("own") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
