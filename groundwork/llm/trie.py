"""A prefix trie of conversations, by owned chains.

The digest of a conversation's first d turns is an exclusive or of position-salted hashes (twice 64
bits), so it is summed in blocks of BLOCK depths that are joined by their totals, however long a
conversation is. A digest's minimum, the smallest conv_id that starts so, owns the node; only
digests that several share are looked up, all others are their one conversation's own. Who owns a
prefix owns all longer ones, so each conversation's first owned depth is found by binary search:
one batched join of all blocks' last digests with the minima tells the block, log2(BLOCK) batched
joins the depth in it. A conversation's owned depths are a chain; chains hang on the owner of the
prefix before their first depth. From the chains without further chains on them upwards, round by
round, totals go to the chains they hang on; sums from each chain's end upwards then give its nodes.

Members that end in a node are joined in ascending pieces of at most 4096 ids and hashed as a
stream, so no list of members is held whole.

Defined results: null roles and texts are empty; rows without a conv_id are left out; null turns
come first; rows of one turn go by an MD5 of role and text, repeated rows are turns each; c%5 has
the sign of c; extra columns are ignored, whatever their names; an empty table has no root and gives
an empty result. Nothing is bounded but by the rounds: as many as chains hang on chains, at most
the depth of the trie.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.llm.common import map_arrow, materialize, pick

BLOCK, PIECE = 6, 12  # powers of two: depths in a block; ids in a piece
FAMILY, HEADS = 5, 9  # conversation c starts with the first crc32(c) % HEADS turns of conversation c - c % FAMILY
EMPTY = hashlib.sha256(b"").hexdigest()


def block(depth: Column | str) -> Column:
    return F.shiftright(depth, BLOCK)


def digest(role: Column, text: Column) -> Column:
    return F.md5(F.concat(F.md5(role.cast("binary")), text).cast("binary"))


def in_order(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> conv_id, pos from 1, digest, bytes.

    Rows are dealt by ranges of (conv_id, turn), so a long conversation spreads over tasks; each
    counts its own rows, and the counts of the ranges before are added.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    narrow = conversations.filter("conv_id is not null").select("conv_id", "turn", digest(role, text).alias("digest"), F.octet_length(text).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row"))
    order = [F.asc_nulls_first("turn"), "digest", "row"]
    ranged = materialize(narrow.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "trie-rows")
    counts = ranged.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    local = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))
    placed = ranged.withColumn("local", local).join(counts.select("conv_id", "part", before.alias("before")), ["conv_id", "part"])
    return placed.select("conv_id", (F.col("before") + F.col("local")).alias("pos"), "digest", "bytes")


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """own (conv_id, pos, digest, bytes) -> conversations (conv_id, last) and their rows (conv_id, depth from 0, digest, bytes)."""
    borrowed = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    heads = own.filter((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < HEADS)).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "bytes"))).alias("head"))
    convs = own.groupBy("conv_id").agg(F.max("pos").alias("n")).withColumn("h", borrowed)
    convs = convs.join(heads.withColumnRenamed("conv_id", "first"), F.col("conv_id") - F.col("conv_id") % FAMILY == F.col("first"), "left")
    head = F.slice(F.coalesce("head", F.expr("cast(array() as array<struct<pos:bigint,digest:string,bytes:bigint>>)")), F.lit(1), F.col("h"))
    convs = convs.select("conv_id", "n", "h", head.alias("head")).withColumn("last", F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = materialize(convs, "trie-conversations")
    start = convs.select("conv_id", F.explode(F.concat(F.array(F.struct(F.lit(0).cast("long").alias("pos"), F.lit("").alias("digest"), F.lit(0).cast("long").alias("bytes"))), "head")).alias("x")).select("conv_id", F.col("x.pos").alias("depth"), "x.digest", "x.bytes")
    shift = convs.select("conv_id", (F.size("head") - F.col("h")).alias("shift"), F.explode(F.sequence(F.lit(0).cast("long"), block("n"))).alias("slot"))
    rest = own.filter(F.col("pos") > borrowed).withColumn("slot", block("pos")).join(shift, ["conv_id", "slot"])
    return convs.select("conv_id", "last"), start.union(rest.select("conv_id", (F.col("pos") + F.col("shift")).alias("depth"), "digest", "bytes"))


def prefixes(rows: DataFrame) -> DataFrame:
    """rows (conv_id, depth, digest, bytes) -> conv_id, block, nodes: array of (depth, a, b, bytes) with the prefix digests a, b."""
    root = F.col("depth") == 0
    terms = rows.select("conv_id", "depth", block("depth").alias("block"), "bytes", F.when(root, F.lit(0)).otherwise(F.xxhash64("depth", "digest")).alias("s"), F.when(root, F.lit(0)).otherwise(F.xxhash64("digest", "depth")).alias("t"))
    run = Window.partitionBy("conv_id", "block").orderBy("depth")
    local = terms.select("conv_id", "block", "depth", F.expr("bit_xor(s)").over(run).alias("a"), F.expr("bit_xor(t)").over(run).alias("b"), "bytes")
    blocks = materialize(local.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("depth", "a", "b", "bytes"))).alias("nodes")), "trie-blocks")
    end = F.element_at("nodes", -1)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("conv_id", "block", end["a"].alias("s"), end["b"].alias("t"))
    offsets = offsets.select("conv_id", "block", *(F.coalesce(F.expr(f"bit_xor({c})").over(before), F.lit(0)).alias(c) for c in ("s", "t")))
    moved = F.transform("nodes", lambda x: F.struct(x["depth"].alias("depth"), x["a"].bitwiseXOR(F.col("s")).alias("a"), x["b"].bitwiseXOR(F.col("t")).alias("b"), x["bytes"].alias("bytes")))
    return blocks.join(offsets, ["conv_id", "block"]).select("conv_id", "block", moved.alias("nodes"))


def minima(prefix: DataFrame) -> DataFrame:
    """prefixes -> a, b, n, owner of the digests that several conversations share."""
    flat = prefix.select("conv_id", F.explode("nodes").alias("x")).select("conv_id", "x.a", "x.b")
    return flat.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("conv_id").alias("owner")).filter("n > 1")


def first_owned(prefix: DataFrame, shared: DataFrame) -> DataFrame:
    """conv_id, first: each conversation's first owned depth, by binary search; those that own nothing are left out."""
    owned = F.col("owner").isNull() | (F.col("owner") == F.col("conv_id"))
    minimum = shared.select("a", "b", "owner")
    end = F.element_at("nodes", -1)
    ends = prefix.select("conv_id", "block", end["a"].alias("a"), end["b"].alias("b")).join(minimum, ["a", "b"], "left")
    found = prefix.join(ends.filter(owned).groupBy("conv_id").agg(F.min("block").alias("block")), ["conv_id", "block"])
    state = found.select("conv_id", "nodes", F.lit(0).alias("low"), (F.size("nodes") - 1).alias("high"))  # what is at high is owned, nothing below low
    for _ in range(BLOCK):
        middle = F.shiftright(F.col("low") + F.col("high"), 1)
        asked = state.withColumn("middle", middle).withColumn("x", F.get("nodes", F.col("middle"))).withColumns({"a": F.col("x.a"), "b": F.col("x.b")})
        told = asked.join(minimum, ["a", "b"], "left")
        state = told.select("conv_id", "nodes", F.when(owned, F.col("low")).otherwise(F.col("middle") + 1).alias("low"), F.when(owned, F.col("middle")).otherwise(F.col("high")).alias("high"))
    return state.select("conv_id", F.get("nodes", F.col("low"))["depth"].alias("first"))


def totals(chains: DataFrame) -> DataFrame:
    """chains (conv_id, parent, at, saved, leaves, missing: chains that hang on it) -> the same with the sums of all chains below.

    Round by round, chains on which nothing is missing any more hand their totals on.
    """
    spark, finished, pending = chains.sparkSession, [], chains
    while True:
        finished.append(pending.filter("missing = 0").drop("missing"))
        waiting = pending.filter("missing > 0")
        if waiting.isEmpty():
            break
        arrived = finished[-1].groupBy("parent").agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"), F.count("*").alias("m")).withColumnRenamed("parent", "to")
        more = waiting.join(arrived, F.col("conv_id") == F.col("to"), "left")
        plus = lambda c, x: (F.col(c) + F.coalesce(x, F.lit(0))).alias(c)
        pending = materialize(more.select("conv_id", "parent", "at", plus("saved", "s"), plus("leaves", "l"), (F.col("missing") - F.coalesce("m", F.lit(0))).alias("missing")), "trie-chains")
    out = finished[0]
    for x in finished[1:]:
        out = out.union(x)
    return out


def ends(prefix: DataFrame, convs: DataFrame, shared: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256 of the nodes in which a conversation ends."""
    at = convs.select("conv_id", block("last").alias("block"))
    end = F.element_at("nodes", -1)
    last = prefix.join(at, ["conv_id", "block"]).select("conv_id", end["a"].alias("a"), end["b"].alias("b"), end["depth"].alias("depth"))
    owned = last.join(shared.select("a", "b", "owner"), ["a", "b"], "left").withColumn("owner", F.coalesce("owner", "conv_id"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    pieces = owned.groupBy("owner", "depth", F.shiftright("conv_id", PIECE).alias("piece")).agg(ids.alias("ids"))

    def hashed(batches):
        import pyarrow as pa

        def sent(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["conv_id", "depth", "ends_sha256"])

        at, state = None, hashlib.sha256()
        for batch in batches:
            rows = []
            for owner, depth, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                if at == (owner, depth):
                    state.update(b",")
                else:
                    if at:
                        rows.append((*at, state.hexdigest()))
                    at, state = (owner, depth), hashlib.sha256()
                state.update(ids.encode())
            yield sent(rows)
        if at:
            yield sent([(*at, state.hexdigest())])

    return map_arrow(pieces.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "piece"), hashed, "conv_id long, depth long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    own = materialize(in_order(pick(conversations, "conv_id", "turn", "role", "text")), "trie-turns")
    convs, rows = rebuilt(own)
    prefix = materialize(prefixes(rows), "trie-prefixes")
    shared = materialize(minima(prefix), "trie-minima")
    chains = materialize(first_owned(prefix, shared).join(convs, "conv_id"), "trie-owned")
    spread = chains.withColumn("block", F.explode(F.sequence(block("first"), block("last"))))
    flat = prefix.join(spread, ["conv_id", "block"]).select("conv_id", "block", "last", F.explode(F.filter("nodes", lambda x: x["depth"] >= F.col("first"))).alias("x")).select("conv_id", "block", "last", "x.*")
    n = F.coalesce("n", F.lit(1))
    nodes = flat.join(shared.select("a", "b", "n"), ["a", "b"], "left").select("conv_id", "block", "last", "depth", n.alias("n_convs"), ((n - 1) * F.col("bytes")).alias("saved"))
    nodes = materialize(nodes, "trie-nodes")
    before = chains.filter("first > 0").select("conv_id", (F.col("first") - 1).alias("at"), block(F.col("first") - 1).alias("block"))
    hung = prefix.join(before, ["conv_id", "block"]).select("conv_id", "at", F.explode(F.filter("nodes", lambda x: x["depth"] == F.col("at"))).alias("x"))
    hung = hung.select("conv_id", "at", "x.a", "x.b").join(shared.select("a", "b", F.col("owner").alias("parent")), ["a", "b"]).select("conv_id", "parent", "at")
    hung = materialize(hung, "trie-hung")
    kids = hung.groupBy(F.col("parent").alias("to"), F.col("at").alias("place")).agg(F.count("*").alias("m"))
    known = chains.join(nodes.groupBy("conv_id").agg(F.sum("saved").alias("saved")), "conv_id").join(hung, "conv_id", "left")
    known = known.join(kids.groupBy("to").agg(F.sum("m").alias("missing")), F.col("conv_id") == F.col("to"), "left").drop("to")
    known = known.join(kids, (F.col("conv_id") == F.col("to")) & (F.col("last") == F.col("place")), "left")
    known = known.select("conv_id", "parent", "at", "saved", F.col("m").isNull().cast("long").alias("leaves"), F.coalesce("missing", F.lit(0)).alias("missing"))
    below = totals(materialize(known, "trie-chains")).filter("parent is not null")
    below = below.groupBy(F.col("parent").alias("conv_id"), F.col("at").alias("depth")).agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"), F.count("*").alias("m"))
    zero = F.lit(0).cast("long")
    each = nodes.join(below, ["conv_id", "depth"], "left").join(hung.select("conv_id", (F.col("at") + 1).alias("depth"), "parent"), ["conv_id", "depth"], "left")
    last = F.col("depth") == F.col("last")
    each = each.select(
        "conv_id", "depth", "block", "n_convs", F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id"), (F.coalesce("m", zero) + (~last).cast("long")).alias("n_children"),
        (F.col("saved") + F.coalesce("s", zero)).alias("saved"), (F.coalesce("l", zero) + (last & F.col("m").isNull()).cast("long")).alias("leaves"),
    )
    each = materialize(each, "trie-each")
    up = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth"))
    after = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    later = each.groupBy("conv_id", "block").agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
    later = later.select("conv_id", "block", *(F.coalesce(F.sum(c).over(after), zero).alias(c) for c in ("s", "l")))
    summed = each.withColumns({"saved": F.sum("saved").over(up), "leaves": F.sum("leaves").over(up)}).join(later, ["conv_id", "block"])
    return summed.join(ends(prefix, convs, shared), ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaves") + F.col("l")).alias("n_leaves"), (F.col("saved") + F.col("s")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")
    )
