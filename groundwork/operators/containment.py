"""Which quotes are substrings of which sources: a join by a multi-pattern automaton.

The heads of a block of quotes make an Aho-Corasick automaton; each source is read through it once,
whatever the number of quotes, and where a head ends the whole quote is compared. Blocks are
bounded in bytes and number, so a worker holds one automaton of bounded size and builds it once.
A quote set of more than MOST_PASSES blocks would read the sources too often: its quotes of five
words and more then meet sources in a word 3-shingle from their inside, by an equi-join, and only
the shorter ones go in blocks. Nothing is compared by a nested loop.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.functions import text as t
from groundwork.session import shared_dir, ship

HEAD = 32  # code points of a quote that the automaton knows
BLOCK_BYTES, BLOCK_QUOTES = 16 << 20, 1 << 16  # what a block may hold: its automaton has at most HEAD * BLOCK_QUOTES nodes
MOST_PASSES = 4
_last: dict = {}  # the automaton that this worker built last, by its block


def automaton(key: int, quotes: list[str]):
    """The automaton of the quotes' heads; each head tells the places of its quotes."""
    if key not in _last:
        import ahocorasick

        heads: dict[str, list[int]] = {}
        for k, q in enumerate(quotes):
            heads.setdefault(q[:HEAD], []).append(k)
        found = ahocorasick.Automaton()
        for head, places in heads.items():
            found.add_word(head, (len(head), places))
        if heads:
            found.make_automaton()
        _last.clear()
        _last[key] = found
    return _last[key]


def found_in(text: str, machine, quotes: list[str]) -> list[int]:
    """The places of the quotes that the text holds."""
    seen: set[int] = set()
    for end, (n, places) in machine.iter(text):
        for k in places:
            if k not in seen and (len(quotes[k]) == n or text.startswith(quotes[k], end - n + 1)):
                seen.add(k)
    return sorted(seen)


def grounded_pairs(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """quotes (quote_id, quote) x sources (source_id, text): pairs whose normalized quote is a substring of the source; empty quotes are in none."""
    q, s = normalized(quotes, sources)
    if blocks_of(q) > MOST_PASSES:
        return by_shingles(quotes, sources)
    return by_automaton(q, s)


def normalized(quotes: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    q = quotes.select("quote_id", t.normalize(F.col("quote")).alias("q")).filter("q <> ''")
    return q, sources.select("source_id", t.normalize(F.col("text")).alias("s"))


def blocks_of(q: DataFrame) -> int:
    of = q.agg(F.count("*").alias("n"), F.sum(F.octet_length("q")).alias("bytes")).first()
    return max(1, -(-of["n"] // BLOCK_QUOTES), -(-(of["bytes"] or 0) // BLOCK_BYTES))


def by_shingles(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """The same for quote sets of any size: long quotes by an inner shingle, where edge words can't be fragments, short ones in blocks."""
    q, s = normalized(quotes, sources)
    words = F.split("q", " ")
    long, short = q.filter(F.size(words) >= 5), q.filter(F.size(words) < 5)
    keyed = long.select("quote_id", "q", F.array_join(F.slice(words, 2, 3), " ").alias("shingle"))
    three = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    grams = s.select("source_id", F.explode(F.array_distinct(F.get(F.transform(F.array(F.split("s", " ")), three), F.lit(0)))).alias("shingle"))
    hits = grams.join(keyed, "shingle").select("quote_id", "q", "source_id").distinct()
    met = hits.join(s, "source_id").filter(F.col("s").contains(F.col("q"))).select("quote_id", "source_id")
    return met.union(by_automaton(short, s))


def by_automaton(q: DataFrame, s: DataFrame) -> DataFrame:
    """q (quote_id, q) and s (source_id, s), both normalized -> quote_id, source_id. Several blocks are written one after another."""
    spark, blocks = s.sparkSession, blocks_of(q)
    if blocks == 1:
        return one_pass(q, s)
    path = f"{shared_dir(spark)}/contained-{uuid.uuid4().hex}"
    for at in range(blocks):
        pairs = one_pass(q.filter(F.pmod(F.xxhash64("quote_id", "q"), F.lit(blocks)) == at), s)
        pairs.write.mode("append").parquet(path)
    return spark.read.schema(pairs.schema).parquet(path)


def one_pass(q: DataFrame, s: DataFrame) -> DataFrame:
    """One block of quotes, sent to all tasks, against all sources."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructField, StructType

    spark = s.sparkSession
    ship(spark)
    some = q.collect()
    sent = spark.sparkContext.broadcast(([r["quote_id"] for r in some], [r["q"] for r in some]))
    kinds = [x.schema[c].dataType for x, c in ((q, "quote_id"), (s, "source_id"))]
    quote_kind, key = to_arrow_type(kinds[0]), uuid.uuid4().int

    def run(batches):
        import pyarrow as pa

        from groundwork.operators import containment  # the shipped module, whose last automaton outlives a task

        ids, quotes = sent.value
        if not quotes:
            return
        machine = containment.automaton(key, quotes)
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                hits = containment.found_in(text, machine, quotes)
                at += [i] * len(hits)
                found += [ids[k] for k in hits]
            yield pa.RecordBatch.from_arrays([pa.array(found, quote_kind), batch.column(0).take(pa.array(at, pa.int64()))], ["quote_id", "source_id"])

    return s.select("source_id", "s").mapInArrow(run, StructType([StructField("quote_id", kinds[0]), StructField("source_id", kinds[1])]))
