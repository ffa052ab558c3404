"""Two-stage retrieval: table choice, nearest neighbours, rank fusion, reranking, citations."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.functions import text as t
from groundwork.session import shared_dir, ship

RRF = 60
INDEX_ROWS = 50_000  # rows above which an approximate index pays
QUERY_BYTES = 16 << 20  # queries' vectors that may be sent to every task; more go in blocks
HELD = 1 << 19  # hits that a task holds before it sends what it has
HITS = 1 << 18  # hits that a block's queries ask of a task; more go in blocks too, so that a task's best fit in what it holds
COLLECTION = "knowledge"  # fixed value: the collection meant where none is named


def choose_tables(tables: DataFrame, collection: str | None, kind: str | None = None, default: str = COLLECTION) -> DataFrame:
    """tables (table_name) that a collection stands for: all for * or empty, the exact one, else those it prefixes.

    An unset collection (None) is the one named `default`. The kind (code or docs) is a suffix; an exact match ignores it.
    """
    collection = default if collection is None else collection
    name = F.col("table_name")
    of_kind = name.endswith("_" + kind) if kind in ("code", "docs") else F.lit(True)
    if not collection or collection == "*":
        return tables.filter(of_kind)
    exact = tables.agg(F.coalesce(F.max(F.col("table_name") == collection), F.lit(False)).alias("has"))
    return tables.crossJoin(F.broadcast(exact)).filter(F.when(F.col("has"), name == collection).otherwise(name.startswith(collection + "_") & of_kind)).drop("has")


def recall_depth(k: Column, tables: Column, least: int = 30) -> Column:
    """How many hits a table gives before fusion."""
    one = F.greatest(4 * k, F.lit(least))
    return F.when(tables > 1, F.least(F.greatest(one, 4 * tables), F.lit(100))).otherwise(one)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(queries: DataFrame, base: DataFrame, k: int, within: str | None = None, metric: str = "cosine") -> DataFrame:
    """queries (query_id, vector) x base (id, vector[, within]) -> query_id, id[, within], distance, rank from 0.

    Each task multiplies its rows with blocks of query vectors in numpy and keeps its own k best
    a query (and group), so what is shuffled is k rows a task, query and group, not pairs; a task
    whose best alone are more than HELD rows sends them as they come. Ties go
    to the smaller id, distances being rounded to 9 places. Queries of more than QUERY_BYTES, or
    that ask more than HITS of a task, are dealt by their id to blocks of about half of that, which are searched one after another and
    written to the shared folder, so that the driver and the tasks hold one block at a time.
    Null vectors have no neighbours and are none, and rows without a group are left out; vectors of another width than the queries' are
    refused, as are queries of several widths.
    """
    spark = queries.sparkSession
    groups = base.agg(F.approx_count_distinct(within).alias("n")).first()["n"] if within else 1
    blocks = blocks_for(queries, k * groups)
    if blocks == 1:
        return _nearest(queries, base, k, within, metric)
    path = f"{shared_dir(spark)}/nearest-{uuid.uuid4().hex}"
    for at in range(blocks):
        found = _nearest(queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == at), base, k, within, metric)
        found.write.mode("append").parquet(path)
    return spark.read.schema(found.schema).parquet(path)


def _nearest(queries: DataFrame, base: DataFrame, k: int, within: str | None, metric: str) -> DataFrame:
    """nearest() of one block of queries."""
    ship(queries.sparkSession)
    ids, asked = gathered(queries)
    norms, width = np.linalg.norm(asked, axis=1), asked.shape[1]
    columns = ["id", *([within] if within else []), "vector"]
    form = "query_id long, id long, " + (f"{within} long, " if within else "") + "distance double"

    def sent(held):
        import pyarrow as pa

        q, found, group, d = held
        cols = [pa.array(ids[q]), pa.array(found), *([pa.array(group)] if within else []), pa.array(d)]
        return pa.RecordBatch.from_arrays(cols, names=["query_id", *columns[:-1], "distance"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if not len(ids):
                continue
            rows, there = matrix(batch.column(len(columns) - 1), width)
            n = len(rows)
            if not n:
                continue
            key = batch.column(0).to_numpy()[there]
            groups = batch.column(1).to_numpy(zero_copy_only=False)[there] if within else np.zeros(n, np.int64)
            norm = np.linalg.norm(rows, axis=1)
            for at in range(0, len(ids), 64):
                block = asked[at : at + 64]
                if metric == "cosine":
                    d = 1 - (block @ rows.T) / (norms[at : at + 64, None] * norm[None, :])
                else:
                    d = ((block[:, None, :] - rows[None, :, :]) ** 2).sum(axis=2) if n * len(block) * rows.shape[1] < 1 << 24 else (block**2).sum(1)[:, None] + (rows**2).sum(1)[None, :] - 2 * block @ rows.T
                d = np.abs(np.round(d, 9))  # no negative zeros
                for g in np.unique(groups):
                    own = np.flatnonzero(groups == g)
                    i, j = smallest(d[:, own], k)
                    held.append((at + i, key[own[j]], groups[own[j]], d[i, own[j]]))
                    size += len(i)
                    if size > HELD:
                        held = [best_of(held, k)]
                        size = len(held[0][0])
                        if size > HELD // 2:
                            yield sent(held[0])
                            held, size = [], 0
        if held:
            yield sent(best_of(held, k))

    best = (base.filter(F.col(within).isNotNull()) if within else base).select(F.col("id").cast("long"), *([F.col(within).cast("long").alias(within)] if within else []), "vector").mapInArrow(run, form)
    rank = F.row_number().over(Window.partitionBy("query_id", *([within] if within else [])).orderBy("distance", "id")) - 1
    return best.withColumn("rank", rank.cast("long")).filter(F.col("rank") < k)


def matrix(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow column of lists as a matrix of the vectors that are there, and where they are; another width is refused."""
    lengths = np.diff(column.offsets.to_numpy())
    there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    if len(there) and (lengths[there] != width).any():
        raise ValueError(f"vectors of width {lengths[there].min()} to {lengths[there].max()}, not {width}")
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(there), width), there


def gathered(queries: DataFrame, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ids and the matrix of queries (query_id, vector) that have a vector; several widths, or another than `width`, are refused."""
    some = queries.filter("vector is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>")).collect()
    widths = {len(r["vector"]) for r in some} | ({width} if width is not None and some else set())
    if len(widths) > 1:
        raise ValueError(f"vectors of width {min(widths)} to {max(widths)}")
    return np.array([r["query_id"] for r in some], np.int64), np.array([r["vector"] for r in some], np.float64).reshape(len(some), max(widths, default=width or 0))


def smallest(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the k smallest of each row are, with all that tie with the last of them."""
    if d.shape[1] <= k:
        return np.nonzero(np.ones(d.shape, bool))
    last = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
    return np.nonzero((d <= last) | np.isnan(last))


def best_of(parts: list[tuple], k: int) -> tuple:
    """The k hits of least distance, then id, of each query and group; parts hold arrays of query, id, group, distance."""
    q, found, group, d = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((found, d, group, q))
    q, group = q[order], group[order]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (group[1:] != group[:-1])
    first = np.flatnonzero(new)
    kept = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) < k
    return q[kept], found[order][kept], group[kept], d[order][kept]


def blocks_for(queries: DataFrame, hits: int) -> int:
    """In how many blocks queries go that ask for so many hits of a task each."""
    size, n = _bytes(queries), queries.count() * hits
    return max(1 if size <= QUERY_BYTES else -(-2 * size // QUERY_BYTES), 1 if n <= HITS else -(-2 * n // HITS))


def _bytes(queries: DataFrame) -> int:
    return (queries.agg(F.sum(F.greatest(F.size("vector"), F.lit(0))).alias("n")).first()["n"] or 0) * 8


def fuse(hits: DataFrame, k: int | None = None, c: int = RRF, by: tuple[str, ...] = ("query_id",), payload: tuple[str, ...] = ("id",)) -> DataFrame:
    """Reciprocal rank fusion of hits (by..., list, rank, source_file, text, payload...).

    Rows with one source_file and one text start (64 characters) are one; contributions are added
    in order of list and rank; the payload is the last row's. Order: score falling, file, text start.
    """
    key = [*by, "source_file", F.substring("text", 1, 64).alias("text64")]
    parts = F.array_sort(F.collect_list(F.struct("list", "rank")))
    score = F.aggregate(parts, F.lit(0.0), lambda s, x: s + F.lit(1.0) / (x["rank"] + c))
    last = F.max_by(F.struct("text", *payload), F.struct("list", "rank"))
    merged = hits.groupBy(*key).agg(score.alias("score"), last.alias("p")).withColumn("score", F.round("score", 9))
    out = merged.select(*by, "source_file", "text64", "score", "p.*")
    out = out.withColumn("place", (F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "source_file", "text64")) - 1).cast("long"))
    return out if k is None else out.filter(F.col("place") < k)


def rerank(candidates: DataFrame, scores: DataFrame, top: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """candidates (by..., place, ...) with scores (by..., place, relevance): scored ones first by falling score, then the others; ties keep their places."""
    joined = candidates.join(scores, [*by, "place"], "left")
    order = Window.partitionBy(*by).orderBy(F.col("relevance").isNull(), F.desc("relevance"), "place")
    return joined.withColumn("final", (F.row_number().over(order) - 1).cast("long")).filter(F.col("final") < top)


def word_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != ""))


def lexical_relevance(query: Column, text: Column) -> Column:
    """The offline reranker: the share of the query's distinct words that the text has."""
    q = word_set(query)
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, word_set(text))) / F.size(q))


def top_by_words(queries: DataFrame, docs: DataFrame, k: int, rarest: int = 3) -> DataFrame:
    """queries (query_id, text) x docs (doc_id, text) -> query_id, doc_id, relevance (share of the query's distinct words), place: the k best that share a word.

    The maximum-score rule, in two rounds. A query's rarest words bring in documents whose scores
    give a floor: the k-th best so far shares m words. A document that reaches it has one of all but
    the query's m - 1 most common words, so only those bring in the candidates of the second round;
    the common ones merely raise scores. Ties go to the smaller doc_id; null texts have no words.
    """
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/words-{uuid.uuid4().hex}"
    docs.select("doc_id", word_set(F.coalesce("text", F.lit(""))).alias("words")).filter(F.size("words") > 0).write.parquet(path)
    held = spark.read.schema(f"doc_id {dict(docs.dtypes)['doc_id']}, words array<string>").parquet(path)
    q = queries.select("query_id", word_set(F.coalesce("text", F.lit(""))).alias("w")).filter(F.size("w") > 0).withColumn("n", F.size("w"))
    each = q.select("query_id", "n", F.explode("w").alias("word"))
    frequent = held.select(F.explode("words").alias("word")).join(each.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count("*").alias("df"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("df", "word"))
    ranked = each.join(frequent, "word").withColumn("nth", nth)  # words that no document has can bring none in
    ranked.write.parquet(f"{path}-ranked")
    ranked = spark.read.schema(ranked.schema).parquet(f"{path}-ranked")

    def scored(words: DataFrame) -> DataFrame:
        postings = held.select("doc_id", F.explode("words").alias("word"))
        pairs = postings.join(words.select("query_id", "word"), "word").select("query_id", "doc_id").distinct()
        return pairs.join(held, "doc_id").join(q, "query_id").select("query_id", "doc_id", "n", F.size(F.array_intersect("w", "words")).alias("m"))

    best = Window.partitionBy("query_id").orderBy(F.desc("m"), "doc_id")
    first = scored(ranked.filter(F.col("nth") <= rarest)).withColumn("place", F.row_number().over(best)).filter(F.col("place") == k)
    floor = first.select("query_id", F.col("m").alias("floor"))
    known = Window.partitionBy("query_id")
    needed = ranked.withColumn("known", F.count("*").over(known)).join(floor, "query_id", "left").filter(F.col("nth") <= F.col("known") - F.coalesce("floor", F.lit(1)) + 1)
    place = (F.row_number().over(best) - 1).cast("long")
    return scored(needed).withColumn("place", place).filter(F.col("place") < k).select("query_id", "doc_id", F.round(F.col("m") / F.col("n"), 9).alias("relevance"), "place")


def relevance(response: Column) -> Column:
    """index -> score of a rerank response: {"results": [...]} or a bare list, relevance_score or score; NULL if unreadable."""
    item = "array<struct<index:int, relevance_score:double, score:double>>"
    rows = F.coalesce(F.from_json(response, f"struct<results:{item}>")["results"], F.from_json(response, item))
    return F.transform(rows, lambda r: F.struct(r["index"].alias("index"), F.coalesce(r["relevance_score"], r["score"]).alias("relevance")))


def last_score(logits: Column) -> Column:
    """A model's score: the last of its logits."""
    return F.when(F.size(logits) > 0, F.element_at(logits, -1))


def context(rows: DataFrame, by: tuple[str, ...] = ("query_id",), order: str = "final") -> DataFrame:
    """Cited chunks in order, joined for a prompt. rows: by..., order, source_type, source_file, line_start, line_end, text."""
    piece = F.concat(t.citation(F.col("source_type"), F.col("source_file"), F.col("line_start"), F.col("line_end")), F.lit("\n"), F.trim("text"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, piece.alias("x")))), lambda s: s["x"])
    files = F.sort_array(F.collect_set("source_file"))
    shown = F.concat(F.array_join(F.slice(files, 1, 5), ", "), F.when(F.size(files) > 5, ", ...").otherwise(""))
    return rows.groupBy(*by).agg(F.array_join(ordered, "\n\n---\n\n").alias("context"), shown.alias("sources"))


def embed(rows: DataFrame, text: str = "text", width: int = 64) -> DataFrame:
    """The offline embedder: hashed letter 3-grams, unit length, order kept. An interface; models may stand in its place."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda i: F.pmod(F.xxhash64(F.lower(F.substring(F.col(text), i, 3))), F.lit(width)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.size(F.filter(F.col("_g"), lambda g: g == j)).cast("double"))
    x = rows.withColumn("_g", grams).withColumn("_c", counts)
    return x.withColumn("vector", F.transform("_c", lambda v: (v / F.sqrt(dot(F.col("_c"), F.col("_c")))).cast("float"))).drop("_g", "_c")
