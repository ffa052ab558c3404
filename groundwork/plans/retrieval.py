"""Queries of two-stage retrieval over `embeddings` (label stands for a logical table) and `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.operators import retrieval as r
from groundwork.operators import models, vector_index
from groundwork.plans.common import table

#: For both engines: the file and text that a vector's chunk has; files and text starts repeat within and across lists.
FILE, TEXT = "concat('src', vec_id % 7, '.py')", "concat(repeat('shared start of a chunk ', 3), vec_id % 40, ' end ', vec_id)"


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 20."""
    return base(spark, sf_dir).filter("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")


PAIRS = """pairs AS (SELECT q.vec_id AS query_id, b.vec_id AS id, b.vec_id, b.label, abs(round(1 - list_dot_product(q.embedding::DOUBLE[], b.embedding::DOUBLE[]) /
 (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 9)) AS distance
 FROM embeddings q, embeddings b WHERE q.vec_id % 20 = 0)"""


def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.nearest(asked(spark, sf_dir), base(spark, sf_dir), 10).select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


KNN_TOPK = f"WITH {PAIRS} SELECT query_id, id, round(distance, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) - 1 AS rank FROM pairs) WHERE rank < 10"


def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest five, exact at any size."""
    return r.nearest(asked(spark, sf_dir), base(spark, sf_dir), 5).select("query_id", "id", "rank")


VECTOR_SEARCH = f"WITH {PAIRS} SELECT query_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) - 1 AS rank FROM pairs) WHERE rank < 5"


def knn_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.nearest(asked(spark, sf_dir), base(spark, sf_dir), 5, metric="l2").select("query_id", "id", "rank")


KNN_L2 = """WITH pairs AS (SELECT q.vec_id AS query_id, b.vec_id AS id, round(list_sum(list_transform(range(1, 65), lambda i: pow(q.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE, 2))), 9) AS d FROM embeddings q, embeddings b WHERE q.vec_id % 20 = 0)
SELECT query_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) - 1 AS rank FROM pairs) WHERE rank < 5"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of each logical table, with their chunks."""
    near = r.nearest(asked(spark, sf_dir), base(spark, sf_dir), 20, within="label")
    chunk = near.withColumn("vec_id", F.col("id"))
    return chunk.select("query_id", F.col("label").alias("list"), "rank", "id", "distance", F.expr(FILE).alias("source_file"), F.expr(TEXT).alias("text"))


def knn_by_label_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.fuse(hits(spark, sf_dir), 30).select("query_id", "place", "source_file", "text64", F.round("score", 6).alias("score"), "id")


HITS = f"""{PAIRS}, hits AS (SELECT query_id, label AS list, rank, id, distance, {FILE} AS source_file, {TEXT} AS text
 FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY distance, id) - 1 AS rank FROM pairs) WHERE rank < 20)"""
FUSED = f"""{HITS}, merged AS (SELECT query_id, source_file, substr(text, 1, 64) AS text64, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, max_by(id, list * 1000 + rank) AS id, max_by(distance, list * 1000 + rank) AS distance, max_by(text, list * 1000 + rank) AS text FROM hits GROUP BY ALL),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_file, text64) - 1 AS place FROM merged)"""
KNN_BY_LABEL_RRF = f"WITH {FUSED} SELECT query_id, place, source_file, text64, round(score, 6) AS score, id FROM fused WHERE place < 30"


def single_list_bypass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One list is not fused: rows with one key stay apart, in order of distance."""
    return hits(spark, sf_dir).filter("list = 0").select("query_id", F.col("rank").alias("place"), "source_file", "id")


SINGLE_LIST_BYPASS = f"WITH {HITS} SELECT query_id, rank AS place, source_file, id FROM hits WHERE list = 0"


def region_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support of a passage by a collection: the similarity of the first fused chunk, and the chunks' files."""
    f = r.fuse(hits(spark, sf_dir), 5, payload=("id", "distance"))
    files = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "source_file"))), lambda x: x["source_file"]), ",")
    return f.groupBy("query_id").agg(F.round(1 - F.min_by("distance", "place"), 6).alias("sim"), files.alias("files"))


REGION_SCORE = f"WITH {FUSED} SELECT query_id, round(1 - min_by(distance, place), 6) AS sim, string_agg(source_file, ',' ORDER BY place) AS files FROM fused WHERE place < 5 GROUP BY 1"


def rerank_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reranker's JSON replies joined back by index; a third of the candidates has no score, every fifth query no reply."""
    f = r.fuse(hits(spark, sf_dir), 12)
    item = F.struct(F.col("place").cast("int").alias("index"), ((F.col("id") * 7 % 11) / 11.0).alias("relevance_score"))
    some = f.filter("place % 3 < 2 and query_id % 100 <> 0").groupBy("query_id").agg(F.collect_list(item).alias("results"))
    reply = F.when(F.col("query_id") % 40 == 20, F.to_json("results")).otherwise(F.to_json(F.struct("results")))
    scores = some.select("query_id", F.explode(r.relevance(reply)).alias("x")).select("query_id", F.col("x.index").cast("long").alias("place"), "x.relevance")
    return r.rerank(f, scores, 5).select("query_id", "final", "place", F.round("relevance", 6).alias("relevance"), "id")


RERANK_SCORES = f"""WITH {FUSED}, c AS (SELECT *, CASE WHEN place % 3 < 2 AND query_id % 100 <> 0 THEN (id * 7 % 11) / 11.0::DOUBLE END AS relevance FROM fused WHERE place < 12),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance IS NULL, relevance DESC NULLS LAST, place) - 1 AS final FROM c) SELECT query_id, final, place, round(relevance, 6) AS relevance, id FROM o WHERE final < 5"""


def lexical_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five documents that share most of each passage's words; common words bring no document in."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = r.top_by_words(q, table(spark, sf_dir, "documents").select("doc_id", "text"), 5)
    return found.select("query_id", "place", "doc_id", F.round("relevance", 6).alias("relevance"))


WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: w <> ''))"
LEXICAL_RERANK = f"""WITH q AS (SELECT item_id AS query_id, unnest({WORDS.format("text")}) AS w, len({WORDS.format("text")}) AS n FROM benchmark), d AS (SELECT doc_id, unnest({WORDS.format("text")}) AS w FROM documents),
s AS (SELECT query_id, doc_id, round(count(*) / n::DOUBLE, 9) AS relevance FROM q JOIN d USING (w) GROUP BY query_id, doc_id, n),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, doc_id) - 1 AS place FROM s) SELECT query_id, place, doc_id, round(relevance, 6) AS relevance FROM p WHERE place < 5"""


def cite_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context of each query: cited chunks in order, and the files they come from."""
    f = r.fuse(hits(spark, sf_dir), 8).withColumn("line_start", F.when(F.col("id") % 2 == 0, F.col("id") % 100)).withColumn("line_end", F.col("line_start") + 9)
    return r.context(f.withColumn("source_type", F.when(F.col("id") % 2 == 0, "code").otherwise("doc")), order="place")


CITE_CONCAT = f"""WITH {FUSED}, x AS (SELECT *, CASE WHEN id % 2 = 0 THEN id % 100 END AS a FROM fused WHERE place < 8),
y AS (SELECT query_id, string_agg(concat('[source: ', CASE WHEN id % 2 = 0 THEN 'code' ELSE 'doc' END, ' | ', source_file, CASE WHEN coalesce(a, 0) > 0 THEN concat(':', a, '-', a + 9) ELSE '' END, ']', chr(10), trim(text)), concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY place) AS context,
 list_sort(list(DISTINCT source_file)) AS files FROM x GROUP BY 1)
SELECT query_id, context, concat(array_to_string(files[1:5], ', '), CASE WHEN len(files) > 5 THEN ', ...' ELSE '' END) AS sources FROM y"""


def recall_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 40).alias("k"), (F.col("vec_id") % 31).alias("tables"))
    return x.select("vec_id", r.recall_depth(F.col("k"), F.col("tables")).alias("oracle_depth"), r.recall_depth(F.col("k"), F.col("tables"), 25).alias("validator_depth"))


RECALL_DEPTHS = """SELECT vec_id, CASE WHEN vec_id % 31 > 1 THEN least(greatest(4 * (vec_id % 40), 30, 4 * (vec_id % 31)), 100) ELSE greatest(4 * (vec_id % 40), 30) END AS oracle_depth,
 CASE WHEN vec_id % 31 > 1 THEN least(greatest(4 * (vec_id % 40), 25, 4 * (vec_id % 31)), 100) ELSE greatest(4 * (vec_id % 40), 25) END AS validator_depth FROM embeddings"""


def table_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What several collections stand for, over tables named after the documents' sources."""
    names = table(spark, sf_dir, "documents").select(F.expr("concat(CASE source WHEN 'src5' THEN 'knowledge' ELSE source END, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '_x_code' ELSE '_docs' END)").alias("table_name")).distinct()
    cases = (("*", None), ("*", "code"), ("src1", "docs"), ("src2_x", "code"), ("src2_x", "docs"), ("src", None), ("nothing", None), ("", "docs"), (None, None), (None, "docs"))
    parts = [r.choose_tables(names, c, k).select(F.lit("unset" if c is None else c).alias("collection"), F.lit(k or "").alias("kind"), "table_name") for c, k in cases]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


TABLE_SELECTION = """WITH n AS (SELECT DISTINCT concat(CASE source WHEN 'src5' THEN 'knowledge' ELSE source END, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '_x_code' ELSE '_docs' END) AS table_name FROM documents),
v(collection, kind) AS (VALUES ('*', ''), ('*', 'code'), ('src1', 'docs'), ('src2_x', 'code'), ('src2_x', 'docs'), ('src', ''), ('nothing', ''), ('', 'docs'), ('unset', ''), ('unset', 'docs')),
c AS (SELECT collection AS asked, CASE collection WHEN 'unset' THEN 'knowledge' ELSE collection END AS collection, kind FROM v)
SELECT asked AS collection, kind, table_name FROM c, n WHERE CASE WHEN collection IN ('', '*') THEN kind = '' OR ends_with(table_name, '_' || kind)
 WHEN collection IN (SELECT table_name FROM n) THEN table_name = collection ELSE starts_with(table_name, collection || '_') AND (kind = '' OR ends_with(table_name, '_' || kind)) END"""


def query_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What would be embedded for each document as a query: the prefix and at most 6000 characters (a limit of the feature)."""
    from groundwork.functions.text import query_text

    q = query_text(F.lit("query: "), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(q).cast("long").alias("n"), F.md5(q.cast("binary")).alias("digest"))


QUERY_TRUNCATION = "SELECT doc_id, length('query: ' || substr(text, 1, 6000)) AS n, md5('query: ' || substr(text, 1, 6000)) AS digest FROM documents"


def knn_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search by an index of cells and product codes, its probes measured (rows only; index_recall tells its recall)."""
    index = vector_index.opened(base(spark, sf_dir))
    return index.search(asked(spark, sf_dir), 10, index.probes_needed(asked(spark, sf_dir), 10))


def index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that the index holds, queries, true neighbours, and whether the index finds nine in ten of them."""
    rows, queries = base(spark, sf_dir), asked(spark, sf_dir)
    index = vector_index.opened(rows)
    true = r.nearest(queries, rows, 10).select("query_id", "id")
    found = index.search(queries, 10, index.probes_needed(queries, 10)).select("query_id", "id", F.lit(1).alias("hit"))
    hits = true.join(found, ["query_id", "id"], "left").agg(F.countDistinct("query_id").alias("n_queries"), F.count("*").alias("n_true"), (F.count("hit") >= 0.9 * F.count("*")).alias("recalled"))
    return index.rows().agg(F.count("*").alias("n_indexed")).crossJoin(hits)  # a row each


INDEX_RECALL = "SELECT count(*) AS n_indexed, count(*) FILTER (vec_id % 20 = 0) AS n_queries, 10 * count(*) FILTER (vec_id % 20 = 0) AS n_true, true AS recalled FROM embeddings"


def vector_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widths per logical table, whether they agree, and whether an index pays at that size."""
    x = base(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.min(F.size("vector")).cast("long").alias("least"), F.max(F.size("vector")).cast("long").alias("most"))
    return x.select("label", "n", "least", (F.col("least") == F.col("most")).alias("one_width"), (F.col("n") > r.INDEX_ROWS).alias("indexed"))


VECTOR_WIDTH = "SELECT label, count(*) AS n, min(len(embedding)) AS least, min(len(embedding)) = max(len(embedding)) AS one_width, count(*) > 50000 AS indexed FROM embeddings GROUP BY label"


def embed_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offline embedder over all benchmark passages (rows only)."""
    return r.embed(table(spark, sf_dir, "benchmark")).select("item_id", "vector")


def entailed_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each document entails the passage of its remainder, by the offline backend of the entailment interface."""
    claims = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("claim"))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 40).alias("item_id"), F.col("text").alias("passage"))
    return models.entail(docs.join(F.broadcast(claims.filter("item_id < 40")), "item_id")).select("doc_id", "item_id", F.round("entailed", 6).alias("entailed"))


ENTAILED_PASSAGES = f"""WITH b AS (SELECT item_id, text AS claim, {WORDS.format("text")} AS w FROM benchmark WHERE item_id < 40)
SELECT doc_id, item_id, CASE WHEN text IS NOT NULL AND claim IS NOT NULL THEN CASE WHEN len(w) = 0 THEN 0.0::DOUBLE ELSE round(len(list_intersect(w, {WORDS.format("text")})) / len(w)::DOUBLE, 6) END END AS entailed
FROM documents JOIN b ON item_id = doc_id % 40"""


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verifier replies and reranker logits as scores."""
    from groundwork.functions.text import entailment

    reply = F.expr(REPLY)
    logits = F.when(F.col("item_id") % 5 == 0, F.array().cast("array<double>")).otherwise(F.array(F.lit(0.5), (F.col("item_id") % 9) / 9.0))
    return table(spark, sf_dir, "benchmark").select("item_id", entailment(reply).alias("entailed"), F.round(r.last_score(logits), 6).alias("last_logit"))


REPLY = "CASE item_id % 9 WHEN 0 THEN 'SUPPORTED' WHEN 1 THEN 'Unsupported.' WHEN 2 THEN 'Yes, it is' WHEN 3 THEN 'No' WHEN 4 THEN '0.75' WHEN 5 THEN 'score 1.5' WHEN 6 THEN 'maybe' WHEN 7 THEN '' ELSE 'it contradicts' END"
MODEL_SCORES = rf"""WITH x AS (SELECT item_id, lower(trim({REPLY})) AS l FROM benchmark), y AS (SELECT *, try_cast(nullif(regexp_extract(l, '(\d*\.?\d+)', 1), '') AS DOUBLE) AS v FROM x)
SELECT item_id, CASE WHEN l = '' THEN NULL WHEN regexp_matches(l, 'unsupported|not support|contradict') OR starts_with(l, 'no') THEN 0.0::DOUBLE WHEN regexp_matches(l, 'supported|entail') OR starts_with(l, 'yes') THEN 1.0::DOUBLE WHEN v BETWEEN 0 AND 1 THEN v END AS entailed,
 CASE WHEN item_id % 5 <> 0 THEN round((item_id % 9) / 9.0::DOUBLE, 6) END AS last_logit FROM y"""

QUERIES = {f.__name__: f for f in (knn_topk, vector_search, knn_l2, knn_by_label_rrf, single_list_bypass, region_score, rerank_scores, lexical_rerank, cite_concat, recall_depths, table_selection, query_truncation, knn_approximate, index_recall, vector_width, embed_passages, entailed_passages, model_scores)}
ORACLES = {k: globals()[k.upper()] for k in QUERIES if k.upper() in globals()}
