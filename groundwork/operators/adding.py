"""Adding files and web pages to a chunk store: chunk, embed, append what the tables lack."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.functions import text as t
from groundwork.operators import chunking, content, retrieval, web
from groundwork.sources.catalog import Store

LEAST = 50  # characters of a page's main text below which it counts as not fetched


def add_files(store: Store, files: DataFrame, collection: str, embedder=retrieval.embed) -> None:
    """files (source_file, kind code or docs, language, text) to the collection's two tables; files that they hold stay as they are."""
    rows = embedder(chunking.chunk_rows(files))
    suffix = F.when(F.col("source_type") == "code", "_code").otherwise("_docs")
    store.append(rows.withColumn("table_name", F.concat(F.lit(collection), suffix)))


def add_pages(store: Store, pages: DataFrame, collection: str, embedder=retrieval.embed) -> int:
    """The main content of pages (url, html) as documents under their addresses; the number of pages that have a main text, of which there must be one."""
    marked = content.with_markdown(pages.select("url", "html"))
    main = F.when(F.length("markdown") > LEAST, F.col("markdown")).otherwise(web.main_text(F.col("html")))  # a page whose blocks are all short is taken whole
    named = marked.select(F.concat(t.url_stem(F.col("url")), F.lit(".md")).alias("source_file"), "url", main.alias("main"))
    fetched = named.filter(F.length("main") > LEAST)
    n = fetched.count()
    if not n:
        raise ValueError("no page could be fetched")
    files = fetched.select("source_file", F.lit("docs").alias("kind"), F.lit("").alias("language"), web.with_source(F.col("url"), F.col("main")).alias("text"))
    add_files(store, files, collection, embedder)
    return n
