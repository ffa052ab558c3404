"""Web sources: links, sitemaps, fetch routing, metasearch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.functions import text as t
from groundwork.sources.paths import ordered_distinct

# A Markdown link's targets, and the endings that are fetched as text.
MARKDOWN_LINK = r"\[.*?\]\((https?://[^\s\)]+|/[^\s\)]+|[^\s\)]+\.md|[^\s\)]+\.html|[^\s\)]+\.txt)\)"
TEXT_ENDINGS = [".md", ".txt", ".rst", ".json", ".csv", ".tsv"]
HREF = r"(?i)<a\s[^>]*href\s*=\s*[\"']([^\"']*)[\"']"


def page_links(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> page_id, pos, href, link (absolute, without its fragment)."""
    x = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(HREF), 1)).alias("pos", "href"))
    return x.select("page_id", F.col("pos").cast("long").alias("pos"), "href", t.resolve_url(F.col("url"), F.col("href")).alias("link"))


def manifest_links(manifests: DataFrame) -> DataFrame:
    """manifests (base, text) -> base, pos, link: link targets of a Markdown manifest, absolute, each once."""
    x = manifests.select("base", F.posexplode(F.regexp_extract_all("text", F.lit(MARKDOWN_LINK), 1)).alias("pos", "raw"))
    x = x.filter(F.split_part(F.trim("raw"), F.lit("#"), F.lit(1)) != "")
    y = x.select("base", F.col("pos").cast("long").alias("pos"), t.resolve_url(F.col("base"), F.col("raw")).alias("link"))
    return y.groupBy("base", "link").agg(F.min("pos").alias("pos"))


def sitemap_urls(fetched: DataFrame, start: str, depth: int = 1, most: int = 50, by_name: bool = False) -> DataFrame:
    """fetched (url, xml) -> pos, url: pages that a sitemap names, nested sitemaps followed.

    Level by level: at most `depth` levels and `most` sitemaps, each visited once. by_name: any loc
    counts, and is nested if it ends with .xml or holds `sitemap`; else the element around it tells.
    The cap is part of the feature. A level holds at most `most` addresses, so they go in a filter.
    """
    spark = fetched.sparkSession
    level, visited, found = [start], [], []
    clean = F.regexp_replace("xml", r"(</?)[A-Za-z0-9_]+:", "$1")
    clean = F.regexp_replace(clean, r"\sxmlns(:\w+)?\s*=\s*(\"[^\"]*\"|'[^']*')", "")
    for d in range(depth):
        level = [u for u in level if u not in visited][: most - len(visited)]
        if not level:
            break
        visited += level
        here = fetched.filter(F.col("url").isin(level)).withColumn("x", clean)
        if by_name:
            locs = here.select(F.col("url").alias("map"), F.posexplode(F.xpath("x", F.lit("//loc/text()"))).alias("pos", "loc"))
            locs = locs.withColumn("nested", F.lower("loc").endswith(".xml") | F.lower("loc").contains("sitemap"))
        else:
            take = lambda path, nested: here.select(F.col("url").alias("map"), F.posexplode(F.xpath("x", F.lit(path))).alias("pos", "loc"), F.lit(nested).alias("nested"))
            locs = take("//url/loc/text()", False).unionByName(take("//sitemap/loc/text()", True))
        order = F.create_map(*[F.lit(v) for i, u in enumerate(level) for v in (u, i)])
        locs = locs.withColumn("loc", F.trim("loc")).filter("loc <> ''").withColumn("pos", F.lit(d).cast("long") * 10**12 + F.element_at(order, F.col("map")).cast("long") * 10**9 + F.col("pos"))
        found.append(locs.filter("not nested").select("pos", F.col("loc").alias("url")))
        level = [r["loc"] for r in locs.filter("nested").groupBy("loc").agg(F.min("pos").alias("p")).orderBy("p").limit(most).collect()]
    out = found[0] if found else spark.createDataFrame([], "pos long, url string")
    for f in found[1:]:
        out = out.unionByName(f)
    return ordered_distinct(out, "url")


def robots_sitemaps(lines: DataFrame) -> DataFrame:
    """lines (pos, line) of robots.txt -> pos, url of its Sitemap directives."""
    return lines.filter(F.lower("line").startswith("sitemap:")).select("pos", F.trim(F.expr("substr(line, instr(line, ':') + 1)")).alias("url"))


MOST_MAPS = 50  # fixed value: sitemaps that are read for one target
LOC = r"(?is)<(?:[A-Za-z0-9_]+:)?loc\s*>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</"


def harvest(targets: DataFrame, fetched: DataFrame, depth: int = 1, include: str | None = None, exclude: str | None = None, most: int = MOST_MAPS) -> DataFrame:
    """targets (target) and fetched (url, body) -> target, url: the pages that each site names, each once.

    All sites go together, a level of sitemaps a round. A site whose sitemap is not there is asked
    by the Sitemap lines of its robots.txt, and without any by the links of its manifest, llms.txt;
    a target that is a manifest is read as one. Locations that end with .xml or hold `sitemap` are
    nested sitemaps, read down to `depth` levels, each once a site and at most `most` of them.
    """
    body = fetched.select(F.col("url").alias("at"), "body").filter("body is not null")
    full = F.when(F.col("target").rlike("^https?://"), F.col("target")).otherwise(F.concat(F.lit("https://"), F.regexp_replace("target", "^/+", "")))
    site = targets.select("target").distinct().withColumn("full", full).withColumn("root", F.regexp_extract("full", "^(https?://[^/?#]+)", 1))
    manifest = F.lower("full").contains("llms.txt")
    is_map = F.lower("full").endswith(".xml") | F.lower("full").contains("sitemap")
    start = site.filter(~manifest).select("target", "root", F.when(is_map, F.col("full")).otherwise(F.concat("root", F.lit("/sitemap.xml"))).alias("url"))
    there = start.join(body.select("at"), start.url == F.col("at"), "left_semi").select("target", "url")
    lost = start.join(body.select("at"), start.url == F.col("at"), "left_anti").select("target", "root")
    lines = lost.join(body, F.concat("root", F.lit("/robots.txt")) == F.col("at")).select("target", F.explode(t.lines(F.col("body"))).alias("line"))
    named = robots_sitemaps(lines.select(F.col("target").alias("pos"), "line")).select(F.col("pos").alias("target"), "url")
    told = lost.join(named.select("target").distinct(), "target", "left_anti").select("target", F.concat("root", F.lit("/llms.txt")).alias("at"))
    manifests = told.union(site.filter(manifest).select("target", F.col("full").alias("at"))).join(body, "at")
    links = manifest_links(manifests.select(F.col("at").alias("base"), F.col("body").alias("text")).distinct())
    found = manifests.select("target", F.col("at").alias("base")).join(links, "base").select("target", F.col("link").alias("url"))
    level = there.union(named).distinct()
    visited = level
    for _ in range(depth):
        maps = level.join(body, level.url == F.col("at"))
        loc = maps.select("target", F.explode(F.regexp_extract_all("body", F.lit(LOC), 1)).alias("loc"))
        loc = loc.select("target", F.trim(F.replace("loc", F.lit("&amp;"), F.lit("&"))).alias("url")).filter("url <> ''").distinct()
        nested = F.lower("url").endswith(".xml") | F.lower("url").contains("sitemap")
        found = found.union(loc.filter(~nested))
        new = loc.filter(nested).join(visited, ["target", "url"], "left_anti")
        before = visited.groupBy("target").agg(F.count("*").alias("read"))
        nth = F.row_number().over(Window.partitionBy("target").orderBy("url"))
        level = new.withColumn("nth", nth).join(before, "target").filter(F.col("nth") + F.col("read") <= most).select("target", "url")
        visited = visited.union(level)
    return grep(found.distinct(), include, exclude)


# What the academic preset asks for.
ACADEMIC = (("categories", "science"), ("engines", "arxiv,google_scholar,crossref,core"))


def search_requests(queries: DataFrame, bases: DataFrame, academic: bool = False, engines: str | None = None, time_range: str | None = None) -> DataFrame:
    """queries (query) x bases (source, base) -> query, source, url: what to ask each server; the academic preset takes the place of engines."""
    told = ACADEMIC if academic else (("engines", engines),) if engines else ()
    more = [F.concat(F.lit(f"&{k}="), F.url_encode(F.lit(v))) for k, v in (("format", "json"), *told, *((("time_range", time_range),) if time_range else ()))]
    url = F.concat(F.regexp_replace("base", "/+$", ""), F.lit("/search?q="), F.url_encode("query"), *more)
    return queries.select("query").distinct().join(F.broadcast(bases), F.lit(True)).select("query", "source", url.alias("url"))  # bases are a handful of servers


def grep(urls: DataFrame, include: str | None = None, exclude: str | None = None, column: str = "url") -> DataFrame:
    """Addresses that match include and not exclude, anywhere and in any case."""
    out = urls
    if include:
        out = out.filter(F.col(column).rlike("(?i)" + include))
    return out.filter(~F.col(column).rlike("(?i)" + exclude)) if exclude else out


def url_list(lines: DataFrame) -> DataFrame:
    """lines (pos, line) -> pos, url: trimmed, without blanks and comments."""
    return lines.select("pos", F.trim("line").alias("url")).filter("url <> '' and not url like '#%'")


def links_only(lines: DataFrame) -> DataFrame:
    """http(s) addresses among result lines, trimmed, each once."""
    return ordered_distinct(lines.select("pos", F.trim("line").alias("url")).filter(F.col("url").rlike("^https?://")), "url")


def main_text(html: Column) -> Column:
    """The text of a page: scripts, styles and tags dropped, entities of the five basic signs undone, space collapsed."""
    x = F.regexp_replace(html, r"(?is)<(script|style|nav|header|footer)\b.*?</\1\s*>", " ")
    x = F.regexp_replace(x, r"(?s)<!--.*?-->|<[^>]*>", " ")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(sign))
    return t.collapse(x)


def fetch_route(url: Column, content_type: Column, text_chars: Column, rendered_chars: Column) -> Column:
    """How a page becomes Markdown: pdf, direct, html (100 characters of main text), browser (over 50), or failed."""
    path = F.lower(F.regexp_replace(url, "[?#].*$", ""))
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    direct = F.exists(F.array(*map(F.lit, TEXT_ENDINGS)), lambda e: path.endswith(e)) | kind.contains("text/markdown") | kind.contains("text/plain")
    return F.when(path.endswith(".pdf") | kind.contains("application/pdf"), "pdf").when(direct, "direct").when(text_chars >= 100, "html").when(rendered_chars > 50, "browser").otherwise("failed")


def with_source(url: Column, text: Column) -> Column:
    return F.concat(F.lit("# Source: "), url, F.lit("\n\n"), text)


INSTANCE = "map<string, struct<network_type:string, uptime:struct<uptimeMonth:double>, timing:struct<search:struct<`all`:struct<median:double>>>, html:struct<grade:string>, engines:map<string, struct<error_rate:double>>>>"


def rank_instances(rows: DataFrame, top: int = 5, engine: str = "google cse") -> DataFrame:
    """rows (json of {"instances": {...}}) -> url, uptime, latency, place: reliable search servers, the best `top` (the feature's limit)."""
    x = rows.select(F.explode(F.from_json("json", f"struct<instances:{INSTANCE}>")["instances"]).alias("url", "i"))
    y = x.select("url", F.col("i.network_type").alias("net"), F.coalesce("i.uptime.uptimeMonth", F.lit(0.0)).alias("uptime"), F.coalesce(F.col("i.timing.search.all.median"), F.lit(999.0)).alias("latency"), F.col("i.html.grade").alias("grade"), F.coalesce(F.element_at("i.engines", F.lit(engine))["error_rate"], F.lit(0.0)).alias("errors"))
    good = y.filter((F.col("net") == "normal") & (F.col("uptime") >= 99) & F.col("grade").isin("A", "A+", "V") & (F.col("errors") < 50))
    best = good.orderBy(F.desc("uptime"), "latency", "url").limit(top)  # each task keeps `top`
    place = F.row_number().over(Window.orderBy(F.desc("uptime"), "latency", "url"))  # over those few
    return best.select(place.cast("long").alias("place"), "url", "uptime", "latency")


def first_answer(replies: DataFrame, top: int = 10) -> DataFrame:
    """replies (query, source, json {"results": [...]}) -> query, place, title, url, engine, content: the results of the first source that has any, `top` at most."""
    rows = F.from_json("json", "struct<results:array<struct<title:string, url:string, engine:string, content:string>>>")["results"]
    x = replies.withColumn("r", rows).filter(F.size("r") > 0)
    first = x.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("source"))).filter("n = 1")
    y = first.select("query", F.posexplode(F.slice("r", 1, top)).alias("pos", "r"))
    return y.select("query", (F.col("pos") + 1).cast("long").alias("place"), F.coalesce("r.title", F.lit("Untitled")).alias("title"), F.coalesce("r.url", F.lit("")).alias("url"), F.coalesce("r.engine", F.lit("unknown")).alias("engine"), F.trim(F.coalesce("r.content", F.lit(""))).alias("content"))


def research_report(results: DataFrame) -> DataFrame:
    """query -> report: the results numbered from 1."""
    item = F.concat(F.col("place").cast("string"), F.lit(". **"), "title", F.lit("**\n   - URL: "), "url", F.lit("\n   - Source Engine: "), "engine", F.lit("\n   - Snippet: "), "content", F.lit("\n"))
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", item.alias("x")))), lambda s: s["x"]), "\n")
    return results.groupBy("query").agg(F.concat(F.lit("# Research Report: "), F.first("query"), F.lit("\n\n## Search Results\n\n"), items).alias("report"))


def is_fresh(now: Column, modified: Column, seconds: int = 86_400) -> Column:
    return F.unix_timestamp(now) - F.unix_timestamp(modified) < seconds
