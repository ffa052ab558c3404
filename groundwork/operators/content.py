"""The main content of web pages: blocks scored by text and links, rendered as Markdown. Expressions alone.

A page without its scripts, navigation and advertising boxes is cut at block tags. A block's own
weight is its characters less three times those inside links; its score adds a quarter of both
neighbours' weights. Blocks of enough score, and code, that are not mostly links are content, and
so are headings right above one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.functions import text as t

# The elements that never hold content, those that are dropped by a word of their class or id, and those that begin a block.
DROPPED = ("script", "style", "head", "noscript", "nav", "header", "footer", "aside", "form")
BOXES = ("div", "section", "ul", "ol", "p", "span")
SIDE_WORDS = "ad|ads|advert|banner|breadcrumb|comments|cookie|menu|newsletter|popup|promo|related|share|sidebar|social|sponsor"
BLOCK = "address|article|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|h[1-6]|hr|html|li|main|ol|p|pre|section|table|tbody|tfoot|thead|tr|ul"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
COMMENT, TAG, CELL, LINK = r"(?s)<!--.*?-->", r"(?s)<[^>]*>", r"(?i)<(td|th)\b[^>]*>", r"(?is)<a\b[^>]*>(.*?)</a\s*>"
BOUND = rf"(?i)<(/?)({BLOCK})\b[^>]*>"
LEAST = 160  # four times the score that content has


def dropped(name: str) -> str:
    return rf"(?is)<{name}\b.*?</{name}\s*>"


def box(name: str) -> str:
    return rf"""(?is)<{name}\b[^>]*\b(?:class|id)\s*=\s*["'][^"'>]*\b(?:{SIDE_WORDS})\b[^"'>]*["'][^>]*>.*?</{name}\s*>"""


def untagged(c: Column) -> Column:
    c = F.regexp_replace(c, TAG, " ")
    for entity, sign in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return c


def held(value: Column, then) -> Column:
    """then(value), the value computed once: a column named inside a lambda is put there whole by the optimizer's filters, and computed again for every element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def with_blocks(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with `blocks`, an array of (tag, text, n_chars, link_chars, score, kept); blocks without text are left out. Null pages have none."""
    c = F.regexp_replace(F.translate(F.coalesce(html, F.lit("")), "\x01\x02", "  "), COMMENT, " ")
    for name in DROPPED:
        c = F.regexp_replace(c, dropped(name), " ")
    for name in BOXES:
        c = F.regexp_replace(c, box(name), " ")
    marked = F.regexp_replace(F.regexp_replace(c, CELL, " | "), BOUND, "\x01$1$2\x02")

    def block(piece: Column) -> Column:
        told = piece.contains("\x02")
        tag = F.when(told, F.lower(F.substring_index(piece, "\x02", 1))).otherwise("")
        inner = F.when(told, F.split_part(piece, F.lit("\x02"), F.lit(2))).otherwise(piece)
        links = F.aggregate(F.regexp_extract_all(inner, F.lit(LINK), 1), F.lit(0), lambda n, x: n + F.length(t.collapse(untagged(x))))
        return F.struct(tag.alias("tag"), F.when(tag == "pre", F.rtrim(untagged(inner))).otherwise(t.collapse(untagged(inner))).alias("text"), links.alias("links"))

    def weighed(b: Column) -> Column:
        return F.struct(b["tag"].alias("tag"), b["text"].alias("text"), F.length(b["text"]).alias("n"), b["links"].alias("links"), (F.length(b["text"]) - 3 * b["links"]).alias("own"))

    def beside(all_: Column, place: Column) -> Column:
        return F.coalesce(F.when(place >= 0, F.get(all_, place)["own"]), F.lit(0))

    def scored(all_: Column, b: Column, i: Column) -> Column:
        score = 4 * b["own"] + beside(all_, i - 1) + beside(all_, i + 1)
        return F.struct(b["tag"].alias("tag"), b["text"].alias("text"), b["n"].alias("n_chars"), b["links"].alias("link_chars"), score.alias("score"), ((2 * b["links"] <= b["n"]) & ((score >= LEAST) | (b["tag"] == "pre"))).alias("good"))

    def kept(all_: Column, b: Column, i: Column) -> Column:
        under = F.coalesce(F.get(all_, i + 1)["good"], F.lit(False))
        return F.struct(*(b[c].alias(c) for c in ("tag", "text", "n_chars", "link_chars", "score")), (b["good"] | (b["tag"].rlike("^h[1-6]$") & under)).alias("kept"))

    own = F.filter(F.transform(F.transform(F.split(marked, "\x01"), block), weighed), lambda b: b["text"] != "")
    scores = held(own, lambda x: F.transform(x, lambda b, i: scored(x, b, i)))
    return pages.withColumn("blocks", held(scores, lambda x: F.transform(x, lambda b, i: kept(x, b, i))))


def with_markdown(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with `markdown`: the kept blocks, with headings, lists, tables, quotes and code."""

    def rendered(all_: Column, b: Column, i: Column) -> Column:
        tag, said = b["tag"], b["text"]
        form = (
            F.when(tag.rlike("^h[1-6]$"), F.concat(F.repeat(F.lit("#"), F.substring(tag, 2, 1).cast("int")), F.lit(" "), said))
            .when(tag == "li", F.concat(F.lit("- "), said))
            .when(tag == "tr", F.concat(said, F.lit(" |")))
            .when(tag == "blockquote", F.concat(F.lit("> "), said))
            .when(tag == "pre", F.concat(F.lit("```\n"), said, F.lit("\n```")))
            .otherwise(said)
        )
        close = tag.isin("li", "tr") & F.coalesce(F.get(all_, i - 1)["tag"] == tag, F.lit(False))
        return F.concat(F.when(i == 0, "").when(close, "\n").otherwise("\n\n"), form)

    kept = F.filter("blocks", lambda b: b["kept"])
    return with_blocks(pages, html).withColumn("markdown", F.array_join(held(kept, lambda x: F.transform(x, lambda b, i: rendered(x, b, i))), ""))
