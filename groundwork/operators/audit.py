"""Grounding audit: anchors, tag transitions, stitching, claims. The exact-substring proof is operators.containment.

Review text is a table of lines (doc, idx, line); a source is one normalized string a doc. Similarity
annotates and routes; it never grants or denies grounding. A NULL score always accepts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.functions import text as t

AUTHORED, PROMOTED, FLAGGED = "evidence", ("validated", "fixed"), ("unsupported",)
#: Fixed value: the marker of a field that has no evidence.
SENTINEL = "not specified in paper"
STITCH_GAP = 200


def family(tag: str = AUTHORED) -> list[str]:
    return [tag, *PROMOTED, *FLAGGED]


def review_lines(docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """A row a line: doc, idx from 0, line."""
    return docs.select(doc, F.posexplode(t.lines(F.col(text))).alias("idx", "line")).withColumn("idx", F.col("idx").cast("long"))


def with_heading(lines: DataFrame) -> DataFrame:
    """The nearest heading above each line; a heading starts at column 0 and has text after blanks."""
    own = F.when(F.col("line").rlike(r"^#{1,6}\s+"), F.trim(F.regexp_extract("line", r"^#{1,6}\s+(.*)$", 1)))
    order = Window.partitionBy("doc").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("is_heading", own.isNotNull()).withColumn("hdr", F.coalesce(F.last(own, True).over(order), F.lit("(top)")))


def anchors(lines: DataFrame, tag: str = AUTHORED) -> DataFrame:
    """Every anchor of the tag family: doc, idx, ord (from 0 in its line), hdr, tag, quote, uncertain, raw."""
    tags = "|".join(family(tag))
    one = rf'`?\[({tags})\]`?\s*"([^"]+)"\s*(\(OCR-uncertain\))?'
    found = with_heading(lines).filter(~F.col("is_heading")).select("doc", "idx", "hdr", F.posexplode(F.regexp_extract_all("line", F.lit(one), 0)).alias("ord", "raw"))
    out = found.select(
        "doc", "idx", F.col("ord").cast("long").alias("ord"), "hdr", F.regexp_extract("raw", one, 1).alias("tag"), F.regexp_extract("raw", one, 2).alias("quote"), (F.regexp_extract("raw", one, 3) != "").alias("uncertain"), "raw"
    )
    bare = F.trim(F.regexp_replace(F.lower(t.normalize(F.col("quote"))), r"\.+$", ""))
    return out.filter(bare != SENTINEL)


def soft(quote: Column, uncertain: Column) -> Column:
    return uncertain | quote.contains("$")


def transition(tag: Column, grounded: Column, is_soft: Column, in_baseline: Column, has_baseline: Column, authored: str = AUTHORED) -> Column:
    """The tag an anchor has after the audit."""
    edited = has_baseline & ~in_baseline
    return (
        F.when(tag == "unsupported", tag)
        .when(grounded & (tag == authored), F.when(edited, "fixed").otherwise("validated"))
        .when(grounded, tag)
        .when(is_soft & tag.isin(*PROMOTED), authored)
        .when(~is_soft & (tag == "validated"), authored)
        .otherwise(tag)
    )


def outcome(tag: Column, grounded: Column, is_soft: Column, in_baseline: Column, has_baseline: Column, authored: str = AUTHORED) -> Column:
    """What an anchor counts as: flagged, validated, fixed, kept, warn or tripped."""
    edited = has_baseline & ~in_baseline
    return (
        F.when(tag == "unsupported", "flagged")
        .when(grounded & (tag == authored), F.when(edited, "fixed").otherwise("validated"))
        .when(grounded & (tag == "fixed"), "fixed")
        .when(grounded, "kept")
        .when(is_soft, "warn")
        .otherwise("tripped")
    )


def finalized(tag: Column, grounded: Column, is_soft: Column, in_baseline: Column, has_baseline: Column, state: Column, authored: str = AUTHORED) -> Column:
    """The tag after the last step: grounded authored tags are promoted; ungrounded ones demoted if the debate agreed."""
    edited = has_baseline & ~in_baseline
    return (
        F.when(~tag.isin(authored, "fixed") | is_soft, tag)
        .when(grounded, F.when(tag == authored, F.when(edited, "fixed").otherwise("validated")).otherwise(tag))
        .when(F.coalesce(state == "agreed", F.lit(False)), "unsupported")
        .otherwise(tag)
    )


def exit_code(tripped: Column, floor: Column, no_progress: Column) -> Column:
    return F.when((tripped == 0) & ~floor, 0).when(no_progress & ~floor, 0).otherwise(1)


def stitch(fragments: Column, source: Column) -> Column:
    """Fold over fragments: the first place of each after the one before. Struct of first, end (0 based) and matched length, ok."""
    zero = F.struct(F.lit(-1).alias("first"), F.lit(0).alias("at"), F.lit(0).alias("matched"), F.lit(True).alias("ok"))

    def step(acc, f):
        found = F.call_function("locate", f, source, acc["at"] + 1) - 1
        ok = acc["ok"] & (found >= 0)
        return F.struct(
            F.when(acc["first"] < 0, found).otherwise(acc["first"]).alias("first"), F.when(ok, found + F.length(f)).otherwise(acc["at"]).alias("at"), (acc["matched"] + F.length(f)).alias("matched"), ok.alias("ok")
        )

    return F.aggregate(fragments, zero, step)


def stitched(quote: Column, source: Column, score: Column | None = None, threshold: float = 0.6, gap: int = STITCH_GAP) -> Column:
    """The one continuous source span that an ellipsis-spliced quote came from; NULL where it can't be rebuilt."""
    parts = t.split_ellipsis(quote)
    run = stitch(parts, source)
    span = F.substring(source, run["first"] + 1, run["at"] - run["first"])
    fits = run["ok"] & (run["at"] - run["first"] - run["matched"] <= gap) & ~span.contains('"')
    accept = F.lit(True) if score is None else F.coalesce(score >= threshold, F.lit(True))
    return F.when((F.size(parts) >= 2) & ~source.contains(t.normalize(quote)) & fits & accept, span)


def relabelled(line: Column, changes: Column, tag: str = AUTHORED) -> Column:
    """The line with each change (raw, new_tag) applied to the first place of its raw text."""
    tags = "|".join(family(tag))

    def step(acc, x):
        at = F.call_function("locate", x["raw"], acc)
        new = F.concat(F.lit("["), x["new_tag"], F.lit("]"), F.regexp_replace(x["raw"], rf"^`?\[({tags})\]`?", ""))
        return F.when(at > 0, F.concat(F.substring(acc, F.lit(1), at - 1), new, F.substring(acc, at + F.length(x["raw"]), F.length(acc)))).otherwise(acc)

    return F.aggregate(changes, line, step)


def paragraphs(lines: DataFrame) -> DataFrame:
    """Claims of a text: doc, para (from 1), block. Fences toggle code; blank lines, headings and fences end a paragraph."""
    order = Window.partitionBy("doc").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    bare = F.trim("line")
    fence = bare.startswith("```") | bare.startswith("~~~")
    x = lines.withColumn("fence", fence).withColumn("inside", F.sum(fence.cast("int")).over(order) % 2 == 1)
    x = x.withColumn("edge", F.col("fence") | F.col("inside") | bare.startswith("#") | (bare == ""))
    x = x.withColumn("run", F.sum(F.col("edge").cast("int")).over(order)).filter(~F.col("edge"))
    block = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "line"))), lambda s: s["line"]), "\n")
    blocks = x.groupBy("doc", "run").agg(F.trim(block).alias("block"))
    return blocks.select("doc", F.row_number().over(Window.partitionBy("doc").orderBy("run")).alias("para"), "block")


def claim_blocks(lines: DataFrame, at: DataFrame, margin: int = 2, paragraphs_each_way: int = 0) -> DataFrame:
    """The passage around each line of `at` (doc, idx): its paragraph, more paragraphs each way within its heading, and some lines."""
    order = Window.partitionBy("doc").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.trim("line").rlike(r"^#{1,6}\s")
    edge = heading | (F.trim("line") == "")
    x = lines.withColumn("edge", edge).withColumn("part", F.sum(heading.cast("int")).over(order)).withColumn("run", F.sum(edge.cast("int")).over(order))
    spans = x.filter(~F.col("edge")).groupBy("doc", "part", "run").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    spans = spans.withColumn("nth", F.row_number().over(Window.partitionBy("doc", "part").orderBy("run")))
    own = at.join(x.filter(~F.col("edge")).select("doc", "idx", "part", "run"), ["doc", "idx"]).join(spans.select("doc", "part", "run", "nth"), ["doc", "part", "run"])
    near = spans.select("doc", "part", F.col("nth").alias("other"), "lo", "hi")
    others = F.sequence(F.col("nth") - paragraphs_each_way, F.col("nth") + paragraphs_each_way)
    reach = own.withColumn("other", F.explode(others)).join(near, ["doc", "part", "other"])
    bounds = reach.groupBy("doc", "idx").agg((F.min("lo") - margin).alias("lo"), (F.max("hi") + margin).alias("hi"))
    taken = bounds.select("doc", "idx", F.explode(F.sequence("lo", "hi")).alias("i")).join(lines.select("doc", F.col("idx").alias("i"), "line"), ["doc", "i"])
    block = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda s: s["line"]), "\n")
    return taken.groupBy("doc", "idx").agg(F.regexp_replace(block, r"^\s+|\s+$", "").alias("block"))


def verified(entail: Column, cosine: Column, entail_threshold: float = 0.5, region_threshold: float = 0.6) -> Column:
    """method, score, threshold: entailment where there is one, else similarity; supported unless a score says no."""
    method = F.when(entail.isNotNull(), "entail").otherwise("cosine")
    score, least = F.coalesce(entail, cosine), F.when(entail.isNotNull(), entail_threshold).otherwise(region_threshold)
    return F.struct(method.alias("method"), score.alias("score"), least.alias("threshold"), F.coalesce(score >= least, F.lit(True)).alias("supported"))


def report(trips: DataFrame) -> DataFrame:
    """A Markdown report a doc from trips (doc, ord, hdr, quote, score, threshold, method, block); docs without trips have none."""
    shown = F.when(F.col("score").isNull(), "n/a").otherwise(F.format_string("%.2f", F.col("score")))
    risk = F.when(F.col("score").isNull(), "").when(F.col("score") >= F.col("threshold"), F.concat(F.lit("  (supported, "), F.col("method"), F.lit(")"))).otherwise(F.concat(F.lit("  (LOW, "), F.col("method"), F.lit(")")))
    part = F.concat(F.lit("## "), F.col("hdr"), F.lit("\n- claim support "), shown, risk, F.lit(f'\n- [{AUTHORED}] "'), F.col("quote"), F.lit('"\n'), F.col("block"))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", part.alias("p")))), lambda s: s["p"]), "\n\n")
    return trips.groupBy("doc").agg(F.concat(F.lit("# Evidence grounding\n\n"), F.count("*").cast("string"), F.lit(" unresolved\n\n"), parts).alias("report"))


def no_progress(attempts: DataFrame) -> DataFrame:
    """attempts (doc, attempt, tripped array): whether each attempt tripped over the same set as the one before; attempt 0 starts anew."""
    now = F.array_join(F.sort_array("tripped"), ",")
    before = F.lag(now).over(Window.partitionBy("doc").orderBy("attempt"))
    return attempts.select("doc", "attempt", now.alias("tripped_set"), F.coalesce((before == now) & (F.col("attempt") > 0), F.lit(False)).alias("no_progress"))
