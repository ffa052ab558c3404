"""Queries of the grounding audit. Review text is made from `benchmark`, sources are all `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.functions import text as t
from groundwork.operators import audit, containment
from groundwork.plans.common import normalize, quote_hash, table

#: One expression for both engines: the line of each item by k, and the item's review.
LINE = """CASE k WHEN 0 THEN CASE WHEN item_id % 3 = 0 THEN concat('## Item ', item_id) ELSE '' END
 WHEN 1 THEN concat('Claim ', item_id, ' says more.')
 ELSE concat('- `[', CASE item_id % 4 WHEN 0 THEN 'evidence' WHEN 1 THEN 'validated' WHEN 2 THEN 'fixed' ELSE 'unsupported' END, ']` "',
   CASE WHEN item_id % 13 = 5 THEN 'Not specified in paper.' WHEN item_id % 5 = 3 THEN concat(text, ' $x$') ELSE text END, '"',
   CASE WHEN item_id % 7 = 0 THEN ' (OCR-uncertain)' ELSE '' END,
   CASE WHEN item_id % 10 = 1 THEN concat(' and [evidence] "second quote ', item_id, '"') ELSE '' END) END"""
ANCHOR = r"""`?\[(evidence|validated|fixed|unsupported)\]`?\s*"([^"]+)"\s*(\(OCR-uncertain\))?"""


def review(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "benchmark").crossJoin(spark.range(3).toDF("k")).select((F.col("item_id") % 4).alias("doc"), "item_id", "k", F.expr(LINE).alias("line"))
    return x.selectExpr("doc", "bigint(row_number() over (partition by doc order by item_id, k)) - 1 as idx", "line", "item_id")


REVIEW = f"""review AS (SELECT item_id % 4 AS doc, row_number() OVER (PARTITION BY item_id % 4 ORDER BY item_id, k) - 1 AS idx, item_id, {LINE} AS line
 FROM benchmark, range(3) r(k)),
headed AS (SELECT *, regexp_matches(line, '^#{{1,6}}\\s+') AS is_heading,
  coalesce(last_value(CASE WHEN regexp_matches(line, '^#{{1,6}}\\s+') THEN trim(regexp_extract(line, '^#{{1,6}}\\s+(.*)$', 1)) END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY idx), '(top)') AS hdr FROM review),
raws AS (SELECT doc, idx, hdr, unnest(regexp_extract_all(line, '{ANCHOR}')) AS raw, unnest(range(len(regexp_extract_all(line, '{ANCHOR}')))) AS ord FROM headed WHERE NOT is_heading),
parts AS (SELECT doc, idx, ord, hdr, regexp_extract(raw, '{ANCHOR}', 1) AS tag, regexp_extract(raw, '{ANCHOR}', 2) AS quote, regexp_extract(raw, '{ANCHOR}', 3) <> '' AS uncertain, raw FROM raws),
anchors AS (SELECT * FROM parts WHERE trim(regexp_replace(lower({normalize("quote")}), '\\.+$', '')) <> 'not specified in paper')"""

SOURCES = f"sources AS MATERIALIZED (SELECT doc_id AS source_id, {normalize('text')} AS s FROM documents)"


def ground_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    sources = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "text")
    found = containment.grounded_pairs(quotes, sources).groupBy("quote_id").agg(F.count("*").alias("n_sources"), F.min("source_id").alias("first_source"))
    n = F.coalesce("n_sources", F.lit(0))
    return quotes.join(found, "quote_id", "left").select(
        F.col("quote_id").alias("item_id"), F.when(n > 0, "validated").otherwise("evidence").alias("tag"), n.alias("n_sources"), "first_source", t.quote_hash(F.col("quote")).alias("quote_hash")
    )


GROUND_PASSAGES = f"""WITH {SOURCES}, quotes AS (SELECT item_id, text, {normalize("text")} AS q FROM benchmark),
hits AS (SELECT item_id, count(*) AS n, min(source_id) AS first_source FROM quotes JOIN sources ON contains(s, q) AND q <> '' GROUP BY 1)
SELECT item_id, CASE WHEN coalesce(n, 0) > 0 THEN 'validated' ELSE 'evidence' END AS tag, coalesce(n, 0) AS n_sources, first_source, {quote_hash("text")} AS quote_hash
FROM quotes LEFT JOIN hits USING (item_id)"""


def shingle_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strategy for large quote sets, run at any size."""
    quotes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    sources = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "text")
    return containment.by_shingles(quotes, sources)


SHINGLE_GROUNDING = f"""WITH {SOURCES} SELECT item_id AS quote_id, source_id FROM benchmark JOIN sources ON contains(s, {normalize("text")})"""


def anchor_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = audit.anchors(review(spark, sf_dir))
    return a.select("doc", "idx", "ord", "hdr", "tag", "quote", "uncertain", audit.soft(F.col("quote"), F.col("uncertain")).alias("is_soft"), t.quote_hash(F.col("quote")).alias("quote_hash"))


ANCHOR_EXTRACT = f"""WITH {REVIEW} SELECT doc, idx, ord, hdr, tag, quote, uncertain, uncertain OR contains(quote, '$') AS is_soft, {quote_hash("quote")} AS quote_hash FROM anchors"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors with grounded, is_soft, baseline membership and the debate's state."""
    a = audit.anchors(review(spark, sf_dir)).withColumn("h", t.quote_hash(F.col("quote")))
    sources = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "text")
    quotes = a.select(F.col("h").alias("quote_id"), "quote").dropDuplicates(["quote_id"])
    hit = containment.grounded_pairs(quotes, sources).select(F.col("quote_id").alias("h")).distinct().withColumn("hit", F.lit(True))
    base = table(spark, sf_dir, "benchmark").filter("item_id % 2 = 0").select((F.col("item_id") % 4).alias("doc"), t.quote_hash(F.col("text")).alias("h")).distinct().withColumn("base", F.lit(True))
    flags = a.join(hit, "h", "left").join(base, ["doc", "h"], "left")
    return flags.select(
        "doc", "idx", "ord", "hdr", "tag", "quote", "h", "raw", F.coalesce("hit", F.lit(False)).alias("grounded"), audit.soft(F.col("quote"), F.col("uncertain")).alias("is_soft"),
        F.coalesce("base", F.lit(False)).alias("in_baseline"), (F.col("doc") % 2 == 0).alias("has_baseline"), F.when(F.col("doc") < 2, "agreed").when(F.col("doc") == 2, "deadlock").alias("state"),
    )


JUDGED = f"""{REVIEW}, {SOURCES},
hashed AS (SELECT *, {quote_hash("quote")} AS h FROM anchors),
uniq AS (SELECT h, any_value(quote) AS quote FROM hashed GROUP BY h),
hit AS (SELECT DISTINCT h FROM uniq JOIN sources ON contains(s, {normalize("quote")})),
base AS (SELECT DISTINCT item_id % 4 AS doc, {quote_hash("text")} AS h FROM benchmark WHERE item_id % 2 = 0),
judged AS (SELECT doc, idx, ord, hdr, tag, quote, h, raw, h IN (SELECT h FROM hit) AS grounded, uncertain OR contains(quote, '$') AS is_soft,
 (doc, h) IN (SELECT (doc, h) FROM base) AS in_baseline, doc % 2 = 0 AS has_baseline, CASE WHEN doc < 2 THEN 'agreed' WHEN doc = 2 THEN 'deadlock' END AS state FROM hashed)"""
OUTCOME = """CASE WHEN tag = 'unsupported' THEN 'flagged' WHEN grounded AND tag = 'evidence' THEN CASE WHEN has_baseline AND NOT in_baseline THEN 'fixed' ELSE 'validated' END
 WHEN grounded AND tag = 'fixed' THEN 'fixed' WHEN grounded THEN 'kept' WHEN is_soft THEN 'warn' ELSE 'tripped' END"""
NEW_TAG = """CASE WHEN tag = 'unsupported' THEN tag WHEN grounded AND tag = 'evidence' THEN CASE WHEN has_baseline AND NOT in_baseline THEN 'fixed' ELSE 'validated' END
 WHEN grounded THEN tag WHEN is_soft AND tag IN ('validated', 'fixed') THEN 'evidence' WHEN NOT is_soft AND tag = 'validated' THEN 'evidence' ELSE tag END"""
FLAGS = ("tag", "grounded", "is_soft", "in_baseline", "has_baseline")


def audit_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = [F.col(c) for c in FLAGS]
    return judged(spark, sf_dir).select("doc", "idx", "ord", "tag", "grounded", "is_soft", audit.transition(*cols).alias("new_tag"), audit.outcome(*cols).alias("outcome"))


AUDIT_TRANSITIONS = f"WITH {JUDGED} SELECT doc, idx, ord, tag, grounded, is_soft, {NEW_TAG} AS new_tag, {OUTCOME} AS outcome FROM judged"


def counters(j: DataFrame) -> DataFrame:
    o = audit.outcome(*[F.col(c) for c in FLAGS])
    count = lambda name: F.count_if(F.col("o") == name).alias(name)
    x = j.withColumn("o", o).groupBy("doc").agg(F.count("*").alias("total"), *map(count, ("validated", "fixed", "flagged", "kept", "warn", "tripped")))
    return x


def audit_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a document's audit, the anchor floor against its baseline and the exit code."""
    base = table(spark, sf_dir, "benchmark").filter("item_id % 2 = 0").groupBy((F.col("item_id") % 4).alias("doc")).agg(F.count_distinct(t.quote_hash(F.col("text"))).alias("baseline"))
    x = counters(judged(spark, sf_dir)).join(base, "doc", "left").withColumn("baseline", F.coalesce("baseline", F.lit(0)))
    floor = (F.col("baseline") > 0) & (F.col("total") < F.col("baseline"))
    return x.withColumn("floor_violation", floor).withColumn("exit_code", audit.exit_code(F.col("tripped"), F.col("floor_violation"), F.col("doc") == 3))


AUDIT_COUNTERS = f"""WITH {JUDGED}, o AS (SELECT *, {OUTCOME} AS o FROM judged),
c AS (SELECT doc, count(*) AS total, count_if(o = 'validated')::BIGINT AS validated, count_if(o = 'fixed')::BIGINT AS fixed, count_if(o = 'flagged')::BIGINT AS flagged, count_if(o = 'kept')::BIGINT AS kept, count_if(o = 'warn')::BIGINT AS warn, count_if(o = 'tripped')::BIGINT AS tripped FROM o GROUP BY doc),
b AS (SELECT item_id % 4 AS doc, count(DISTINCT {quote_hash("text")}) AS baseline FROM benchmark WHERE item_id % 2 = 0 GROUP BY 1),
f AS (SELECT c.*, coalesce(baseline, 0) AS baseline, coalesce(baseline, 0) > 0 AND total < coalesce(baseline, 0) AS floor_violation FROM c LEFT JOIN b USING (doc))
SELECT doc, total, validated, fixed, flagged, kept, warn, tripped, baseline, floor_violation, CASE WHEN tripped = 0 AND NOT floor_violation THEN 0 WHEN doc = 3 AND NOT floor_violation THEN 0 ELSE 1 END::INT AS exit_code FROM f"""


def finalize_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = [F.col(c) for c in (*FLAGS, "state")]
    return judged(spark, sf_dir).select("doc", "idx", "ord", "tag", "state", audit.finalized(*cols).alias("new_tag"))


FINALIZE_TAGS = f"""WITH {JUDGED} SELECT doc, idx, ord, tag, state, CASE WHEN tag NOT IN ('evidence', 'fixed') OR is_soft THEN tag
 WHEN grounded THEN CASE WHEN tag = 'evidence' THEN CASE WHEN has_baseline AND NOT in_baseline THEN 'fixed' ELSE 'validated' END ELSE tag END
 WHEN coalesce(state = 'agreed', false) THEN 'unsupported' ELSE tag END AS new_tag FROM judged"""


def relabel_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as they read after the audit: each changed anchor relabelled in its place."""
    j = judged(spark, sf_dir).withColumn("new_tag", audit.transition(*[F.col(c) for c in FLAGS])).filter("new_tag <> tag")
    changes = j.groupBy("doc", "idx").agg(F.array_sort(F.collect_list(F.struct("ord", "raw", "new_tag"))).alias("changes"))
    return review(spark, sf_dir).join(changes, ["doc", "idx"]).select("doc", "idx", audit.relabelled(F.col("line"), F.col("changes")).alias("line"))


RELABEL_LINES = rf"""WITH {JUDGED}, n AS (SELECT *, {NEW_TAG} AS new_tag FROM judged), ch AS (SELECT doc, idx, list({{'raw': raw, 'new_tag': new_tag}} ORDER BY ord) AS ch FROM n WHERE new_tag <> tag GROUP BY doc, idx),
one AS (SELECT doc, idx, line, ch, list_transform(ch, lambda x: x.raw) AS raws FROM review JOIN ch USING (doc, idx)),
s1 AS (SELECT doc, idx, ch, CASE WHEN contains(line, ch[1].raw) THEN concat(substr(line, 1, instr(line, ch[1].raw) - 1), '[', ch[1].new_tag, ']', regexp_replace(ch[1].raw, '^`?\[(evidence|validated|fixed|unsupported)\]`?', ''), substr(line, instr(line, ch[1].raw) + length(ch[1].raw))) ELSE line END AS line FROM one)
SELECT doc, idx, CASE WHEN len(ch) > 1 AND contains(line, ch[2].raw) THEN concat(substr(line, 1, instr(line, ch[2].raw) - 1), '[', ch[2].new_tag, ']', regexp_replace(ch[2].raw, '^`?\[(evidence|validated|fixed|unsupported)\]`?', ''), substr(line, instr(line, ch[2].raw) + length(ch[2].raw))) ELSE line END AS line FROM s1"""

#: Splices made of a document's own normalized text, and of the next document's for some.
SPLICED = """concat(substr(n, 2, 29), ' ... ', CASE WHEN doc_id % 9 = 4 THEN 'nowhere to be found' ELSE substr(n, 61 + (doc_id % 5) * 60, 30) END, CASE WHEN doc_id % 6 = 5 THEN concat(' . . . ', substr(n, 1 + length(n) - 20, 20)) ELSE '' END)"""


def ellipsis_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "documents").select("doc_id", t.normalize(F.col("text")).alias("n")).filter("length(n) >= 100").withColumn("quote", F.expr(SPLICED))
    score = F.when(F.col("doc_id") % 8 == 0, 0.4).when(F.col("doc_id") % 8 < 4, 0.9)
    parts = t.split_ellipsis(F.col("quote"))
    return x.select("doc_id", F.size(parts).cast("long").alias("n_parts"), audit.stitched(F.col("quote"), F.col("n"), score).alias("stitched"))


ELLIPSIS_STITCH = rf"""WITH RECURSIVE d AS (SELECT doc_id, {normalize("text")} AS n FROM documents), q AS (SELECT *, {SPLICED} AS quote FROM d WHERE length(n) >= 100),
p AS (SELECT *, list_filter(list_transform(regexp_split_to_array(quote, '\s*(?:\.{{3,}}|…|\.(?:\s+\.){{2,}})\s*'), lambda x: {normalize("x")}), lambda x: x <> '') AS parts FROM q),
w AS (SELECT doc_id, 1 AS i, instr(n, parts[1]) AS first, CASE WHEN instr(n, parts[1]) > 0 THEN instr(n, parts[1]) - 1 + length(parts[1]) END AS upto, length(parts[1]) AS matched FROM p
 UNION ALL SELECT w.doc_id, i + 1, first, CASE WHEN upto IS NOT NULL AND instr(substr(n, upto + 1), parts[i + 1]) > 0 THEN upto + instr(substr(n, upto + 1), parts[i + 1]) - 1 + length(parts[i + 1]) END, matched + length(parts[i + 1])
 FROM w JOIN p USING (doc_id) WHERE i < len(parts)),
e AS (SELECT p.doc_id, p.n, p.quote, len(parts) AS n_parts, first, upto, matched, substr(n, first, upto - first + 1) AS span FROM p JOIN w ON p.doc_id = w.doc_id AND w.i = len(parts))
SELECT doc_id, n_parts, CASE WHEN n_parts >= 2 AND NOT contains(n, {normalize("quote")}) AND upto IS NOT NULL AND upto - first + 1 - matched <= 200 AND NOT contains(span, '"') AND doc_id % 8 <> 0 THEN span END AS stitched FROM e"""

#: Review prose with headings, fences and blank lines, from conversation turns.
PROSE = """CASE WHEN turn % 7 = 0 THEN concat('## Turn ', turn) WHEN turn % 7 = 3 THEN '' WHEN turn % 9 = 4 THEN '```' ELSE text END"""


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each conversation: doc, idx, line (line breaks in a turn stay one line)."""
    x = table(spark, sf_dir, "conversations").selectExpr("conv_id as doc", "turn", f"replace({PROSE}, '\n', ' ') as line")
    return x.selectExpr("doc", "bigint(row_number() over (partition by doc order by turn, line)) - 1 as idx", "line")


PROSE_SQL = f"prose AS (SELECT conv_id AS doc, row_number() OVER (PARTITION BY conv_id ORDER BY turn, replace({PROSE}, chr(10), ' ')) - 1 AS idx, replace({PROSE}, chr(10), ' ') AS line FROM conversations)"


def claim_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with a score and whether they fail: only a score below the threshold does."""
    p = audit.paragraphs(prose(spark, sf_dir))
    score = F.when(F.col("doc") % 3 > 0, (F.length("block") % 100) / 100.0)
    v = audit.verified(F.lit(None).cast("double"), score)
    return p.select("doc", F.col("para").cast("long"), "block", v["method"].alias("method"), v["score"].alias("score"), v["supported"].alias("supported"))


PARAGRAPHS = f"""{PROSE_SQL}, f AS (SELECT *, starts_with(trim(line), '```') OR starts_with(trim(line), '~~~') AS fence FROM prose),
g AS (SELECT *, sum(fence::INT) OVER (PARTITION BY doc ORDER BY idx) % 2 = 1 AS inside FROM f),
e AS (SELECT *, fence OR inside OR starts_with(trim(line), '#') OR trim(line) = '' AS edge FROM g),
r AS (SELECT *, sum(edge::INT) OVER (PARTITION BY doc ORDER BY idx) AS run FROM e),
b AS (SELECT doc, run, trim(string_agg(line, chr(10) ORDER BY idx)) AS block FROM r WHERE NOT edge GROUP BY doc, run),
paras AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY run) AS para, block FROM b)"""
CLAIM_PARAGRAPHS = f"""WITH {PARAGRAPHS}, s AS (SELECT *, CASE WHEN doc % 3 > 0 THEN (length(block) % 100) / 100.0::DOUBLE END AS score FROM paras)
SELECT doc, para, block, 'cosine' AS method, score, coalesce(score >= 0.6, true) AS supported FROM s"""


def claim_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = prose(spark, sf_dir)
    at = lines.filter("trim(line) <> '' and not trim(line) rlike '^#'").select("doc", "idx")
    return audit.claim_blocks(lines, at, 1, 1)


CLAIM_BLOCKS = rf"""WITH {PROSE_SQL}, x AS (SELECT *, regexp_matches(trim(line), '^#{{1,6}}\s') OR trim(line) = '' AS edge,
 sum(regexp_matches(trim(line), '^#{{1,6}}\s')::INT) OVER (PARTITION BY doc ORDER BY idx) AS part FROM prose),
y AS (SELECT *, sum(edge::INT) OVER (PARTITION BY doc ORDER BY idx) AS run FROM x),
sp AS (SELECT doc, part, run, min(idx) AS lo, max(idx) AS hi FROM y WHERE NOT edge GROUP BY ALL),
sn AS (SELECT *, row_number() OVER (PARTITION BY doc, part ORDER BY run) AS nth FROM sp),
a AS (SELECT doc, idx FROM prose WHERE trim(line) <> '' AND NOT regexp_matches(trim(line), '^#')),
o AS (SELECT a.doc, a.idx, y.part, sn.nth FROM a JOIN y ON a.doc = y.doc AND a.idx = y.idx AND NOT edge JOIN sn ON sn.doc = y.doc AND sn.part = y.part AND sn.run = y.run),
bo AS (SELECT o.doc, o.idx, min(lo) - 1 AS lo, max(hi) + 1 AS hi FROM o JOIN sn ON o.doc = sn.doc AND o.part = sn.part AND abs(o.nth - sn.nth) <= 1 GROUP BY ALL)
SELECT bo.doc, bo.idx, regexp_replace(string_agg(line, chr(10) ORDER BY p.idx), '^\s+|\s+$', '', 'g') AS block FROM bo JOIN prose p ON p.doc = bo.doc AND p.idx BETWEEN lo AND hi GROUP BY ALL"""


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of each turn and the weakest support among them; a failed scoring counts 0."""
    x = table(spark, sf_dir, "conversations").select("conv_id", "turn", t.sentences(F.col("text")).alias("s"))
    probs = F.transform("s", lambda s: (F.length(s) % 100) / 100.0)
    weakest = F.when(F.col("turn") % 11 == 10, 0.0).otherwise(F.coalesce(F.array_min(probs), F.lit(0.0)))
    return x.select("conv_id", "turn", F.size("s").cast("long").alias("n_sentences"), F.array_join("s", "|").alias("sentences"), weakest.alias("support"))


SENTENCE_SPLIT = r"""WITH p AS (SELECT conv_id, turn, trim(text) AS c, list_filter(list_transform(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) >= 8) AS k FROM conversations),
q AS (SELECT *, CASE WHEN len(k) > 0 THEN k ELSE [c] END AS s FROM p)
SELECT conv_id, turn, len(s) AS n_sentences, array_to_string(s, '|') AS sentences, CASE WHEN turn % 11 = 10 THEN 0.0::DOUBLE ELSE coalesce(list_min(list_transform(s, lambda x: (length(x) % 100) / 100.0::DOUBLE)), 0.0::DOUBLE) END AS support FROM q"""


def no_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts made from turns: two turns a step, so that some attempts trip over the same set."""
    x = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("attempt"), F.array(t.quote_hash(F.concat(F.lit("q"), F.floor(F.col("turn") / 2).cast("string"))), F.lit("b")).alias("tripped"))
    return audit.no_progress(x)


NO_PROGRESS = f"""WITH x AS (SELECT conv_id AS doc, turn AS attempt, array_to_string(list_sort([{quote_hash("concat('q', turn // 2)")}, 'b']), ',') AS tripped_set FROM conversations)
SELECT doc, attempt, tripped_set, coalesce(lag(tripped_set) OVER (PARTITION BY doc ORDER BY attempt) = tripped_set AND attempt > 0, false) AS no_progress FROM x"""


def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Markdown report of each document that has trips; clean documents have none."""
    j = judged(spark, sf_dir).withColumn("o", audit.outcome(*[F.col(c) for c in FLAGS])).filter("o = 'tripped'")
    score = F.when(F.col("idx") % 2 == 0, (F.length("quote") % 100) / 100.0)
    return audit.report(j.select("doc", (F.col("idx") * 100 + F.col("ord")).alias("ord"), "hdr", "quote", score.alias("score"), F.lit(0.6).alias("threshold"), F.lit("cosine").alias("method"), F.concat(F.lit("line "), F.col("idx").cast("string")).alias("block")))


AUDIT_REPORT = f"""WITH {JUDGED}, o AS (SELECT *, {OUTCOME} AS o, CASE WHEN idx % 2 = 0 THEN (length(quote) % 100) / 100.0::DOUBLE END AS score FROM judged)
SELECT doc, concat('# Evidence grounding', chr(10), chr(10), count(*), ' unresolved', chr(10), chr(10), string_agg(concat('## ', hdr, chr(10), '- claim support ', CASE WHEN score IS NULL THEN 'n/a' ELSE printf('%.2f', score) END,
 CASE WHEN score IS NULL THEN '' WHEN score >= 0.6 THEN '  (supported, cosine)' ELSE '  (LOW, cosine)' END, chr(10), '- [evidence] "', quote, '"', chr(10), 'line ', idx), chr(10) || chr(10) ORDER BY idx, ord)) AS report FROM o WHERE o = 'tripped' GROUP BY doc"""


def claims_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = claim_paragraphs(spark, sf_dir).filter("not supported")
    part = F.concat(F.lit("## Paragraph "), F.col("para").cast("string"), F.lit("\n- claim support: "), F.format_string("%.2f", F.col("score")), F.lit(" (LOW, "), F.col("method"), F.lit(")\n"), F.col("block"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para", part.alias("p")))), lambda s: s["p"]), "\n\n")
    return x.groupBy("doc").agg(F.count("*").alias("n_unsupported"), joined.alias("report"))


CLAIMS_REPORT = f"""WITH {PARAGRAPHS}, s AS (SELECT *, CASE WHEN doc % 3 > 0 THEN (length(block) % 100) / 100.0::DOUBLE END AS score FROM paras)
SELECT doc, count(*) AS n_unsupported, string_agg(concat('## Paragraph ', para, chr(10), '- claim support: ', printf('%.2f', score), ' (LOW, cosine)', chr(10), block), chr(10) || chr(10) ORDER BY para) AS report FROM s WHERE score < 0.6 GROUP BY doc"""


def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grounded, hard quotes whose surrounding claim scores below its threshold; entailment goes before similarity."""
    j = judged(spark, sf_dir).filter("grounded and not is_soft and tag <> 'unsupported'")
    entail = F.when(F.col("idx") % 3 == 0, (F.length("quote") % 10) / 10.0)
    cosine = F.when(F.col("idx") % 3 == 1, (F.length("quote") % 7) / 7.0)
    v = audit.verified(entail, cosine)
    return j.select("doc", "idx", "ord", v["method"].alias("method"), F.round(v["score"], 6).alias("score"), v["threshold"].alias("threshold"), (~v["supported"]).alias("drifts"))


DRIFT = f"""WITH {JUDGED}, x AS (SELECT *, CASE WHEN idx % 3 = 0 THEN (length(quote) % 10) / 10.0::DOUBLE END AS e, CASE WHEN idx % 3 = 1 THEN (length(quote) % 7) / 7.0::DOUBLE END AS c FROM judged WHERE grounded AND NOT is_soft AND tag <> 'unsupported')
SELECT doc, idx, ord, CASE WHEN e IS NOT NULL THEN 'entail' ELSE 'cosine' END AS method, round(coalesce(e, c), 6) AS score, CASE WHEN e IS NOT NULL THEN 0.5::DOUBLE ELSE 0.6::DOUBLE END AS threshold,
 NOT coalesce(coalesce(e, c) >= CASE WHEN e IS NOT NULL THEN 0.5 ELSE 0.6 END, true) AS drifts FROM x"""


def baseline_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set of quote hashes of each document before a debate, and its identity."""
    h = audit.anchors(review(spark, sf_dir)).groupBy("doc").agg(F.sort_array(F.collect_set(t.quote_hash(F.col("quote")))).alias("h"))
    return h.select("doc", F.size("h").cast("long").alias("n_hashes"), F.array_join("h", ",").alias("hashes"), F.sha2(F.array_join("h", ","), 256).alias("state_id"))


BASELINE_CAPTURE = f"""WITH {REVIEW}, h AS (SELECT doc, list_sort(list(DISTINCT {quote_hash("quote")})) AS h FROM anchors GROUP BY doc)
SELECT doc, len(h) AS n_hashes, array_to_string(h, ',') AS hashes, sha256(array_to_string(h, ',')) AS state_id FROM h"""


def response_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims-only audit of each assistant turn: paragraphs, and how many fail."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc"), "text")
    p = audit.paragraphs(audit.review_lines(turns))
    return p.groupBy("doc").agg(F.count("*").alias("n_claims"), F.count_if(F.length("block") % 4 == 0).alias("n_failed"))


RESPONSE_VALIDATION = f"""WITH l AS (SELECT conv_id * 1000 + turn AS doc, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS idx FROM conversations WHERE role = 'assistant'),
e AS (SELECT *, starts_with(trim(line), '#') OR trim(line) = '' AS edge FROM l), r AS (SELECT *, sum(edge::INT) OVER (PARTITION BY doc ORDER BY idx) AS run FROM e),
b AS (SELECT doc, run, trim(string_agg(line, chr(10) ORDER BY idx)) AS block FROM r WHERE NOT edge GROUP BY doc, run)
SELECT doc, count(*) AS n_claims, count_if(length(block) % 4 = 0)::BIGINT AS n_failed FROM b GROUP BY doc"""

QUERIES = {f.__name__: f for f in (ground_passages, shingle_grounding, anchor_extract, audit_transitions, audit_counters, finalize_tags, relabel_lines, ellipsis_stitch, claim_paragraphs, claim_blocks, sentence_split, no_progress, audit_report, claims_report, drift, baseline_capture, response_validation)}
ORACLES = {k: globals()[k.upper()] for k in QUERIES}
