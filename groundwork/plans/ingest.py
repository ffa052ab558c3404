"""Queries of ingestion: paths made from `documents` (R5 of the fixtures), routing, chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.functions import text as t
from groundwork.operators import chunking
from groundwork.sources import paths
from groundwork.plans.common import table

#: For both engines: a repository, a path in it, and their variety by doc_id.
REPO = "concat('repo', doc_id % 5)"
REL = """concat(CASE doc_id % 8 WHEN 0 THEN 'src/' WHEN 1 THEN 'docs/' WHEN 2 THEN 'Tests/unit/' WHEN 3 THEN '' WHEN 4 THEN 'node_modules/x/' WHEN 5 THEN '.hidden/' WHEN 6 THEN 'a/images/' ELSE 'lib/spec/' END,
 CASE doc_id % 11 WHEN 0 THEN 'test_' WHEN 1 THEN 'Latest' WHEN 2 THEN 'User' ELSE 'f' END, doc_id % 97, CASE doc_id % 11 WHEN 2 THEN 'Test' WHEN 3 THEN '-test' WHEN 4 THEN '.spec' ELSE '' END,
 CASE doc_id % 9 WHEN 0 THEN '.py' WHEN 1 THEN '.R' WHEN 2 THEN '.md' WHEN 3 THEN '.pdf' WHEN 4 THEN '.txt' WHEN 5 THEN '.h' WHEN 6 THEN '.PNG' WHEN 7 THEN '' ELSE '.zip' END)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.expr(REPO).alias("repo"), F.expr(REL).alias("rel")).distinct()


FILES = f"files AS (SELECT DISTINCT {REPO} AS repo, {REL} AS rel FROM documents)"
EXT = r"lower(regexp_extract(regexp_extract(rel, '([^/]*)$', 1), '^\.*[^.].*?(\.[^.]*)$', 1))"
LIST = lambda x: "(" + ", ".join(f"'{e}'" for e in x) + ")"
KIND = f"CASE WHEN {EXT} IN {LIST(paths.CODE)} THEN 'code' WHEN {EXT} IN {LIST(paths.TEXT)} THEN 'text_doc' WHEN {EXT} IN {LIST(paths.IMAGE + paths.DOCUMENT)} THEN 'ocr_doc' END"
LANG = f"coalesce(CASE {EXT} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in paths.LANGUAGE.items()) + " END, '')"
TEST = rf"""(len(list_filter(string_split(rel, '/')[:-2], lambda p: lower(p) IN {LIST(paths.TEST_FOLDERS)})) > 0 OR regexp_matches(rel, '{paths.TEST_DELIMITED}') OR regexp_matches(rel, '{paths.TEST_EXACT}') OR regexp_matches(rel, '{paths.TEST_CAMEL}'))"""


def classify_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("repo", "rel", paths.kind(F.col("rel")).alias("kind"), paths.language(F.col("rel")).alias("language"), t.table_name(F.col("rel")).alias("table_name"))


CLASSIFY_PATHS = rf"""WITH {FILES} SELECT repo, rel, {KIND} AS kind, {LANG} AS language,
 coalesce(nullif(regexp_replace(regexp_replace(CASE WHEN {EXT} <> '' THEN left(regexp_extract(rel, '([^/]*)$', 1), -length({EXT})) ELSE regexp_extract(rel, '([^/]*)$', 1) END, '[^0-9A-Za-z._-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'doc') AS table_name FROM files"""


def test_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("repo", "rel", paths.is_test(F.col("rel")).alias("is_test"))


TEST_PATHS = f"WITH {FILES} SELECT repo, rel, {TEST} AS is_test FROM files"


def walk_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a walk takes: pruned folders, sidecars and active files (those of repo0's .h kind) left out."""
    f = files(spark, sf_dir)
    return paths.walk(f, exclude=f.filter("rel like '%.h'").select("rel"))


WALK = rf"""{FILES}, typed AS (SELECT repo, rel, {KIND} AS kind, regexp_extract(rel, '^(.*)/[^/]*$', 1) AS dir, CASE WHEN {EXT} <> '' THEN left(regexp_extract(rel, '([^/]*)$', 1), -length({EXT})) ELSE regexp_extract(rel, '([^/]*)$', 1) END AS stem, {EXT} AS ext FROM files
 WHERE len(list_filter(string_split(rel, '/')[:-2], lambda d: lower(d) IN {LIST(paths.IGNORED)} OR d IN {LIST(paths.SKIPPED)} OR starts_with(d, '.'))) = 0),
walked AS (SELECT repo, rel, kind, concat(repo, '/', rel) AS source_file FROM typed x WHERE kind IS NOT NULL AND rel NOT LIKE '%.h'
 AND NOT (ext IN {LIST(paths.TEXT)} AND EXISTS (SELECT 1 FROM typed y WHERE y.kind = 'ocr_doc' AND y.repo = x.repo AND y.dir = x.dir AND y.stem = x.stem)))"""
WALK_REPOS = f"WITH {WALK} SELECT * FROM walked"


def top_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders and classifiable files at the top of each repository."""
    first = F.split_part("rel", F.lit("/"), F.lit(1))
    entries = files(spark, sf_dir).select("repo", first.alias("name"), F.col("rel").contains("/").alias("is_dir")).distinct()
    return paths.top_level(entries)


TOP_LEVEL = f"""WITH {FILES}, e AS (SELECT DISTINCT repo, split_part(rel, '/', 1) AS rel, contains(rel, '/') AS is_dir FROM files),
p AS (SELECT repo, rel AS name, is_dir, CASE WHEN is_dir THEN 'folder' WHEN {KIND} IS NOT NULL THEN 'file' END AS part FROM e WHERE rel NOT IN {LIST(paths.SKIPPED)} AND NOT starts_with(rel, '.'))
SELECT * FROM p WHERE part IS NOT NULL"""


def incremental_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walked files that a table does not hold yet; it holds those of repo1 and repo2."""
    w = walk_repos(spark, sf_dir)
    return paths.new_files(w, w.filter("repo in ('repo1', 'repo2')")).select("source_file", "kind")


INCREMENTAL_FILES = f"WITH {WALK} SELECT source_file, kind FROM walked WHERE source_file NOT IN (SELECT source_file FROM walked WHERE repo IN ('repo1', 'repo2'))"


def repo_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All paths with forward slashes, each once, numbered in order; a leading ./ goes, a dotfile's dot stays."""
    x = table(spark, sf_dir, "documents").select(F.expr(f"concat(CASE WHEN doc_id % 2 = 0 THEN './' ELSE '' END, replace({REL}, '/', CASE WHEN doc_id % 3 = 0 THEN '\\\\' ELSE '/' END))").alias("p"))
    clean = F.regexp_replace(F.replace("p", F.lit("\\"), F.lit("/")), r"^\./", "")
    return x.select(clean.alias("path")).distinct()


REPO_LISTING = rf"SELECT DISTINCT regexp_replace(replace(concat(CASE WHEN doc_id % 2 = 0 THEN './' ELSE '' END, replace({REL}, '/', CASE WHEN doc_id % 3 = 0 THEN '\' ELSE '/' END)), '\', '/'), '^\./', '') AS path FROM documents"

BASELINE_RULES = ["*.tar.gz", "*.lock", "*.log", "*.map"]
RULE = "CASE doc_id % 5 WHEN 0 THEN '# note' WHEN 1 THEN '  ' WHEN 2 THEN concat(' *.e', doc_id % 7, ' ') WHEN 3 THEN concat('dir', doc_id % 4, '/') ELSE '*.tmp' END"


def ignore_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.expr(RULE).alias("line"))
    return paths.rules(lines, BASELINE_RULES)


IGNORE = f"given AS (SELECT doc_id AS pos, trim({RULE}) AS rule FROM documents), base AS (SELECT min(pos) AS pos, rule FROM (SELECT * FROM given WHERE rule <> '' AND NOT starts_with(rule, '#') UNION ALL SELECT -1, '.groundwork/') GROUP BY rule)"
IGNORE_RULES = f"WITH {IGNORE} SELECT pos, rule FROM base"


def split_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that leave only sources, and rules that leave only tests."""
    base = ignore_rules(spark, sf_dir)
    f = table(spark, sf_dir, "documents").select(F.expr(REL).alias("path"), "doc_id").groupBy("path").agg(F.min("doc_id").alias("pos"))
    both = [paths.split_rules(base, f, m).withColumn("mode", F.lit(m)) for m in ("source", "tests")]
    return both[0].unionByName(both[1])


SPLIT_RULES = f"""WITH {IGNORE}, f AS (SELECT {REL} AS rel, min(doc_id) AS pos FROM documents GROUP BY 1), m(mode) AS (VALUES ('source'), ('tests')),
x AS (SELECT mode, pos, rule FROM m, base UNION ALL SELECT mode, (SELECT max(pos) FROM base) + 1 + pos, rel FROM m, f WHERE {TEST} = (mode = 'source'))
SELECT mode, min(pos) AS pos, rule FROM x GROUP BY mode, rule"""


def glob_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = spark.createDataFrame([(0, "src/*.py"), (1, "plain/name.txt"), (2, "docs/f?.md"), (3, "src/f*.py"), (4, "plain/name.txt"), (5, "lib/spec/f[0-4]*.txt"), (6, "none/*.x")], "ord long, pattern string")
    f = files(spark, sf_dir).select(F.col("rel").alias("path")).distinct()
    return paths.expand(patterns, f)


GLOB_EXPANSION = rf"""WITH {FILES}, m AS (SELECT 0 AS ord, rel FROM files WHERE regexp_full_match(rel, 'src/[^/]*\.py') UNION ALL SELECT 1, 'plain/name.txt' UNION ALL SELECT 2, rel FROM files WHERE regexp_full_match(rel, 'docs/f[^/]\.md')
 UNION ALL SELECT 3, rel FROM files WHERE regexp_full_match(rel, 'src/f[^/]*\.py') UNION ALL SELECT 5, rel FROM files WHERE regexp_full_match(rel, 'lib/spec/f[0-4][^/]*\.txt')),
g AS (SELECT rel AS path, min(ord) AS ord FROM m GROUP BY rel) SELECT row_number() OVER (ORDER BY ord, path) - 1 AS pos, path FROM g"""


def extractor_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each file's Markdown comes from, over switches that vary by doc_id."""
    x = table(spark, sf_dir, "documents").withColumn("rel", F.expr(REL)).withColumn("ext", paths.extension(F.col("rel")))
    sidecar = F.when(F.col("doc_id") % 6 == 0, F.lit("old")).when(F.col("doc_id") % 6 == 1, F.lit(""))
    converted = F.when(F.col("doc_id") % 4 > 0, F.expr("substr(text, 1, cast(doc_id % 150 as int))"))
    r = paths.route(F.col("ext"), F.col("doc_id") % 10 > 0, F.col("doc_id") % 3 == 0, F.col("doc_id") % 200, sidecar, F.col("doc_id") % 7 == 0, converted)
    return x.select("doc_id", "ext", r.alias("route"))


EXTRACTOR_ROUTING = f"""WITH x AS (SELECT doc_id, text, {REL} AS rel FROM documents), e AS (SELECT *, {EXT} AS ext FROM x)
SELECT doc_id, ext, CASE WHEN doc_id % 7 <> 0 AND doc_id % 6 = 0 THEN 'sidecar' WHEN doc_id % 10 > 0 AND ext NOT IN {LIST(paths.IMAGE)} AND (doc_id % 3 = 0 OR ext <> '.pdf' OR doc_id % 200 > 100)
 AND doc_id % 4 > 0 AND length(trim(substr(text, 1, doc_id % 150))) > 100 THEN 'converter' ELSE 'ocr' END AS route FROM e"""

#: Pages made of benchmark passages; attempts of growing care, some failed.
CARE = "CASE WHEN attempt = 2 THEN text WHEN attempt = 1 THEN concat(text, ' extra words') ELSE regexp_replace(text, '[aeiou]', 'x') END"


def ocr_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "benchmark").crossJoin(spark.range(3).toDF("attempt"))
    md = F.when(F.col("attempt") == 2, F.col("text")).when(F.col("attempt") == 1, F.concat("text", F.lit(" extra words"))).otherwise(F.regexp_replace("text", "[aeiou]", "x"))
    raw = F.when(F.col("item_id") % 5 == 4, F.lit("")).otherwise(F.col("text"))
    y = x.select((F.col("item_id") % 6).alias("doc"), F.col("item_id").alias("page"), "attempt", raw.alias("raw_text"), F.when(F.col("item_id") % 7 != 3, md).alias("md"))
    return y.withColumn("cer", F.when(F.col("md").isNotNull(), F.round(t.error_rate(F.col("raw_text"), F.col("md")), 6)))


ATTEMPTS = r"""att AS (SELECT item_id % 6 AS doc, item_id AS page, attempt, CASE WHEN item_id % 5 = 4 THEN '' ELSE text END AS raw_text,
 CASE WHEN item_id % 7 <> 3 THEN CASE WHEN attempt = 2 THEN text WHEN attempt = 1 THEN concat(text, ' extra words') ELSE regexp_replace(text, '[aeiou]', 'x', 'g') END END AS md FROM benchmark, range(3) r(attempt)),
n AS (SELECT *, regexp_replace(lower(raw_text), '[^a-z0-9]', '', 'g') AS a, regexp_replace(lower(md), '[^a-z0-9]', '', 'g') AS b FROM att),
rated AS (SELECT doc, page, attempt, raw_text, md, CASE WHEN md IS NULL THEN NULL WHEN a = '' THEN 0.0::DOUBLE ELSE round(levenshtein(a, b) / length(a)::DOUBLE, 6) END AS cer FROM n)"""


def cer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr_attempts(spark, sf_dir).select("doc", "page", "attempt", "cer")


CER_PAIRS = f"WITH {ATTEMPTS} SELECT doc, page, attempt, cer FROM rated"


def best_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.best_page(ocr_attempts(spark, sf_dir)).select("doc", "page", "md")


BEST = f"""{ATTEMPTS}, k AS (SELECT *, coalesce(sum(coalesce(cer <= 0.15 OR trim(raw_text) = '', false)::INT) OVER (PARTITION BY doc, page ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM rated),
o AS (SELECT doc, page, arg_min(md, coalesce(cer, 1e9) * 10 + attempt) AS md, min(cer) AS cer, max(raw_text) AS raw FROM k WHERE before = 0 GROUP BY doc, page),
best AS (SELECT doc, page, CASE WHEN length(trim(raw)) > 50 AND coalesce(cer, 1e9) > 0.4 THEN trim(raw) ELSE md END AS md FROM o)"""
BEST_PAGES = f"WITH {BEST} SELECT * FROM best"


def joined_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.join_pages(best_pages(spark, sf_dir))


JOINED_PAGES = f"WITH {BEST} SELECT doc, string_agg(md, chr(10) || chr(10) ORDER BY page) AS text FROM best WHERE trim(md) <> '' GROUP BY doc"


def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.windows(F.col("text"), 800)).alias("pos", "chunk"))
    return w.select("doc_id", F.col("pos").cast("long").alias("pos"), F.length("chunk").cast("long").alias("n"), F.md5(F.col("chunk").cast("binary")).alias("digest"))


CHUNK_WINDOWS = """WITH w AS (SELECT doc_id, unnest(range(1 + greatest(0, ceil((length(text) - 800) / 640.0))::BIGINT)) AS pos, text FROM documents WHERE length(text) > 0)
SELECT doc_id, pos, length(substr(text, pos * 640 + 1, 800)) AS n, md5(substr(text, pos * 640 + 1, 800)) AS digest FROM w"""


def chunk_pack_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts packed by lines up to 500 characters, sentences broken into lines first."""
    lined = F.replace("text", F.lit(". "), F.lit(".\n"))
    c = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.packed_lines(lined, 500)).alias("pos", "chunk"))
    return c.select("doc_id", F.col("pos").cast("long").alias("pos"), F.length("chunk").cast("long").alias("n"), F.md5(F.col("chunk").cast("binary")).alias("digest"))


CHUNK_PACK_LINES = r"""WITH RECURSIVE t AS (SELECT doc_id, replace(text, '. ', '.' || chr(10)) AS x FROM documents),
l AS (SELECT doc_id, list_filter(list_transform(range(1, len(string_split(x, chr(10))) + 1), lambda i: CASE WHEN i < len(string_split(x, chr(10))) THEN string_split(x, chr(10))[i] || chr(10) ELSE string_split(x, chr(10))[i] END), lambda s: s <> '') AS ls FROM t),
u AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i, len(ls) AS n FROM l),
f AS (SELECT doc_id, 0::BIGINT AS i, []::VARCHAR[] AS out, []::VARCHAR[] AS buf FROM l
 UNION ALL SELECT f.doc_id, f.i + 1,
  CASE WHEN length(line) > 500 THEN list_concat(CASE WHEN len(buf) > 0 THEN list_append([]::VARCHAR[], array_to_string(buf, '')) ELSE []::VARCHAR[] END, list_transform(range(1 + ceil((length(line) - 500) / 400.0)::BIGINT), lambda k: substr(line, k * 400 + 1, 500)))
   WHEN length(array_to_string(buf, '')) + length(line) > 500 AND len(buf) > 0 THEN [array_to_string(buf, '')] ELSE []::VARCHAR[] END,
  CASE WHEN length(line) > 500 THEN []::VARCHAR[] WHEN length(array_to_string(buf, '')) + length(line) > 500 AND len(buf) > 0 THEN list_append(buf[-3:], line) ELSE list_append(buf, line) END
 FROM f JOIN u ON u.doc_id = f.doc_id AND u.i = f.i + 1),
c AS (SELECT doc_id, i * 1000 + k AS ord, out[k + 1] AS chunk FROM (SELECT doc_id, i, out, unnest(range(len(out))) AS k FROM f) UNION ALL
 SELECT f.doc_id, 1000000000, array_to_string(buf, '') FROM f JOIN (SELECT doc_id, len(ls) AS n FROM l) e ON e.doc_id = f.doc_id AND e.n = f.i WHERE len(buf) > 0)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS pos, length(chunk) AS n, md5(chunk) AS digest FROM c"""


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk rows of all documents: Markdown by headings, fences and size; code by its syntax (rows only)."""
    f = table(spark, sf_dir, "documents").withColumn("rel", F.expr(REL))
    kind = F.coalesce(paths.kind(F.col("rel")), F.lit("text_doc"))
    return chunking.chunk_rows(f.select(F.concat(F.expr(REPO), F.lit("/"), "rel").alias("source_file"), kind.alias("kind"), paths.language(F.col("rel")).alias("language"), "text"))


CODED = """concat(chr(10), '  lead ', doc_id, chr(10), 'func f', doc_id, '() {', chr(10), '  a', doc_id, '()', chr(10), chr(10), '  b()', chr(10), '}', chr(10), '# note', chr(10), chr(10), text, CASE doc_id % 3 WHEN 0 THEN chr(10) ELSE '' END)"""


def code_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of all documents' texts, each after a function with a blank line in it."""
    return chunking.code_blocks(table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.expr(CODED.replace("chr(", "char(")).alias("text")))


CODE_BLOCKS = rf"""WITH x AS (SELECT doc_id, string_split_regex({CODED}, '\r\n|\n|\r') AS ls FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, CASE WHEN len(ls) > 1 AND ls[-1] = '' THEN ls[:-2] ELSE ls END AS ls FROM x),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM k),
s AS (SELECT *, regexp_matches(line, '^[^\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}}})\]]') AS starts FROM l),
g AS (SELECT *, greatest(sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY i), 1) AS g FROM s),
b AS (SELECT doc_id, g, min(i) AS first_line, max(i) AS last_line, sum(length(line)) + count(*) - 1 AS n_chars, max(CASE WHEN starts THEN line END) AS head FROM g GROUP BY ALL),
m AS (SELECT *, regexp_extract(head, '(?:(?:function|func|fn|class|def|struct|interface|sub)\s+([A-Za-z_]\w*)|^([A-Za-z_.]\w*)\s*(?:<-|=)\s*function|\b([A-Za-z_]\w*)\s*\()', ['a', 'b', 'c']) AS n FROM b)
SELECT doc_id, first_line, last_line, CASE WHEN n.a <> '' THEN n.a WHEN n.b <> '' THEN n.b ELSE coalesce(n.c, '') END AS symbol, n_chars::BIGINT AS n_chars FROM m"""


#: A class of a field and two methods, the second with a document's words as its lines.
CLASS = """concat('class C', doc_id, ' {', chr(10), '  field = [1, {a: 2}]', chr(10), chr(10), '  // of note', chr(10), '  first(a) {', chr(10), '    return a', chr(10), '  }', chr(10),
 '  second(b,', chr(10), '    c) {', chr(10), '    if (b) {', chr(10), '      ', replace(regexp_replace(text, '[^A-Za-z \n]', '', 'g'), chr(10), concat(chr(10), '      ')), chr(10), '    }', chr(10), '  }', chr(10), '}', chr(10))"""


def nested_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a class around each document's words holds."""
    made = F.expr(CLASS.replace("chr(", "char(").replace(", '', 'g')", ", '')"))
    return chunking.nested_blocks(table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", made.alias("text")), "javascript")


NESTED_BLOCKS = rf"""WITH x AS (SELECT doc_id, string_split_regex({CLASS}, '\r\n|\n|\r') AS ls FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, unnest(ls[:-2]) AS line, unnest(range(1, len(ls))) AS i FROM x),
top AS (SELECT *, sum((regexp_matches(line, '^[^\s}})\]]'))::INT) OVER (PARTITION BY doc_id ORDER BY i) AS top FROM l),
d AS (SELECT *, coalesce(sum(length(regexp_replace(line, '[^(\[{{]', '', 'g')) - length(regexp_replace(line, '[^)\]}}]', '', 'g'))) OVER (PARTITION BY doc_id, top ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS level FROM top),
b AS (SELECT *, level = 1 AND trim(line) <> '' AND left(trim(line), 1) NOT IN (')', ']', '}}') AND NOT starts_with(lag(line) OVER (PARTITION BY doc_id, top ORDER BY i), '  //') AS begins FROM d WHERE top = 1),
g AS (SELECT *, sum(begins::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM b)
SELECT doc_id, min(i) AS first_line, max(i) AS last_line, CASE g WHEN 0 THEN concat('C', doc_id) WHEN 1 THEN '' WHEN 2 THEN 'first' ELSE 'second' END AS symbol FROM g GROUP BY doc_id, g"""


ENV = """CASE doc_id % 7 WHEN 0 THEN concat('export K', doc_id % 40, '="v ', doc_id, ' # kept"') WHEN 1 THEN concat('K', doc_id % 40, '=plain', doc_id, ' # note') WHEN 2 THEN '# comment' WHEN 3 THEN ''
 WHEN 4 THEN concat(' K', doc_id % 40, ' = ''single ', doc_id, '''') WHEN 5 THEN 'no assignment' ELSE concat('K', doc_id % 40, '=a=b#c') END"""


def env_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select((F.col("doc_id") % 3).alias("file"), F.col("doc_id").alias("pos"), F.expr(ENV.replace("''single ', doc_id, ''''", '\\\'single \', doc_id, "\'"')).alias("line"))
    return paths.env_entries(lines)


ENV_ENTRIES = rf"""WITH x AS (SELECT doc_id % 3 AS file, doc_id AS pos, regexp_replace(trim({ENV}), '^export\s+', '') AS l FROM documents), y AS (SELECT file, pos, trim(substr(l, 1, instr(l, '=') - 1)) AS key, trim(substr(l, instr(l, '=') + 1)) AS raw FROM x WHERE l <> '' AND NOT starts_with(l, '#') AND contains(l, '=')),
z AS (SELECT file, pos, key, CASE WHEN length(raw) >= 2 AND (regexp_matches(raw, '^".*"$') OR regexp_matches(raw, '^''.*''$')) THEN substr(raw, 2, length(raw) - 2) ELSE trim(regexp_replace(raw, '\s+#.*$', '')) END AS value FROM y WHERE key <> '')
SELECT key, arg_min(value, file * 1000000000 + pos) AS value FROM z GROUP BY key"""


def metadata_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "documents")
    null = F.lit(None).cast("string")
    h = t.metadata_header(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("T"), F.col("doc_id").cast("string"))).otherwise(null), F.when(F.col("doc_id") % 3 == 0, "A, B").otherwise(null), F.when(F.col("doc_id") % 5 == 0, "").otherwise(null), F.when(F.col("doc_id") % 7 == 0, F.col("lang")).otherwise(null))
    return x.select("doc_id", h.alias("header"))


METADATA_HEADERS = """WITH b AS (SELECT doc_id, concat_ws(chr(10), CASE WHEN doc_id % 2 = 0 THEN concat('- **Title**: T', doc_id) END, CASE WHEN doc_id % 3 = 0 THEN '- **Author(s)**: A, B' END, CASE WHEN doc_id % 7 = 0 AND coalesce(lang, '') <> '' THEN concat('- **Subject**: ', lang) END) AS b FROM documents)
SELECT doc_id, CASE WHEN b = '' THEN '' ELSE concat('# Document Metadata', chr(10), chr(10), b, chr(10), chr(10), '---', chr(10), chr(10)) END AS header FROM b"""

QUERIES = {f.__name__: f for f in (classify_paths, test_paths, walk_repos, top_level, incremental_files, repo_listing, ignore_rules, split_rules, glob_expansion, extractor_routing, cer_pairs, best_pages, joined_pages, chunk_windows, chunk_pack_lines, chunk_documents, code_blocks, nested_blocks, env_entries, metadata_headers)}
ORACLES = {k: globals()[k.upper()] for k in QUERIES if k.upper() in globals()}
