"""Corpus files as rows: kinds, languages, test paths, ignore rules, walks and incremental ingestion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# File extensions by kind, and the language of each.
IMAGE = [".png", ".jpg", ".jpeg", ".tif", ".tiff", ".webp", ".bmp", ".gif"]
DOCUMENT = [".pdf", ".xps", ".oxps", ".epub", ".mobi", ".fb2", ".cbz", ".svg", ".txt", ".docx", ".pptx", ".xlsx", ".html", ".asciidoc"]
CODE = [".r", ".py", ".js", ".ts", ".cpp", ".cc", ".c", ".h", ".hpp", ".go", ".rs", ".java", ".rb", ".sh", ".sql"]
TEXT = [".md", ".rmd", ".txt", ".rst"]
LANGUAGE = {
    ".r": "r", ".py": "python", ".js": "javascript", ".ts": "typescript", ".cpp": "cpp", ".cc": "cpp", ".c": "c", ".h": "cpp",
    ".hpp": "cpp", ".go": "go", ".rs": "rust", ".java": "java", ".rb": "ruby", ".sh": "bash", ".sql": "sql",
}
IGNORED = [".git", "renv", "packrat", "node_modules", "__pycache__", ".venv", "build", "dist", "data", ".rproj.user"]
SKIPPED = ["index", "images"]  # folders that hold our own files

# What makes a path a test's.
TEST_FOLDERS = ["test", "tests", "testing", "testthat", "__tests__", "spec", "specs", "e2e", "end-to-end", "fixtures", "testdata", "test_fixtures", "benchmarks", "benches"]
TEST_DELIMITED = r"(?i)(^|/)((tests?|specs?|unit_?tests?)[_\-\.][^/]+|.+[_\-\.](tests?|specs?|unit_?tests?)\.[^/]+)$"
TEST_EXACT = r"(?i)(^|/)(conftest\.py|tests?\.py|tests?\.rs|test_helper\.rb|setupTests\.[^/]+)$"
TEST_CAMEL = r"(^|/)[a-zA-Z0-9_]*(Test|Tests|TestCase|Spec)\.[a-zA-Z0-9]+$"


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """The last dotted part of the file name, lower case; none for names whose only dots lead."""
    return F.lower(F.regexp_extract(base_name(path), r"^\.*[^.].*?(\.[^.]*)$", 1))


def stem(path: Column) -> Column:
    """The file name without its extension."""
    name = base_name(path)
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def kind(path: Column, code: list = CODE, text: list = TEXT) -> Column:
    """code, text_doc or ocr_doc, in this order of precedence; NULL for other files."""
    e = extension(path)
    return F.when(e.isin(code), "code").when(e.isin(text), "text_doc").when(e.isin(IMAGE + DOCUMENT), "ocr_doc")


def language(path: Column) -> Column:
    pairs = [F.lit(x) for p in LANGUAGE.items() for x in p]
    return F.coalesce(F.element_at(F.create_map(*pairs), extension(path)), F.lit(""))


def is_test(path: Column) -> Column:
    """A file in a test folder, or named as tests are."""
    clean = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^/+|/+$", "")
    parts = F.split(clean, "/")
    folders = F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.lower(p).isin(TEST_FOLDERS))
    return (clean != "") & (folders | clean.rlike(TEST_DELIMITED) | clean.rlike(TEST_EXACT) | clean.rlike(TEST_CAMEL))


def walk(files: DataFrame, ignore: list = IGNORED, exclude: DataFrame | None = None) -> DataFrame:
    """files (repo, rel) -> repo, rel, kind, source_file: what a walk of the repositories takes.

    Ignored, own and dotted folders are pruned; a text document beside a scanned one of the same
    stem is its sidecar and left out; so are files in `exclude` (rel).
    """
    parts = F.split("rel", "/")
    inner = F.slice(parts, 1, F.size(parts) - 1)
    kept = files.filter(~F.exists(inner, lambda d: F.lower(d).isin(ignore) | d.isin(SKIPPED) | d.startswith(".")))
    typed = kept.withColumn("kind", kind(F.col("rel"))).withColumn("dir", folder(F.col("rel"))).withColumn("stem", stem(F.col("rel")))
    scanned = typed.filter("kind = 'ocr_doc'").select("repo", "dir", "stem").distinct()
    is_text = extension(F.col("rel")).isin(TEXT)
    out = typed.filter("kind is not null").filter(~is_text).unionByName(typed.filter("kind is not null").filter(is_text).join(scanned, ["repo", "dir", "stem"], "left_anti").select(*typed.columns))
    if exclude is not None:
        out = out.join(exclude.select("rel"), "rel", "left_anti")
    return out.select("repo", "rel", "kind", F.concat("repo", F.lit("/"), "rel").alias("source_file"))


def top_level(entries: DataFrame) -> DataFrame:
    """entries (name, is_dir) of a collection: its folders, and its files of a known kind, by name."""
    x = entries.filter(~F.col("name").isin(SKIPPED) & ~F.col("name").startswith("."))
    return x.withColumn("part", F.when(F.col("is_dir"), "folder").when(kind(F.col("name")).isNotNull(), "file")).filter("part is not null")


def rules(lines: DataFrame, baseline: list[str], own: str = ".groundwork/") -> DataFrame:
    """lines (pos, line) -> pos, rule: rules without comments and blanks, else the baseline; our own folder first; each once."""
    spark = lines.sparkSession
    given = lines.select("pos", F.trim("line").alias("rule")).filter("rule <> '' and not rule like '#%'")
    default = spark.createDataFrame([(i, x) for i, x in enumerate(baseline)], "pos long, rule string")
    some = given.agg((F.count("*") > 0).alias("some"))
    base = given.unionByName(default.crossJoin(F.broadcast(some)).filter("not some").drop("some"))
    mine = base.agg((F.count_if(F.col("rule") == own) > 0).alias("has")).filter("not has").select(F.lit(-1).cast("long").alias("pos"), F.lit(own).alias("rule"))
    return ordered_distinct(base.unionByName(mine), "rule")


def ordered_distinct(rows: DataFrame, value: str, pos: str = "pos") -> DataFrame:
    """Each value once, at its first place."""
    return rows.groupBy(value).agg(F.min(pos).alias(pos)).select(pos, value)


def split_rules(base: DataFrame, files: DataFrame, mode: str) -> DataFrame:
    """The ignore rules that leave sources (mode `source`) or tests (`tests`): the base rules, then the files to leave out."""
    chosen = files.filter(is_test(F.col("path")) if mode == "source" else ~is_test(F.col("path")))
    last = base.agg(F.coalesce(F.max("pos"), F.lit(-1)).alias("last"))
    more = chosen.crossJoin(F.broadcast(last)).select((F.col("last") + 1 + F.col("pos")).alias("pos"), F.col("path").alias("rule"))
    return ordered_distinct(base.unionByName(more), "rule")


def new_files(files: DataFrame, embedded: DataFrame) -> DataFrame:
    """Files whose source_file the table does not hold yet."""
    return files.join(embedded.select("source_file").distinct(), "source_file", "left_anti")


def expand(patterns: DataFrame, files: DataFrame) -> DataFrame:
    """patterns (ord, pattern) -> pos, path: globs as their sorted matches, other patterns verbatim, each path once."""
    magic = F.col("pattern").rlike(r"[*?\[]")
    literal = F.regexp_replace("pattern", r"([.+^${}()|\\])", r"\\$1")
    rx = F.concat(F.lit("^"), F.replace(F.replace(literal, F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]")), F.lit("$"))
    rx = F.regexp_replace(rx, r"\[!", "[^")
    globs = patterns.filter(magic).withColumn("rx", rx)
    found = files.select("path").join(globs, F.expr("path rlike rx")).select("ord", "path")
    both = found.unionByName(patterns.filter(~magic).select("ord", F.col("pattern").alias("path")))
    first = both.groupBy("path").agg(F.min("ord").alias("ord"))
    return first.select((F.row_number().over(Window.orderBy("ord", "path")) - 1).cast("long").alias("pos"), "path")


def route(ext: Column, use_converter: Column, converter_ocr: Column, text_chars: Column, sidecar: Column, overwrite: Column, converted: Column) -> Column:
    """Where a document's Markdown comes from: its sidecar, the converter, or page-wise OCR.

    Images never meet the converter; with its OCR off, a PDF does only if its text layer has more
    than 100 characters; a conversion of 100 characters or fewer falls back to OCR.
    """
    fast = use_converter & ~ext.isin(IMAGE) & (converter_ocr | (ext != ".pdf") | (text_chars > 100))
    return F.when(~overwrite & (F.coalesce(F.length(sidecar), F.lit(0)) > 0), "sidecar").when(fast & (F.coalesce(F.length(F.trim(converted)), F.lit(0)) > 100), "converter").otherwise("ocr")


def best_page(attempts: DataFrame, threshold: float = 0.15, fallback: float = 0.4) -> DataFrame:
    """attempts (doc, page, attempt, md, cer, raw_text) -> doc, page, md: attempts up to the first good one, the best of them.

    Pages without a text layer take the first attempt; if even the best is worse than `fallback` and
    the layer has over 50 characters, the layer itself stands in.
    """
    w = Window.partitionBy("doc", "page").orderBy("attempt")
    good = F.coalesce((F.col("cer") <= threshold) | (F.trim("raw_text") == ""), F.lit(False))
    tried = attempts.withColumn("before", F.coalesce(F.sum(good.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter("before = 0")
    best = tried.groupBy("doc", "page").agg(F.min_by("md", F.struct(F.col("cer").isNull(), "cer", "attempt")).alias("md"), F.min("cer").alias("cer"), F.max("raw_text").alias("raw"))
    layer = (F.length(F.trim("raw")) > 50) & (F.coalesce("cer", F.lit(float("inf"))) > fallback)
    return best.select("doc", "page", F.when(layer, F.trim("raw")).otherwise(F.col("md")).alias("md"))


def join_pages(pages: DataFrame) -> DataFrame:
    """Pages of a document in order, blank ones dropped, joined by blank lines."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page", "md"))), lambda s: s["md"])
    return pages.filter("trim(md) <> ''").groupBy("doc").agg(F.array_join(ordered, "\n\n").alias("text"))


def whole_texts(spark, path: str) -> DataFrame:
    """Markdown and text files, one row each: path, text (undecodable bytes replaced)."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def list_files(spark, path: str) -> DataFrame:
    """All files under a folder, without their content: path, size, modified."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def env_entries(lines: DataFrame) -> DataFrame:
    """lines (file, pos, line) of KEY=VALUE files: key, value; `export` is dropped, matching quotes unwrapped, ` #` comments cut; the first writer wins."""
    x = lines.select("file", "pos", F.regexp_replace(F.trim("line"), r"^export\s+", "").alias("l")).filter("l <> '' and not l like '#%' and l like '%=%'")
    raw = F.trim(F.expr("substr(l, instr(l, '=') + 1)"))
    quoted = raw.rlike("^\".*\"$") | raw.rlike("^'.*'$")
    value = F.when(quoted & (F.length(raw) >= 2), F.expr("substr(trim(substr(l, instr(l, '=') + 1)), 2, length(trim(substr(l, instr(l, '=') + 1))) - 2)")).otherwise(F.trim(F.regexp_replace(raw, r"\s+#.*$", "")))
    y = x.select("file", "pos", F.trim(F.expr("substr(l, 1, instr(l, '=') - 1)")).alias("key"), value.alias("value")).filter("key <> ''")
    return y.groupBy("key").agg(F.min_by("value", F.struct("file", "pos")).alias("value"))
