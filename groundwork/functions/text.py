"""Scalar functions on text: Column -> Column, no UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java's white space with Unicode rules, and the four separators that Python's \s has besides.
SPACE = r"(?U)[\s\x1c-\x1f]"
#: Curly quotes and dashes, and what stands for them.
CURLY, PLAIN = "’“”–—", "'\"\"--"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
ELLIPSIS = r"\s*(?:\.{3,}|…|\.(?:\s+\.){2,})\s*"


def collapse(c: Column) -> Column:
    """Runs of white space become one blank; both ends are stripped."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def normalize(c: Column) -> Column:
    """Curly quotes and dashes unified, white space collapsed. Case counts; NULL becomes empty."""
    return collapse(F.translate(F.coalesce(c, F.lit("")), CURLY, PLAIN))


def quote_hash(c: Column) -> Column:
    return F.substring(F.sha1(normalize(c).cast("binary")), 1, 12)


def lines(c: Column) -> Column:
    """Lines as Python's splitlines gives them: all its breaks, no empty line after a last break."""
    text = F.coalesce(c, F.lit(""))
    parts = F.split(text, LINE_BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def excerpt(c: Column, n: int = 280) -> Column:
    return F.substring(F.coalesce(c, F.lit("")), 1, n)


def query_text(prefix: Column, query: Column, most: int = 6000) -> Column:
    """What is embedded for a query: the prefix, and the query cut at `most` characters."""
    return F.concat(F.coalesce(prefix, F.lit("")), F.substring(query, 1, most))


PROPOSAL = r"(?im)^\s*PROPOSAL:\s*(.+)$"


def proposals(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(PROPOSAL), 1)


def proposal_hash(c: Column) -> Column:
    """Hash of all PROPOSAL lines, or of the whole turn where there is none."""
    found = proposals(c)
    return quote_hash(F.when(F.size(found) > 0, F.array_join(found, " ")).otherwise(F.coalesce(c, F.lit(""))))


def proposal_line(c: Column) -> Column:
    found = proposals(c)
    return F.when(F.size(found) > 0, F.trim(F.element_at(found, -1))).otherwise("")


def verdict(c: Column) -> Column:
    """agree or object, by the first VERDICT line; NULL if there is none."""
    found = F.regexp_extract(F.coalesce(c, F.lit("")), r"(?im)^\s*VERDICT:\s*(AGREE|OBJECT)\b", 1)
    return F.nullif(F.lower(found), F.lit(""))


def header_field(c: Column, name: str) -> Column:
    """The first `NAME: value` line of a verdict file; NULL if absent."""
    found = F.regexp_extract_all(c, F.lit(rf"(?m)^{name}:[ \t]*(.*)$"), 1)
    return F.when(F.size(found) > 0, F.trim(F.get(found, F.lit(0))))


def entailment(c: Column) -> Column:
    """A verifier's reply as a probability. Negative words go first, as `unsupported` holds `supported`; NULL if unreadable."""
    low = F.lower(F.trim(c))
    number = F.nullif(F.regexp_extract(low, r"(\d*\.?\d+)", 1), F.lit("")).cast("double")
    return (
        F.when(low.isNull() | (low == ""), None)
        .when(low.rlike("unsupported|not support|contradict") | low.startswith("no"), 0.0)
        .when(low.rlike("supported|entail") | low.startswith("yes"), 1.0)
        .when(number.between(0, 1), number)
    )


def letters_and_digits(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edit distance over the reference's length, letters and digits alone; 0 where the reference has none."""
    r, h = letters_and_digits(reference), letters_and_digits(hypothesis)
    return F.when(F.length(r) == 0, 0.0).otherwise(F.levenshtein(r, h) / F.length(r))


def token_number(c: Column) -> Column:
    """12.5k, 3M or 1,024 as a number of tokens, truncated; unreadable text is 0."""
    x = F.regexp_replace(F.lower(F.trim(c)), ",", "")
    number = F.regexp_replace(x, "[km]$", "").try_cast("double")
    return F.coalesce((F.when(x.endswith("k"), number * 1000).when(x.endswith("m"), number * 1_000_000).otherwise(number)).cast("long"), F.lit(0))


def one_decimal(n: Column, by: int) -> Column:
    """n / by to one decimal as C and Python print it: at a tie the double's own error decides, else the even digit.

    For n from `by` to 10 * by; whole numbers lose their `.0`.
    """
    low, rest, half = F.floor(n / (by // 10)), n % (by // 10), by // 20
    exact = lambda c: c.cast("long").cast("decimal(19,0)")
    double, true = exact((n / float(by)) * float(1 << 52)) * by, exact(n) * (1 << 52)
    up = (rest > half) | ((rest == half) & ((double > true) | ((double == true) & (low % 2 == 1))))
    tenths = low + F.when(up, 1).otherwise(0)
    whole = F.floor(tenths / 10).cast("string")
    return F.when(tenths % 10 == 0, whole).otherwise(F.concat(whole, F.lit("."), (tenths % 10).cast("string")))


def token_text(n: Column) -> Column:
    """A number of tokens in short: 999, 1.5k, 15k, 1.5M, 15M."""
    n = F.coalesce(n, F.lit(0)).cast("long")
    whole = lambda by: F.bround(n / float(by), 0).cast("long").cast("string")
    return (
        F.when(n >= 10_000_000, F.concat(whole(10**6), F.lit("M")))
        .when(n >= 1_000_000, F.concat(one_decimal(n, 10**6), F.lit("M")))
        .when(n >= 10_000, F.concat(whole(1000), F.lit("k")))
        .when(n >= 1000, F.concat(one_decimal(n, 1000), F.lit("k")))
        .otherwise(n.cast("string"))
    )


def cost_text(c: Column) -> Column:
    c = F.coalesce(c, F.lit(0.0))
    return F.when(c <= 0, "0.00").when(c < 0.01, F.format_string("%.4f", c)).otherwise(F.format_string("%.2f", c))


def table_name(path: Column) -> Column:
    """A table's name for a document: its stem, other characters than letters, digits, dot, dash collapsed to _."""
    base = F.element_at(F.split(path, "/"), -1)
    stem = F.regexp_replace(base, r"(?<=[^.])\.[^.]*$", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(stem, "[^0-9A-Za-z._-]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit("doc"))


def session_slug(c: Column) -> Column:
    return F.regexp_replace(c, r"[^a-zA-Z0-9_\-.]", "_")


def url_stem(url: Column) -> Column:
    """host_path for a fetched page: the port's colon becomes _, a bare host's path is `index`."""
    host = F.replace(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]*)", 1), F.lit(":"), F.lit("_"))
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1), "/+$", "")
    last = F.coalesce(F.nullif(F.element_at(F.split(path, "/"), -1), F.lit("")), F.lit("index"))
    return F.regexp_replace(F.concat(host, F.lit("_"), table_name(last)), "^_+|_+$", "")


def resolve_url(base: Column, link: Column) -> Column:
    """An absolute address for a link, its fragment dropped and the dot segments of its path resolved."""
    clean = F.split_part(F.trim(link), F.lit("#"), F.lit(1))
    site = F.regexp_extract(base, r"^([A-Za-z]+://[^/?#]*)", 1)
    page = F.regexp_replace(base, "[?#].*$", "")
    folder = F.regexp_extract(page, r"^([A-Za-z]+://[^/]*(?:/.*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    joined = F.when(clean.startswith("/"), F.concat(site, clean)).otherwise(F.concat(folder, clean))
    whole = clean.rlike("^[A-Za-z]+://")
    beside = F.concat(F.regexp_extract(base, "^([A-Za-z]+:)", 1), clean)
    return F.when(whole, clean).when(clean.startswith("//"), beside).when(clean == "", F.regexp_replace(base, "#.*$", "")).when(clean.startswith("?"), F.concat(page, clean)).otherwise(without_dots(joined))


def without_dots(url: Column) -> Column:
    """An address whose path has no segments `.` and `..`; a `..` at the root goes nowhere."""
    site, path = (F.regexp_extract(url, r"^([A-Za-z]+://[^/?#]*)([^?#]*)", i) for i in (1, 2))
    up = lambda done: F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
    kept = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda done, x: F.when(x == "..", F.when(F.size(done) > 1, up(done)).otherwise(done)).when(x == ".", done).otherwise(F.concat(done, F.array(x))))
    end = F.when(path.rlike(r"/\.\.?$"), "/").otherwise("")
    new = F.concat(site, F.array_join(kept, "/"), end, F.substr(url, F.length(site) + F.length(path) + 1))
    return F.when(path.rlike(r"/\.\.?(/|$)"), new).otherwise(url)


def citation(source_type: Column, source_file: Column, first: Column, last: Column) -> Column:
    place = F.when(F.coalesce(first, F.lit(0)) > 0, F.concat(F.lit(":"), first.cast("string"), F.lit("-"), last.cast("string"))).otherwise("")
    return F.concat(F.lit("[source: "), source_type, F.lit(" | "), source_file, place, F.lit("]"))


def strip_reasoning(c: Column) -> Column:
    """A transcript turn without its tagged reasoning and without the ANSWER marker."""
    out = F.regexp_replace(c, r"(?s)<thinking-content-([0-9a-fA-F]+)>.*?</thinking-content-[0-9a-fA-F]+>", "")
    out = F.regexp_replace(out, r"(?s)<think>.*?</think>", "")
    return F.trim(F.regexp_replace(out, r"►\s*\*{0,2}ANSWER\*{0,2}", ""))


def after_answer(c: Column) -> Column:
    """A captured debate turn: what stands after the first ANSWER marker, or all of it."""
    cut = F.regexp_replace(c, r"(?s)^.*?►\s*\*{0,2}ANSWER\*{0,2}", "")
    return F.trim(F.regexp_replace(cut, r"(?m)^.*<thinking-content-[0-9a-fA-F]+>.*$", ""))


def strip_colours(c: Column) -> Column:
    return F.regexp_replace(c, r"\x1b\[[0-9;]*m", "")


def colour(c: Column, part: int) -> Column:
    """Red (0), green (1) or blue (2) of #RRGGBB; NULL where it is no colour."""
    h = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), "^#+", "")
    return F.when(h.rlike("^[0-9A-Fa-f]{6}$"), F.conv(F.substring(h, 2 * part + 1, 2), 16, 10).cast("long"))


def no_key(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit("")))).isin("sk-dummy", "dummy", "none", "null", "")


def metadata_header(title: Column, authors: Column, date: Column, subject: Column) -> Column:
    """A Markdown block of what is known of a document; empty if nothing is."""
    row = lambda name, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"- **{name}**: "), v))
    body = F.concat_ws("\n", row("Title", title), row("Author(s)", authors), row("Date", date), row("Subject", subject))
    return F.when(body == "", "").otherwise(F.concat(F.lit("# Document Metadata\n\n"), body, F.lit("\n\n---\n\n")))


def sentences(c: Column, least: int = 8) -> Column:
    """Sentences of at least `least` characters, or the whole text where none is."""
    kept = F.filter(F.transform(F.split(F.trim(c), r"(?<=[.!?])\s+"), lambda p: F.trim(p)), lambda s: F.length(s) >= least)
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.trim(c)))


def split_ellipsis(c: Column) -> Column:
    """The fragments of a quote spliced with ellipses, normalized, blank ones dropped."""
    return F.filter(F.transform(F.split(c, ELLIPSIS), normalize), lambda p: p != "")
