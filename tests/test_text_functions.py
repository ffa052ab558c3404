"""Truth tables of the scalar functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from groundwork.functions import text as t
from groundwork.plans import dag
from groundwork.sources import paths


def apply(spark, fn, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.select("i", fn(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def check(spark, fn, cases, kind="string"):
    assert apply(spark, fn, [a for a, _ in cases], kind) == [b for _, b in cases]


def test_normalize(spark):
    check(spark, t.normalize, [("  a\u00a0\u2009b\x1cc\n", "a b c"), ("\u201cq\u201d \u2019 \u2013\u2014", "\"q\" ' --"), ("\u2018 kept", "\u2018 kept"), ("Case", "Case"), (None, "")])


def test_lines(spark):
    check(spark, t.lines, [("a\nb\r\nc\rd", ["a", "b", "c", "d"]), ("a\n", ["a"]), ("a\n\n", ["a", ""]), ("x\x0by\u2028z\x85w", ["x", "y", "z", "w"]), (None, [])])


def test_debate_lines(spark):
    two = "intro\n  proposal: one \nPROPOSAL: two\n"
    check(spark, t.proposal_line, [(two, "two"), ("none", ""), (None, "")])
    check(spark, t.verdict, [("VERDICT: AGREE\nVERDICT: OBJECT", "agree"), ("  verdict: object now", "object"), ("VERDICT: AGREED", None), (None, None)])
    a, b, c = apply(spark, t.proposal_hash, [two, "PROPOSAL: one  \nx\nPROPOSAL:   two", "PROPOSAL: other"])
    assert a == b != c and len(a) == 12


def test_entailment(spark):
    check(spark, t.entailment, [("SUPPORTED", 1.0), ("UNSUPPORTED", 0.0), ("not supported", 0.0), ("No.", 0.0), ("yes", 1.0), ("0.37", 0.37), (".5", 0.5), ("7", None), ("hm", None), ("", None), (None, None)])


def test_costs(spark):
    check(spark, t.token_number, [("12.5k", 12500), ("3M", 3_000_000), ("1,024", 1024), ("7.9", 7), ("oops", 0), ("1.2345k", 1234)])
    python = lambda n: f"{n / 1e6:.0f}M" if n >= 10**7 else f"{n / 1e6:.1f}M".replace(".0M", "M") if n >= 10**6 else f"{n / 1e3:.0f}k" if n >= 10**4 else f"{n / 1e3:.1f}k".replace(".0k", "k") if n >= 1000 else str(n)
    ns = [0, 999, 1000, 1050, 1150, 1250, 1350, 1750, 9949, 9950, 9999, 10_500, 11_500, 999_999, 1_050_000, 1_250_000, 9_950_000, 10_500_000, 123_456_789, *range(1050, 10_000, 100)]
    check(spark, t.token_text, [(n, python(n)) for n in ns], "long")
    check(spark, t.cost_text, [(0.0, "0.00"), (-1.0, "0.00"), (0.0042, "0.0042"), (0.01, "0.01"), (12.5, "12.50")], "double")


def test_names(spark):
    check(spark, t.table_name, [("a/b c (1).pdf", "b_c_1"), (".hidden", ".hidden"), ("x.tar.gz", "x.tar"), ("///", "doc"), ("ünï.md", "n")])
    check(spark, t.url_stem, [("https://h.org:8080/a/b.html", "h.org_8080_b"), ("https://h.org/", "h.org_index"), ("https://h.org/p q/?x=1", "h.org_p_q")])
    check(spark, t.session_slug, [("a b/c-d.e", "a_b_c-d.e")])


def test_resolve(spark):
    base = F.lit("https://x.org/docs/guide/page.html?q#f")
    check(spark, lambda c: t.resolve_url(base, c), [("https://y.org/a#b", "https://y.org/a"), ("/r.md", "https://x.org/r.md"), ("n.md#s", "https://x.org/docs/guide/n.md"), (" z ", "https://x.org/docs/guide/z")])


def test_reasoning(spark):
    check(spark, t.strip_reasoning, [("<think>a\nb</think>plan", "plan"), ("<thinking-content-af1>x</thinking-content-af1>► **ANSWER** y", "y"), ("plain", "plain")])
    check(spark, t.after_answer, [("noise ► **ANSWER** yes ► ANSWER no", "yes ► ANSWER no"), ("no mark", "no mark")])


def test_sentences(spark):
    check(spark, t.sentences, [("First one is long. Second one too! x.", ["First one is long.", "Second one too!"]), ("tiny", ["tiny"]), ("1 starts with a digit. 2 does as well.", ["1 starts with a digit.", "2 does as well."])])


def test_keys_and_colours(spark):
    check(spark, t.no_key, [(None, True), ("", True), (" NONE ", True), ("sk-Dummy", True), ("sk-1", False)])
    check(spark, lambda c: F.array(*[t.colour(c, i) for i in range(3)]), [("#0A10ff", [10, 16, 255]), ("0a10FF", [10, 16, 255]), ("#123", [None] * 3), ("xyzxyz", [None] * 3)])


def test_debate_switches(spark):
    cases = [(None, [True, False, False]), ("1", [True, False, False]), ("0 1", [False, True, False]), ("[1,0,1]", [True, False, True]), ("true", [False] * 3), ("", [False] * 3), ("0,0,0,1", [False] * 3)]
    check(spark, lambda c: dag.debate_switches(F.lit(True), c), cases)
    check(spark, lambda c: dag.debate_switches(F.lit(False), c), [(a, [False] * 3) for a, _ in cases])


def test_kinds(spark):
    check(spark, paths.kind, [("a.py", "code"), ("a.R", "code"), ("n.txt", "text_doc"), ("n.md", "text_doc"), ("p.PDF", "ocr_doc"), ("i.jpeg", "ocr_doc"), ("z.zip", None), ("Makefile", None), (".gitignore", None), ("a.b/c", None)])
    check(spark, paths.language, [("x.h", "cpp"), ("x.sh", "bash"), ("x.md", "")])


@pytest.mark.parametrize("yes", [True, False])
def test_test_paths(spark, yes):
    tests = ["tests/x.py", "a/Spec/b.rb", "test_a.py", "a/b_test.go", "x-test.R", "c.test.tsx", "m.spec.ts", "conftest.py", "src/tests.rs", "UserTest.java", "AuthSpec.scala", "unit_test_x.py", "e2e/a.js", "a\\tests\\b.py", "setupTests.ts", "x/benches/y.rs"]
    others = ["contest.java", "latest.ts", "src/attest.py", "testimony.md", "inspect.py", "src/main.py", "protest/x.py", "greatest.go", "specification.md", "", "a/test", "fastest.rs"]
    check(spark, paths.is_test, [(p, yes) for p in (tests if yes else others)])


def test_error_rate(spark):
    rows = spark.createDataFrame([("Hello, World", "hello world"), ("", "x"), ("abc", "abd"), ("a", "zzzz")], "r string, h string")
    assert [round(x[0], 4) for x in rows.select(t.error_rate(F.col("r"), F.col("h"))).collect()] == [0.0, 0.0, 0.3333, 4.0]


def test_links_resolve_as_the_standard_library_does(spark):
    from urllib.parse import urldefrag, urljoin

    bases = ["https://x.org/a/b/c.html?q=1", "http://x.org", "https://x.org/a/", "https://x.org:80/a/b/../d"]
    links = ["e", "./e", "../e", "../../e", "../../../../e", "/f/../g", "/./g/.", "..", ".", "h/..", "?p=../2", "//y.org/k/../m", "https://z.org/n/../o", "", "#top", "p/./q/../r?s=/../t#u", "...", "a..b"]
    rows = [(b, x) for b in bases for x in links]
    got = spark.createDataFrame(rows, "b string, x string").select("b", "x", t.resolve_url(F.col("b"), F.col("x")).alias("y")).collect()
    assert [r for r in got if r.y != urldefrag(urljoin(r.b, r.x)).url] == []
