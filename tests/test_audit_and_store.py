"""Invariants of the audit, the chunkers, fusion, the chunk store, streams, plans."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from groundwork.functions import text as t
from groundwork.operators import adding, audit, chunking, containment, content, logs, models, retrieval, vector_index, web
from groundwork.plans import dag
from groundwork.plans.events import tumble
from groundwork.sources import catalog, paths, sinks
from groundwork.streaming import streams


def test_transition_table(spark):
    """Every row of the audit's table of states."""
    cases = [
        ("unsupported", False, False, False, False, "unsupported", "flagged"), ("evidence", True, False, False, False, "validated", "validated"), ("evidence", True, True, False, True, "fixed", "fixed"),
        ("evidence", True, False, True, True, "validated", "validated"), ("fixed", True, False, False, True, "fixed", "fixed"), ("validated", True, True, False, True, "validated", "kept"),
        ("validated", False, True, False, False, "evidence", "warn"), ("fixed", False, True, False, False, "evidence", "warn"), ("evidence", False, True, False, False, "evidence", "warn"),
        ("validated", False, False, False, False, "evidence", "tripped"), ("fixed", False, False, False, False, "fixed", "tripped"), ("evidence", False, False, False, False, "evidence", "tripped"),
    ]
    df = spark.createDataFrame(cases, "tag string, g boolean, s boolean, b boolean, h boolean, new string, o string")
    cols = [F.col(c) for c in ("tag", "g", "s", "b", "h")]
    for r in df.select("*", audit.transition(*cols).alias("x"), audit.outcome(*cols).alias("y")).collect():
        assert (r.x, r.y) == (r.new, r.o), r


def test_null_scores_accept(spark):
    rows = spark.createDataFrame([(None, None), (None, 0.59), (0.49, 0.9), (0.5, 0.1), (None, 0.6)], "e double, c double")
    assert [r[0]["supported"] for r in rows.select(audit.verified(F.col("e"), F.col("c"))).collect()] == [True, False, False, True, True]


def test_anchors(spark):
    text = '## Head\n`[evidence]` "one" and [fixed] "two" (OCR-uncertain)\n[evidence] "Not specified in paper..."\n#no heading\n[other] "x"\n[validated] "$3"'
    a = audit.anchors(audit.review_lines(spark.createDataFrame([(1, text)], "doc long, text string"))).orderBy("idx", "ord").collect()
    assert [(x.idx, x.ord, x.hdr, x.tag, x.quote, x.uncertain) for x in a] == [(1, 0, "Head", "evidence", "one", False), (1, 1, "Head", "fixed", "two", True), (5, 0, "Head", "validated", "$3", False)]


def test_stitch_is_exact_and_idempotent(spark):
    source = "The quick brown fox jumps over the lazy dog and runs " + "x" * 300 + " away."
    quotes = ["quick brown ... lazy dog", "The quick \u2026 away.", "lazy dog ... quick", "quick brown fox", "missing ... lazy", "fox . . . over"]
    df = spark.createDataFrame([(i, q, source) for i, q in enumerate(quotes)], "i int, q string, s string").withColumn("x", audit.stitched(F.col("q"), F.col("s")))
    got = [r.x for r in df.orderBy("i").collect()]
    assert got == ["quick brown fox jumps over the lazy dog", None, None, None, None, "fox jumps over"]
    assert all(x in source for x in got if x)
    again = df.filter("x is not null").select(audit.stitched(F.col("x"), F.col("s")).alias("y")).collect()
    assert all(r.y is None for r in again)


def test_relabel_takes_the_right_anchor(spark):
    line = 'a [evidence] "one" b `[evidence]` "two"'
    changes = [("`[evidence]` \"two\"", "fixed"), ('[evidence] "one"', "validated")]
    df = spark.createDataFrame([(line, changes)], "line string, c array<struct<raw:string,new_tag:string>>")
    assert df.select(audit.relabelled(F.col("line"), F.col("c"))).first()[0] == 'a [validated] "one" b [fixed] "two"'


def test_grounding_strategies_agree(spark, monkeypatch):
    s = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (2, "xalpha beta gamma delta epsilonx"), (3, None)], "source_id long, text string")
    q = spark.createDataFrame([(1, "lpha beta gamma  delta epsilon"), (2, "beta"), (3, ""), (4, "gamma beta"), (5, None)], "quote_id long, quote string")
    want = {(1, 1), (1, 2), (2, 1), (2, 2)}
    assert {tuple(r) for r in containment.grounded_pairs(q, s).collect()} == want == {tuple(r) for r in containment.by_shingles(q, s).collect()}
    monkeypatch.setattr(containment, "BLOCK_QUOTES", 1)
    assert sorted(map(tuple, containment.grounded_pairs(q, s).collect())) == sorted(want)  # three blocks
    monkeypatch.setattr(containment, "MOST_PASSES", 2)
    assert {tuple(r) for r in containment.grounded_pairs(q, s).collect()} == want
    assert containment.grounded_pairs(q.limit(0), s).count() == containment.grounded_pairs(q, s.limit(0)).count() == 0


def test_contained_quotes_equal_a_plain_loop(spark):
    """Quotes that begin, end and hold others, longer than their heads, of few letters, outside the basic plane, under names of any type."""
    draw = np.random.default_rng(5)
    texts = ["".join(draw.choice(list("ab é😀"), int(n))) for n in draw.integers(0, 300, 60)] + ["a" * 500]
    quotes = ["".join(draw.choice(list("ab é😀"), int(n))) for n in draw.integers(1, 9, 80)] + [x[i : i + 60] for x in texts for i in (0, 7)] + [x[3:70] + "b" for x in texts] + ["a" * n for n in (31, 32, 33, 34, 499, 501)]
    q = spark.createDataFrame([(f"q{k}", x) for k, x in enumerate(quotes)], "quote_id string, quote string")
    s = spark.createDataFrame(list(enumerate(texts)), "source_id int, text string").repartition(3)
    plain = lambda x: " ".join(x.split())
    want = sorted((f"q{k}", i) for k, x in enumerate(quotes) for i, y in enumerate(texts) if plain(x) and plain(x) in plain(y))
    assert sorted(map(tuple, containment.grounded_pairs(q, s).collect())) == want and len(want) > 1000


@pytest.mark.parametrize("k", [1, 4])
def test_the_best_by_words_equal_a_plain_loop(spark, k):
    """Queries whose words are all common, all unknown, none, or of one document; ties, nulls."""
    draw = np.random.default_rng(k)
    vocabulary, weight = np.array([f"w{i}" for i in range(60)]), 1 / np.arange(1, 61)
    say = lambda n: " ".join(draw.choice(vocabulary, n, p=weight / weight.sum()))
    docs = [(i, say(int(draw.integers(1, 30)))) for i in range(150)] + [(150, None), (151, ""), (152, "w0 W0 only")]
    queries = [(i, say(int(draw.integers(1, 20)))) for i in range(40)] + [(40, "none of these"), (41, None), (42, docs[7][1]), (43, "w0"), (44, "only w0 unknown")]
    want = []
    for i, x in queries:
        w = {*(x or "").lower().split()}
        shared = sorted((-len(w & {*(y or "").lower().split()}), d) for d, y in docs)
        want += [(i, d, round(-m / len(w), 9), p) for p, (m, d) in enumerate(shared[:k]) if m]
    found = retrieval.top_by_words(spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string").repartition(3), k)
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_fusion_ignores_the_order_of_rows(spark):
    rows = [(1, l, r, f"f{(l + r) % 3}", f"t{(l * r) % 4}", l * 10 + r) for l in range(3) for r in range(6)]
    schema = "query_id long, list long, rank long, source_file string, text string, id long"
    a = retrieval.fuse(spark.createDataFrame(rows, schema), 8).collect()
    b = retrieval.fuse(spark.createDataFrame(rows[::-1], schema).repartition(3), 8).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


@pytest.mark.parametrize("how", [{"k": 5}, {"k": 3, "metric": "l2"}, {"k": 4, "within": "label"}])
def test_blocks_of_queries_find_what_one_block_does(spark, monkeypatch, how):
    from tests.conftest import SF

    from groundwork.plans.retrieval import asked, base

    whole = sorted(map(tuple, retrieval.nearest(asked(spark, SF), base(spark, SF), **how).collect()))
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 5 * 64 * 8)
    assert retrieval._bytes(asked(spark, SF)) > 2 * retrieval.QUERY_BYTES
    assert sorted(map(tuple, retrieval.nearest(asked(spark, SF), base(spark, SF), **how).collect())) == whole


def test_queries_that_ask_for_many_hits_go_in_blocks(spark, monkeypatch):
    from tests.conftest import SF

    from groundwork.plans.retrieval import asked, base

    want = sorted(map(tuple, retrieval.nearest(asked(spark, SF), base(spark, SF), 4, within="label").collect()))
    monkeypatch.setattr(retrieval, "HITS", 700)  # 25 queries for 4 of each label
    assert retrieval.blocks_for(asked(spark, SF), 4) == 1 and retrieval.blocks_for(asked(spark, SF), 40) == 3
    assert sorted(map(tuple, retrieval.nearest(asked(spark, SF), base(spark, SF), 4, within="label").collect())) == want


def test_the_closest_centres_need_bounded_memory():
    import tracemalloc

    rows, centres = np.random.default_rng(1).normal(size=(8000, 8)), np.random.default_rng(2).normal(size=(2000, 8))
    tracemalloc.start()
    got = vector_index.closest(rows, centres)
    assert tracemalloc.get_traced_memory()[1] < 40e6  # all distances are 128 MB
    tracemalloc.stop()
    assert (got[:50] == ((rows[:50, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)).all() and len(vector_index.closest(rows[:0], centres)) == 0


@pytest.mark.parametrize("held", [1, 40, 1 << 21])
def test_a_task_keeps_its_own_best(spark, monkeypatch, held):
    from tests.conftest import SF

    from groundwork.plans.retrieval import asked, base

    want = sorted(map(tuple, retrieval.nearest(asked(spark, SF), base(spark, SF), 4, within="label").collect()))
    monkeypatch.setattr(retrieval, "HELD", held)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = sorted(map(tuple, retrieval.nearest(asked(spark, SF), base(spark, SF), 4, within="label").collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


def test_search_takes_the_index_by_the_number_of_rows(spark, tmp_path):
    from tests.conftest import SF

    from groundwork.plans.retrieval import asked, base

    where = f"file://{tmp_path}/index"
    exact = {(r.query_id, r.id) for r in vector_index.search(asked(spark, SF), base(spark, SF), 5, path=where).collect()}
    assert exact == {(r.query_id, r.id) for r in retrieval.nearest(asked(spark, SF), base(spark, SF), 5).collect()} and not (tmp_path / "index").exists()
    written = []
    for _ in range(2):  # built, then found there
        near = {(r.query_id, r.id) for r in vector_index.search(asked(spark, SF), base(spark, SF), 5, rows=100, path=where).collect()}
        assert len(exact & near) >= 0.9 * len(exact)
        written.append({p.name for p in (tmp_path / "index").rglob("*.parquet")})
    assert written[0] == written[1]
    assert [vector_index.cells_for(n) for n in (0, 2_000, 50_001, 10**10)] == [4, 45, 224, 4096]


def vectors(spark, rows, name="id"):
    return spark.createDataFrame(rows, f"{name} long, vector array<float>")


def test_vectors_that_are_null_have_no_neighbours(spark):
    q = vectors(spark, [(1, [1.0, 0.0]), (2, None)], "query_id")
    b = vectors(spark, [(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0]), (4, [2.0, 0.0]), (5, None)]).repartition(3)
    for metric, want in (("cosine", [(1, 1, 0.0), (1, 4, 0.0), (1, 3, 1.0)]), ("l2", [(1, 1, 0.0), (1, 4, 1.0), (1, 3, 2.0)])):
        assert [tuple(r)[:3] for r in retrieval.nearest(q, b, 9, metric=metric).orderBy("rank").collect()] == want
    assert retrieval.nearest(q.filter("query_id = 2"), b, 3).count() == 0 and retrieval.nearest(q, b.limit(0), 3).count() == 0


@pytest.mark.parametrize("odd", [[1.0], [0.0, 1.0, 5.0], []])
def test_vectors_of_mixed_width_are_refused(spark, odd):
    even = [(1, [1.0, 0.0]), (3, [0.0, 1.0])]
    with pytest.raises(ValueError, match="width"):
        retrieval.nearest(vectors(spark, even + [(4, odd)], "query_id"), vectors(spark, even), 2)
    with pytest.raises(Exception, match="vectors of width"):
        retrieval.nearest(vectors(spark, even, "query_id"), vectors(spark, even + [(4, odd)]).coalesce(1), 2).collect()


def test_the_k_smallest_keep_their_ties():
    draw = np.random.default_rng(0)
    d = draw.integers(0, 6, (50, 40)).astype(float)
    for k in (1, 5, 39, 60):
        i, j = retrieval.smallest(d, k)
        for q in range(50):
            own = set(j[i == q].tolist())
            assert set(np.argsort(d[q], kind="stable")[:k].tolist()) <= own and (k >= 40 or d[q][list(own)].max() == np.sort(d[q])[k - 1])


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_the_registered_index_recalls(spark, sf):
    from groundwork.plans.retrieval import asked, base, knn_approximate

    where = f"/root/testdata/{sf}"
    exact = {(r.query_id, r.id, r.distance) for r in retrieval.nearest(asked(spark, where), base(spark, where), 10).collect()}
    near = [(r.query_id, r.id, r.distance) for r in knn_approximate(spark, where).collect()]
    assert len(exact & {*near}) >= 0.9 * len(exact) and len(near) == len({*near}) == len(exact)


def test_an_index_holds_every_row_and_searches_in_blocks(spark, tmp_path, monkeypatch):
    from tests.conftest import SF

    from groundwork.plans.retrieval import asked, base

    rows = base(spark, SF).select("id", "vector").union(vectors(spark, [(9001, None)]))
    index = vector_index.Index.build(rows, f"file://{tmp_path}/index", cells=9)
    assert index.rows().count() == rows.count() - 1 and index.rows().select("cell").distinct().count() == 9
    whole = sorted(map(tuple, index.search(asked(spark, SF), 4, 9).collect()))
    assert whole == sorted(map(tuple, retrieval.nearest(asked(spark, SF), rows, 4).select("query_id", "id", "distance", "rank").collect()))  # all cells, a long short list
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 5 * 64 * 8)
    assert sorted(map(tuple, index.search(asked(spark, SF), 4, 9).collect())) == whole
    with pytest.raises(Exception, match="width"):
        vector_index.Index.build(rows.union(vectors(spark, [(9002, [1.0])])), f"file://{tmp_path}/other")


def test_files_and_pages_are_added_once(spark, tmp_path):
    store = catalog.Store(spark, str(tmp_path / "store"))
    files = spark.createDataFrame([("a.py", "code", "python", "def f():\n    return 1\n"), ("b.md", "docs", "", "# B\n\nsome words here"), ("c.md", "docs", "", None)], "source_file string, kind string, language string, text string")
    adding.add_files(store, files, "mine")
    adding.add_files(store, files, "mine")
    pages = spark.createDataFrame([("https://x.org/guide/start", "<html><body><p>" + "word " * 30 + "</p></body></html>"), ("https://x.org/none", "<p>short</p>"), ("https://x.org/null", None)], "url string, html string")
    assert adding.add_pages(store, pages, "mine") == 1
    held = [(r.table_name, r.source_file) for r in store.read().select("table_name", "source_file").distinct().collect()]
    assert store.read().filter("source_file = 'a.py'").count() == 1 and {x for x, _ in held} == {"mine_code", "mine_docs"} and len(held) == 3
    with pytest.raises(ValueError):
        adding.add_pages(store, pages.filter("url like '%none'"), "mine")


def test_sessions_are_logged_and_archived(spark, tmp_path):
    log, old = str(tmp_path / "log"), str(tmp_path / "old")
    turns = spark.createDataFrame([("s1", 1, "a"), ("s1", 2, "b"), ("s2", 1, None)], "session string, turn int, text string")
    sinks.append_turns(turns, log)
    sinks.append_turns(turns.filter("session = 's1' and turn = 2"), log)
    assert sinks.archive(spark, log, "s1", old) and not sinks.archive(spark, log, "s1", old)
    assert spark.read.parquet(log).count() == 1 and spark.read.parquet(old).count() == 3
    sinks.append_turns(turns, log)
    with pytest.raises(FileExistsError):
        sinks.archive(spark, log, "s1", old)


@pytest.mark.parametrize("last", ["23:59:25.261702", "23:59:25.5", "23:59:26.5", "23:59:25.761702", "23:59:59.999999"])
def test_freshness_counts_from_the_nearest_second(spark, tmp_path, last):
    """The last event's time falls on either side of a half second; events lie a day before it, give or take."""
    import duckdb

    from groundwork.plans import sources

    where = f"{tmp_path}/events.parquet"
    duckdb.sql(f"COPY (SELECT i AS event_id, TIMESTAMP '2024-01-30 {last}' - to_microseconds(86400000000 * (i > 0)::INT - 250000 * (i - 8)) AS ts FROM range(13) r(i) UNION ALL SELECT 99, NULL) TO '{where}' (FORMAT parquet)")
    events = duckdb.read_parquet(where)  # noqa: F841
    want = sorted(duckdb.sql(sources.FRESH_CACHE).fetchall())
    assert sorted(tuple(r) for r in sources.fresh_cache(spark, str(tmp_path)).collect()) == want and {True, False} <= {r[1] for r in want}


def test_lists_have_an_item_a_line(spark, tmp_path):
    sinks.write_lines(spark.createDataFrame([("https://a",), (None,), ("b\nc",), ("",)], "url string"), "url", str(tmp_path / "urls"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "urls")).collect()) == ["", "b c", "https://a"]


def test_line_packing_equals_plain_python(spark):
    texts = ["".join(f"line {i}\n" for i in range(100)), "x" * 5000, "", "a\n" + "y" * 1200 + "\nb\nc", "one\rtwo\r\nthree", "z" * 500 + "\n" + "q" * 20]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r[0] for r in df.select("i", chunking.packed_lines(F.col("t"), 500).alias("x")).orderBy("i").select("x").collect()]
    assert got == [chunking.pack(x.splitlines(keepends=True), 500) for x in texts]
    assert all(len(c) <= 500 for x in got for c in x)


def test_markdown_keeps_fences_and_headings():
    text = "# A\n\nintro\n\n```py\n" + "".join(f"x{i} = {i}\n" for i in range(200)) + "```\n\n## B\n| a | b |\n" + "word " * 400
    parts = chunking.markdown(text, 400, 50)
    code = [p for p in parts if p.startswith("```")]
    assert len(code) > 2 and all(p.startswith("```py\n") and p.rstrip().endswith("```") for p in code)
    assert any(p.startswith("# A") for p in parts) and any("## B" in p for p in parts)
    assert all(len(p) <= 400 for p in parts if not p.startswith("```")) and sum(p.count("x199 = 199") for p in parts) == 1
    assert chunking.markdown("") == [] and chunking.markdown("```\nshort\n```") == ["```\nshort\n```"]


def test_code_chunks():
    source = "import os\n\ndef f(a):\n    return a\n\nclass C:\n    def g(self):\n        return '" + "x" * 150 + "'\n\n    def h(self):\n        return 2\n"
    found = chunking.code(source, "python", 120)
    assert any(s == "f" or "def f" in c for c, _, _, s in found) and all(b >= a >= 1 for _, a, b, _ in found)
    assert chunking.code(source, "cobol") == [] and [x[0] for x in chunking.code("def broken(", "python")] == ["def broken("]
    assert [x[3] for x in chunking.code("func a() {\n  1\n}\nfunc b() {\n  2\n}\n", "go", 16)] == ["a", "b"]


PIECES = ["def f(a):", "    return a", "class C:", "    x = 1", "    def g(self):", "        return 2", "", "# note", "import os", "a = 1; b = 2", "broken(", "func h() {", "  y()", "}", "@d", "    # inside", "\x0c", "s = (1,", "  2)", "z = 'a\u2028b'", "if x: pass"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25), st.sampled_from(["python", "go", "r"]), st.sampled_from(["\n", "\r\n", "\r"]), st.sampled_from([1, 15, 60, 2000]))
def test_code_chunks_lose_no_line(lines, language, mark, most):
    """Each line that is not blank lies in a chunk that says so, whatever the syntax; nothing is made up."""
    source = mark.join(lines)
    found = chunking.code(source, language, most)
    joined = "\n".join(t for t, *_ in found)
    for i, line in enumerate(lines, 1):
        if line.strip():
            assert any(a <= i <= b for _, a, b, _ in found)
            assert line in joined or len(line) > most
    if most == 2000:
        assert [x for x in joined.split("\n") if x.strip()] == [x for x in lines if x.strip()]
    for (_, _, b, _), (_, a, _, _) in zip(found, found[1:]):
        assert a >= b or most < 2000


JS = """import x from 'y'

class Big extends Base {
  field = [1, {a: "}"}]

  // what one does
  // and why
  one(a) {
    return `}
  ${a}` + /[{]/.test(a)
  }

  async two(b,
    c) {
    if (b) {
      x()
    } else {
      y('it is')
    }
  }
}
"""
RUBY = "class A\n  # one\n  def one(x)\n    if x\n      y\n    else\n      z\n    end\n  end\n\n  def self.two\n    1\n  end\nend\n"
SHELL = "main() {\n  local a=1\n  for x in 1 2; do\n    echo $x\n  done\n  run \"$a\"\n}\n"
R = "f <- function(x) {\n  # add\n  g <- function(y) {\n    y + 1 # }\n  }\n  g(x)\n}\n"
GO = "type T struct {\n\ta int\n\tb []string\n}\n"
RUST = "impl<'a> T<'a> {\n    fn one(&'a self, c: char) -> u8 {\n        if c == '}' { 1 } else { 2 }\n    }\n    pub fn two() {}\n}\n"


@pytest.mark.parametrize(
    "language, source, want",
    [
        ("javascript", JS, [(3, 3, "Big"), (4, 5, ""), (6, 12, "one"), (13, 21, "two")]), ("ruby", RUBY, [(1, 1, "A"), (2, 10, "one"), (11, 13, "two")]),
        ("bash", SHELL, [(1, 1, "main"), (2, 2, ""), (3, 5, ""), (6, 7, "")]), ("r", R, [(1, 1, "f"), (2, 5, "g"), (6, 7, "g")]), ("go", GO, [(1, 1, ""), (2, 2, ""), (3, 4, "")]),
        ("rust", RUST, [(1, 1, ""), (2, 4, "one"), (5, 6, "two")]),
    ],
)
def test_blocks_hold_members(language, source, want):
    lines = chunking.code_lines(source)
    top = max(chunking.block_units(lines), key=lambda u: u[1] - u[0])
    found = [u[:3] for u in chunking.inner_units(lines, top, language)]
    assert [(a, b) for a, b, _ in found] == [(a, b) for a, b, _ in want] and [n for *_, n in found if n] == [n for *_, n in want if n]


def test_long_classes_open_to_their_methods():
    body = "".join(f"    call{i}(`{'x' * 40}`);\n" for i in range(12))
    source = "class Big {\n" + "".join(f"  method{k}(a) {{\n{body}  }}\n\n" for k in range(12)) + "}\n"
    chunks = chunking.code(source, "javascript", 600)
    assert list(dict.fromkeys(c[3] for c in chunks if c[3].startswith("method"))) == [f"method{k}" for k in range(12)]
    covered = {k for _, a, b, _ in chunks for k in range(a, b + 1)}
    assert {k for k, x in enumerate(source.split("\n"), 1) if x.strip()} <= covered and all(len(t) <= 1200 and b - a < 20 for t, a, b, _ in chunks)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["class A {", "  m(a) {", "    x(", "  }", "}", ")", "'", '"', "`", "/*", "*/", "// {", "# [", "    end", "  def b", "", "\t{[(", "if x then", "  fi"]), max_size=60), st.sampled_from(sorted(chunking.CODE_LANGUAGES)), st.integers(5, 120))
def test_broken_code_loses_no_line(lines, language, most):
    source = "\n".join(lines)
    chunks = chunking.code(source, language, most)
    kept = chunking.code_lines(source)
    covered = {k for _, a, b, _ in chunks for k in range(a, b + 1)}
    assert {k for k, x in enumerate(kept, 1) if x.strip()} <= covered
    for unit in chunking.block_units(kept):
        inner = chunking.inner_units(kept, unit, language)
        assert not inner or [k for a, b, *_ in inner for k in range(a, b + 1)] == list(range(unit[0], unit[1] + 1))


def test_braces_a_thousand_deep_are_chunked():
    source = "f() {\n" + "".join("  " * k + "{\n" for k in range(1000)) + "}\n" * 1001
    assert "".join(t for t, *_ in chunking.code(source, "c", 500)).count("{") >= 1001


PAGE = """<html><head><title>T</title></head><body><nav><a href="/a">All</a></nav><div class="promo box"><p>Buy now, it is a long advertising text that says much of nothing.</p></div>
<h1>Title &amp; more</h1><p>A first paragraph that is long enough to be what the page is about, with <b>bold</b> words.</p><p>Short one.</p>
<ul><li>An item that says something of its own, at length and in words</li><li>Another item that does the same thing in other words</li></ul>
<table><tr><th>Name of the thing</th><td>its value, which is told here in full</td></tr><tr><td>second name</td><td>and a second value</td></tr></table>
<pre>if a:
    b()</pre><blockquote>Someone said this, and it is quoted here at some length.</blockquote>
<ul><li><a href="/1">A link to some other page of this site</a></li><li><a href="/2">A link to yet another page of this site</a></li></ul><!-- <p>no</p> --><footer>Foot</footer></body></html>"""


def test_main_content_as_markdown(spark):
    found = content.with_markdown(spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "<p>" + "word " * 50), (5, "no tags, but enough text to be the content of a page")], "page_id long, html string")).orderBy("page_id").collect()
    said = found[0].markdown
    assert said.startswith("# Title & more\n\nA first paragraph") and "\n\nShort one.\n\n- An item" in said and "words\n- Another item" in said
    assert "| Name of the thing | its value, which is told here in full |\n| second name | and a second value |" in said and "```\nif a:\n    b()\n```" in said and "> Someone said" in said
    assert not any(x in said for x in ("All", "Buy", "link", "no</p>", "Foot"))
    assert [r.markdown for r in found[1:]] == ["", "", ("word " * 50).strip(), "no tags, but enough text to be the content of a page"]


def test_a_page_is_cut_once_whatever_is_asked_of_its_blocks(spark):
    """A filter on the blocks takes in their whole expression; it must not be computed for each block again."""
    x = content.with_blocks(spark.createDataFrame([(1, PAGE)], "page_id long, html string"))
    plans = [x.select("page_id", F.posexplode_outer("blocks")), x.filter(F.size("blocks") > 0)]
    once = x._jdf.queryExecution().optimizedPlan().toString().count("split(")
    assert [p._jdf.queryExecution().optimizedPlan().toString().count("split(") for p in plans] == [once, 2 * once]  # in the filter and in the result


def test_code_of_deep_syntax_is_still_chunked():
    for source in ("(" * 5000 + ")" * 5000, "x = " + "-" * 100_000 + "1", "def f():\n  a\n\n  b\n# end"):
        found = chunking.code(source, "python")
        assert found and sum(len(t) for t, *_ in found) >= len(source.strip()) - source.count("\n")


def test_long_fences_lose_nothing():
    for head, foot in (("```py\n", "```"), ("~~~\n", "~~~"), ("```\n", "```"), ("``` title\n", "end```")):
        body = "".join(f"line {i} {'x' * (i % 90)}\n" for i in range(60))
        parts = chunking.fenced(head + body + foot, 300)
        assert all(p.startswith(head[:3]) and p.endswith(foot[-3:] + "\n") for p in parts)
        inner = "".join(p.split("\n", 1)[1][: -len("```\n")] for p in parts)
        assert all(f"line {i} " in inner for i in range(60)) and ("title" in inner) == ("title" in head) and ("end" in inner) == ("end" in foot)
    assert "".join(chunking.fenced("```\n" + "never closed\n" * 100, 50)).count("never closed") == 100


def rows(spark, files, table="c_docs", width=3):
    return spark.createDataFrame([(f"text {f}", [0.1] * width, f, "doc", "", "", 0, 0, table) for f in files], catalog.SCHEMA)


def test_store(spark, tmp_path):
    s = catalog.Store(spark, f"file://{tmp_path}/store")
    assert s.tables() == [] and s.read().count() == 0
    s.append(rows(spark, ["r/a.md", "r/b.md"]))
    s.append(rows(spark, ["r/a.md", "r/c.md", "a_md"]))  # a is there already
    s.append(rows(spark, ["x/a.md"], "d_docs"))
    assert s.tables() == ["c_docs", "d_docs"] and s.read().count() == 5
    with pytest.raises(ValueError):
        s.append(rows(spark, ["new.md"], width=4))
    with pytest.raises(ValueError):
        s.append(spark.createDataFrame([("t", "f", "c_docs")], "text string, source_file string, table_name string"))
    assert s.remove_file("a.md", "c_") == 1 and s.read().count() == 4  # the sign _ in names is plain
    assert s.remove_file("x/a.md") == 1 and s.tables() == ["c_docs"]
    with pytest.raises(ValueError):
        s.overwrite(rows(spark, ["new.md"], width=4))
    s.compact()
    assert sorted(r.files for r in s.files().collect()) == ["a_md,r/b.md,r/c.md"]
    with pytest.raises(KeyError):
        s.drop("none")
    s.wipe()
    assert s.tables() == []


def test_no_task_writes_two_tables_anew(spark, tmp_path, monkeypatch):
    """Files are named by the task that wrote them: a task of compaction or deletion has one table, and a large table several tasks."""
    s, names = catalog.Store(spark, f"file://{tmp_path}/store"), [f"t{i}" for i in range(9)]

    def tasks() -> list:
        found = s.read().select("table_name", F.regexp_extract(F.input_file_name(), r"/part-(\d+)", 1).alias("task")).distinct().collect()
        return sorted((r.table_name, r.task) for r in found)

    for n in names:
        s.append(rows(spark, [f"{x}.md" for x in "abcdef"], n))
    s.compact()
    assert [t for t, _ in tasks()] == names and len({k for _, k in tasks()}) == 9
    assert s.remove_file("a.md") == 9 and [t for t, _ in tasks()] == names and len({k for _, k in tasks()}) == 9
    monkeypatch.setattr(catalog, "FILE_BYTES", 1000)
    assert s.remove_file("b.md") == 9 and len({k for _, k in tasks()}) == len(tasks()) > 9
    s.compact(3)
    assert len({k for _, k in tasks()}) == len(tasks()) > 9 and s.read().count() == 36
    s.append(rows(spark, ["x.md", "y.md"], "new"), files_per_table=1)
    assert [t for t, _ in tasks()].count("new") == 1 and s.read().count() == 38


@pytest.mark.parametrize("names", [["007", "12", "1e3"], ["a b", "x=y", "50%", "é/ü:z"], ["True", "2024-01-01", "null", "-1"]])
def test_table_names_stay_as_they_are(spark, tmp_path, names):
    s = catalog.Store(spark, f"file://{tmp_path}/store")
    for name in names:
        s.append(rows(spark, ["r/a.md", "r/b.md"], name))
        s.append(rows(spark, ["r/b.md", "r/c.md"], name))  # b is there already
    assert s.tables() == sorted(names) and sorted(r.table_name for r in s.files().collect()) == sorted(names)
    assert s.remove_file("a.md") == len(names) and s.read().count() == 2 * len(names)
    s.compact()
    assert s.remove_file("b.md", names[0]) == 1 and s.tables() == sorted(names)
    s.overwrite(rows(spark, ["only.md"], names[1]))
    assert {(r.table_name, r.chunks) for r in s.files().collect()} == {(n, 1 if k < 2 else 2) for k, n in enumerate(names)}
    s.drop(names[1])
    assert s.remove_file("c.md", names[0]) == 1 and s.tables() == sorted(names[2:])


def test_a_store_refuses_vectors_that_do_not_fit(spark, tmp_path):
    s = catalog.Store(spark, f"file://{tmp_path}/store")
    good = rows(spark, ["a.md"])
    for bad in (good.union(rows(spark, ["b.md"], width=4)), good.withColumn("vector", F.lit(None).cast("array<float>")), good.withColumn("table_name", F.lit(None).cast("string")), good.withColumn("table_name", F.lit(""))):
        with pytest.raises(ValueError):
            s.append(bad)
    assert not s.exists()
    s.append(good)
    with pytest.raises(ValueError):
        s.append(rows(spark, ["c.md"]), width=9)


def chunked(spark, files: int, chunks: int):
    """Chunks of some files, numbered."""
    one = rows(spark, [f"f{i}.md" for i in range(files)]).withColumn("n_chunks", F.lit(chunks))
    return one.withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).withColumn("line_start", F.col("seq"))


def test_files_over_several_batches_arrive_whole(spark, tmp_path):
    """Ten chunks a file over three micro-batches and two runs of one query; the second run goes on from the checkpoint."""
    store = catalog.Store(spark, f"file://{tmp_path}/out")
    all_chunks = chunked(spark, 6, 10).persist()

    def run():
        stream = spark.readStream.schema(all_chunks.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        streams.ingest(stream, store, f"file://{tmp_path}/checkpoint").awaitTermination()
        return {r.source_file: r.n for r in store.read().groupBy("source_file").agg(F.count("*").alias("n")).collect()}

    for part in (F.col("seq") < 4, (F.col("seq") >= 3) & (F.col("seq") < 7)):  # chunk 3 comes twice
        all_chunks.filter(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert run() == {}
    all_chunks.filter("seq >= 7 and source_file <> 'f5.md' or source_file = 'f0.md'").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert run() == {f"f{i}.md": 10 for i in range(5)}
    assert run() == {f"f{i}.md": 10 for i in range(5)}
    all_chunks.filter("seq >= 7").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert run() == {f"f{i}.md": 10 for i in range(6)}
    held = store.read().filter("source_file = 'f0.md'")
    assert [r.line_start for r in held.orderBy("line_start").collect()] == list(range(10)) and not {"seq", "n_chunks"} & {*held.columns}


def test_streamed_ingest_equals_batch(spark, tmp_path):
    chunked(spark, 6, 1).repartition(3).write.parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    store = catalog.Store(spark, f"file://{tmp_path}/out")
    for _ in range(2):
        streams.ingest(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), store).awaitTermination()
    assert sorted(r.source_file for r in store.read().collect()) == [f"f{i}.md" for i in range(6)]
    with pytest.raises(ValueError):
        streams.ingest(spark.readStream.schema(catalog.SCHEMA).parquet(f"{tmp_path}/in"), store)


def test_no_task_writes_a_part_of_a_stream_alone(spark, tmp_path):
    import glob

    from tests.conftest import SF

    from groundwork.plans import events
    from groundwork.session import shared_dir

    spark.read.parquet(f"{SF}/documents.parquet").limit(90).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    shared = shared_dir(spark).removeprefix("file://")
    old = {*glob.glob(f"{shared}/streamed-*")}
    assert events.stream_ingest(spark, str(tmp_path)).count() == 90
    (new,) = {*glob.glob(f"{shared}/streamed-*")} - old
    assert len(glob.glob(f"{new}/in/part=0/*.parquet")) == 3 and len(glob.glob(f"{new}/in/part=*")) == 4


def test_sources_from_files(spark, tmp_path):
    (tmp_path / "repo/src").mkdir(parents=True)
    (tmp_path / "repo/src/a.py").write_text("x = 1\n")
    (tmp_path / "repo/n.md").write_text("# N\n")
    assert sorted(r.path.rsplit("/", 1)[1] for r in paths.list_files(spark, str(tmp_path)).collect()) == ["a.py", "n.md"]
    assert sorted(r.text for r in paths.whole_texts(spark, str(tmp_path)).collect()) == ["# N\n", "x = 1\n"]


def test_sitemaps(spark):
    maps = [("r", "<i:sitemapindex xmlns:i='n'><i:sitemap><i:loc> s1 </i:loc></i:sitemap><i:sitemap><i:loc>r</i:loc></i:sitemap></i:sitemapindex>"), ("s1", "<urlset><url><loc>u1</loc></url><url><loc>u2</loc></url><url><loc>u1</loc></url></urlset>")]
    f = spark.createDataFrame(maps, "url string, xml string")
    assert [r.url for r in web.sitemap_urls(f, "r", 2).orderBy("pos").collect()] == ["u1", "u2"]
    assert web.sitemap_urls(f, "r", 1).count() == 0 and web.sitemap_urls(f, "gone", 3).count() == 0
    named = spark.createDataFrame([("sitemap.xml", "<x><loc>a.xml</loc><loc>p</loc></x>"), ("a.xml", "<x><loc>q</loc></x>")], "url string, xml string")
    assert {r.url for r in web.sitemap_urls(named, "sitemap.xml", 2, by_name=True).collect()} == {"p", "q"}


def test_costs_of_a_log(spark):
    log = "x Tokens: 28k sent, 100 received. Cost: $0.04 message, $0.10 session.\n> Tokens: 10k sent, 50 received. Cost: $0.02 message, $0.12 session.\n"
    r = logs.cost_totals(logs.cost_entries(spark.createDataFrame([("a", log)], "log string, text string"))).first()
    assert (r.entries, r.sent, r.received, r.cost) == (2, 38000, 150, 0.06)


def test_models_get_batches_in_order_and_failures_are_null(spark):
    def factory():
        calls = []

        def model(texts):
            calls.append(len(texts))
            if "bad" in texts:
                raise RuntimeError("no answer")
            return [[float(len(t)), float(len(texts)), float(len(calls))] for t in texts]

        return model

    models.register("embed", "test", factory)
    rows = [(i, "x" * i) for i in range(20)] + [(20, None), (21, "bad"), (22, "y")]
    found = models.embed(spark.createDataFrame(rows, "id long, text string").coalesce(1), "test").orderBy("id").collect()
    assert [r.vector and r.vector[:2] for r in found[:16]] == [[i, 8.0] for i in range(16)]  # eight at a time
    assert all(r.vector is None for r in found[16:]) and [r.id for r in found] == list(range(23))  # the last call holds the bad one
    for wrong in (lambda: models.embed(spark.createDataFrame(rows, "id long, text string"), "none"), lambda: models.backend("rerank", "none")):
        with pytest.raises(ValueError, match="unknown"):
            wrong()
    assert models.in_batches(lambda xs: xs[:1], [1, 2, 3], 2) == [None, None, 3] and models.in_batches(len, [], 2) == []


def test_the_offline_models_equal_their_expressions(spark):
    texts = ["a", "", "Some words here, and ÄÖ some more", "x" * 300, "日本語 text"]
    rows = spark.createDataFrame([(i, t, texts[-1 - i]) for i, t in enumerate(texts)], "id long, text string, other string")
    both = models.embed(retrieval.embed(rows).withColumnRenamed("vector", "want")).collect()
    assert all(np.allclose(r.vector, r.want, atol=1e-6) for r in both)
    pairs = models.entail(models.rerank(rows, "other", "text"), "other", "text").withColumn("want", retrieval.lexical_relevance(F.col("other"), F.col("text"))).collect()
    assert all(r.relevance == r.entailed == r.want for r in pairs)


def test_a_debate_of_any_length_and_order_holds_two_proposals(spark):
    import itertools
    from types import SimpleNamespace

    import pandas as pd

    draw = np.random.default_rng(1)
    for _ in range(60):
        n = int(draw.integers(1, 9))
        turns = [(k, str(draw.choice(["architect", "oracle"])), str(draw.choice(["h1", "h2"])), draw.choice(["agree", "object", None])) for k in range(n)]
        want_hashes, verdicts = [h for _, r, h, _ in turns if r == "architect"], [v for _, r, _, v in turns if r == "oracle"]
        said = verdicts[-1] if verdicts else None
        want = "agreed" if said == "agree" else "deadlock" if said == "object" and len(want_hashes) > 1 and want_hashes[-1] == want_hashes[-2] else "continue"
        state = SimpleNamespace(exists=False, get=None)
        state.update = lambda x, state=state: state.__dict__.update(exists=True, get=x)
        mixed = [turns[i] for i in draw.permutation(n)]
        for part in itertools.batched(mixed, 2):
            (out,) = streams._turns((1,), iter([pd.DataFrame(part, columns=["turn", "role", "proposal_hash", "verdict"])]), state)
        assert (out.state[0], out.n[0], len(state.get)) == (want, n, 7)


def test_execution_order_equals_a_plain_rescan():
    draw = np.random.default_rng(3)
    for _ in range(80):
        n = int(draw.integers(1, 14))
        nodes = [(f"t{k}", [f"t{int(d)}" for d in draw.integers(0, n + 1, int(draw.integers(0, 3)))]) for k in draw.permutation(n)]
        left, ended, out = [*nodes], set(), []
        while (at := next((i for i, (_, deps) in enumerate(left) if ended.issuperset(deps)), None)) is not None:
            ended.add(left[at][0])
            out.append(left.pop(at)[0])
        assert dag.execution_order(nodes) == out


def test_execution_order_and_levels(spark, monkeypatch):
    nodes = [("c", ["a", "b"]), ("a", []), ("b", ["a"]), ("x", ["gone"]), ("d", ["c"])]
    assert dag.execution_order(nodes) == ["a", "b", "c", "d"]
    df = spark.createDataFrame(nodes, "id string, depends_on array<string>")
    want = {"a": 0, "b": 1, "c": 2, "x": 0, "d": 3}
    assert {r.id: r.level for r in dag.levels(df).collect()} == want
    monkeypatch.setattr(dag, "PLAN_ROWS", 0)
    assert {r.id: r.level for r in dag.levels(df).collect()} == want
    with pytest.raises(ValueError):
        dag.plan_levels({"a": ["b"], "b": ["a"]})


def test_tumbling_refuses_zero():
    with pytest.raises(ValueError):
        tumble(F.lit(5), 0)


def test_empty_tables(spark):
    e = spark.createDataFrame([], "doc long, text string")
    lines = audit.review_lines(e)
    assert audit.anchors(lines).count() == audit.paragraphs(lines).count() == 0
    assert audit.claim_blocks(lines, lines.select("doc", "idx")).count() == 0
    assert e.select(t.normalize(F.col("text"))).count() == 0
