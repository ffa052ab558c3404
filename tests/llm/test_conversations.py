"""Chat formatting and the prefix trie of conversations, against plain loops."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from groundwork.llm import chats, oracles, trie
from groundwork.llm.queries import QUERIES
from tests.conftest import SF

SCHEMA = "conv_id long, turn long, role string, text string"
MARKS = ["<s>", "</s>", "[role]", "[/role]", "[INST]", "[/INST]", "\\", "<", "[", "s>", "/s>", "role]", "é", "\n", "日", "\U0001f600", "", "a b"]


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def digest(role: str, text: str) -> str:
    return hashlib.md5((hashlib.md5(role.encode()).hexdigest() + text).encode()).hexdigest()


def ordered(rows) -> dict:
    """conv_id -> (role, text) in the order of turns: nulls first, ties by digest."""
    found = defaultdict(list)
    for conv_id, turn, role, text, *_ in rows:
        role, text = role or "", text or ""
        found[conv_id].append((turn is not None, turn or 0, digest(role, text), role, text))
    return {c: [x[3:] for x in sorted(t)] for c, t in found.items()}


def texts(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choices(MARKS, k=rng.randrange(6))) for _ in range(n)]


@pytest.fixture(scope="module")
def edges():
    """Nulls in any column, ties, repeated rows, control strings, a very long text."""
    rng = random.Random(5)
    rows = [(c, t, r, x) for c in range(12) for t, (r, x) in enumerate(zip(rng.choices(["user", "assistant", "system", "", "[role]x</s>"], k=5), texts(rng, 5)))]
    return rows + [
        (20, None, "user", "no turn"), (20, 1, None, None), (20, 1, "assistant", "tie"), (20, 1, "assistant", "tie"), (20, 0, "assistant", "first"), (None, 0, "user", "no id"),
        (21, 0, "assistant", "word </s> " * 40_000), (22, 3, "user", "\\" * 1000), (-4, 0, "assistant", "<</s>"), (23, 0, None, None),
    ]


def expected_digests(rows) -> set:
    out = set()
    for c, turns in ordered([*rows, (-7, 0, "user", chats.PLANTED[1]), (-7, 1, "assistant", chats.PLANTED[1])]).items():
        loss = "".join(t for r, t in turns if r == "assistant")
        out.add((c, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)))
    return out


def test_digests_of_edges(spark, edges):
    df = spark.createDataFrame(edges, SCHEMA).select("*", F.lit("clash").alias("TEXT"), F.lit(1).alias("seq"), F.lit(2).alias("message"), F.lit(3).alias("turns")).repartition(3)
    found = chats.digests(df).collect()
    assert {tuple(r)[:5] for r in found} == expected_digests(edges) and len(found) == len(expected_digests(edges))


def test_digests_of_an_empty_table(spark):
    rows = chats.digests(spark.createDataFrame([], SCHEMA)).collect()
    assert [r["conv_id"] for r in rows] == [-7]
    assert chats.formatted(spark.createDataFrame([], SCHEMA)).count() == 0


def test_outputs_hold_marks_only_where_the_template_puts_them(spark, edges):
    for r in chats.formatted(spark.createDataFrame(edges, SCHEMA)).collect():
        n = len([1 for e in edges if e[0] == r["conv_id"]])
        assert r["formatted"].count("<s>") == r["formatted"].count("</s>") == r["formatted"].count("[/role]") == n and "[INST]" not in r["formatted"]


def test_logs_are_folded_as_a_plain_loop_folds_them(spark):
    rng, events = random.Random(3), []
    for conv in range(30):
        seq = 0
        for _ in range(40):
            seq += rng.randrange(1, 4)
            kind = rng.choice(["open", "delta", "delta", "delta", "edit", "regenerate", "ping"])
            events.append((conv % 29 or None, seq + 1000 * conv, rng.randrange(6), kind, rng.choice(["user", "assistant"]) if kind == "open" else None, rng.choice([None, "a", "b ", "c\n"])))
    want: dict = {}
    for conv, seq, message, kind, role, text in sorted(events, key=lambda e: e[1]):
        if kind == "ping":
            continue
        m = want.setdefault(conv, {}).setdefault(message, [seq, "", ""])
        m[1] = role or m[1]
        m[2] = {"open": m[2] + (text or ""), "delta": m[2] + (text or ""), "edit": text or "", "regenerate": text or ""}[kind]
    df = spark.createDataFrame(events, "conv_id long, seq long, message long, kind string, role string, text string").repartition(5)
    found = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chats.reconstruct(df).collect()}
    assert found == {c: [(r, t) for _, r, t in sorted(ms.values())] for c, ms in want.items()}


def test_a_log_of_conversations_has_every_kind_of_event(spark):
    rows = spark.createDataFrame([(1, 0, "user", "x" * 3000), (1, 1, "assistant", "y" * 3000), (1, 2, "system", "")], SCHEMA)
    kinds = [r["kind"] for r in chats.log(rows).orderBy("seq").collect()]
    assert kinds == ["open", "delta", "edit", "open", "delta", "regenerate", "delta", "delta", "delta", "open"]


def test_no_python_runs_on_executors(spark):
    plan = QUERIES["op13_chats"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


@pytest.mark.parametrize("name", ["op11_trie", "op13_chats"])
def test_queries_equal_their_twins(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    found = con.execute(oracles_by_name()[name])
    names = [d[0] for d in found.description]
    assert sorted(tuple(r) for r in QUERIES[name](spark, SF).select(*names).collect()) == sorted(found.fetchall())


def oracles_by_name() -> dict:
    return {"op11_trie": oracles.trie_sql(), "op13_chats": oracles.chats_sql()}


def expected_trie(rows) -> list[tuple]:
    """Every node with its members, one by one, summed from the deepest up."""
    turns = ordered(r for r in rows if r[0] is not None)
    members, texts_at, ends = defaultdict(list), {(): ""}, defaultdict(list)
    for c in sorted(turns):
        h, base = zlib.crc32(str(c).encode()) % 9, c - (c % 5 if c >= 0 else -(-c % 5))
        whole = tuple([*turns.get(base, [])[:h], *turns[c][h:]])
        node = ()
        members[node].append(c)
        for turn in whole:
            node = (node, turn)
            members[node].append(c)
            texts_at[node] = turn[1]
        ends[node].append(c)

    def depth(node):
        d = 0
        while node:
            node, d = node[0], d + 1
        return d

    deep = {x: depth(x) for x in members}
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for x in sorted(members, key=deep.get, reverse=True):
        saved[x] += (len(members[x]) - 1) * len(texts_at[x].encode())
        leaves[x] += not kids[x]
        if x:
            kids[x[0]] += 1
            leaves[x[0]] += leaves[x]
            saved[x[0]] += saved[x]
    return sorted((members[x][0], deep[x], members[x[0]][0] if x else None, len(members[x]), kids[x], leaves[x], saved[x], sha(",".join(map(str, ends[x])))) for x in members)


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def found_trie(df) -> list[tuple]:
    return sorted(tuple(r[c] for c in COLUMNS) for r in trie.trie(df).collect())


def test_trie_of_edges(spark, edges):
    """Conversations of hundreds of turns that part from each other late, copies, and a trie of chains on chains."""
    rng = random.Random(11)
    rows = [r for r in edges if r[0] != 21]
    rows += [(c, t, "user", f"same {t}" if t < 300 - 40 * (c % 5) else f"own {c} {t}") for c in range(100, 112) for t in range(180 + 20 * (c % 4))]
    rows += [(c, t, "user", "x") for c in range(200, 230) for t in range(rng.randrange(14))] + [(c, t, "user", "y" if t == c - 300 else "x") for c in range(300, 314) for t in range(14)]
    rows += [(400 + k, t, "user", "copy") for k in range(20) for t in range(9)]
    df = spark.createDataFrame(rows, SCHEMA).select("*", F.lit("clash").alias("TEXT"), F.lit(1).alias("depth"), F.lit(2).alias("part"), F.lit(3).alias("row"), F.lit(4).alias("a")).repartition(3)
    assert found_trie(df) == expected_trie(rows)


def test_trie_of_few_conversations_and_of_none(spark):
    assert found_trie(spark.createDataFrame([], SCHEMA)) == []
    for rows in ([(1, 0, "user", "x")], [(3, 0, None, None), (3, 0, None, None), (None, 0, "user", "gone")], [(-4, 0, "user", "a"), (-5, 0, "user", "b"), (-5, 1, "user", "a")]):
        assert found_trie(spark.createDataFrame(rows, SCHEMA)) == expected_trie(rows)


def test_one_conversation_with_most_rows_is_counted_in_parts(spark):
    rows = [(10, t % 700, "user", str(t % 50)) for t in range(5000)] + [(c, t, "user", str(t)) for c in range(20) for t in range(3) if c != 10]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert [(r["conv_id"], r["pos"], r["digest"]) for r in trie.in_order(df).orderBy("conv_id", "pos").collect()] == [(c, k + 1, digest(*x)) for c, xs in sorted(ordered(rows).items()) for k, x in enumerate(xs)]


def test_totals_rise_over_many_rounds(spark):
    """Ten chains, each hanging on the one before."""
    chains = [(k, k - 1 if k else None, k, 1, int(k == 39), int(k < 39)) for k in range(40)]
    df = spark.createDataFrame(chains, "conv_id long, parent long, at long, saved long, leaves long, missing long")
    assert {(r["conv_id"], r["saved"], r["leaves"]) for r in trie.totals(df.filter("conv_id >= 30").withColumn("parent", F.when(F.col("conv_id") > 30, F.col("parent")))).collect()} == {(k, 40 - k, 1) for k in range(30, 40)}
