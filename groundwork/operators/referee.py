"""The debate referee: states, ledgers and verdict files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.functions import text as t


def turn_facts(turns: DataFrame) -> DataFrame:
    """turns (issue, turn, role, text) -> with excerpt, proposal, proposal_hash (architect) and verdict (oracle)."""
    architect, oracle = F.col("role") == "architect", F.col("role") == "oracle"
    return turns.withColumns({
        "excerpt": t.excerpt(F.coalesce(F.nullif(t.proposal_line(F.col("text")), F.lit("")), F.col("text"))),
        "proposal_hash": F.when(architect, t.proposal_hash(F.col("text"))),
        "verdict": F.when(oracle, t.verdict(F.col("text"))),
    })


def consensus(facts: DataFrame) -> DataFrame:
    """issue, state: agreed by the last verdict; deadlock if it objects and the last two proposals are one; else continue."""
    architect, oracle = F.col("role") == "architect", F.col("role") == "oracle"
    before = F.lag("proposal_hash").over(Window.partitionBy("issue", "role").orderBy("turn"))
    x = facts.withColumn("same", F.when(architect, F.coalesce(before == F.col("proposal_hash"), F.lit(False))))
    y = x.groupBy("issue").agg(F.max_by(F.when(oracle, F.struct("verdict")), F.when(oracle, F.col("turn"))).alias("last"), F.max_by("same", F.when(architect, F.col("turn"))).alias("stable"), F.count("*").alias("n"))
    state = F.when(F.col("last.verdict") == "agree", "agreed").when((F.col("last.verdict") == "object") & F.coalesce("stable", F.lit(False)), "deadlock").otherwise("continue")
    return y.select("issue", state.alias("state"), "n")


def outcome(state: Column, rounds: Column, cap: int, gate_green: Column) -> Column:
    """What a debate ends with: clean if the gate was green before, exhausted at the cap."""
    return F.when(gate_green, "clean").when((state == "continue") & (rounds >= cap), "exhausted").otherwise(state)


def chain(rounds: DataFrame) -> DataFrame:
    """rounds (issue, round, state) -> the rounds that run: none after one that agreed or was clean."""
    w = Window.partitionBy("issue").orderBy("round").rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.max(F.col("state").isin("agreed", "clean").cast("int")).over(w), F.lit(0))
    return rounds.withColumn("runs", done == 0)


def actionable(state: Column, gate: Column, draft: Column) -> Column:
    return ((state == "agreed") & gate) | draft


def verdict_file(state: Column, gate: Column, proposal: Column, draft: Column, oracle: Column) -> Column:
    """The text of a verdict file: two header lines, a note where it is due, the resolution, the oracle's last reply."""
    note = F.when(state == "clean", "> Already grounded; nothing to apply.\n\n").when(~actionable(state, gate, draft), "> HELD FOR HUMAN REVIEW.\n\n").otherwise("")
    reply = F.when(F.coalesce(oracle, F.lit("")) != "", F.concat(F.lit("\n---\n\n# Oracle Assessment\n\n"), F.trim(oracle), F.lit("\n"))).otherwise("")
    return F.concat(F.lit("STATUS: "), state, F.lit("\nGATE: "), F.when(gate, "present").otherwise("none"), F.lit("\n\n"), note, F.lit("# Resolution\n\n"), F.trim(F.coalesce(proposal, F.lit(""))), F.lit("\n"), reply)


def read_verdict(text: Column) -> Column:
    status, gate = t.header_field(text, "STATUS"), t.header_field(text, "GATE")
    return F.struct(status.alias("status"), gate.alias("gate"), ((F.coalesce(status, F.lit("")) == "agreed") & (F.coalesce(gate, F.lit("")) == "present")).alias("actionable"))


def ledgers(rows: DataFrame) -> DataFrame:
    """rows (issue, json) -> issue, state, n_turns: ledgers that cannot be read are empty ones."""
    ledger = F.from_json("json", "struct<issue:string, state:string, turns:array<struct<turn:int, role:string, verdict:string>>>")
    x = rows.withColumn("l", ledger)
    return x.select("issue", F.coalesce("l.state", F.lit("continue")).alias("state"), F.when(F.col("l.turns").isNull(), 0).otherwise(F.size("l.turns")).cast("long").alias("n_turns"))


def reusable(runs: DataFrame) -> DataFrame:
    """runs (session, run, files array): whether a run may go on with the session before it: its sorted files hash alike."""
    h = F.sha2(F.array_join(F.sort_array("files"), ","), 256)
    before = F.lag("h").over(Window.partitionBy("session").orderBy("run"))
    return runs.withColumn("h", h).withColumn("reuse", F.coalesce(before == F.col("h"), F.lit(False)))


def gate_cache(runs: DataFrame) -> DataFrame:
    """runs (command, at, green) -> the last result of each command."""
    return runs.groupBy("command").agg(F.max_by("green", "at").alias("green"), F.count("*").alias("runs"))
