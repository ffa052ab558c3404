"""Cost logs, transcripts, captured output, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.functions import text as t

# The forms of a cost line, of a transcript's turn end and of its commands.
COST = r"(?i)Tokens:\s*([0-9.,]+[kM]?)\s*sent,\s*([0-9.,]+[kM]?)\s*received(?:[.\s]*Cost:\s*\$\s*([0-9.,]+)\s*message,\s*\$\s*([0-9.,]+)(?:\s*session)?)?"
TURN_END = r"^>\s*Tokens:\s*[\d\.]+[kKMG]?\s*sent,\s*[\d\.]+[kKMG]?\s*received.*$"
COMMAND = r"^/(add|run|read|drop|model|clear|exit|undo|diff|load|help)\b"
ARTIFACT = r"^>\s*(Added|Moved|No files|Tokens).*"
CHROME = ["Main model:", "Editor model:", "Weak model:", "Git repo:", "Repo-map:", "Added", "Tokens:", "Cost:", "Warning:", "Scraping", "For more info", "Use /help", "Commit", "Committing", "─", "►", "▸"]


def cost_entries(logs: DataFrame) -> DataFrame:
    """logs (log, text) -> log, sent, received, message, session: every cost line found anywhere; a missing cost is 0."""
    whole = logs.select("log", F.explode(F.regexp_extract_all("text", F.lit(COST), 0)).alias("x"))
    number = lambda i: F.coalesce(F.nullif(F.replace(F.regexp_extract("x", COST, i), F.lit(","), F.lit("")), F.lit("")).try_cast("double"), F.lit(0.0))
    return whole.select("log", t.token_number(F.regexp_extract("x", COST, 1)).alias("sent"), t.token_number(F.regexp_extract("x", COST, 2)).alias("received"), number(3).alias("message"), number(4).alias("session"))


def cost_totals(entries: DataFrame) -> DataFrame:
    """Entries, tokens and message costs of each log; session costs are running sums and not added."""
    return entries.groupBy("log").agg(F.count("*").alias("entries"), F.sum("sent").alias("sent"), F.sum("received").alias("received"), F.round(F.sum("message"), 4).alias("cost"))


def cost_line(sent: Column, received: Column, message: Column, session: Column) -> Column:
    parts = (F.lit("Tokens: "), t.token_text(sent), F.lit(" sent, "), t.token_text(received), F.lit(" received. Cost: $"), t.cost_text(message), F.lit(" message, $"), t.cost_text(session), F.lit(" session."))
    return F.concat(*parts)


def running_cost(usage: DataFrame, by: str, order: str, cost: str) -> DataFrame:
    """The session's cost after each message."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return usage.withColumn("session_cost", F.round(F.sum(cost).over(w), 6))


def transcript_turns(lines: DataFrame) -> DataFrame:
    """lines (chat, idx, line) -> chat, turn (from 1), directive, plan: what stands between turn ends; the rest after the last is dropped.

    Leading #### lines are the user's, without commands; the assistant's part loses its reasoning,
    its ANSWER marker and tool notes. Turns without a plan are dropped and not numbered.
    """
    w = Window.partitionBy("chat").orderBy("idx")
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    x = lines.withColumn("end", F.col("line").rlike(TURN_END))
    x = x.withColumn("turn", F.coalesce(F.sum(F.col("end").cast("int")).over(upto), F.lit(0)))
    x = x.withColumn("ends", F.sum(F.col("end").cast("int")).over(Window.partitionBy("chat"))).filter("turn < ends and not end")
    in_turn = Window.partitionBy("chat", "turn").orderBy("idx")
    filled = F.max((F.trim("line") != "").cast("int")).over(in_turn.rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("filled", filled).filter("filled = 1")  # blank lines before the turn do not count
    user = F.min(F.col("line").startswith("####").cast("int")).over(in_turn.rowsBetween(Window.unboundedPreceding, 0)) == 1
    x = x.withColumn("user", user).withColumn("said", F.regexp_replace("line", r"^####\s*", ""))
    mine = F.when(F.col("user") & ~F.trim("said").rlike(COMMAND), F.struct("idx", F.regexp_replace("said", r"^/ask\s*", "").alias("s")))
    theirs = F.when(~F.col("user"), F.struct("idx", F.col("line").alias("s")))
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda s: s["s"]), "\n")
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    y = x.groupBy("chat", "turn").agg(strip(text(mine)).alias("directive"), strip(text(theirs)).alias("plan"))
    plan = strip(t.strip_reasoning(F.col("plan")))
    plan = strip(F.array_join(F.filter(t.lines(plan), lambda s: ~s.rlike(ARTIFACT)), "\n"))
    y = y.withColumn("plan", plan).filter("plan <> ''")
    return y.select("chat", F.row_number().over(Window.partitionBy("chat").orderBy("turn")).cast("long").alias("turn"), "directive", "plan")


def last_turns(turns: DataFrame, n: int = 1, by: str = "chat", order: str = "turn") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))
    return turns.withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r")


def render_turns(turns: DataFrame, n: int = 1) -> DataFrame:
    """chat -> text: one turn as directive and plan, more as prior and active sections."""
    last = last_turns(turns, n)
    w = Window.partitionBy("chat")
    x = last.withColumn("count", F.count("*").over(w)).withColumn("i", F.row_number().over(w.orderBy("turn")))
    header = F.when(F.col("directive") != "", F.concat(F.lit("# Directive\n"), F.col("directive"), F.lit("\n\n"))).otherwise("")
    one = F.concat(header, F.lit("# Specification & Implementation Plan\n"), "plan", F.lit("\n"))
    name = F.when(F.col("i") == F.col("count"), "Active Directive").otherwise(F.concat(F.lit("Prior Context Turn "), F.col("i").cast("string")))
    many = F.concat(F.lit("## "), name, F.lit("\n### User Request:\n"), "directive", F.lit("\n\n### Architect Specification:\n"), "plan", F.lit("\n"))
    x = x.withColumn("part", F.when(F.col("count") == 1, one).otherwise(many))
    return x.groupBy("chat").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "part"))), lambda s: s["part"]), "\n").alias("text"))


def without_chrome(text: Column, banner: str = "Editor v") -> Column:
    """Captured output without the lines that an editor's banner and footer print."""
    noise = lambda l: F.exists(F.array(*map(F.lit, [banner, *CHROME])), lambda p: F.ltrim(l).startswith(p))
    return F.trim(F.array_join(F.filter(t.lines(text), lambda l: ~noise(l)), "\n"))


def last_notes(lines: DataFrame) -> DataFrame:
    """lines (log, idx, line) -> the last line that tells a number of chunks, and the last cost line."""
    x = lines.withColumn("l", t.strip_colours(F.col("line")))
    pick = lambda cond: F.max_by(F.when(cond, F.col("l")), F.when(cond, F.col("idx")))
    return x.groupBy("log").agg(pick(F.col("l").rlike(r"\d+ chunks")).alias("chunk_line"), pick(F.col("l").contains("Tokens:")).alias("cost_line"))


def blocks(lines: DataFrame, begin: str, end: str) -> DataFrame:
    """lines (log, idx, line) -> log, block, text: what stands between lines that match begin and end."""
    w = Window.partitionBy("log").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    x = lines.withColumn("b", F.col("line").rlike(begin)).withColumn("e", F.col("line").rlike(end))
    x = x.withColumn("block", F.sum(F.col("b").cast("int")).over(w))
    x = x.withColumn("open", F.col("block") > 0)
    inner = Window.partitionBy("log", "block").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("closed", F.max(F.col("e").cast("int")).over(inner) == 1).filter("open and not closed and not b")
    return x.groupBy("log", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "line"))), lambda s: s["line"]), "\n").alias("text"))


def sessions(turns: DataFrame) -> DataFrame:
    """turns (session, text, at) -> number, size and last time of each session."""
    return turns.groupBy("session").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("size"), F.max("at").alias("last_at"))


def slots(replies: DataFrame) -> DataFrame:
    """replies (endpoint, json) of a server's slots -> how many there are and how many work."""
    s = F.from_json("json", "array<struct<is_processing:boolean, state:int>>")
    x = replies.select("endpoint", s.alias("s"))
    busy = F.filter("s", lambda v: F.coalesce(v["is_processing"], F.lit(False)) | F.coalesce(v["state"] == 1, F.lit(False)))
    return x.select("endpoint", F.when(F.col("s").isNotNull(), F.size("s").cast("long")).alias("slots"), F.when(F.col("s").isNotNull(), F.size(busy).cast("long")).alias("active"))


def repeating(lines: DataFrame, last: int = 400, least: int = 100, share: float = 0.75) -> DataFrame:
    """lines (log, idx, line): whether the last lines of a log repeat themselves."""
    rank = F.row_number().over(Window.partitionBy("log").orderBy(F.desc("idx")))
    x = lines.withColumn("r", rank).filter((F.col("r") <= last) & (F.trim("line") != ""))
    y = x.groupBy("log").agg(F.count("*").alias("n"), F.count_distinct("line").alias("distinct"))
    return y.withColumn("loops", (F.col("n") >= least) & (F.col("n") - F.col("distinct") >= F.col("n") * share))
