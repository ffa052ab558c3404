"""Queries over logs, transcripts, debates and sessions, made from `events` and `conversations`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.functions import text as t
from groundwork.operators import logs, referee
from groundwork.plans.common import normalize, table

#: A cost line for each event, alike in both engines.
COST = """concat(CASE event_id % 4 WHEN 0 THEN '> ' ELSE 'note. ' END, 'Tokens: ', CASE event_id % 3 WHEN 0 THEN concat(event_id % 90, '.5k') WHEN 1 THEN concat('1,', lpad(cast(event_id % 1000 as varchar), 3, '0')) ELSE cast(event_id % 700 as varchar) END, ' sent, ',
 event_id % 500, ' received', CASE WHEN event_id % 5 = 0 THEN '' ELSE concat('. Cost: $', event_id % 7, '.', lpad(cast(event_id % 100 as varchar), 2, '0'), ' message, $1,000.50 session.') END)"""


def cost_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("log"), F.expr(COST.replace("as varchar", "as string")).alias("text"))


ENTRIES = rf"""l AS (SELECT user_id % 50 AS log, {COST} AS x FROM events), e AS (SELECT log, regexp_extract(x, '{logs.COST}', 1) AS s, regexp_extract(x, '{logs.COST}', 2) AS r, regexp_extract(x, '{logs.COST}', 3) AS m, regexp_extract(x, '{logs.COST}', 4) AS z FROM l WHERE regexp_matches(x, '{logs.COST}')),
entries AS (SELECT log, CASE WHEN ends_with(lower(s), 'k') THEN (replace(left(s, -1), ',', '')::DOUBLE * 1000)::BIGINT ELSE trunc(replace(s, ',', '')::DOUBLE)::BIGINT END AS sent, replace(r, ',', '')::BIGINT AS received,
 coalesce(try_cast(nullif(replace(m, ',', ''), '') AS DOUBLE), 0) AS message, coalesce(try_cast(nullif(replace(z, ',', ''), '') AS DOUBLE), 0) AS session FROM e)"""


def cost_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.cost_entries(cost_logs(spark, sf_dir)).groupBy("log", "sent", "received", "message", "session").agg(F.count("*").alias("n"))


COST_ENTRIES = f"WITH {ENTRIES} SELECT log, sent, received, message, session, count(*) AS n FROM entries GROUP BY ALL"


def cost_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.cost_totals(logs.cost_entries(cost_logs(spark, sf_dir)))


COST_TOTALS = f"WITH {ENTRIES} SELECT log, count(*) AS entries, sum(sent)::BIGINT AS sent, sum(received)::BIGINT AS received, round(sum(message), 4) AS cost FROM entries GROUP BY log"


def cost_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    sent, cost = e * e % 40_000_003, F.when(e % 9 == 0, 0.0).when(e % 9 == 1, (e % 90) / 10_000.0).otherwise((e % 10_000) / 100.0)
    return table(spark, sf_dir, "events").select("event_id", logs.cost_line(sent, e % 3000, cost, F.lit(1.25)).alias("line"))


_TOK = """CASE WHEN {0} >= 10000000 THEN printf('%.0fM', {0} / 1e6) WHEN {0} >= 1000000 THEN replace(printf('%.1fM', {0} / 1e6), '.0M', 'M') WHEN {0} >= 10000 THEN printf('%.0fk', {0} / 1e3) WHEN {0} >= 1000 THEN replace(printf('%.1fk', {0} / 1e3), '.0k', 'k') ELSE ({0})::VARCHAR END"""
COST_FORMAT = f"""WITH x AS (SELECT event_id, event_id * event_id % 40000003 AS s, event_id % 3000 AS r, CASE event_id % 9 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN (event_id % 90) / 10000.0::DOUBLE ELSE (event_id % 10000) / 100.0::DOUBLE END AS c FROM events)
SELECT event_id, concat('Tokens: ', {_TOK.format("s")}, ' sent, ', {_TOK.format("r")}, ' received. Cost: $', CASE WHEN c <= 0 THEN '0.00' WHEN c < 0.01 THEN printf('%.4f', c) ELSE printf('%.2f', c) END, ' message, $1.25 session.') AS line FROM x"""


def session_running_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "events").select("user_id", "event_id", F.round("value", 2).alias("cost"))
    return logs.running_cost(x, "user_id", "event_id", "cost")


SESSION_RUNNING_COST = "SELECT user_id, event_id, round(value, 2) AS cost, round(sum(round(value, 2)) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS session_cost FROM events"

#: A chat log of each conversation: lines by k, alike in both engines.
CHAT = """CASE k WHEN 0 THEN '' WHEN 1 THEN CASE turn % 5 WHEN 0 THEN '#### /add file.py' WHEN 1 THEN '#### /ask do this' ELSE concat('#### request ', turn) END
 WHEN 2 THEN CASE turn % 3 WHEN 0 THEN '####   and more' ELSE concat('plan ', turn, ' ', role) END WHEN 3 THEN CASE turn % 4 WHEN 1 THEN '<think>' WHEN 2 THEN '► **ANSWER**' ELSE '> Added file.py' END
 WHEN 4 THEN CASE turn % 4 WHEN 1 THEN 'hidden' ELSE concat('step ', conv_id) END WHEN 5 THEN CASE turn % 4 WHEN 1 THEN '</think>' ELSE '' END ELSE CASE WHEN turn % 3 <> 2 THEN concat('> Tokens: ', turn, '.1k sent, 20 received.') ELSE 'last words' END END"""


def chat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "conversations").crossJoin(spark.range(7).toDF("k"))
    return x.select(F.col("conv_id").alias("chat"), (F.col("turn") * 7 + F.col("k")).alias("idx"), F.expr(CHAT).alias("line"))


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
TURNS = rf"""c AS (SELECT conv_id AS chat, turn * 7 + k AS idx, {CHAT} AS line FROM conversations, range(7) r(k)),
e AS (SELECT *, regexp_matches(line, '{logs.TURN_END}') AS ends FROM c),
s AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY chat ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg, sum(ends::INT) OVER (PARTITION BY chat) AS n FROM e),
b AS (SELECT *, max((trim(line) <> '')::INT) OVER (PARTITION BY chat, seg ORDER BY idx) AS filled FROM s WHERE seg < n AND NOT ends),
u AS (SELECT *, min(starts_with(line, '####')::INT) OVER (PARTITION BY chat, seg ORDER BY idx) = 1 AS mine, regexp_replace(line, '^####\s*', '') AS said FROM b WHERE filled = 1),
g AS (SELECT chat, seg, {_STRIP.format("coalesce(string_agg(regexp_replace(said, '^/ask\\s*', ''), chr(10) ORDER BY idx) FILTER (mine AND NOT regexp_matches(trim(said), '" + logs.COMMAND + "')), '')")} AS directive,
 coalesce(string_agg(line, chr(10) ORDER BY idx) FILTER (NOT mine), '') AS p FROM u GROUP BY chat, seg),
h AS (SELECT chat, seg, directive, {_STRIP.format("regexp_replace(regexp_replace(p, '(?s)<think>.*?</think>', '', 'g'), '►\\s*\\*{0,2}ANSWER\\*{0,2}', '', 'g')")} AS p FROM g),
f AS (SELECT chat, seg, directive, {_STRIP.format("array_to_string(list_filter(string_split(p, chr(10)), lambda x: NOT regexp_matches(x, '" + logs.ARTIFACT + "')), chr(10))")} AS plan FROM h),
turns AS (SELECT chat, row_number() OVER (PARTITION BY chat ORDER BY seg) AS turn, directive, plan FROM f WHERE plan <> '')"""


def transcript_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.transcript_turns(chat_lines(spark, sf_dir))


TRANSCRIPT_TURNS = f"WITH {TURNS} SELECT * FROM turns"


def last_n_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last two turns of each chat, rendered."""
    return logs.render_turns(transcript_turns(spark, sf_dir), 2)


LAST_N_TURNS = f"""WITH {TURNS}, r AS (SELECT *, row_number() OVER (PARTITION BY chat ORDER BY turn DESC) AS d FROM turns), x AS (SELECT *, count(*) OVER (PARTITION BY chat) AS n, row_number() OVER (PARTITION BY chat ORDER BY turn) AS i FROM r WHERE d <= 2)
SELECT chat, string_agg(CASE WHEN n = 1 THEN concat(CASE WHEN directive <> '' THEN concat('# Directive', chr(10), directive, chr(10), chr(10)) ELSE '' END, '# Specification & Implementation Plan', chr(10), plan, chr(10))
 ELSE concat('## ', CASE WHEN i = n THEN 'Active Directive' ELSE concat('Prior Context Turn ', i) END, chr(10), '### User Request:', chr(10), directive, chr(10), chr(10), '### Architect Specification:', chr(10), plan, chr(10)) END, chr(10) ORDER BY i) AS text FROM x GROUP BY chat"""


def captured_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's log without chrome, and a debate turn's part after the ANSWER marker, colours stripped."""
    x = table(spark, sf_dir, "conversations")
    noise = F.concat(F.lit("Editor v1\n  Tokens: 5\n\x1b[31m"), "text", F.lit("\x1b[0m\n► **ANSWER** final "), F.col("turn").cast("string"), F.lit("\nCommit abc"))
    return x.select("conv_id", "turn", logs.without_chrome(t.strip_colours(noise)).alias("kept"), t.after_answer(noise).alias("answer"))


CAPTURED_OUTPUT = r"""SELECT conv_id, turn, trim(text) AS kept, concat('final ', turn, chr(10), 'Commit abc') AS answer FROM conversations"""


def stderr_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("log"), F.col("event_id").alias("idx"), F.expr("CASE event_id % 3 WHEN 0 THEN concat('retrieved ', event_id, ' chunks') WHEN 1 THEN concat('Tokens: ', event_id) ELSE event_type END").alias("line"))
    return logs.last_notes(x)


STDERR_NOTES = """SELECT user_id % 50 AS log, concat('retrieved ', max(event_id) FILTER (event_id % 3 = 0), ' chunks') AS chunk_line, concat('Tokens: ', max(event_id) FILTER (event_id % 3 = 1)) AS cost_line FROM events GROUP BY 1"""


def plan_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log blocks between start and end markers."""
    x = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("log"), F.col("event_id").alias("idx"), F.expr("CASE event_type WHEN 'view' THEN 'START' WHEN 'purchase' THEN 'SUCCESS' ELSE concat(event_type, ' ', event_id) END").alias("line"))
    return logs.blocks(x, "^START", "^(SUCCESS|FAILURE|ANSWER)")


PLAN_BLOCKS = """WITH x AS (SELECT user_id % 50 AS log, event_id AS idx, CASE event_type WHEN 'view' THEN 'START' WHEN 'purchase' THEN 'SUCCESS' ELSE concat(event_type, ' ', event_id) END AS line FROM events),
b AS (SELECT *, sum((line = 'START')::INT) OVER (PARTITION BY log ORDER BY idx) AS block FROM x), e AS (SELECT *, max((line = 'SUCCESS')::INT) OVER (PARTITION BY log, block ORDER BY idx) AS closed FROM b)
SELECT log, block::BIGINT AS block, string_agg(line, chr(10) ORDER BY idx) AS text FROM e WHERE block > 0 AND closed = 0 AND line <> 'START' GROUP BY ALL"""


def session_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.sessions(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), "text", F.col("turn").alias("at")))


SESSION_INVENTORY = "SELECT conv_id AS session, count(*) AS turns, sum(length(text))::BIGINT AS size, max(turn) AS last_at FROM conversations GROUP BY 1"


def newest_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest session of each user: that of the last event."""
    x = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("session"), "ts")
    return logs.last_turns(x, 1, "user_id", "ts").select("user_id", "ts")


NEWEST_SESSIONS = "SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id"


def slot_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of each endpoint from its JSON reply; unreadable replies give NULL."""
    x = table(spark, sf_dir, "events").filter("event_id is not null").select(F.col("event_id").alias("endpoint"), F.expr("CASE event_id % 4 WHEN 0 THEN '[]' WHEN 1 THEN '[{\"is_processing\": true}, {\"state\": 1}, {\"state\": 0}]' WHEN 2 THEN 'oops' ELSE '[{\"is_processing\": false, \"state\": 1}]' END").alias("json"))
    return logs.slots(x)


SLOT_USAGE = "SELECT event_id AS endpoint, CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 3 THEN 1 END::BIGINT AS slots, CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 3 THEN 1 END::BIGINT AS active FROM events"


def loop_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("log"), F.col("event_id").alias("idx"), F.expr("CASE WHEN user_id % 10 < 5 THEN event_type ELSE cast(event_id as string) END").alias("line"))
    return logs.repeating(x)


LOOP_WATCH = """WITH x AS (SELECT user_id % 10 AS log, event_id, CASE WHEN user_id % 10 < 5 THEN event_type ELSE event_id::VARCHAR END AS line FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY log ORDER BY event_id DESC) AS r FROM x)
SELECT log, count(*) AS n, count(DISTINCT line) AS "distinct", count(*) >= 100 AND count(*) - count(DISTINCT line) >= count(*) * 0.75 AS loops FROM r WHERE r <= 400 GROUP BY log"""

#: A debate from each conversation: user turns propose, assistant turns judge.
ROLE = "CASE role WHEN 'user' THEN 'architect' WHEN 'assistant' THEN 'oracle' ELSE 'system' END"
TURN = """CASE WHEN role = 'user' THEN CASE WHEN (conv_id + turn) % 5 = 0 THEN text ELSE concat('intro\n  proposal: use plan ', (conv_id + turn // 4) % 3, '\nPROPOSAL: and more') END
 WHEN role = 'assistant' THEN CASE (conv_id + turn) % 4 WHEN 0 THEN concat(text, '\nVerdict: AGREE') WHEN 1 THEN 'VERDICT: OBJECT\nVERDICT: AGREE' WHEN 2 THEN '  verdict: object' ELSE 'no verdict' END ELSE text END"""


def debate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("issue"), "turn", F.expr(ROLE).alias("role"), F.expr(TURN.replace("turn // 4", "turn div 4")).alias("text"))


def _duck_turn() -> str:
    """TURN with its line breaks written as chr(10)."""
    out = TURN.replace("\n WHEN", " WHEN")
    return out.replace("\n", "', chr(10), '").replace("'VERDICT: OBJECT', chr(10), 'VERDICT: AGREE'", "concat('VERDICT: OBJECT', chr(10), 'VERDICT: AGREE')")


DEBATE = f"""d AS (SELECT conv_id AS issue, turn, {ROLE} AS role, {_duck_turn()} AS text FROM conversations),
p AS (SELECT *, regexp_extract_all(text, '(?im)^\\s*PROPOSAL:\\s*(.+)$', 1) AS ps FROM d),
facts AS (SELECT issue, turn, role, text, CASE WHEN len(ps) > 0 THEN trim(ps[-1]) ELSE '' END AS proposal,
 CASE WHEN role = 'architect' THEN substr(sha1({normalize("CASE WHEN len(ps) > 0 THEN array_to_string(ps, ' ') ELSE text END")}), 1, 12) END AS proposal_hash,
 CASE WHEN role = 'oracle' THEN nullif(lower(regexp_extract(text, '(?im)^\\s*VERDICT:\\s*(AGREE|OBJECT)\\b', 1)), '') END AS verdict FROM p)"""


def debate_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = referee.turn_facts(debate(spark, sf_dir))
    return f.select("issue", "turn", "role", t.proposal_line(F.col("text")).alias("proposal"), "proposal_hash", "verdict", F.length("excerpt").cast("long").alias("excerpt_chars"))


DEBATE_FACTS = f"WITH {DEBATE} SELECT issue, turn, role, proposal, proposal_hash, verdict, length(substr(coalesce(nullif(proposal, ''), text), 1, 280)) AS excerpt_chars FROM facts"

_STATE = """lo AS (SELECT issue, arg_max(coalesce(verdict, '-'), turn) FILTER (role = 'oracle') AS last, count(*) AS n FROM facts GROUP BY issue),
la AS (SELECT issue, turn, coalesce(lag(proposal_hash) OVER (PARTITION BY issue ORDER BY turn) = proposal_hash, false) AS same FROM facts WHERE role = 'architect'),
ls AS (SELECT issue, arg_max(same, turn) AS stable FROM la GROUP BY issue),
st AS (SELECT lo.issue, n, CASE WHEN last = 'agree' THEN 'agreed' WHEN last = 'object' AND coalesce(stable, false) THEN 'deadlock' ELSE 'continue' END AS state FROM lo LEFT JOIN ls USING (issue))"""


def consensus_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = referee.consensus(referee.turn_facts(debate(spark, sf_dir)))
    return c.select("issue", "state", "n", referee.outcome(F.col("state"), F.col("n"), 6, F.col("issue") % 10 == 0).alias("outcome"))


CONSENSUS_STATE = f"WITH {DEBATE}, {_STATE} SELECT issue, state, n, CASE WHEN issue % 10 = 0 THEN 'clean' WHEN state = 'continue' AND n >= 6 THEN 'exhausted' ELSE state END AS outcome FROM st"


def debate_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds of a chain of debates that still run after those before."""
    x = debate(spark, sf_dir).select("issue", F.col("turn").alias("round"), F.when((F.col("issue") + F.col("turn")) % 6 == 5, "agreed").when(F.col("turn") % 4 == 3, "clean").otherwise("deadlock").alias("state"))
    return referee.chain(x)


DEBATE_ROUNDS = """WITH x AS (SELECT conv_id AS issue, turn AS round, CASE WHEN (conv_id + turn) % 6 = 5 THEN 'agreed' WHEN turn % 4 = 3 THEN 'clean' ELSE 'deadlock' END AS state FROM conversations)
SELECT *, coalesce(max((state IN ('agreed', 'clean'))::INT) OVER (PARTITION BY issue ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS runs FROM x"""


def verdict_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict files written and read back."""
    x = table(spark, sf_dir, "conversations")
    state = F.when(F.col("turn") % 3 == 0, "agreed").when(F.col("turn") % 3 == 1, "deadlock").otherwise("clean")
    gate, draft = F.col("conv_id") % 2 == 0, F.col("turn") % 5 == 4
    f = referee.verdict_file(state, gate, F.concat(F.lit(" "), "text"), draft, F.when(F.col("turn") % 2 == 0, F.lit(" ok ")))
    r = referee.read_verdict(f)
    return x.select("conv_id", "turn", f.alias("file"), referee.actionable(state, gate, draft).alias("written_actionable"), r["status"].alias("status"), r["gate"].alias("gate"), r["actionable"].alias("actionable"))


VERDICT_FILES = """WITH x AS (SELECT conv_id, turn, text, CASE turn % 3 WHEN 0 THEN 'agreed' WHEN 1 THEN 'deadlock' ELSE 'clean' END AS state, conv_id % 2 = 0 AS g, turn % 5 = 4 AS draft FROM conversations)
SELECT conv_id, turn, concat('STATUS: ', state, chr(10), 'GATE: ', CASE WHEN g THEN 'present' ELSE 'none' END, chr(10), chr(10), CASE WHEN state = 'clean' THEN concat('> Already grounded; nothing to apply.', chr(10), chr(10)) WHEN NOT ((state = 'agreed' AND g) OR draft) THEN concat('> HELD FOR HUMAN REVIEW.', chr(10), chr(10)) ELSE '' END,
 '# Resolution', chr(10), chr(10), trim(text), chr(10), CASE WHEN turn % 2 = 0 THEN concat(chr(10), '---', chr(10), chr(10), '# Oracle Assessment', chr(10), chr(10), 'ok', chr(10)) ELSE '' END) AS file,
 (state = 'agreed' AND g) OR draft AS written_actionable, state AS status, CASE WHEN g THEN 'present' ELSE 'none' END AS gate, state = 'agreed' AND g AS actionable FROM x"""


def ledger_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledgers from JSON; broken ones become empty."""
    j = F.expr("CASE turn % 4 WHEN 0 THEN '{\"state\": \"agreed\", \"turns\": [{\"turn\": 0, \"role\": \"oracle\"}]}' WHEN 1 THEN '{broken' WHEN 2 THEN '{\"turns\": []}' END")
    x = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).cast("string").alias("issue"), j.alias("json"))
    return referee.ledgers(x)


LEDGER_LOAD = "SELECT (conv_id * 1000 + turn)::VARCHAR AS issue, CASE WHEN turn % 4 = 0 THEN 'agreed' ELSE 'continue' END AS state, CASE WHEN turn % 4 = 0 THEN 1 ELSE 0 END::BIGINT AS n_turns FROM conversations"


def session_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a run goes on with its session (same set of files), and the last result of each gate command."""
    files = F.array(F.concat(F.lit("b"), F.floor(F.col("turn") / 3).cast("string")), F.lit("a"))
    return referee.reusable(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("run"), files.alias("files"))).select("session", "run", "reuse")


SESSION_REUSE = "SELECT conv_id AS session, turn AS run, coalesce(lag(turn // 3) OVER (PARTITION BY conv_id ORDER BY turn) = turn // 3, false) AS reuse FROM conversations"


def gate_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "events").select(F.concat("event_type", F.lit(" "), (F.col("user_id") % 20).cast("string")).alias("command"), F.col("event_id").alias("at"), (F.col("event_id") % 3 == 0).alias("green"))
    return referee.gate_cache(x)


GATE_CACHE = "SELECT concat(event_type, ' ', user_id % 20) AS command, arg_max(event_id % 3 = 0, event_id) AS green, count(*) AS runs FROM events GROUP BY 1"


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts assembled of project files (first turn only), knowledge and question."""
    x = table(spark, sf_dir, "conversations")
    block = lambda name, c: F.concat(F.lit(f"<{name}>\n"), c, F.lit(f"\n</{name}>"))
    p = F.concat_ws("\n\n", F.when(F.col("turn") == 0, block("project_files", F.concat(F.lit("conv "), F.col("conv_id").cast("string")))), F.when(F.col("role") != "system", block("knowledge_base", F.col("role"))), block("question", F.trim("text")))
    return x.select("conv_id", "turn", p.alias("prompt"))


PROMPTS = """SELECT conv_id, turn, concat_ws(chr(10) || chr(10), CASE WHEN turn = 0 THEN concat('<project_files>', chr(10), 'conv ', conv_id, chr(10), '</project_files>') END, CASE WHEN role <> 'system' THEN concat('<knowledge_base>', chr(10), role, chr(10), '</knowledge_base>') END,
 concat('<question>', chr(10), trim(text), chr(10), '</question>')) AS prompt FROM conversations"""

QUERIES = {f.__name__: f for f in (cost_entries, cost_totals, cost_format, session_running_cost, transcript_turns, last_n_turns, captured_output, stderr_notes, plan_blocks, session_inventory, newest_sessions, slot_usage, loop_watch, debate_facts, consensus_state, debate_rounds, verdict_files, ledger_load, session_reuse, gate_cache, prompts)}
ORACLES = {k: globals()[k.upper()] for k in QUERIES if k.upper() in globals()}
