"""Task planning: phases to task rows, dependency order, switches; and its queries."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundwork.functions import text as t
from groundwork.plans.common import table


def align_tests(phases: DataFrame, convention: str = "tests/test_{stem}.py") -> DataFrame:
    """phases (phase, targets array, tests array) -> phase, pos, target, test: one test file serves all, more go by place, none by the convention."""
    x = phases.select("phase", "tests", F.posexplode("targets").alias("pos", "target"))
    stem = F.regexp_replace(F.element_at(F.split("target", "/"), -1), r"(?<=[^.])\.[^.]*$", "")
    made = F.replace(F.lit(convention), F.lit("{stem}"), stem)
    given = F.when(F.size("tests") == 1, F.get("tests", F.lit(0))).otherwise(F.get("tests", F.col("pos")))
    return x.select("phase", F.col("pos").cast("long").alias("pos"), "target", F.coalesce(given, made).alias("test"))


def skips(flags: list[Column]) -> Column:
    """A phase with nothing switched on is skipped."""
    off = ~F.coalesce(flags[0], F.lit(False))
    for f in flags[1:]:
        off = off & ~F.coalesce(f, F.lit(False))
    return off


def code_mode(any_job: Column, has_oracle: Column, start_job: Column, iterate: Column, post_validate: Column, resolve: Column) -> Column:
    grounding = (has_oracle & start_job) | post_validate | resolve
    return any_job | (has_oracle & ~start_job) | (iterate & ~grounding)


def debate_switches(enabled: Column, raw: Column) -> Column:
    """insert_debate as three booleans: off; first only if unset; a text of numbers padded with false."""
    clean = F.filter(F.transform(F.split(F.replace(F.regexp_replace(raw, "[^0-9, ]", ""), F.lit(" "), F.lit(",")), ","), lambda p: F.trim(p)), lambda p: p != "")
    at = lambda i: F.coalesce(F.get(clean, F.lit(i)).try_cast("long") != 0, F.lit(False))
    return F.when(~F.coalesce(enabled, F.lit(False)), F.array(*[F.lit(False)] * 3)).when(raw.isNull(), F.array(F.lit(True), F.lit(False), F.lit(False))).otherwise(F.array(at(0), at(1), at(2)))


def pick(options: Column, place: Column, default: Column) -> Column:
    """The option at a place (from 0), else the first, else the default; blanks count as missing."""
    own = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(own(F.get(options, place)), own(F.get(options, F.lit(0))), default)


def collection_path(value: Column, root: Column) -> Column:
    """name, db: a collection given as a path names its last part and its own database."""
    path = F.regexp_replace(value, "/+$", "")
    return F.when(value.contains("/"), F.struct(F.element_at(F.split(path, "/"), -1).alias("name"), F.concat(path, F.lit("/db")).alias("db"))).otherwise(F.struct(value.alias("name"), F.concat(root, F.lit("/"), value, F.lit("/db")).alias("db")))


def fill_section(template: Column, heading: str, body: Column) -> Column:
    """The template with the section under `heading` replaced up to the next rule, `## 2.` or the end; appended if it has none."""
    injected = F.concat(F.lit(heading + "\n\n"), F.trim(body), F.lit("\n"))
    safe = F.regexp_replace(F.concat(injected, F.lit("\n")), r"([\\$])", r"\\$1")
    quoted = "\\Q" + heading + "\\E"
    return F.when(template.contains(heading), F.regexp_replace(template, F.lit(rf"(?s){quoted}.*?(?=\n---|\n## 2\.|\z)"), safe)).otherwise(F.concat(template, F.lit("\n\n"), injected))


def resolve_template(wanted: DataFrame, existing: DataFrame, own: str = ".groundwork/") -> DataFrame:
    """wanted (id, path) -> id, found: in the project, its tool folder, flat there, in the package, flat there; else the plain path.

    existing (place: project or package, path) is the listing; places are tried in this order.
    """
    rel = F.when(F.col("path").startswith(own), F.substring("path", len(own) + 1, 10_000)).otherwise(F.col("path"))
    flat = F.element_at(F.split("path", "/"), -1)
    options = [("project", F.col("path")), ("project", F.concat(F.lit(own), rel)), ("project", F.concat(F.lit(own), flat)), ("package", rel), ("package", flat)]
    tried = wanted.select("id", F.col("path").alias("asked"), F.posexplode(F.array(*[F.struct(F.lit(p).alias("place"), c.alias("path")) for p, c in options])).alias("rank", "o"))
    hit = tried.select("id", "asked", "rank", "o.place", "o.path").join(existing.distinct(), ["place", "path"])
    best = hit.groupBy("id").agg(F.min_by(F.concat("place", F.lit(":"), "path"), "rank").alias("found"))
    plain = F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat(F.lit("project:"), F.col("path")))
    return wanted.join(best, "id", "left").select("id", F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.coalesce("found", plain)).alias("found"))


def settings(phases: DataFrame, defaults: DataFrame) -> DataFrame:
    """phases (phase, key, value) over defaults (key, value): every key of every phase, the phase's value first."""
    names = phases.select("phase").distinct()
    keys = phases.select("key").union(defaults.select("key")).distinct()
    every = names.crossJoin(keys)
    own, base = phases.groupBy("phase", "key").agg(F.max("value").alias("own")), defaults.select("key", F.col("value").alias("base"))
    return every.join(own, ["phase", "key"], "left").join(base, "key", "left").select("phase", "key", F.coalesce("own", "base").alias("value"))


def tasks(phases: DataFrame, rounds: int = 2) -> DataFrame:
    """phases (phase, target, ord, code boolean, ingest boolean) -> task rows: id, seq, kind, depends_on, ingest.

    Code: job1 job2 job3 verify; review: oracle autofix heal; then debate and apply for each round;
    review ends with finalize. Each node depends on the one before it for its target; a phase's
    ingestion hangs on its first node alone.
    """
    debate = [x for r in range(1, rounds + 1) for x in (f"debate{r}", f"apply{r}")]
    names = lambda xs: F.array(*map(F.lit, xs))
    kinds = F.when(F.col("code"), names(["job1", "job2", "job3", "verify", *debate])).otherwise(names(["oracle", "autofix", "heal", *debate, "finalize"]))
    x = phases.select("phase", "target", "ord", "ingest", F.posexplode(kinds).alias("step", "kind"))
    x = x.withColumn("id", F.concat_ws("/", "phase", "target", "kind")).withColumn("seq", F.col("ord") * 100 + F.col("step"))
    before = F.lag("id").over(Window.partitionBy("target").orderBy("seq"))
    first = F.row_number().over(Window.partitionBy("phase").orderBy("seq")) == 1
    return x.select("id", F.col("seq").cast("long").alias("seq"), "kind", F.when(before.isNull(), F.array().cast("array<string>")).otherwise(F.array(before)).alias("depends_on"), (F.col("ingest") & first).alias("ingest"))


PLAN_ROWS = 100_000  # a plan is made on the driver from settings; up to this size its levels are worked out there


def levels(nodes: DataFrame) -> DataFrame:
    """nodes (id, depends_on) -> id, level: 0 without known dependencies, else one more than the deepest; a cycle is an error.

    Larger plans than PLAN_ROWS run as a recursive query, whose rounds follow the graph's depth.
    """
    spark, most = nodes.sparkSession, nodes.count()
    if most <= PLAN_ROWS:
        found = plan_levels({r["id"]: list(r["depends_on"]) for r in nodes.select("id", "depends_on").collect()})
        return spark.createDataFrame(list(found.items()), "id string, level long")
    nodes.createOrReplaceTempView("_nodes")
    nodes.select("id", F.explode("depends_on").alias("dep")).join(nodes.select(F.col("id").alias("dep")), "dep").createOrReplaceTempView("_edges")
    return spark.sql(f"""WITH RECURSIVE r(id, level) MAX RECURSION LEVEL {most + 1} AS (SELECT id, 0L FROM _nodes UNION ALL SELECT e.id, r.level + 1 FROM r JOIN _edges e ON e.dep = r.id)
        SELECT id, max(level) AS level FROM r GROUP BY id""")


def plan_levels(depends: dict[str, list[str]]) -> dict[str, int]:
    waits = {k: [d for d in v if d in depends] for k, v in depends.items()}
    after: dict[str, list[str]] = {}
    for k, v in waits.items():
        for d in v:
            after.setdefault(d, []).append(k)
    left, level = {k: len(v) for k, v in waits.items()}, {k: 0 for k, v in waits.items() if not v}
    queue = list(level)
    for k in queue:
        for n in after.get(k, ()):
            left[n] -= 1
            level[n] = max(level.get(n, 0), level[k] + 1)
            if not left[n]:
                queue.append(n)
    if len(queue) < len(depends):
        raise ValueError("the plan has a cycle")
    return level


def ready(nodes: DataFrame, status: DataFrame) -> DataFrame:
    """Pending nodes whose dependencies have all ended, well or not; unknown ones never have. nodes (id, seq, depends_on), status (id, status)."""
    s = status.select(F.col("id").alias("dep"), "status")
    x = nodes.join(status.select("id", F.col("status").alias("own")), "id", "left").filter(F.coalesce("own", F.lit("PENDING")) == "PENDING")
    e = x.select("id", F.explode_outer("depends_on").alias("dep")).join(s, "dep", "left")
    open_ = e.filter(F.col("dep").isNotNull() & ~F.coalesce(F.col("status").isin("SUCCESS", "FAILED"), F.lit(False))).select("id").distinct()
    return x.join(open_, "id", "left_anti").select("id", "seq")


def execution_order(nodes: list[tuple[str, list[str]]]) -> list[str]:
    """The order in which tasks run: again and again the first inserted one that is ready; those never ready stay out.

    A task that failed has ended like one that succeeded. A heap holds the ready ones by their place.
    """
    known = {name: k for k, (name, _) in enumerate(nodes)}
    waits = [{d for d in deps} for _, deps in nodes]
    after: dict[str, list[int]] = {}
    for k, deps in enumerate(waits):
        for d in deps:
            after.setdefault(d, []).append(k)
    heap, out = [k for k, deps in enumerate(waits) if not deps], []
    while heap:
        name = nodes[heapq.heappop(heap)][0]
        out.append(name)
        if known[name] >= 0:
            known[name] = -1  # of tasks of one name the first to end counts
            for k in after.get(name, ()):
                waits[k].discard(name)
                if not waits[k]:
                    heapq.heappush(heap, k)
    return out


def execution(nodes: DataFrame) -> DataFrame:
    """nodes (id, inserted, depends_on) -> id, place from 0 in the order of execution; NULL for those that are never ready.

    A plan is made from settings, so its order is worked out on the driver; more than PLAN_ROWS are refused.
    """
    rows = nodes.select("id", "depends_on").orderBy("inserted").limit(PLAN_ROWS + 1).collect()
    if len(rows) > PLAN_ROWS:
        raise ValueError(f"a plan of more than {PLAN_ROWS} tasks")
    order = {name: k for k, name in enumerate(execution_order([(r["id"], list(r["depends_on"] or [])) for r in rows]))}
    return nodes.sparkSession.createDataFrame([(r["id"], order.get(r["id"])) for r in rows], "id string, place long")


def outcome(gated: Column, actionable: Column, success: Column, soft_fail: Column, final_ok: Column) -> Column:
    """How a node ends: skipped nodes succeed; a soft failure counts as success unless the final check fails."""
    return F.when(gated & ~actionable, "SUCCESS").when(success & final_ok, "SUCCESS").when(soft_fail & final_ok, "SUCCESS").otherwise("FAILED")


# ---- queries ----


def target_test_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets and tests made of each order's lines: one, some or no test files."""
    x = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("phase")).agg(F.array_sort(F.collect_set("l_linenumber")).alias("n"))
    targets = F.transform("n", lambda i: F.concat(F.lit("src/m"), i.cast("string"), F.lit(".x.py")))
    count = F.when(F.col("phase") % 4 == 0, 1).when(F.col("phase") % 4 == 1, 2).when(F.col("phase") % 4 == 2, 9).otherwise(0)
    tests = F.when(count == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), count), lambda i: F.concat(F.lit("t"), i.cast("string"), F.lit(".py"))))
    return align_tests(x.select("phase", targets.alias("targets"), tests.alias("tests")))


TARGET_TEST_ALIGN = """WITH x AS (SELECT l_orderkey AS phase, list_sort(list(DISTINCT l_linenumber)) AS n FROM lineitem GROUP BY 1), y AS (SELECT phase, unnest(n) AS i, unnest(range(len(n))) AS pos, CASE phase % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 9 ELSE 0 END AS c FROM x)
SELECT phase, pos, concat('src/m', i, '.x.py') AS target, CASE WHEN c = 1 THEN 't1.py' WHEN pos < c THEN concat('t', pos + 1, '.py') ELSE concat('tests/test_m', i, '.x.py') END AS test FROM y"""


def phase_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skipping, mode, debate switches and outcome for switches that vary by order."""
    k = F.col("o_orderkey")
    bit = lambda n: F.floor(k / n) % 2 == 1
    raw = F.when(k % 6 == 0, None).when(k % 6 == 1, F.lit("[1, 0, 1]")).when(k % 6 == 2, F.lit("0 1")).when(k % 6 == 3, F.lit("true")).when(k % 6 == 4, F.lit("1,2,3,4")).otherwise(F.lit(""))
    d = debate_switches(bit(16), raw)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", skips([bit(1), bit(2), bit(4), bit(8)]).alias("skip"), code_mode(bit(1), bit(2), bit(4), bit(8), bit(16), bit(32)).alias("code_mode"),
        *[F.get(d, F.lit(i)).alias(f"debate{i + 1}") for i in range(3)], outcome(bit(1), bit(2), bit(4), bit(8), bit(16)).alias("outcome"),
    )


_BIT = "((o_orderkey // {}) % 2 = 1)"
_B = {n: _BIT.format(n) for n in (1, 2, 4, 8, 16, 32)}
PHASE_MODES = f"""SELECT o_orderkey, NOT {_B[1]} AND NOT {_B[2]} AND NOT {_B[4]} AND NOT {_B[8]} AS skip,
 {_B[1]} OR ({_B[2]} AND NOT {_B[4]}) OR ({_B[8]} AND NOT (({_B[2]} AND {_B[4]}) OR {_B[16]} OR {_B[32]})) AS code_mode,
 {_B[16]} AND o_orderkey % 6 IN (0, 1, 4) AS debate1, {_B[16]} AND o_orderkey % 6 IN (2, 4) AS debate2, {_B[16]} AND o_orderkey % 6 IN (1, 4) AS debate3,
 CASE WHEN {_B[1]} AND NOT {_B[2]} THEN 'SUCCESS' WHEN ({_B[4]} OR {_B[8]}) AND {_B[16]} THEN 'SUCCESS' ELSE 'FAILED' END AS outcome FROM orders"""


def phase_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.concat(F.lit("p"), (F.col("n_nationkey") % 5).cast("string")).alias("phase"), F.concat(F.lit("f"), (F.col("n_nationkey") % 7).cast("string")).alias("target"), F.col("n_nationkey").cast("long").alias("ord"), (F.col("n_nationkey") % 2 == 0).alias("code"), (F.col("n_nationkey") % 5 < 2).alias("ingest"))


def task_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks(phase_rows(spark, sf_dir)).select("id", "seq", "kind", F.array_join("depends_on", ",").alias("depends_on"), "ingest")


_TASKS = """p AS (SELECT concat('p', n_nationkey % 5) AS phase, concat('f', n_nationkey % 7) AS target, n_nationkey AS ord, n_nationkey % 2 = 0 AS code, n_nationkey % 5 < 2 AS ingest FROM nation),
k AS (SELECT *, CASE WHEN code THEN ['job1', 'job2', 'job3', 'verify', 'debate1', 'apply1', 'debate2', 'apply2'] ELSE ['oracle', 'autofix', 'heal', 'debate1', 'apply1', 'debate2', 'apply2', 'finalize'] END AS ks FROM p),
u AS (SELECT phase, target, ord, ingest, unnest(ks) AS kind, unnest(range(8)) AS step FROM k),
tasks AS (SELECT concat_ws('/', phase, target, kind) AS id, (ord * 100 + step)::BIGINT AS seq, kind, coalesce(lag(concat_ws('/', phase, target, kind)) OVER (PARTITION BY target ORDER BY ord * 100 + step), '') AS depends_on,
 ingest AND row_number() OVER (PARTITION BY phase ORDER BY ord * 100 + step) = 1 AS ingest FROM u)"""
TASK_ROWS = f"WITH {_TASKS} SELECT * FROM tasks"


def dag_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels(tasks(phase_rows(spark, sf_dir)).select("id", "depends_on"))


DAG_LEVELS = f"WITH RECURSIVE {_TASKS}, r AS (SELECT id, 0::BIGINT AS level FROM tasks UNION ALL SELECT t.id, r.level + 1 FROM r JOIN tasks t ON t.depends_on = r.id) SELECT id, max(level) AS level FROM r GROUP BY id"


def ready_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks that may run once those of the first nations have ended."""
    nodes = tasks(phase_rows(spark, sf_dir)).select("id", "seq", "depends_on")
    status = nodes.select("id", F.when(F.col("seq") < 500, F.when(F.col("seq") % 3 == 0, "FAILED").otherwise("SUCCESS")).otherwise("PENDING").alias("status"))
    return ready(nodes, status)


READY_TASKS = f"WITH {_TASKS} SELECT id, seq FROM tasks WHERE seq >= 500 AND (depends_on = '' OR depends_on IN (SELECT id FROM tasks WHERE seq < 500))"


def execution_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which the plan's tasks run when they were inserted by kind, and some wait for a task that is not there."""
    nodes = tasks(phase_rows(spark, sf_dir)).withColumn("inserted", F.struct("kind", "id"))
    lost = F.array(F.lit("gone"))
    return execution(nodes.select("id", "inserted", F.when(F.col("seq") % 300 == 4, lost).otherwise(F.col("depends_on")).alias("depends_on")))


EXECUTION_PLAN = f"""WITH RECURSIVE {_TASKS}, n AS (SELECT id, CASE WHEN seq % 300 = 4 THEN 'gone' ELSE depends_on END AS dep, row_number() OVER (ORDER BY kind, id) AS ins FROM tasks),
r(step, done) AS (SELECT 0, []::VARCHAR[] UNION ALL SELECT step + 1, list_append(done, arg_min(id, ins)) FROM r JOIN n ON NOT list_contains(done, id) AND (dep = '' OR list_contains(done, dep)) GROUP BY step, done),
o AS (SELECT done FROM r ORDER BY step DESC LIMIT 1) SELECT id, list_position(done, id)::BIGINT - 1 AS place FROM n, o"""


def config_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of each market segment over global ones; template and collection picks; colours."""
    c = table(spark, sf_dir, "customer")
    own = c.select(F.col("c_mktsegment").alias("phase"), F.concat(F.lit("k"), (F.col("c_custkey") % 9).cast("string")).alias("key"), F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("v"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))).alias("value"))
    base = spark.range(12).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.concat(F.lit("g"), F.col("id").cast("string")).alias("value"))
    return settings(own, base)


CONFIG_VALUES = """WITH own AS (SELECT c_mktsegment AS phase, concat('k', c_custkey % 9) AS key, max(CASE WHEN c_custkey % 3 > 0 THEN concat('v', lpad(c_custkey::VARCHAR, 9, '0')) END) AS v FROM customer GROUP BY 1, 2),
k AS (SELECT concat('k', i) AS key, concat('g', i) AS base FROM range(12) r(i)) SELECT p.phase, k.key, coalesce(v, base) AS value FROM (SELECT DISTINCT phase FROM own) p CROSS JOIN k LEFT JOIN own ON own.phase = p.phase AND own.key = k.key"""


def picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-job options, collection paths, colours and dummy keys, by customer."""
    k = F.col("c_custkey")
    options = F.when(k % 4 == 0, F.array(F.lit("a"), F.lit(" "), F.lit("c "))).when(k % 4 == 1, F.array(F.lit("only"))).when(k % 4 == 2, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    path = F.when(k % 3 == 0, F.concat(F.lit("/data/c"), (k % 5).cast("string"), F.lit("/"))).otherwise(F.concat(F.lit("c"), (k % 5).cast("string")))
    p = collection_path(path, F.lit("/root"))
    hexes = F.when(k % 5 == 0, F.lit("#12ab")).when(k % 5 == 1, F.lit("zzzzzz")).otherwise(F.concat(F.lit(" #"), F.lpad(F.hex(k * 7919 % 16777216), 6, "0")))
    key = F.when(k % 6 == 0, None).when(k % 6 == 1, F.lit(" SK-Dummy ")).when(k % 6 == 2, F.lit("none")).when(k % 6 == 3, F.lit("")).otherwise(F.lit("sk-live"))
    return table(spark, sf_dir, "customer").select("c_custkey", pick(options, (k % 3).cast("int"), F.lit("default")).alias("option"), p["name"].alias("collection"), p["db"].alias("db"), *[t.colour(hexes, i).alias(n) for i, n in enumerate(("red", "green", "blue"))], t.no_key(key).alias("no_key"), t.session_slug(F.col("c_name")).alias("slug"))


_H = "(c_custkey * 7919 % 16777216)"
PICKS = f"""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN CASE c_custkey % 3 WHEN 2 THEN 'c' ELSE 'a' END WHEN 1 THEN 'only' ELSE 'default' END AS option, concat('c', c_custkey % 5) AS collection,
 CASE WHEN c_custkey % 3 = 0 THEN concat('/data/c', c_custkey % 5, '/db') ELSE concat('/root/c', c_custkey % 5, '/db') END AS db,
 CASE WHEN c_custkey % 5 > 1 THEN {_H} // 65536 END::BIGINT AS red, CASE WHEN c_custkey % 5 > 1 THEN {_H} // 256 % 256 END::BIGINT AS green, CASE WHEN c_custkey % 5 > 1 THEN {_H} % 256 END::BIGINT AS blue,
 c_custkey % 6 < 4 AS no_key, regexp_replace(c_name, '[^a-zA-Z0-9_\\-.]', '_', 'g') AS slug FROM customer"""

HEADING = "## PREVIOUS COMPLETED SYSTEM GOALS AND CONSTRAINTS"


def template_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's text put into a template's section, over templates with and without it."""
    x = table(spark, sf_dir, "conversations")
    template = F.when(F.col("turn") % 3 == 0, F.lit(f"# A\n{HEADING}\n\nold\n---\nrest")).when(F.col("turn") % 3 == 1, F.lit(f"# B\n{HEADING} x\nold\n## 2. Next")).otherwise(F.lit("# C"))
    return x.select("conv_id", "turn", fill_section(template, HEADING, F.concat("text", F.lit(" $1 \\ "))).alias("filled"))


TEMPLATE_SECTIONS = f"""WITH x AS (SELECT conv_id, turn, turn % 3 AS m, concat('{HEADING}', chr(10), chr(10), trim(concat(text, ' $1 \\ ')), chr(10)) AS i FROM conversations)
SELECT conv_id, turn, CASE m WHEN 0 THEN concat('# A', chr(10), i, chr(10), chr(10), '---', chr(10), 'rest') WHEN 1 THEN concat('# B', chr(10), i, chr(10), chr(10), '## 2. Next') ELSE concat('# C', chr(10), chr(10), i) END AS filled FROM x"""


def template_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each supplier's template is found, five places being tried."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    k = F.col("id")
    name = F.concat(F.lit("t"), k.cast("string"), F.lit(".md"))
    path = F.when(k % 7 == 6, F.concat(F.lit("/abs/"), name)).when(k % 2 == 0, F.concat(F.lit(".groundwork/x/"), name)).otherwise(F.concat(F.lit("x/"), name))
    wanted = s.select("id", path.alias("path"))
    there = s.select(F.explode(F.array(
        F.when(k % 5 == 0, F.struct(F.lit("project").alias("place"), F.concat(F.lit("x/"), name).alias("path"))), F.when(k % 5 == 1, F.struct(F.lit("project").alias("place"), F.concat(F.lit(".groundwork/x/"), name).alias("path"))),
        F.when(k % 5 == 2, F.struct(F.lit("project").alias("place"), F.concat(F.lit(".groundwork/"), name).alias("path"))), F.when(k % 5 < 4, F.struct(F.lit("package").alias("place"), F.concat(F.lit("x/"), name).alias("path"))))).alias("f")).filter("f is not null").select("f.*")
    return resolve_template(wanted, there)


TEMPLATE_PATHS = """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 7 = 6 THEN concat('/abs/t', s_suppkey, '.md')
 WHEN s_suppkey % 2 <> 0 AND s_suppkey % 5 = 0 THEN concat('project:x/t', s_suppkey, '.md') WHEN s_suppkey % 5 = 1 THEN concat('project:.groundwork/x/t', s_suppkey, '.md')
 WHEN s_suppkey % 5 = 2 THEN concat('project:.groundwork/t', s_suppkey, '.md') WHEN s_suppkey % 5 < 4 THEN concat('package:x/t', s_suppkey, '.md')
 WHEN s_suppkey % 2 = 0 THEN concat('project:.groundwork/x/t', s_suppkey, '.md') ELSE concat('project:x/t', s_suppkey, '.md') END AS found FROM supplier"""

QUERIES = {f.__name__: f for f in (target_test_align, phase_modes, task_rows, dag_levels, ready_tasks, execution_plan, config_values, picks, template_sections, template_paths)}
ORACLES = {k: globals()[k.upper()] for k in QUERIES if k.upper() in globals()}
