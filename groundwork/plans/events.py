"""Queries over `events`: forward fill, windows (batch), and the streams, each against its batch twin in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundwork.functions import text as t
from groundwork.operators import chunking
from groundwork.plans import activity
from groundwork.plans.common import quote_hash, table
from groundwork.session import shared_dir
from groundwork.sources import catalog
from groundwork.streaming import streams


def tumble(ts, freq: int):
    """The start of a value's bucket; a frequency of 0 is an error."""
    if freq == 0:
        raise ValueError("frequency 0")
    return F.floor(ts / freq) * freq


def tumbling_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "events").select(tumble(F.unix_timestamp(F.col("ts").cast("timestamp")), 60).alias("start"), "event_type")
    return x.groupBy("start", "event_type").agg(F.count("*").alias("n"))


TUMBLING_EVENTS = "SELECT (floor(floor(epoch(ts)) / 60) * 60)::BIGINT AS start, event_type, count(*) AS n FROM events GROUP BY ALL"


def locf_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last value that is present, two in three being taken away."""
    x = table(spark, sf_dir, "events").withColumn("seen", F.when(F.col("event_id") % 3 == 0, F.col("value")))
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return x.select("event_id", "user_id", F.last("seen", True).over(w).alias("filled"))


LOCF_EVENTS = "SELECT event_id, user_id, last_value(CASE WHEN event_id % 3 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS filled FROM events"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.run_to_end(streams.tumbling(_events(spark, sf_dir), late="10000 days"), "update", ["start", "event_type"])
    return out.select(F.unix_timestamp("start").alias("start"), "event_type", "n", "total")


STREAM_TUMBLING = "SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.run_to_end(streams.sliding(_events(spark, sf_dir), late="10000 days"), "update", ["start"])
    return out.select(F.unix_timestamp("start").alias("start"), "n")


STREAM_SLIDING = "SELECT epoch(s)::BIGINT AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY s"


def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits of each user (batch form)."""
    out = streams.visits(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select(F.unix_timestamp("start").alias("start"), "user_id", "n")


SESSION_WINDOWS = """WITH g AS (SELECT user_id, ts, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 30 MINUTE)::INT, 1) AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT floor(epoch(min(ts)))::BIGINT AS start, user_id, count(*) AS n FROM s GROUP BY user_id, s"""


def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = streams.first_seen(_events(spark, sf_dir).select("user_id", "event_type", "ts"), ["user_id", "event_type"], "10000 days")
    return streams.run_to_end(x.select("user_id", "event_type"))


STREAM_FIRST_SEEN = "SELECT DISTINCT user_id, event_type FROM events"


def stream_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = streams.read(spark, sf_dir, "conversations")
    turns = x.select(F.col("conv_id").alias("issue"), "turn", F.expr(activity.ROLE).alias("role"), F.expr(activity.TURN.replace("turn // 4", "turn div 4")).alias("text"))
    return streams.run_to_end(streams.consensus(turns), "update", ["issue"])


STREAM_CONSENSUS = f"WITH {activity.DEBATE}, {activity._STATE} SELECT issue, state, n FROM st"


def stream_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = streams.read(spark, sf_dir, "conversations")
    rows = x.select(F.col("conv_id").alias("doc"), F.col("turn").alias("attempt"), F.array(t.quote_hash(F.concat(F.lit("q"), F.floor(F.col("turn") / 2).cast("string"))), F.lit("b")).alias("tripped"))
    return streams.run_to_end(streams.attempts(rows))


STREAM_ATTEMPTS = f"""WITH x AS (SELECT conv_id AS doc, turn AS attempt, array_to_string(list_sort([{quote_hash("concat('q', turn // 2)")}, 'b']), ',') AS tripped_set FROM conversations)
SELECT doc, attempt, tripped_set, coalesce(lag(tripped_set) OVER (PARTITION BY doc ORDER BY attempt) = tripped_set AND attempt > 0, false) AS no_progress FROM x"""


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' chunks, dealt over the files of four parts so that a document's come in several micro-batches, streamed into a store."""
    where = f"{shared_dir(spark)}/streamed-{uuid.uuid4().hex}"
    cut = chunking.windows(F.col("text"), 800)
    docs = table(spark, sf_dir, "documents").select("doc_id", cut.alias("cut")).select("doc_id", F.size("cut").alias("n_chunks"), F.posexplode("cut").alias("seq", "text"))
    chunks = docs.select(
        F.concat(F.lit("00"), (F.col("doc_id") % 3).cast("string")).alias("table_name"), F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("source_file"), "seq", "n_chunks", "text",
        F.lit("docs").alias("source_type"), F.lit("").alias("language"), F.col("seq").alias("line_start"),
    )
    parts = chunks.withColumn("part", F.col("seq") % 4)
    parts.write.partitionBy("part").parquet(f"{where}/in")  # a task writes what it cut: no part goes through one
    n_files = len(spark.read.schema(parts.schema).parquet(f"{where}/in").inputFiles())
    store = catalog.Store(spark, f"{where}/store")
    dealt = spark.readStream.schema(parts.schema).option("maxFilesPerTrigger", max(1, -(-n_files // 4))).parquet(f"{where}/in")
    streams.ingest(dealt.drop("part"), store).awaitTermination()
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_start", "text"))), lambda x: x["text"]), "|")
    return store.read().groupBy("table_name", "source_file").agg(F.count("*").alias("n"), F.md5(texts.cast("binary")).alias("digest"))


STREAM_INGEST = """WITH w AS (SELECT doc_id, unnest(range(1 + greatest(0, ceil((length(text) - 800) / 640.0))::BIGINT)) AS pos, text FROM documents WHERE length(text) > 0)
SELECT concat('00', doc_id % 3) AS table_name, concat('d/', doc_id) AS source_file, count(*) AS n, md5(string_agg(substr(text, pos * 640 + 1, 800), '|' ORDER BY pos)) AS digest FROM w GROUP BY doc_id"""


def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension over the star schema: revenue of each nation's customers by order year."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    x = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("r").alias("r"), F.count("*").alias("n_lines"))
    return x.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", F.round("r", 2).alias("revenue"), "n_lines")


REVENUE_BY_NATION = "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n_lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"

QUERIES = {f.__name__: f for f in (tumbling_events, locf_events, stream_tumbling, stream_sliding, session_windows, stream_first_seen, stream_consensus, stream_attempts, stream_ingest, revenue_by_nation)}
ORACLES = {k: globals()[k.upper()] for k in QUERIES if k.upper() in globals()}
