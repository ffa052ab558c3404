"""Structured Streaming forms: incremental ingestion, referee, attempt ledgers, event windows.

Each stream, run to its end over all input, gives the rows of its batch form.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from groundwork.functions import text as t
from groundwork.operators import referee
from groundwork.session import shared_dir, ship

STATE_STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files; the schema is that of the files now there."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/{name}.parque[t]")


def run_to_end(stream: DataFrame, mode: str = "append", key: list[str] | None = None) -> DataFrame:
    """Run over all that is there and give the table written: appended rows, or the last row of each key in update mode."""
    spark = stream.sparkSession
    where = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = f"{where}/rows"

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("_epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{rows}/_e={epoch}")  # a batch that runs again replaces itself

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{where}/state").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    from pyspark.sql.types import LongType

    out = spark.read.schema(StructType([*stream.schema.fields]).add("_epoch", LongType())).option("recursiveFileLookup", True).parquet(rows)
    if key:
        kept = [c for c in stream.columns if c not in key]
        out = out.groupBy(*key).agg(F.max_by(F.struct(*kept), "_epoch").alias("s")).select(*key, *[F.col(f"s.{c}").alias(c) for c in kept])
    return out.select(*stream.columns)


class WholeFiles(StatefulProcessor):
    """Holds a file's chunks until all of them have come, then gives them in order and forgets the file."""

    def __init__(self, held: StructType):
        self.held = held

    def init(self, handle) -> None:
        self.chunks = handle.getListState("chunks", self.held)
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timers) -> Iterator[Row]:
        names = self.held.names
        new = [tuple(r[c] for c in names) for r in rows]
        if any(r[0] is None or r[1] is None for r in new):
            raise ValueError(f"a chunk of {key} has no seq or n_chunks")
        before = self.count.get()[0] if self.count.exists() else 0
        need = max(r[1] for r in new)
        if before + len(new) >= need:
            by_seq = {r[0]: r for r in [*new[::-1], *(tuple(r) for r in (list(self.chunks.get())[::-1] if before else ()))]}  # of chunks that come twice the first
            if len(by_seq) >= need:
                if before:
                    self.chunks.clear()
                    self.count.clear()
                yield from (Row(table_name=key[0], source_file=key[1], **dict(zip(names, by_seq[k]))) for k in sorted(by_seq))
                return
        self.chunks.appendList(new)
        self.count.update((before + len(new),))

    def close(self) -> None:
        pass


def whole_files(stream: DataFrame) -> DataFrame:
    """Chunks (table_name, source_file, seq from 0, n_chunks, ...) of a stream, a file's all at once, when the last of its n_chunks has come.

    The state holds unfinished files only; a chunk that comes twice counts once.
    """
    ship(stream.sparkSession)
    held = StructType([stream.schema[c] for c in ("seq", "n_chunks")] + [f for f in stream.schema if f.name not in ("table_name", "source_file", "seq", "n_chunks")])
    out = StructType([stream.schema["table_name"], stream.schema["source_file"], *held])
    found = stream.groupBy("table_name", "source_file").transformWithState(WholeFiles(held), out, "Append", "None")
    return found.select(*stream.columns)


def ingest(stream: DataFrame, store, checkpoint: str | None = None, width: int | None = None):
    """Chunk rows to the store, file by file: each micro-batch adds the files that are complete and that their tables lack.

    A query that is started again with the same checkpoint goes on where it stopped, unfinished
    files included; without one it has a new folder in the shared one. Numbers (seq, n_chunks) tell
    where a file ends, so rows without them are refused.
    """
    if missing := {"table_name", "source_file", "seq", "n_chunks"} - {*stream.columns}:
        raise ValueError(f"chunks lack {', '.join(sorted(missing))}")
    spark = stream.sparkSession
    where = checkpoint or f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    files = whole_files(stream)
    kept = [c for c in files.columns if c not in ("seq", "n_chunks")]
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKS)  # taken up as the query starts; lists grow there without being rewritten
    try:
        return files.writeStream.option("checkpointLocation", where).foreachBatch(lambda batch, _: store.append(batch.select(*kept), width)).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)


def tumbling(events: DataFrame, length: str = "1 hour", late: str = "1 day") -> DataFrame:
    w = F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def sliding(events: DataFrame, length: str = "2 hours", step: str = "1 hour", late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", length, step)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def visits(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Session windows of each user."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("until"), "user_id", "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Each key once; keys older than the watermark are forgotten."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def _turns(key, frames: Iterator, state) -> Iterator:
    """A debate's state after each batch. Held: the last two proposals and the last verdict by turn, and the number of turns, however many there were."""
    import pandas as pd

    second, two, first, one, last, said, n = state.get if state.exists else (-1, None, -1, None, -1, None, 0)
    for f in frames:
        n += len(f)
        for turn, role, h, v in zip(f["turn"], f["role"], f["proposal_hash"], f["verdict"]):
            if role == "architect" and turn > first:
                second, two, first, one = first, one, int(turn), h
            elif role == "architect" and turn > second:
                second, two = int(turn), h
            elif role == "oracle" and turn > last:
                last, said = int(turn), v
    state.update((second, two, first, one, last, said, n))
    stable = second >= 0 and one == two
    yield pd.DataFrame({"issue": [key[0]], "state": ["agreed" if said == "agree" else "deadlock" if said == "object" and stable else "continue"], "n": [n]})


def consensus(turns: DataFrame) -> DataFrame:
    """The referee as a keyed stream over turns (issue, turn from 0, role, text); update mode, the last row of an issue is its state. Turns may come in any order."""
    ship(turns.sparkSession)
    facts = referee.turn_facts(turns).select("issue", "turn", "role", "proposal_hash", "verdict")
    held = "second long, two string, first long, one string, last long, said string, n long"
    return facts.groupBy("issue").applyInPandasWithState(_turns, "issue long, state string, n long", held, "update", "NoTimeout")


def _attempts(key, frames: Iterator, state) -> Iterator:
    import pandas as pd

    rows = sorted((int(a), ",".join(sorted(s))) for f in frames for a, s in zip(f["attempt"], f["tripped"]))
    before = state.get[0] if state.exists else None
    out = []
    for attempt, now in rows:
        out.append((key[0], attempt, now, bool(attempt > 0 and before is not None and before == now)))
        before = now
    if rows:
        state.update((before,))
    yield pd.DataFrame(out, columns=["doc", "attempt", "tripped_set", "no_progress"])


def attempts(rows: DataFrame) -> DataFrame:
    """rows (doc, attempt, tripped array): whether each attempt got anywhere, as they come in."""
    ship(rows.sparkSession)
    return rows.select("doc", "attempt", "tripped").groupBy("doc").applyInPandasWithState(_attempts, "doc long, attempt long, tripped_set string, no_progress boolean", "before string", "append", "NoTimeout")


def excerpts(turns: DataFrame) -> DataFrame:
    """A stateless stream: each turn's excerpt and proposal."""
    return turns.select("issue", "turn", t.excerpt(F.col("text")).alias("excerpt"), t.proposal_line(F.col("text")).alias("proposal"))
