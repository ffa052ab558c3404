"""The chunk store: Parquet files by table, with guarded appends, listing, deletion and compaction.

A store is a folder of Parquet files partitioned by `table_name`. Deletes write the rest of the
touched tables anew and replace those partitions alone; nothing else is read or written.
"""

from __future__ import annotations

from itertools import accumulate
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StringType, StructField, StructType

SCHEMA = StructType([
    StructField("text", StringType()), StructField("vector", ArrayType(FloatType(), False)), StructField("source_file", StringType()), StructField("source_type", StringType()),
    StructField("language", StringType()), StructField("symbol", StringType()), StructField("line_start", IntegerType()), StructField("line_end", IntegerType()), StructField("table_name", StringType()),
])
REQUIRED = ("source_type", "language")
FILE_BYTES = 64 << 20  # of a file that a deletion writes


def names_file(column: Column, name: str) -> Column:
    """Whether a source file is `name`, or ends with /name. Signs that LIKE would read as wild are plain here."""
    return (column == name) | column.endswith("/" + name)


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self):
        jvm, where = self.spark._jvm, self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        _, where, fs = self._fs()
        return fs.exists(where) and any(s.isDirectory() for s in fs.listStatus(where))

    def read(self) -> DataFrame:
        return self._rows(self.path) if self.exists() else self.spark.createDataFrame([], SCHEMA)

    def _rows(self, path: str) -> DataFrame:
        """Rows under path. Table names are strings, whatever they look like: Spark would read 007 as a number."""
        found = self.spark.read.parquet(path).schema
        names = StructType([StructField(f.name, StringType()) if f.name == "table_name" else f for f in found])
        return self.spark.read.schema(names).parquet(path)

    def guard(self, rows: DataFrame, width: int | None = None) -> None:
        """Refuse rows without the metadata columns or a table name, or a store written without them, or vectors that are null or of another width than the store's and each other's."""
        for where, names in (("rows", rows.columns), *((("store", self.read().columns),) if self.exists() else ())):
            missing = [c for c in REQUIRED if c not in names]
            if missing:
                raise ValueError(f"{where} lack {', '.join(missing)}")
        if rows.filter(F.coalesce(F.col("table_name"), F.lit("")) == "").limit(1).count():
            raise ValueError("rows without a table name")
        if "vector" in rows.columns:
            own = self.read().filter("vector is not null").select(F.size("vector").alias("w")).limit(1).collect() if self.exists() else []
            size = F.when(F.col("vector").isNotNull(), F.size("vector"))
            r = rows.agg(F.min(size).alias("a"), F.max(size).alias("b"), F.count_if(F.col("vector").isNull()).alias("none")).first()
            want = width or (own[0]["w"] if own else r["a"])
            if r["none"]:
                raise ValueError(f"{r['none']} rows have no vector")
            if r["a"] is not None and (r["a"], r["b"]) != (want, want):
                raise ValueError(f"vectors of width {r['a']} to {r['b']}, not {want}")

    def append(self, rows: DataFrame, width: int | None = None, files_per_table: int = 0) -> None:
        """Add rows of source files that a table does not hold yet."""
        self.guard(rows, width)
        if self.exists():
            rows = rows.join(self.read().select("table_name", "source_file").distinct(), ["table_name", "source_file"], "left_anti")
        rows = rows.select([c for c in rows.columns if c != "table_name"] + ["table_name"])
        names = [r["table_name"] for r in rows.select("table_name").distinct().collect()] if files_per_table else []  # a row a table
        self._write(rows, "append", dict.fromkeys(names, files_per_table))

    def overwrite(self, rows: DataFrame) -> None:
        """Replace the tables that rows belong to; rows are refused as in append()."""
        self.guard(rows)
        self._write(rows.select([c for c in rows.columns if c != "table_name"] + ["table_name"]), "overwrite")

    def _write(self, rows: DataFrame, mode: str, files: dict[str, int] | None = None) -> None:
        """files: how many files each table gets; each is a task of its own, so that none holds more than one table."""
        out = self._dealt(rows, files) if files else rows
        out.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("table_name").parquet(self.path)

    def _dealt(self, rows: DataFrame, files: dict[str, int]) -> DataFrame:
        firsts = [0, *accumulate(files.values())]
        places = self.spark.createDataFrame([(t, at, n) for (t, n), at in zip(files.items(), firsts)], "table_name string, _first long, _files long")
        at = F.col("_first") + F.pmod(F.xxhash64(*rows.columns), F.col("_files"))
        return rows.join(F.broadcast(places), "table_name").repartitionById(firsts[-1], at.cast("int")).select(*rows.columns)

    def _files_for(self, tables: list[str]) -> dict[str, int]:
        """How many files of about FILE_BYTES each of these tables fills."""
        fs, folders = self._fs()[2], self._folders()
        return {t: max(1, -(-fs.getContentSummary(folders[t]).getLength() // FILE_BYTES)) for t in tables}

    def tables(self) -> list[str]:
        return sorted(self._folders())

    def _folders(self) -> dict:
        """Table name -> its folder, in whose name some signs are written as %XX."""
        if not self.exists():
            return {}
        _, where, fs = self._fs()
        found = [s.getPath() for s in fs.listStatus(where) if s.isDirectory() and s.getPath().getName().startswith("table_name=")]
        return {unquote(p.getName().partition("=")[2]): p for p in found}

    def files(self) -> DataFrame:
        """table_name, chunks, n_files, files: what each table holds."""
        return list_files(self.read())

    def drop(self, table: str) -> None:
        folder = self._folders()[table]
        self._fs()[2].delete(folder, True)

    def remove_file(self, name: str, prefix: str = "") -> int:
        """Delete a file's chunks from the tables of a collection (by prefix); tables left empty are dropped. Returns the chunks deleted."""
        rows = self.read().filter(F.col("table_name").startswith(prefix))
        gone = names_file(F.col("source_file"), name)
        counts = rows.groupBy("table_name").agg(F.count_if(gone).alias("gone"), F.count("*").alias("n")).filter("gone > 0").collect()  # a row a table
        empty = [r["table_name"] for r in counts if r["gone"] == r["n"]]
        touched = [r["table_name"] for r in counts if r["gone"] < r["n"]]
        if touched:
            staged = f"{self.path}.staged"
            self.read().filter(F.col("table_name").isin(touched)).filter(~gone).write.mode("overwrite").partitionBy("table_name").parquet(staged)
            self._write(self._rows(staged), "overwrite", self._files_for(touched))
            jvm, _, fs = self._fs()
            fs.delete(jvm.org.apache.hadoop.fs.Path(staged), True)
        for t in empty:
            self.drop(t)
        return sum(r["gone"] for r in counts)

    def compact(self, files_per_table: int = 1) -> None:
        staged = f"{self.path}.staged"
        self.read().write.mode("overwrite").partitionBy("table_name").parquet(staged)
        self._write(self._rows(staged), "overwrite", dict.fromkeys(self.tables(), files_per_table))
        jvm, _, fs = self._fs()
        fs.delete(jvm.org.apache.hadoop.fs.Path(staged), True)

    def wipe(self) -> None:
        """Delete the index; texts cached elsewhere stay."""
        _, where, fs = self._fs()
        fs.delete(where, True)


def list_files(chunks: DataFrame) -> DataFrame:
    x = chunks.groupBy("table_name").agg(F.count("*").alias("chunks"), F.sort_array(F.collect_set("source_file")).alias("f"))
    return x.select("table_name", "chunks", F.size("f").cast("long").alias("n_files"), F.array_join("f", ",").alias("files"))


def full_document(chunks: DataFrame, by: str = "table_name", order: str = "seq") -> DataFrame:
    """All texts of a table in stored order, joined by blank lines, under the first row's source."""
    rows = F.array_sort(F.collect_list(F.struct(order, "source_file", F.trim("text").alias("t"))))
    x = chunks.groupBy(by).agg(rows.alias("r"))
    return x.select(by, F.get("r", F.lit(0))["source_file"].alias("source"), F.array_join(F.transform("r", lambda v: v["t"]), "\n\n").alias("text"))


def kept_projects(registry: DataFrame, listing: DataFrame, tool: str = ".groundwork") -> DataFrame:
    """registry (path) whose folder exists and holds the tool's; listing (dir) is what exists."""
    both = listing.select(F.col("dir").alias("path"))
    has = listing.filter(F.col("dir").endswith("/" + tool)).select(F.expr(f"substr(dir, 1, length(dir) - {len(tool) + 1})").alias("path"))
    return registry.select("path").distinct().join(both, "path", "left_semi").join(has, "path", "left_semi")


def clear_sessions(sessions: DataFrame, name: str) -> DataFrame:
    """sessions (project, session) that stay when `name` or `project/name` is cleared; * clears all."""
    from groundwork.functions.text import session_slug

    project, _, session = name.strip().partition("/") if "/" in name else (None, "", name.strip())
    if name == "*":
        return sessions.limit(0)
    hit = F.col("session") == session_slug(F.lit(session))
    return sessions.filter(~(hit & (F.col("project") == project if project else F.lit(True))))


def active_collection(flag: Column, env: Column, config: Column, default: Column) -> Column:
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(blank(flag), blank(env), blank(config), default)


def endpoints(*columns: DataFrame) -> DataFrame:
    """Distinct endpoints of several one-column tables, without a trailing slash."""
    out = columns[0].toDF("url")
    for c in columns[1:]:
        out = out.union(c.toDF("url"))
    return out.select(F.regexp_replace(F.trim("url"), "/+$", "").alias("url")).filter("url <> ''").distinct()
