"""A folder of tables that change together: one commit names the files of all of them.

A commit is one numbered file below ``_commits``, which is created exclusively and lists, for each
table, the folders that hold its rows. Readers take the last whole commit, so they see all tables
before a change or all after it; a writer that dies leaves folders that no commit names, which
``vacuum`` removes. Of two writers that began at one commit, the second to finish gets ``Conflict``.

Tables are of two kinds. A *bucketed* table is dealt by a hash of its key, and a change rewrites
only the buckets that hold changed keys. A *log* is a list of immutable segments: a change appends
one as large as itself, and ``compacted`` joins runs of segments of one level, so that a row is
rewritten as often as the log has levels. Rows of a log may be ended by a tombstone (id, upto):
those of this id in segments up to that number no longer count.
"""

from __future__ import annotations

import copy
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .io import freeing

BUCKETS = 32
FANOUT = 4


class Conflict(Exception):
    """Another writer has committed since this change began."""


class Store:
    """A folder, and its last commit: {number, buckets, tables: {name: {schema, folders} or {schema, segments}}}."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at(path).getFileSystem(self._conf)
        self.state = self.latest()

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def numbers(self) -> list[int]:
        """All commits' numbers, whole or not, in order."""
        found = self._fs.globStatus(self._at(f"{self.path}/_commits/*.json"))
        return sorted(int(f.getPath().getName()[:-5]) for f in found or [])

    def _commit_at(self, number: int) -> str:
        return f"{self.path}/_commits/{number:012d}.json"

    def commit(self, number: int) -> dict | None:
        """What a commit says; none if its writer died within it."""
        stream = self._fs.open(self._at(self._commit_at(number)))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except json.JSONDecodeError:
            return None
        finally:
            stream.close()

    def latest(self) -> dict:
        """The last whole commit, or an empty store."""
        for number in reversed(self.numbers()):
            if (held := self.commit(number)) is not None:
                return held
        return {"number": 0, "buckets": self.buckets, "tables": {}}

    def refresh(self) -> Store:
        self.state = self.latest()
        return self

    def publish(self, state: dict) -> None:
        """Makes ``state`` the next commit, unless there is one."""
        target = self._at(self._commit_at(state["number"]))
        if self._fs.exists(target):
            raise Conflict(f"commit {state['number']} is there already")
        try:
            out = self._fs.create(target, False)
        except Exception as e:  # the file system's own error: somebody was faster
            raise Conflict(f"commit {state['number']} was made meanwhile") from e
        try:
            out.write(bytearray(json.dumps(state).encode()))
        finally:
            out.close()
        self.state = state

    def begin(self) -> Change:
        return Change(self.refresh())

    def schema(self, table: str) -> T.StructType | None:
        held = self.state["tables"].get(table)
        return T.StructType.fromJson(held["schema"]) if held else None

    def _read(self, schema: T.StructType, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def bucket(self, *keys: str) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.state["buckets"])).cast("int")

    def read(self, table: str, schema: T.StructType | None = None, *, buckets: list[int] | None = None) -> DataFrame:
        """A bucketed table's rows, or those of some buckets. A table that is not there yet has ``schema`` and no rows."""
        held = self.state["tables"].get(table)
        if held is None:
            return self.spark.createDataFrame([], schema)
        wanted = [folder for b, folder in held["folders"].items() if buckets is None or int(b) in buckets]
        return self._read(self.schema(table), wanted)

    def segments(self, table: str) -> list[dict]:
        return self.state["tables"].get(table, {}).get("segments", [])

    def rows(self, table: str, schema: str | None = None, *, of: list[dict] | None = None) -> DataFrame:
        """All rows of a log, with the number of their segment in ``seg``; those that tombstones end are still there."""
        held = self.schema(table)
        if held is None:
            return self.spark.createDataFrame([], f"{schema}, seg long")
        return self._read(held, [s["folder"] for s in (self.segments(table) if of is None else of)])

    def live(self, table: str, schema: str, id_col: str, *, of: list[dict] | None = None) -> DataFrame:
        """A log's rows that no tombstone of ``<table>_ends`` ends."""
        rows = self.rows(table, schema, of=of)
        if not self.segments(f"{table}_ends"):
            return rows
        ends = self.rows(f"{table}_ends").groupBy(F.col("id").alias("__ended")).agg(F.max("upto").alias("__upto"))
        return rows.join(ends, (F.col(id_col) == F.col("__ended")) & (F.col("seg") <= F.col("__upto")), "left_anti")

    def vacuum(self, keep: int = 1) -> int:
        """Removes what the last ``keep`` whole commits don't name, and older commits; returns the number of folders.

        No change may be under way: its folders have no commit yet.
        """
        whole = [(n, held) for n in self.numbers() if (held := self.commit(n)) is not None][-keep:]
        named = {folder.split("/")[1] for _, held in whole for t in held["tables"].values() for folder in [*t.get("folders", {}).values(), *(s["folder"] for s in t.get("segments", []))]}
        gone = [f.getPath() for f in self._fs.globStatus(self._at(f"{self.path}/*/w-*")) or [] if f.getPath().getName() not in named]
        for path in gone:
            self._fs.delete(path, True)
        for number in self.numbers():
            if whole and number < whole[0][0]:
                self._fs.delete(self._at(self._commit_at(number)), False)
        return len(gone)


class Change:
    """The next commit of a store while it is being made. Nothing of it is seen before ``commit``."""

    def __init__(self, store: Store):
        self.store, self.state = store, copy.deepcopy(store.state)
        self.state["number"] = max([0, *store.numbers()]) + 1
        self.wrote: dict[str, int] = {}

    def _table(self, name: str, schema: T.StructType, kind: str) -> dict:
        held = self.state["tables"].setdefault(name, {kind: {} if kind == "folders" else []})
        held["schema"] = schema.jsonValue()
        return held

    def replace(self, name: str, df: DataFrame | Callable[[list[int]], DataFrame], buckets: list[int], *key: str, rounds: int = 1) -> None:
        """``df`` becomes the content of these buckets of a table; all others stay as they are.

        If it is a function, it gives the rows of some of the buckets, which are written in ``rounds``: shuffle files
        hold only a round's share of the table at a time.
        """
        fs, self.wrote[name] = self.store._fs, 0
        for part in [buckets[i::rounds] for i in range(rounds)]:
            rows = df(part) if callable(df) else df
            folder = f"{name}/w-{uuid.uuid4().hex[:16]}"
            held = self._table(name, rows.schema, "folders")
            # A large bucket is split into several files where the plan finds it out of proportion.
            dealt = rows.withColumn("__b", self.store.bucket(*key)).hint("rebalance", "__b")
            with freeing(self.store.spark):
                dealt.write.partitionBy("__b").option("compression", "zstd").parquet(f"{self.store.path}/{folder}")
            there = {int(f.getPath().getName()[4:]) for f in fs.globStatus(self.store._at(f"{self.store.path}/{folder}/__b=*")) or []}
            for b in part:
                held["folders"].pop(str(b), None)
            held["folders"].update({str(b): f"{folder}/__b={b}" for b in sorted(there)})
            self.wrote[name] += len(there)

    def append(self, name: str, df: DataFrame, order: list[str], *, level: int = 0, number: int | None = None) -> int:
        """One more segment of a log, each file sorted by ``order`` so that a reader skips what it doesn't ask for; returns its rows.

        Rows stay in the tasks that made them. Nothing is shuffled, and a file of few passages has short
        dictionaries of their identifiers.
        """
        folder = f"{name}/w-{uuid.uuid4().hex[:16]}"
        number = self.state["number"] if number is None else number
        laid = df.withColumn("seg", F.lit(number).cast("long"))
        with freeing(self.store.spark):
            laid.sortWithinPartitions(*order).write.option("compression", "zstd").parquet(f"{self.store.path}/{folder}")
        n = self.store.spark.read.schema(laid.schema).parquet(f"{self.store.path}/{folder}").count()
        held = self._table(name, laid.schema, "segments")
        if n:
            held["segments"].append({"folder": folder, "number": number, "rows": n, "level": level})
            held["segments"].sort(key=lambda s: s["number"])
        self.wrote[name] = self.wrote.get(name, 0) + n
        return n

    def end(self, name: str, ids: DataFrame) -> int:
        """Tombstones for ``ids`` (id): their rows in all segments before this change no longer count."""
        return self.append(f"{name}_ends", ids.select(F.col("id").cast("long"), F.lit(self.state["number"] - 1).cast("long").alias("upto")), ["id"])

    def compacted(self, name: str, schema: str, id_col: str, order: list[str], fanout: int = FANOUT) -> list[int]:
        """Joins the newest ``fanout`` segments of one level, as long as there are so many; returns the rows of each join.

        Levels fall from the oldest segment to the newest, so that those of one level are neighbours.
        A join leaves ended rows out; once the oldest segment is in it, so are the tombstones up to there.
        """
        made = []
        while True:
            segments = self.state["tables"].get(name, {}).get("segments", [])
            tail = [s for s in segments if segments and s["level"] == segments[-1]["level"]]
            if len(tail) < fanout:
                return made
            rows = self._view().live(name, schema, id_col, of=tail).drop("seg")
            table = self.state["tables"][name]
            table["segments"] = [s for s in segments if s not in tail]
            made.append(self.append(name, rows, order, level=tail[-1]["level"] + 1, number=tail[-1]["number"]))
            if len(tail) == len(segments) and self._view().segments(f"{name}_ends"):
                left = self._view().rows(f"{name}_ends").where(F.col("upto") > tail[-1]["number"]).drop("seg")
                self.state["tables"][f"{name}_ends"]["segments"] = []
                self.append(f"{name}_ends", left, ["id"])

    def _view(self) -> Store:
        """The store as this change leaves it."""
        view = copy.copy(self.store)
        view.state = self.state
        return view

    def commit(self) -> dict:
        self.store.publish(self.state)
        return self.state
