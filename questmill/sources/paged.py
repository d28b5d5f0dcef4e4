"""A remote table, read in pages of a stable key and written in chunks, as a Spark data source.

The remote is any database with a DB-API module; `connect` names a function that
opens a connection, so that tasks open their own. SQL is kept to what SQLite and
PostgreSQL share.

Reading: the driver cuts the key's order into ranges, tasks walk through theirs by
"key greater than the last one", a page at a time, so rows that come or go between
two pages are neither repeated nor skipped. Filters on equality and lists of values
go along.

Writing: each task puts its rows, in chunks and many chunks a transaction, into a
staging table beside the target, under a name of its own attempt. Only when all tasks are done, one
transaction applies the rows of the attempts that Spark counts, and clears them. A
task that dies leaves nothing in the target, and a write that is repeated changes no
row.
"""

from __future__ import annotations

import importlib
import random
import re
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from questmill.functions.text import TRANSIENT

#: Rows of a page and of a chunk, tries, and the error codes and classes that a new try may mend; fixed values.
PAGE, CHUNK, TRIES = 1000, 80, 5
#: Chunks of a task that are staged in one transaction.
CHUNKS_STAGED = 250
RETRY_CODES = "40001 40P01 53300 53400 57014 57P01 57P03 58000 58030".split()
#: Words of a busy server; fixed values.
BUSY = r"timeout|temporarily unavailable|too many connections|502|503|504|429|database is locked"
MODES = ("upsert", "ignore", "delete", "update")


def is_transient(error: BaseException) -> bool:
    """Whether a new try may succeed: by the error's code, else by its words."""
    code = str(getattr(error, "pgcode", None) or getattr(error, "sqlstate", None) or "")
    return code in RETRY_CODES or code.startswith("08") or bool(re.search(rf"{TRANSIENT}|{BUSY}", str(error)))


def with_retry[T](run: Callable[[], T], tries: int = TRIES, sleep: Callable[[float], None] = time.sleep) -> T:
    """What run gives; after a transient error once more, up to so many tries, with waits that double."""
    for attempt in range(tries):
        try:
            return run()
        except Exception as error:
            if attempt + 1 == tries or not is_transient(error):
                raise
            sleep(min(8.0, 0.25 * 2**attempt) + random.random() * 0.15)
    raise AssertionError("no try was made")


def _name(s: str) -> str:
    return '"' + s.replace('"', '""') + '"'


@dataclass
class _Remote:
    """How to reach a table: module:function, its argument, table, key columns."""

    connect: str
    target: str
    table: str
    key: list[str]

    @classmethod
    def of(cls, options: dict[str, str]) -> _Remote:
        missing = [k for k in ("connect", "target", "dbtable", "key") if not options.get(k)]
        if missing:
            raise ValueError(f"options are missing: {', '.join(missing)}")
        return cls(options["connect"], options["target"], options["dbtable"], [k.strip() for k in options["key"].split(",")])

    def open(self):
        module, function = self.connect.split(":")
        return with_retry(lambda: getattr(importlib.import_module(module), function)(self.target))

    def once(self, con, sql: str, values: Sequence = ()) -> list[tuple]:
        mark = getattr(importlib.import_module(type(con).__module__.split(".")[0]), "paramstyle", "qmark")
        cur = con.cursor()
        cur.execute(sql if mark == "qmark" else sql.replace("?", "%s"), tuple(values))
        return cur.fetchall() if cur.description else []

    def run(self, con, sql: str, values: Sequence = ()) -> list[tuple]:
        return with_retry(lambda: self.once(con, sql, values))

    @property
    def keys(self) -> str:
        return ", ".join(map(_name, self.key))

    def staging(self, job: str) -> str:
        return f"{self.table}__{job}"


class KeyRange(InputPartition):
    """Keys behind after up to last; None: no bound. values: the list of a pushed filter that this partition takes."""

    def __init__(self, after: tuple | None, last: tuple | None, values: tuple[str, tuple] | None = None):
        self.after, self.last, self.values = after, last, values


class PagedReader(DataSourceReader):
    def __init__(self, remote: _Remote, schema: StructType, partitions: int, page: int):
        self.remote, self.names, self.n, self.page = remote, schema.fieldNames(), max(1, partitions), page
        self.equal: list[tuple[str, object]] = []
        self.listed: tuple[str, tuple] | None = None

    def _where(self, values: tuple[str, tuple] | None) -> tuple[list[str], list]:
        tests = [f"{_name(c)} = ?" for c, _ in self.equal]
        own = [v for _, v in self.equal]
        if values:
            tests.append(f"{_name(values[0])} IN ({', '.join('?' * len(values[1]))})")
            own += values[1]
        return tests, own

    def partitions(self) -> list[InputPartition]:
        """Ranges of about equal size; with a pushed list, a partition for each chunk of its values."""
        if self.listed:
            column, values = self.listed[0], list(dict.fromkeys(self.listed[1]))
            return [KeyRange(None, None, (column, tuple(values[i : i + CHUNK]))) for i in range(0, len(values), CHUNK)]
        r, con = self.remote, self.remote.open()
        try:
            tests, own = self._where(None)
            where = f" WHERE {' AND '.join(tests)}" if tests else ""
            ((count,),) = r.run(con, f"SELECT count(*) FROM {_name(r.table)}{where}", own)
            cuts = []
            for i in range(1, self.n):
                cuts += r.run(con, f"SELECT {r.keys} FROM {_name(r.table)}{where} ORDER BY {r.keys} LIMIT 1 OFFSET ?", [*own, count * i // self.n])
            ends = [None, *dict.fromkeys(cuts), None]
            return [KeyRange(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        finally:
            con.close()

    def read(self, partition: KeyRange) -> Iterator[tuple]:
        r, con = self.remote, self.remote.open()
        marks = f"({', '.join('?' * len(r.key))})"
        tests, own = self._where(partition.values)
        if partition.last is not None:
            tests, own = [*tests, f"({r.keys}) <= {marks}"], [*own, *partition.last]
        columns = ", ".join(map(_name, [*self.names, *r.key]))
        after = partition.after
        try:
            while True:
                now, values = (tests, own) if after is None else ([*tests, f"({r.keys}) > {marks}"], [*own, *after])
                where = f" WHERE {' AND '.join(now)}" if now else ""
                rows = r.run(con, f"SELECT {columns} FROM {_name(r.table)}{where} ORDER BY {r.keys} LIMIT {self.page}", values)
                for row in rows:
                    yield tuple(row[: len(self.names)])
                if len(rows) < self.page:
                    return
                after = tuple(rows[-1][len(self.names) :])
        finally:
            con.close()


class FilteringReader(PagedReader):
    """Takes filters on equality and one list of values along."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.value is not None:
                self.equal.append((f.attribute[0], f.value))
            elif isinstance(f, In) and len(f.attribute) == 1 and self.listed is None and None not in f.value:
                self.listed = (f.attribute[0], tuple(f.value))
            else:
                yield f


@dataclass
class Staged(WriterCommitMessage):
    attempt: str
    rows: int


class PagedWriter(DataSourceWriter):
    """Applies rows by key: upsert, ignore (insert what is absent), delete or update (columns of present rows)."""

    def __init__(self, remote: _Remote, schema: StructType, mode: str, chunk: int):
        if mode not in MODES:
            raise ValueError(f"mode {mode} is none of {', '.join(MODES)}")
        self.remote, self.names, self.mode, self.chunk, self.job = remote, schema.fieldNames(), mode, chunk, uuid.uuid4().hex[:12]
        if set(remote.key) - set(self.names):
            raise ValueError(f"rows need the key: {', '.join(remote.key)}")
        con = remote.open()
        try:
            columns = ", ".join(map(_name, self.names))
            remote.run(con, f"CREATE TABLE {_name(remote.staging(self.job))} AS SELECT {columns}, '' AS _attempt FROM {_name(remote.table)} WHERE 1 = 0")
            con.commit()
        finally:
            con.close()

    def write(self, rows: Iterator[Row]) -> Staged:
        r, con, attempt, count, held = self.remote, self.remote.open(), uuid.uuid4().hex, 0, []
        width = len(self.names) + 1

        def stage() -> None:
            """The held rows in chunks, as one transaction: all of them or none."""
            try:
                for i in range(0, len(held), self.chunk):
                    chunk = held[i : i + self.chunk]
                    marks = ", ".join([f"({', '.join('?' * width)})"] * len(chunk))
                    r.once(con, f"INSERT INTO {_name(r.staging(self.job))} VALUES {marks}", [v for row in chunk for v in row])
                con.commit()
            except Exception:
                con.rollback()
                raise

        def flush() -> None:
            with_retry(stage)
            held.clear()

        try:
            for row in rows:
                held.append([*row, attempt])
                count += 1
                if len(held) == self.chunk * CHUNKS_STAGED:
                    flush()
            if held:
                flush()
        finally:
            con.close()
        return Staged(attempt, count)

    def _merge(self, attempts: str) -> str:
        r = self.remote
        target, staged = _name(r.table), f"(SELECT * FROM {_name(r.staging(self.job))} WHERE _attempt IN ({attempts})) AS s"
        same = " AND ".join(f"s.{_name(k)} = {target}.{_name(k)}" for k in r.key)
        if self.mode == "delete":
            # By a list that is made once; a test of each row would read the staging table anew.
            return f"DELETE FROM {target} WHERE ({r.keys}) IN (SELECT {r.keys} FROM {staged})"
        rest = [n for n in self.names if n not in r.key]
        changed = " OR ".join(f"{{0}}.{_name(n)} IS DISTINCT FROM {{1}}.{_name(n)}" for n in rest)
        if self.mode == "update":
            values = ", ".join(f"{_name(n)} = s.{_name(n)}" for n in rest)
            return f"UPDATE {target} SET {values} FROM {staged} WHERE {same} AND ({changed.format(target, 's')})"
        columns = ", ".join(map(_name, self.names))
        into = f"INSERT INTO {target} ({columns}) SELECT {columns} FROM {staged} WHERE true ON CONFLICT ({r.keys}) DO"
        if self.mode == "ignore" or not rest:
            return f"{into} NOTHING"
        values = ", ".join(f"{_name(n)} = excluded.{_name(n)}" for n in rest)
        return f"{into} UPDATE SET {values} WHERE {changed.format(target, 'excluded')}"

    def commit(self, messages: list[Staged | None]) -> None:
        done = [m.attempt for m in messages if m is not None and m.rows]
        con = self.remote.open()
        try:
            if done:
                self.remote.run(con, self._merge(", ".join(["?"] * len(done))), done)
            self.remote.run(con, f"DROP TABLE {_name(self.remote.staging(self.job))}")
            con.commit()
        finally:
            con.close()

    def abort(self, messages: list[Staged | None]) -> None:
        con = self.remote.open()
        try:
            self.remote.run(con, f"DROP TABLE IF EXISTS {_name(self.remote.staging(self.job))}")
            con.commit()
        finally:
            con.close()


class PagedTable(DataSource):
    """Options: connect, target, dbtable, key (comma-joined); partitions and page to read; mode and chunk to write."""

    @classmethod
    def name(cls) -> str:
        return "paged_table"

    def reader(self, schema: StructType) -> PagedReader:
        kind = FilteringReader if self.options.get("pushdown") == "true" else PagedReader
        return kind(_Remote.of(self.options), schema, int(self.options.get("partitions", 8)), int(self.options.get("page", PAGE)))

    def writer(self, schema: StructType, overwrite: bool) -> PagedWriter:
        if overwrite:
            raise ValueError("paged_table applies rows by key: use mode append")
        return PagedWriter(_Remote.of(self.options), schema, self.options.get("mode", "upsert"), int(self.options.get("chunk", CHUNK)))


def sqlite(path: str):
    """A connection to a SQLite file in a shared folder; writers wait for each other."""
    import sqlite3

    return sqlite3.connect(path, timeout=120)


def read_paged(spark: SparkSession, schema: str, **options: str) -> DataFrame:
    """A remote table's rows; see PagedTable for the options. Filters go along where the session allows it to Python sources."""
    spark.dataSource.register(PagedTable)
    allowed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("paged_table").schema(schema).options(pushdown=allowed, **options).load()


def write_paged(rows: DataFrame, **options: str) -> None:
    """Apply rows, one for each key, to a remote table; see PagedTable for the options."""
    rows.sparkSession.dataSource.register(PagedTable)
    rows.write.format("paged_table").options(**options).mode("append").save()
