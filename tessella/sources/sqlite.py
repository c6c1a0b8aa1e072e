"""SQLite files as a source: one file or a folder of them, filters pushed into the file, new rows as a stream, and their writer."""

from __future__ import annotations

import hashlib
import os
import sqlite3
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith


def connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def files_of(path: str) -> list[str]:
    """The file, or a folder's files by name."""
    path = path.removeprefix("file://").removeprefix("file:")
    return sorted(map(str, Path(path).glob("*.sqlite"))) if os.path.isdir(path) else [path]


def source_version(path: str) -> str:
    """A tag of what the files hold: their name and the first twelve digits of a SHA-256, read block by block."""
    digest = hashlib.sha256()
    for name in files_of(path):
        with open(name, "rb") as file:
            while block := file.read(1 << 20):
                digest.update(block)
    return f"{Path(path).stem}-{digest.hexdigest()[:12]}"


class SqliteSource(DataSource):
    """format("sqlite"): a table of SQLite files, in row order, with row_number and every value as text.

    Options: path (a file, or a folder of .sqlite files, read one behind the other by name), table, required (column
    names, by comma), limit, rows_per_partition. Files must be readable from every executor, as in a shared folder.
    Filters on row_number leave whole partitions out; equality, lists, beginnings and nulls of other columns are asked
    of the file, and Spark asks them again, as SQLite's numbers as text needn't be Python's; such rows always come. As a
    stream, a file's rows beyond the last row id that was read are new; rows must be appended, never changed, and
    row_number is the row id then.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def columns(self) -> list[str]:
        files = files_of(self.options["path"])
        if not files:
            raise ValueError(f"there is no SQLite file in {self.options['path']}")
        with connect(files[0]) as db:
            found = [r[1] for r in db.execute(f"pragma table_info({quoted(self.options['table'])})")]
        if not found:
            raise ValueError(f"there is no table {self.options['table']}")
        if missing := sorted({c for c in self.options.get("required", "").split(",") if c} - set(found)):
            raise ValueError(f"columns are missing: {', '.join(missing)}")
        return found

    def schema(self) -> str:
        return ", ".join(["row_number bigint", *(f"`{c}` string" for c in self.columns())])

    def reader(self, schema) -> DataSourceReader:
        return SqliteReader(self.options, self.columns())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return SqliteStream(self.options, self.columns())


def register(spark: SparkSession) -> None:
    """Makes format("sqlite") known to a session, which must allow filters to be pushed into Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)


def as_text(row: tuple) -> tuple:
    return tuple(None if v is None else str(v) for v in row)


def asked_of_file(column: str, value_filter: Filter) -> tuple[str, list] | None:
    """A condition in SQL that holds for all rows that pass the filter, and its values; null if there is none."""
    name = quoted(column)
    odd = f"typeof({name}) in ('real', 'blob')"
    match value_filter:
        case EqualTo(_, str(v)):
            return f"({odd} or cast({name} as text) = ?)", [v]
        case In(_, values) if values and len(values) <= 500 and all(isinstance(v, str) for v in values):
            return f"({odd} or cast({name} as text) in ({', '.join('?' * len(values))}))", list(values)
        case StringStartsWith(_, str(v)):
            return f"({odd} or substr(cast({name} as text), 1, ?) = ?)", [len(v), v]
        case IsNotNull(_):
            return f"{name} is not null", []
        case IsNull(_):
            return f"{name} is null", []
    return None


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]) -> None:
        self.path, self.table, self.names = options["path"], quoted(options["table"]), columns
        self.limit, self.step = int(options.get("limit", -1)), int(options.get("rows_per_partition", 10_000))
        self.least, self.most = 1, 1 << 62
        self.conditions: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = ".".join(f.attribute) if hasattr(f, "attribute") else None
            if column == "row_number":
                match f:
                    case EqualTo(_, int(v)):
                        self.least, self.most = max(self.least, v), min(self.most, v)
                    case GreaterThan(_, int(v)):
                        self.least = max(self.least, v + 1)
                    case GreaterThanOrEqual(_, int(v)):
                        self.least = max(self.least, v)
                    case LessThan(_, int(v)):
                        self.most = min(self.most, v - 1)
                    case LessThanOrEqual(_, int(v)):
                        self.most = min(self.most, v)
            elif column in self.names and (made := asked_of_file(column, f)):
                self.conditions.append(made)
            yield f  # what the file answers is a first choice; Spark decides

    def partitions(self) -> list[InputPartition]:
        """(file, first row id, how many rows, rows before): one pass over the ids, so that no partition has to skip rows."""
        made, total = [], 0
        for path in files_of(self.path):
            left = -1 if self.limit < 0 else max(0, self.limit - total)
            with connect(path) as db:
                begins, n = [], 0
                for n, (rowid,) in enumerate(db.execute(f"select rowid from {self.table} order by rowid limit ?", (left,)), 1):
                    if n % self.step == 1 or self.step == 1:
                        begins.append(rowid)
            made += [(path, rowid, min(self.step, n - k * self.step), total + k * self.step) for k, rowid in enumerate(begins)]
            total += n
        within = [p for p in made if p[3] + 1 <= self.most and p[3] + p[2] >= self.least]
        return [InputPartition(p) for p in within] or [InputPartition(("", 0, 0, 0))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path, first, n, before = partition.value
        if not n:
            return
        listed = ", ".join(map(quoted, self.names))
        where = " and ".join(["true", *(c for c, _ in self.conditions)])
        values = [v for _, given in self.conditions for v in given]
        rows = f"select row_number() over (order by rowid) as place, {listed} from {self.table} where rowid >= ? order by rowid limit ?"
        with connect(path) as db:
            for place, *row in db.execute(f"select * from ({rows}) where {where} order by place", (first, n, *values)):
                yield (before + place, *as_text(row))


class SqliteStream(DataSourceStreamReader):
    """Offsets are row ids; one file."""

    def __init__(self, options: dict, columns: list[str]) -> None:
        files = files_of(options["path"])
        if len(files) != 1:
            raise ValueError("a stream reads one file")
        self.path, self.table, self.names = files[0], quoted(options["table"]), columns
        self.step = int(options.get("rows_per_partition", 10_000))

    def initialOffset(self) -> dict:
        return {"rowid": 0}

    def latestOffset(self) -> dict:
        with connect(self.path) as db:
            return {"rowid": db.execute(f"select coalesce(max(rowid), 0) from {self.table}").fetchone()[0]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition((a, min(a + self.step, end["rowid"]))) for a in range(start["rowid"], end["rowid"], self.step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        listed = ", ".join(map(quoted, self.names))
        with connect(self.path) as db:
            for rowid, *row in db.execute(f"select rowid, {listed} from {self.table} where rowid > ? and rowid <= ? order by rowid", partition.value):
                yield (rowid, *as_text(row))

    def commit(self, end: dict) -> None:
        pass


def filed(folder: str, table: str, names: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tried = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        os.makedirs(folder, exist_ok=True)
        draft, done = f"{folder}/.part-{part:05d}-{tried}", f"{folder}/part-{part:05d}.sqlite"
        written = 0
        with sqlite3.connect(draft) as db:
            db.execute(f"create table {quoted(table)} ({', '.join(map(quoted, names))})")
            for batch in batches:
                db.executemany(f"insert into {quoted(table)} values ({', '.join('?' * len(names))})", zip(*(c.to_pylist() for c in batch.columns)))
                written += batch.num_rows
        db.close()
        os.replace(draft, done)  # a task that runs again replaces its file as a whole
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([written], pa.int64())], ["part", "rows"])

    return run


def write_files(rows: DataFrame, table: str, folder: str) -> int:
    """Each partition as a SQLite file of a folder that all executors share; the number of rows. Columns must be numbers or strings."""
    plain = folder.removeprefix("file://").removeprefix("file:")
    return sum(r["rows"] for r in rows.mapInArrow(filed(plain, table, rows.columns), "part int, rows long").collect())
