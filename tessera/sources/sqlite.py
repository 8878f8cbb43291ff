"""SQLite files as a Spark source: `spark.read.format("sqlite")`, in ranges of a key and with filters in the file's own SQL.

Options: path (a file, or a folder of *.db files, at a place that driver and workers all
have mounted), table, key (a column of whole numbers, by whose ranges a file is read; without it a file
is one partition) rows (a partition's range of keys, about so many) and where (see `encoded`). The schema comes from the
table's declaration, or the one that is given. Files are opened for reading only.

`where` names filters that the file applies, as conditions that must all hold. They are an option, not what Spark pushes by itself:
in the Spark version used here, a filter that is pushed to a Python source stays with the relation, so that other uses of the
same DataFrame lose rows. A key that is null is in the first range.
"""

from __future__ import annotations

import glob
import json
import os
import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

BATCH = 10_000
#: Operators of `where`; SQLite compares numbers, and text by its bytes, as Spark does.
OPERATORS = ("=", "<", "<=", ">", ">=", "in", "is null", "is not null")


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _files(path: str) -> list[str]:
    path = path.removeprefix("file://").removeprefix("file:")
    found = sorted(glob.glob(os.path.join(glob.escape(path), "*.db"))) if os.path.isdir(path) else [path] if os.path.exists(path) else []
    if not found:
        raise FileNotFoundError(f"no SQLite file at {path}")
    return found


def _type(declared: str):
    d = declared.upper()
    return LongType() if "INT" in d else StringType() if any(x in d for x in ("CHAR", "CLOB", "TEXT")) else DoubleType() if any(x in d for x in ("REAL", "FLOA", "DOUB")) else BinaryType() if "BLOB" in d else StringType()


class Range(InputPartition):
    def __init__(self, file: str, where: str, values: tuple):
        super().__init__((file, where, values))
        self.file, self.where, self.values = file, where, values


class SqliteReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.path, self.table, self.key = options["path"], options["table"], options.get("key")
        self.rows, self.names = int(options.get("rows", 1_000_000)), schema.names
        self.where, self.values = [], []
        for name, operator, value in json.loads(options.get("where", "[]")):
            marks = f" ({', '.join('?' * len(value))})" if operator == "in" else "" if operator.startswith("is") else " ?"
            self.where.append(f"{_quoted(name)} {operator}{marks}")
            self.values += value if operator == "in" else [] if operator.startswith("is") else [value]

    def partitions(self) -> list[Range]:
        out = []
        for file in _files(self.path):
            if not self.key:
                out.append(Range(file, "1", ()))
                continue
            key = _quoted(self.key)
            with _open(file) as c:
                low, high, n = c.execute(f"SELECT min({key}), max({key}), count(*) FROM {_quoted(self.table)}").fetchone()
            if low is None:
                out.append(Range(file, "1", ()))
                continue
            step = max(1, -(-(high - low + 1) // max(1, -(-n // self.rows))))
            edges = [*range(low, high + 1, step), high + 1]
            for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                out.append(Range(file, f"({key} >= ? AND {key} < ?{f' OR {key} IS NULL' if not i else ''})", (a, b)))
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        columns = ", ".join(map(_quoted, self.names)) or "1"
        with _open(partition.file) as c:
            rows = c.execute(f"SELECT {columns} FROM {_quoted(self.table)} WHERE {' AND '.join([partition.where, *self.where])}", (*partition.values, *self.values))
            while batch := rows.fetchmany(BATCH):
                yield from batch


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> StructType:
        with _open(_files(self.options["path"])[0]) as c:
            columns = c.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not columns:
            raise ValueError(f"no table {self.options['table']}")
        return StructType([StructField(name, _type(declared), True) for _, name, declared, *_ in columns])

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(self.options, schema)


def encoded(where: list[tuple]) -> str:
    """Conditions (column, one of OPERATORS, value: a list for `in`, ignored for `is null` and `is not null`) as an option's text."""
    for _, operator, _ in where:
        if operator not in OPERATORS:
            raise ValueError(f"no operator {operator}")
    return json.dumps(where)


def read(spark: SparkSession, path: str, table: str, key: str | None = None, rows: int | None = None, schema: str | None = None, where: list[tuple] = ()) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    options = {"path": path, "table": table, "where": encoded(list(where))} | ({"key": key} if key else {}) | ({"rows": str(rows)} if rows else {})
    reader = spark.read.format("sqlite").options(**options)
    found = (reader.schema(schema) if schema else reader).load()
    if unknown := {name for name, *_ in where} - set(found.columns):
        raise ValueError(f"no column {', '.join(sorted(unknown))}")
    return found


def write(rows: DataFrame, folder: str, table: str) -> None:
    """Each task writes its rows as a SQLite file of its own below `folder`, under a name that only a finished file bears."""
    fields = [(f.name, {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "float": "REAL", "binary": "BLOB"}.get(f.dataType.simpleString(), "TEXT")) for f in rows.schema]
    local = folder.removeprefix("file://").removeprefix("file:")
    declared, marks = ", ".join(f"{_quoted(n)} {t}" for n, t in fields), ", ".join("?" * len(fields))

    def run(partition) -> None:
        from pyspark import TaskContext

        os.makedirs(local, exist_ok=True)
        at = os.path.join(local, f"part-{TaskContext.get().partitionId():05d}.db")
        attempt = f"{at}.{TaskContext.get().taskAttemptId()}"
        with sqlite3.connect(attempt) as c:
            c.execute(f"CREATE TABLE {_quoted(table)} ({declared})")
            c.executemany(f"INSERT INTO {_quoted(table)} VALUES ({marks})", (tuple(r) for r in partition))
        c.close()
        os.replace(attempt, at)

    rows.foreachPartition(run)
