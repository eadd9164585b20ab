"""Tables of SQLite files, such as crawl stores, as a Spark data source: read by ranges of rowids, filtered by SQLite on request.

``spark.dataSource.register(SqliteSource)``, then
``spark.read.format("sqlite").option("table", "pages").load(path)``, or ``table``.  The file must be
readable under that path by every executor (a shared mount).  It is opened read-only;
a table without rowids is one partition.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringStartsWith
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

#: Rows of an Arrow batch; partitions where the option "partitions" names none.
BATCH, PARTITIONS = 10_000, 8
_COMPARE = {EqualTo: "=", EqualNullSafe: "IS", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
_ARROW = {LongType(): pa.int64(), DoubleType(): pa.float64(), BinaryType(): pa.binary(), StringType(): pa.string()}


def _name(identifier: str) -> str:
    return '"' + identifier.replace('"', '""') + '"'


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(path.removeprefix('file://'))}?mode=ro", uri=True)


def _type_of(declared: str) -> LongType | DoubleType | BinaryType | StringType:
    """The type of a column by SQLite's rules of affinity."""
    d = declared.upper()
    if "INT" in d:
        return LongType()
    if "CHAR" in d or "CLOB" in d or "TEXT" in d:
        return StringType()
    if "REAL" in d or "FLOA" in d or "DOUB" in d or "NUM" in d or "DEC" in d:
        return DoubleType()
    return BinaryType() if "BLOB" in d else StringType()


def _as(kind: object, value: object) -> object:
    """A value as its column's type has it: SQLite keeps any value in any column."""
    if value is None:
        return None
    try:
        if isinstance(kind, StringType):
            return value.decode("utf-8", "replace") if isinstance(value, bytes) else value if isinstance(value, str) else str(value)
        if isinstance(kind, BinaryType):
            return value if isinstance(value, bytes) else str(value).encode()
        return int(value) if isinstance(kind, LongType) else float(value)
    except ValueError:
        return None


class _Rows(InputPartition):
    def __init__(self, first: int | None, last: int | None):
        super().__init__((first, last))


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: StructType, parts: int):
        self.path, self.table, self.schema, self.parts = path, table, schema, parts
        self.where: list[tuple[str, list]] = []

    def partitions(self) -> list[InputPartition]:
        con = _open(self.path)
        try:
            first, last = con.execute(f"SELECT min(rowid), max(rowid) FROM {_name(self.table)}").fetchone()
        except sqlite3.OperationalError:
            return [_Rows(None, None)]
        finally:
            con.close()
        if first is None:
            return [_Rows(0, -1)]
        step = -(-(last - first + 1) // self.parts)
        return [_Rows(at, min(at + step - 1, last)) for at in range(first, last + 1, step)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        first, last = partition.value
        where = list(self.where) + ([("rowid BETWEEN ? AND ?", [first, last])] if first is not None else [])
        sql = f"SELECT {', '.join(map(_name, self.schema.names))} FROM {_name(self.table)}" + (" WHERE " + " AND ".join(f"({w})" for w, _ in where) if where else "")
        con = _open(self.path)
        try:
            cursor = con.execute(sql, [v for _, values in where for v in values])
            while rows := cursor.fetchmany(BATCH):
                columns = [pa.array([_as(f.dataType, v) for v in column], _ARROW[f.dataType]) for f, column in zip(self.schema.fields, zip(*rows, strict=True), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, self.schema.names)
        finally:
            con.close()


class PushedReader(SqliteReader):
    """A reader that lets SQLite filter."""

    def _said(self, f: Filter) -> tuple[str, list] | None:
        """The filter as a condition and its values; None if SQLite wouldn't take it as Spark does."""
        if isinstance(f, Not):
            inner = self._said(f.child) if isinstance(f.child, (EqualTo, In, IsNull, IsNotNull)) else None
            return inner and (f"NOT ({inner[0]})", inner[1])
        if len(getattr(f, "attribute", ())) != 1 or f.attribute[0] not in self.schema.names:
            return None
        name, kind = _name(f.attribute[0]), self.schema[f.attribute[0]].dataType
        if isinstance(f, (IsNull, IsNotNull)):
            return f"{name} IS {'NOT ' * isinstance(f, IsNotNull)}NULL", []
        values = list(f.value) if isinstance(f, In) else [f.value]
        # only values of the column's own kind: SQLite orders kinds, Spark casts them
        own = int if isinstance(kind, LongType) else (int, float) if isinstance(kind, DoubleType) else str if isinstance(kind, StringType) else ()
        if any(not isinstance(v, own) or isinstance(v, bool) for v in values):
            return None
        if isinstance(f, In):
            return f"{name} IN ({', '.join('?' * len(values))})", values
        if isinstance(f, StringStartsWith):
            return f"substr({name}, 1, {len(values[0])}) = ?", values
        return (f"{name} {_COMPARE[type(f)]} ?", values) if type(f) in _COMPARE else None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            said = self._said(f)
            if said is None:
                yield f
            else:
                self.where.append(said)


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> StructType:
        con = _open(self.options["path"])
        try:
            found = con.execute(f"PRAGMA table_info({_name(self.options['table'])})").fetchall()
        finally:
            con.close()
        if not found:
            raise ValueError(f"{self.options['path']} has no table {self.options['table']}")
        return StructType([StructField(name, _type_of(declared or "")) for _, name, declared, *_ in found])

    def reader(self, schema: StructType) -> SqliteReader:
        kind = PushedReader if self.options.get("push", "false").lower() == "true" else SqliteReader
        return kind(self.options["path"], self.options["table"], schema, int(self.options.get("partitions", PARTITIONS)))


def table(spark: SparkSession, path: str, name: str, partitions: int = PARTITIONS, push: bool = False) -> DataFrame:
    """A table of a SQLite file as a DataFrame.

    push lets SQLite filter.  Spark keeps one reader for a DataFrame, with the filters
    of its first scan, so a DataFrame that a plan reads more than once must be loaded
    without.
    """
    if push:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").option("table", name).option("partitions", partitions).option("push", str(push).lower()).load(path)
