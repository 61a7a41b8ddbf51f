"""Sources: files, lists of files, paths, SQL databases, a session-wide store of named frames, warehouse connectors."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession

#: Reader and writer names in use elsewhere, as formats of Spark.
FORMATS = {"csv": "csv", "parquet": "parquet", "json": "json", "orc": "orc", "table": "csv", "text": "text", "avro": "avro"}
#: Options of such readers and writers, as options of Spark; None means the option has no counterpart and is left out.
OPTIONS = {"sep": "sep", "delimiter": "sep", "encoding": "encoding", "compression": "compression", "index": None, "quotechar": "quote", "escapechar": "escape", "date_format": "dateFormat", "na_rep": "nullValue", "na_values": "nullValue"}


def file_format(name: str) -> str:
    """``read_csv``, ``to_parquet`` or plain ``orc`` as a format of Spark."""
    short = name.removeprefix("read_").removeprefix("to_")
    if short not in FORMATS:
        raise ValueError(f"no format for {name!r}")
    return FORMATS[short]


def file_options(fmt: str, options: dict[str, Any]) -> dict[str, Any]:
    """Options in the names of Spark; a CSV has a header unless told otherwise."""
    out: dict[str, Any] = {"header": True, "inferSchema": True} if fmt == "csv" else {}
    for k, v in options.items():
        to = OPTIONS.get(k, k)
        if to is not None:
            out[to] = v
    return out


class Source(Protocol):
    """Whatever yields the input of a transform."""

    def read(self, spark: SparkSession) -> Any: ...


@dataclass
class FileSource:
    """One file or folder. ``columns`` are pruned in the scan; ``schema`` spares the inference pass over text formats."""

    path: str
    reader: str = "read_csv"
    columns: list[str] | None = None
    schema: Any = None
    options: dict[str, Any] = field(default_factory=dict)

    def read(self, spark: SparkSession) -> DataFrame:
        fmt = file_format(self.reader)
        options = file_options(fmt, self.options)
        reader = spark.read.format(fmt)
        if self.schema is not None:
            options.pop("inferSchema", None)
            reader = reader.schema(self.schema)
        df = reader.options(**options).load(self.path)
        return df.select(*self.columns) if self.columns else df

    def __str__(self) -> str:
        return self.path


@dataclass
class MultiFileSource:
    """Several files of one format, as a list of frames; nothing is read before it is used."""

    paths: list[str]
    reader: str = "read_csv"
    options: dict[str, Any] = field(default_factory=dict)

    def read(self, spark: SparkSession) -> list[DataFrame]:
        return [FileSource(p, self.reader, options=self.options).read(spark) for p in self.paths]

    def __str__(self) -> str:
        return str(self.paths)


@dataclass
class PathSource:
    """A path, or a list of them, handed on unread."""

    path: str | list[str]

    def read(self, spark: SparkSession) -> str | list[str]:
        return self.path

    def __str__(self) -> str:
        return str(self.path)


def quoted(name: str) -> str:
    """A table name for use inside SQL, its parts quoted."""
    return ".".join('"' + part.replace('"', '""') + '"' for part in name.split("."))


@dataclass
class Database:
    """Options of a JDBC connection; the port is part of the address."""

    user: str
    password: str
    host: str
    port: int
    database: str
    protocol: str = "postgresql"

    @property
    def url(self) -> str:
        return f"jdbc:{self.protocol}://{self.host}:{self.port}/{self.database}"

    def options(self) -> dict[str, str]:
        return {"url": self.url, "user": self.user, "password": self.password}

    def query(self, spark: SparkSession, sql: str) -> DataFrame:
        return spark.read.format("jdbc").options(**self.options(), query=sql).load()

    def table(self, spark: SparkSession, name: str, column: str | None = None, bounds: tuple[Any, Any] | None = None, partitions: int = 8) -> DataFrame:
        """A whole table, read in parallel ranges of ``column`` where one is given."""
        options: dict[str, Any] = {**self.options(), "dbtable": quoted(name)}
        if column and bounds:
            options |= {"partitionColumn": column, "lowerBound": bounds[0], "upperBound": bounds[1], "numPartitions": partitions}
        return spark.read.format("jdbc").options(**options).load()

    def has_table(self, spark: SparkSession, name: str, schema: str = "public") -> bool:
        known = "SELECT table_schema, table_name FROM information_schema.tables"
        return self.query(spark, known).where(f"table_schema = '{schema}' and table_name = '{name}'").limit(1).count() == 1


@dataclass
class QuerySource:
    """A SQL text, against a database if one is given, else against the session's views and tables."""

    sql: str
    database: Database | None = None

    def read(self, spark: SparkSession) -> DataFrame:
        return self.database.query(spark, self.sql) if self.database else spark.sql(self.sql)

    def __str__(self) -> str:
        return self.sql


@dataclass
class TableSource:
    """A table by name: of a database, else of the session's catalog."""

    name: str
    database: Database | None = None

    def read(self, spark: SparkSession) -> DataFrame:
        return self.database.table(spark, self.name) if self.database else spark.table(self.name)

    def exists(self, spark: SparkSession) -> bool:
        return self.database.has_table(spark, self.name) if self.database else spark.catalog.tableExists(self.name)

    def __str__(self) -> str:
        return self.name


@dataclass
class WarehouseSource:
    """A query of a cloud warehouse through its connector, which must be on the class path."""

    sql: str
    credentials: str | None = None
    format: str = "bigquery"

    def read(self, spark: SparkSession) -> DataFrame:
        options = {"query": self.sql, "viewsEnabled": "true"} | ({"credentialsFile": self.credentials} if self.credentials else {})
        return spark.read.format(self.format).options(**options).load()

    def __str__(self) -> str:
        return self.sql


class FrameStore:
    """Named frames shared within a session: written once, then read by name. ``persist`` keeps them in memory and on disk."""

    def __init__(self, spark: SparkSession, prefix: str = "stored_"):
        self.spark, self.prefix = spark, prefix

    @staticmethod
    def new_id() -> str:
        return uuid.uuid4().hex

    def exists(self, name: str) -> bool:
        return any(t.isTemporary and t.name.lower() == (self.prefix + name).lower() for t in self.spark.catalog.listTables())

    def put(self, df: DataFrame, name: str, overwrite: bool = True) -> str:
        """Stores ``df``; an existing name raises unless it may be overwritten."""
        if not overwrite and self.exists(name):
            raise ValueError(f"{name} is already stored")
        df.persist().createOrReplaceTempView(self.prefix + name)
        return name

    def get(self, name: str) -> DataFrame:
        return self.spark.table(self.prefix + name)


@dataclass
class StoreSource:
    """A stored frame by name."""

    store: FrameStore
    name: str

    def read(self, spark: SparkSession) -> DataFrame:
        return self.store.get(self.name)

    def __str__(self) -> str:
        return self.name
