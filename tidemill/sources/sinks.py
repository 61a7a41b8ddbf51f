"""Sinks: files, SQL tables, the store of named frames, warehouses, fitted tables, temporary file names."""

from __future__ import annotations

import os
import random
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.sources.tables import Database, FrameStore, file_format, file_options, quoted

#: What to do with an existing table, as save modes of Spark.
MODES = {"replace": "overwrite", "append": "append", "fail": "errorifexists"}


class Sink(Protocol):
    """Whatever takes the output of a transform."""

    def write(self, df: DataFrame) -> None: ...


@dataclass
class FileSink:
    """A folder of files of one format."""

    path: str
    writer: str = "to_csv"
    mode: str = "overwrite"
    partition_by: list[str] = field(default_factory=list)
    options: dict[str, Any] = field(default_factory=dict)

    def write(self, df: DataFrame) -> None:
        fmt = file_format(self.writer)
        options = file_options(fmt, self.options)
        options.pop("inferSchema", None)
        df.write.format(fmt).mode(self.mode).options(**options).partitionBy(*self.partition_by).save(self.path)

    def __str__(self) -> str:
        return self.path


@dataclass
class DatabaseSink:
    """A SQL table written in batches through JDBC; ``drop`` makes the table anew."""

    name: str
    database: Database
    if_exists: str = "append"
    drop: bool = False
    batch: int = 10_000

    def options(self) -> dict[str, Any]:
        return {**self.database.options(), "dbtable": quoted(self.name), "batchsize": self.batch, "truncate": not self.drop}

    def write(self, df: DataFrame) -> None:
        df.write.format("jdbc").options(**self.options()).mode("overwrite" if self.drop else MODES[self.if_exists]).save()


@dataclass
class TableSink:
    """A table of the session's catalog."""

    name: str
    if_exists: str = "replace"

    def write(self, df: DataFrame) -> None:
        df.write.mode(MODES[self.if_exists]).saveAsTable(self.name)


@dataclass
class WarehouseSink:
    """A table of a cloud warehouse through its connector. An empty frame is not written; nested and binary columns go as strings."""

    name: str
    credentials: str | None = None
    drop: bool = True
    format: str = "bigquery"

    def prepared(self, df: DataFrame) -> DataFrame:
        plain = {"tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "date", "timestamp", "timestamp_ntz", "string"}
        return df.select(*(F.col(c) if t in plain or t.startswith("decimal") else F.col(c).cast("string").alias(c) for c, t in df.dtypes))

    def write(self, df: DataFrame) -> bool:
        if df.isEmpty():
            return False
        options = {"table": self.name} | ({"credentialsFile": self.credentials} if self.credentials else {})
        self.prepared(df).write.format(self.format).options(**options).mode("overwrite" if self.drop else "append").save()
        return True


@dataclass
class StoreSink:
    """A named frame of the session's store."""

    store: FrameStore
    name: str
    overwrite: bool = True

    def write(self, df: DataFrame) -> None:
        self.store.put(df, self.name, self.overwrite)


@dataclass
class NullSink:
    """Runs the frame and keeps nothing."""

    def write(self, df: DataFrame) -> None:
        df.write.format("noop").mode("overwrite").save()


class NameGenerator:
    """File names of a stem and a seeded hexadecimal tag; a position gives the same name each time."""

    def __init__(self, path: str = "", filename: str = "X", length: int = 4, separator: str = "_", seed: int = 123):
        self.path, self.filename, self.length, self.separator = path, filename, length, separator
        self._random = random.Random(seed)
        self._tags: list[str] = []

    def tag(self) -> str:
        """The next tag: hexadecimal digits drawn one by one."""
        made = "".join(self._random.choice("0123456789abcdef") for _ in range(self.length))
        self._tags.append(made)
        return made

    def name(self, position: int | None = None) -> str:
        """The next name, or the one at ``position``, counted from one."""
        if position is None:
            self.tag()
            position = len(self._tags)
        while len(self._tags) < position:
            self.tag()
        return os.path.join(self.path, f"{self.filename}{self.separator}{self._tags[position - 1]}")
