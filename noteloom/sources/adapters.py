"""Connectors: anything that yields raw documents becomes a DataFrame."""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from noteloom.sources.pages import scan

SCHEMA = "content string, filename string"


class Adapter(Protocol):
    """A source of (content, filename) pairs, made without arguments.

    It may have parts() -> list of strings and fetch_part(part): then each part
    is a task of its own.
    """

    def fetch(self) -> Iterator[tuple[str, str]]: ...

    def target_dir(self) -> str: ...


def load_adapter(dotted: str) -> Adapter:
    """The adapter class of a dotted path, made."""
    module, _, name = dotted.rpartition(".")
    return getattr(importlib.import_module(module), name)()


class _Part(InputPartition):
    def __init__(self, part: str | None):
        super().__init__(part)
        self.part = part


class _Reader(DataSourceReader):
    def __init__(self, dotted: str):
        self.dotted = dotted

    def partitions(self) -> list[InputPartition]:
        adapter = load_adapter(self.dotted)
        return [_Part(p) for p in adapter.parts()] or [_Part(None)] if hasattr(adapter, "parts") else [_Part(None)]

    def read(self, partition: _Part) -> Iterator[tuple[str, str]]:
        adapter = load_adapter(self.dotted)
        yield from adapter.fetch() if partition.part is None else adapter.fetch_part(partition.part)


class AdapterSource(DataSource):
    """spark.read.format("noteloom_adapter").option("adapter", dotted path)."""

    @classmethod
    def name(cls) -> str:
        return "noteloom_adapter"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["adapter"])


def adapter_documents(spark: SparkSession, dotted: str) -> DataFrame:
    spark.dataSource.register(AdapterSource)
    return spark.read.format("noteloom_adapter").option("adapter", dotted).load()


def folder_documents(spark: SparkSession, folder: str) -> DataFrame:
    """content, filename of a folder's markdown files, without subfolder names;
    none for a folder that is not there."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], SCHEMA)
    return scan(spark, folder).select("content", F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"))
