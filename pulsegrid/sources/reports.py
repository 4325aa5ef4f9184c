"""Report folders that are replaced as a whole.

A report is written in two phases. Tasks write their rows as JSON lines into a version
folder of the report, each attempt into a file of its own; the driver then moves a manifest,
which names the version's committed files, over the old one. Readers follow the manifest
alone: before the move they see the old report, after it the new one, and never a part. A
failed write removes what its committed tasks left and leaves the manifest as it is.

The folder must be one that the driver and all executors share.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

MANIFEST = "manifest.json"
FORMAT = "report"


def local_path(path: str) -> str:
    """The path of a shared mount; other file systems are refused."""
    plain = path.removeprefix("file://").removeprefix("file:") if path.startswith("file:") else path
    if "://" in plain:
        raise ValueError(f"reports are written to a mounted folder, not to {path}")
    return plain


def manifest_of(path: str) -> dict | None:
    """The committed version of a report: id, schema, files and rows; None without one."""
    try:
        with open(os.path.join(local_path(path), MANIFEST), encoding="utf-8") as file:
            return json.load(file)
    except FileNotFoundError:
        return None


@dataclass
class _Written(WriterCommitMessage):
    file: str
    rows: int


class _ReportWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, keep: int):
        self.path, self.schema, self.keep = local_path(path), schema.json(), keep
        self.version = uuid.uuid4().hex

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        folder = os.path.join(self.path, self.version)
        os.makedirs(folder, exist_ok=True)
        name, rows = f"part-{uuid.uuid4().hex}.json", 0
        try:
            with open(os.path.join(folder, name), "w", encoding="utf-8") as file:
                for batch in iterator:
                    for row in batch.to_pylist():
                        file.write(json.dumps(row, default=str, ensure_ascii=False) + "\n")
                        rows += 1
        except BaseException:
            os.unlink(os.path.join(folder, name))
            raise
        return _Written(name, rows)

    def commit(self, messages: list) -> None:
        done = [m for m in messages if m is not None]
        os.makedirs(self.path, exist_ok=True)
        before = manifest_of(self.path)
        history = ([before["version"], *before["older"]] if before else [])[: self.keep]
        made = {"version": self.version, "older": history, "schema": json.loads(self.schema), "files": sorted(m.file for m in done if m.rows), "rows": sum(m.rows for m in done)}
        draft = os.path.join(self.path, f".{uuid.uuid4().hex}.tmp")
        with open(draft, "w", encoding="utf-8") as file:
            json.dump(made, file)
            file.flush()
            os.fsync(file.fileno())
        os.replace(draft, os.path.join(self.path, MANIFEST))

    def abort(self, messages: list) -> None:
        for message in messages:
            if message is not None:
                os.unlink(os.path.join(self.path, self.version, message.file))


@dataclass
class _Part(InputPartition):
    file: str


class _ReportReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = local_path(path), schema
        self.manifest = manifest_of(path)

    def partitions(self) -> list[InputPartition]:
        folder = os.path.join(self.path, self.manifest["version"])
        return [_Part(os.path.join(folder, f)) for f in self.manifest["files"]] or [_Part("")]

    def read(self, partition: _Part) -> Iterator[tuple]:
        if not partition.file:
            return
        types = [f.dataType for f in self.schema.fields]
        with open(partition.file, encoding="utf-8") as file:
            for line in file:
                row = json.loads(line)
                yield tuple(_as(row[f], kind) for f, kind in zip(self.schema.fieldNames(), types, strict=True))


def _as(value, kind):
    """A JSON value in its column's type: decimals, dates and times travel as texts."""
    if value is None:
        return None
    name = kind.typeName()
    if name == "decimal":
        from decimal import Decimal

        return Decimal(value)
    if name in ("date", "timestamp", "timestamp_ntz"):
        from datetime import date, datetime

        return date.fromisoformat(value) if name == "date" else datetime.fromisoformat(value)
    if name == "array":
        return [_as(v, kind.elementType) for v in value]
    if name == "struct":
        return tuple(_as(value[f.name], f.dataType) for f in kind.fields)
    return value


class ReportSource(DataSource):
    """``format("report")``: option ``path``, and ``keep``, the versions named in the history."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        found = manifest_of(self.options["path"])
        if found is None:
            raise FileNotFoundError(f"no report in {self.options['path']}")
        return StructType.fromJson(found["schema"])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ReportReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if not overwrite:
            raise ValueError("a report is replaced as a whole: use mode overwrite")
        return _ReportWriter(self.options["path"], schema, int(self.options.get("keep", "3")))


def write_report(df: DataFrame, path: str) -> None:
    """Replace the report in ``path`` by the rows of ``df``, in one step for its readers."""
    df.sparkSession.dataSource.register(ReportSource)
    df.write.format(FORMAT).mode("overwrite").option("path", path).save()


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The committed rows of the report in ``path``."""
    spark.dataSource.register(ReportSource)
    return spark.read.format(FORMAT).option("path", path).load()
