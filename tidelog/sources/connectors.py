"""Spark data sources over foreign stores' files: mutations of logs and tables, edits of manifests.

    spark.dataSource.register(LogSource); spark.read.format("tidelog_log").load(path)

Files are listed on the driver and read whole by executors, tables a few blocks
a partition. Paths are URIs of any store that pyarrow.fs opens.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tidelog.sources import formats

BLOCKS_TOGETHER = 256


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _files(path: str, *kinds: str) -> list[str]:
    store, base = _open(path)
    info = store.get_file_info(base)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base))
    return sorted(f.path for f in found if f.type == fs.FileType.File and ((n := formats.parse_name(f.base_name)) and n[0] in kinds or f is info))


def _read(path: str, file: str) -> bytes:
    with _open(path)[0].open_input_file(file) as f:
        return f.read()


@dataclass
class FilePart(InputPartition):
    file: str
    first: int = 0
    end: int = 0


class _Reader(DataSourceReader):
    kinds: tuple[str, ...] = ()

    def __init__(self, options: dict):
        self.path, self.options = options["path"], options

    def partitions(self) -> list[FilePart]:
        return [FilePart(f) for f in _files(self.path, *self.kinds)]


class LogReader(_Reader):
    kinds = ("log",)

    def read(self, part: FilePart) -> Iterator[tuple]:
        data = _read(self.path, part.file)
        mode = self.options.get("mode", "tolerate_tail")
        kept = formats.recover_log(data, mode)
        for (start, _, payload), _ in zip(formats.read_log(data).records, kept, strict=False):
            for seq, op, key, value in formats.decode_batch(payload):
                yield part.file, start, key, seq, op, value


class LogSource(DataSource):
    """Mutations of commit logs; option ``mode``: tolerate_tail, absolute or point_in_time."""

    @classmethod
    def name(cls) -> str:
        return "tidelog_log"

    def schema(self) -> str:
        return "file string, offset bigint, key binary, seq bigint, op tinyint, value binary"

    def reader(self, schema) -> LogReader:  # noqa: ANN001
        return LogReader(self.options)


class ManifestReader(_Reader):
    kinds = ("manifest",)

    def read(self, part: FilePart) -> Iterator[tuple]:
        for version, payload in enumerate(formats.recover_log(_read(self.path, part.file), "tolerate_tail")):
            e = formats.decode_edit(payload)
            plain = json.dumps(e, default=lambda b: b.hex())
            yield part.file, version, e.get("comparator"), e.get("log_number"), e.get("next_file"), e.get("last_seq"), len(e["added"]), len(e["deleted"]), plain


class ManifestSource(DataSource):
    """Edits of manifests, one row each; ``edit`` is all of it as JSON."""

    @classmethod
    def name(cls) -> str:
        return "tidelog_manifest"

    def schema(self) -> str:
        return "file string, version bigint, comparator string, log_number bigint, next_file bigint, last_seq bigint, added int, deleted int, edit string"

    def reader(self, schema) -> ManifestReader:  # noqa: ANN001
        return ManifestReader(self.options)


class TableReader(_Reader):
    kinds = ("sst",)

    def partitions(self) -> list[FilePart]:
        out = []
        for f in _files(self.path, *self.kinds):
            n = formats.Table(_read(self.path, f)).blocks()
            out += [FilePart(f, k, min(n, k + BLOCKS_TOGETHER)) for k in range(0, n, BLOCKS_TOGETHER)]
        return out

    def read(self, part: FilePart) -> Iterator[tuple]:
        table = formats.Table(_read(self.path, part.file))
        for block in range(part.first, part.end):
            for key, seq, op, value in table.records(block):
                yield part.file, key, seq, op, value


@dataclass
class Written(WriterCommitMessage):
    file: str | None


class TableWriter(DataSourceWriter):
    """A table file for each partition, whose rows are sorted by key and falling sequence."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        records = [(bytes(r["key"]), r["seq"], r["op"], None if r["value"] is None else bytes(r["value"])) for r in rows]
        if not records:
            return Written(None)
        store, base = _open(self.path)
        store.create_dir(base, recursive=True)
        name = f"{base}/{TaskContext.get().taskAttemptId() + 1:06d}.sst"
        with store.open_output_stream(name) as f:
            f.write(formats.write_table(records))
        return Written(name)

    def commit(self, messages: list) -> None:
        """Every file is whole once its task has ended."""

    def abort(self, messages: list) -> None:
        store, _ = _open(self.path)
        for m in messages:
            if m is not None and m.file:
                store.delete_file(m.file)


class TableSource(DataSource):
    """Records of sorted tables; also writes them."""

    @classmethod
    def name(cls) -> str:
        return "tidelog_table"

    def schema(self) -> str:
        return "file string, key binary, seq bigint, op tinyint, value binary"

    def reader(self, schema) -> TableReader:  # noqa: ANN001
        return TableReader(self.options)

    def writer(self, schema, overwrite: bool) -> TableWriter:  # noqa: ANN001
        return TableWriter(self.options)


def register(spark: SparkSession) -> None:
    for source in (LogSource, ManifestSource, TableSource):
        spark.dataSource.register(source)
