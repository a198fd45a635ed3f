"""The units of a folder of mixed files: as a data source, and of files that Spark has read.

    spark.dataSource.register(EvidenceSource)
    spark.read.format("evidence").option("category", "...").load("/cases/17")
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .units import SCHEMA, units_of

COLUMNS = [c.strip().split(" ")[0] for c in SCHEMA.replace("<string,string>", "").split(",")]
BATCH = 4096
PART_BYTES, OPEN_BYTES = 64 << 20, 1 << 20


class Files(InputPartition):
    """Files that one task reads: some small ones, or a large one."""

    def __init__(self, paths: list[str]):
        self.paths = paths


class EvidenceReader(DataSourceReader):
    """Lists files and plans tasks of about `partBytes`; each file counts `openBytes` besides its own."""

    def __init__(self, options: dict[str, str]):
        self.path, self.category = options["path"], options.get("category")
        self.part, self.open = int(options.get("partbytes", PART_BYTES)), int(options.get("openbytes", OPEN_BYTES))

    def _store(self):
        from pyarrow import fs

        if "://" not in self.path and not self.path.startswith("file:"):
            return fs.LocalFileSystem(), self.path
        return fs.FileSystem.from_uri(self.path.replace("file:/", "file:///", 1) if self.path.startswith("file:/") and not self.path.startswith("file://") else self.path)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = self._store()
        top = store.get_file_info(root)
        found = [top] if top.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        hidden = lambda p: any(x.startswith((".", "_")) for x in p[len(root) :].split("/"))
        files = sorted((-(f.size or 0), f.path) for f in found if f.type == fs.FileType.File and (f is top or not hidden(f.path)))
        parts, held, size = [], [], 0
        for less, path in files:
            cost = self.open - less
            if held and size + cost > self.part:
                parts.append(Files(held))
                held, size = [], 0
            held.append(path)
            size += cost
        return [*parts, Files(held)] if held else [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = self._store()
        for path in partition.paths:
            with store.open_input_file(path) as stream:
                yield from units_of(path, _Seekable(stream), self.category)


class _Seekable(io.RawIOBase):
    """A store's file as Python's readers expect one."""

    def __init__(self, stream):
        self._stream = stream

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        data = self._stream.read(len(into))
        into[: len(data)] = data
        return len(data)

    def seek(self, at: int, whence: int = 0) -> int:
        self._stream.seek(at, whence)
        return self._stream.tell()

    def tell(self) -> int:
        return self._stream.tell()


class EvidenceSource(DataSource):
    """`evidence`: units with their provenance. Options: path (a folder or a file of a store that pyarrow opens), category,
    partBytes, openBytes. Hidden files are left out; a file that can't be read gives a row with an error."""

    @classmethod
    def name(cls) -> str:
        return "evidence"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> EvidenceReader:
        return EvidenceReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EvidenceSource)


def of_files(files: DataFrame, category: str | None = None) -> DataFrame:
    """Units of a table of files (path, content and, if there, category), for stores that only Spark opens. Files without
    content give none."""
    declared = F.col("category") if "category" in files.columns else F.lit(category)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held = []
            for path, content, kind in zip(pdf["path"], pdf["content"], pdf["category"], strict=True):
                for row in units_of(path, io.BytesIO(bytes(content)), kind):
                    held.append(row)
                    if len(held) >= BATCH:
                        yield _frame(held)
                        held = []
            if held:
                yield _frame(held)

    return files.where("content IS NOT NULL").select("path", "content", declared.cast("string").alias("category")).mapInPandas(run, SCHEMA)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=COLUMNS)
    return out.astype({c: "Int64" for c in ("line", "row", "message")})
