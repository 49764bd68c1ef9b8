"""Activity pages as a data source, for batches and for streams whose offset is the last page that was read.

Pages are files below a folder, one JSON object a line, whose names are in the order in which they were landed.  A page
is read whole by one task; folders are listed on the driver, through pyarrow's file systems.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .readers import ACTIVITY_PAGE


def _folder(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Page(InputPartition):
    path: str
    name: str


class _Pages:
    def __init__(self, options: dict):
        self.path = options["path"]

    def names(self) -> list[str]:
        from pyarrow import fs

        system, path = _folder(self.path)
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return sorted(f.base_name for f in found if f.is_file and not f.base_name.startswith(("_", ".")))

    def read(self, partition: Page) -> Iterator[tuple]:
        system, path = _folder(partition.path)
        with system.open_input_stream(f"{path.rstrip('/')}/{partition.name}") as stream:
            held = b""
            while True:
                piece = stream.read(1 << 20)
                *lines, held = (held + piece).split(b"\n")
                if not piece:
                    lines, held = [*lines, held], b""
                for line in lines:
                    if line.strip():
                        yield self._row(json.loads(line))
                if not piece:
                    return

    @staticmethod
    def _row(x: dict) -> tuple:
        data, duration = x.get("data"), x.get("duration")
        text = data if data is None or isinstance(data, str) else json.dumps(data, separators=(",", ":"), ensure_ascii=False)
        return x.get("bucket_id"), x.get("page"), x.get("id"), x.get("timestamp"), None if duration is None else float(duration), text


class _Batch(_Pages, DataSourceReader):
    def partitions(self) -> list[Page]:
        return [Page(self.path, n) for n in self.names()]


class _Stream(_Pages, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"page": ""}

    def latestOffset(self) -> dict:
        return {"page": max(self.names(), default="")}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return [Page(self.path, n) for n in self.names() if start["page"] < n <= end["page"]]

    def commit(self, end: dict) -> None:
        """Pages stay where they are: what was read is in the checkpoint."""


class ActivityPages(DataSource):
    """format("activity_pages").load(folder), read or readStream."""

    @classmethod
    def name(cls) -> str:
        return "activity_pages"

    def schema(self) -> str:
        return ACTIVITY_PAGE

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ActivityPages)
