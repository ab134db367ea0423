"""A feed of pages in a folder, newer ones under greater cursors, as a data source for tables and streams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


def _open(path: str):
    """The file system of a path (local, or one that a URI names) and the path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def cursors(path: str) -> list[str]:
    """The cursors of the pages that are there, ascending as text."""
    from pyarrow import fs

    files, folder = _open(path)
    found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.base_name.removeprefix("cursor=") for f in found if f.type == fs.FileType.Directory and f.base_name.startswith("cursor="))


@dataclass
class Page(InputPartition):
    path: str
    cursor: str


def page_rows(page: Page | None) -> Iterator[tuple[str, str]]:
    """cursor and item (JSON text) of each line that is not blank of a page's files, in the order of their names; none of no page."""
    from pyarrow import fs

    if page is None:
        return
    files, folder = _open(page.path)
    found = files.get_file_info(fs.FileSelector(f"{folder}/cursor={page.cursor}"))
    for name in sorted(f.path for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))):
        with files.open_input_stream(name) as lines:
            rest = b""
            while block := lines.read(1 << 20):
                *whole, rest = (rest + block).split(b"\n")
                yield from ((page.cursor, line.decode()) for line in whole if line.strip())
            if rest.strip():
                yield page.cursor, rest.decode()


class _Batch(DataSourceReader):
    def __init__(self, path: str, since: str):
        self.path, self.since = path, since

    def partitions(self) -> list[Page]:
        return [Page(self.path, c) for c in cursors(self.path) if c > self.since]

    def read(self, partition: Page) -> Iterator[tuple[str, str]]:
        return page_rows(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str, since: str):
        self.path, self.since = path, since

    def initialOffset(self) -> dict:
        return {"cursor": self.since}

    def latestOffset(self) -> dict:
        return {"cursor": max([self.since, *cursors(self.path)])}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return [Page(self.path, c) for c in cursors(self.path) if start["cursor"] < c <= end["cursor"]]

    def read(self, partition: Page) -> Iterator[tuple[str, str]]:
        return page_rows(partition)

    def commit(self, end: dict) -> None:
        """Pages are left where they are."""


class PageFeed(DataSource):
    """Format ``pages``: cursor and item of ``<path>/cursor=<cursor>/*``, a partition a page; ``since``: only later cursors.

    As a stream its offset is the last cursor, which Spark keeps in the checkpoint: a stream that was stopped goes on after it,
    and a batch that was not finished is read again, page by page the same. A page must be whole when its folder appears
    (written elsewhere and renamed); one with a cursor that the stream has passed is not seen.
    """

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "cursor string, item string"

    def _where(self) -> tuple[str, str]:
        if not self.options.get("path"):
            raise ValueError("a feed needs a path")
        return self.options["path"].rstrip("/"), self.options.get("since", "")

    def reader(self, schema) -> DataSourceReader:
        return _Batch(*self._where())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(*self._where())


def read(spark: SparkSession, path: str, since: str = "") -> DataFrame:
    """The pages after a cursor as a table."""
    spark.dataSource.register(PageFeed)
    return spark.read.format("pages").option("since", since).load(path)


def read_stream(spark: SparkSession, path: str, since: str = "") -> DataFrame:
    spark.dataSource.register(PageFeed)
    return spark.readStream.format("pages").option("since", since).load(path)
