"""Sources that give their rows page by page, as a Spark data source.

A service answers with a page of a list: so many rows from a place on, of a stretch of
time.  ``register`` makes ``spark.read.format("pages")`` read it: each partition is a range
of lists, and the rows of one list are asked for page by page until one is short.  A
list of more than ``max_pages`` pages is an error, not a loop without end.
``readStream`` asks all lists for what came since the last batch; its offset is one time.

The service is a class, named by its import path in option ``service``, made with the
other options on the driver and on the executors:

    SCHEMA                                               DDL of the rows
    lists() -> int                                       how many lists there are
    page(number, start, count, since, until) -> list     rows of since <= time < until from ``start`` on; None has no bound
    latest() -> int                                      the time up to which rows are complete (streams only)
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

_ROWS = pa.schema([("at", pa.int64()), ("match_id", pa.string())])


def service_of(options: dict):
    module, _, name = options["service"].rpartition(".")
    return getattr(importlib.import_module(module), name)


class Lists(InputPartition):
    """Lists from ``lo`` up to ``hi``, and of their rows those of a stretch of time."""

    def __init__(self, lo: int, hi: int, since: int | None = None, until: int | None = None):
        self.lo, self.hi, self.since, self.until = lo, hi, since, until


class Pages:
    """Asks a service for rows."""

    def __init__(self, options: dict):
        self.options = dict(options)
        self.size, self.most, self.parts = (int(options.get(k, d)) for k, d in (("page_size", 100), ("max_pages", 100), ("partitions", 8)))

    def service(self):
        return service_of(self.options)(self.options)

    def partitions(self, since: int | None = None, until: int | None = None) -> list[Lists]:
        n = self.service().lists()
        step = max(1, -(-n // self.parts))
        return [Lists(lo, min(n, lo + step), since, until) for lo in range(0, n, step)] or [Lists(0, 0)]

    def rows(self, part: Lists) -> Iterator[tuple]:
        service = self.service()
        for number in range(part.lo, part.hi):
            ask = lambda k, count, number=number: service.page(number, k * self.size, count, part.since, part.until)
            for k in range(self.most):
                page = ask(k, self.size)
                yield from page
                if len(page) < self.size:
                    break
            else:
                if ask(self.most, 1):
                    raise ValueError(f"list {number} has more than {self.most} pages of {self.size} rows")


class PageReader(DataSourceReader):
    def __init__(self, pages: Pages):
        self.pages = pages

    def partitions(self) -> list[Lists]:
        return self.pages.partitions()

    def read(self, partition: Lists) -> Iterator[tuple]:
        yield from self.pages.rows(partition)


class PageStream(DataSourceStreamReader):
    """Offsets are the time up to which rows have been read."""

    def __init__(self, pages: Pages):
        self.pages = pages

    def initialOffset(self) -> dict:
        return {"until": int(self.pages.options.get("since", 0))}

    def latestOffset(self) -> dict:
        return {"until": self.pages.service().latest()}

    def partitions(self, start: dict, end: dict) -> list[Lists]:
        return self.pages.partitions(start["until"], end["until"])

    def read(self, partition: Lists) -> Iterator[tuple]:
        yield from self.pages.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return service_of(self.options).SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(Pages(self.options))

    def streamReader(self, schema) -> PageStream:
        return PageStream(Pages(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)


class HistoryFiles:
    """Match histories in the shared folder, newest first: option ``path`` holds a folder
    ``list=<n>`` of Parquet files with columns at (seconds) and match_id for each player.

    It stands for the service that gives a player's match ids in pages.  The rows of one list
    and stretch of time are read and sorted once (some 20 bytes each stay in memory), so
    a page's work is that of its own rows.
    """

    SCHEMA = "list int, at long, match_id string"

    def __init__(self, options: dict):
        self.files, self.path = fs.FileSystem.from_uri(options["path"])
        self.known: tuple[tuple | None, pa.Table | None] = (None, None)

    def _names(self, path: str) -> list[str]:
        return [f.base_name for f in self.files.get_file_info(fs.FileSelector(path, allow_not_found=True))]

    def lists(self) -> int:
        return 1 + max((int(n.split("=")[1]) for n in self._names(self.path) if n.startswith("list=")), default=-1)

    def _newest_first(self, number: int, since: int | None, until: int | None) -> pa.Table:
        """The rows of a list and of a stretch of time in order, kept until others are asked for."""
        if self.known[0] != (number, since, until):
            folder = f"{self.path}/list={number}"
            bounds = [("at", op, time) for op, time in ((">=", since), ("<", until)) if time is not None] or None
            tables = [pq.read_table(f"{folder}/{n}", filesystem=self.files, columns=["at", "match_id"], filters=bounds, partitioning=None) for n in self._names(folder) if n.endswith(".parquet")]
            rows = pa.concat_tables([_ROWS.empty_table(), *(t.cast(_ROWS) for t in tables)])
            self.known = (number, since, until), rows.sort_by([("at", "descending"), ("match_id", "descending")]).combine_chunks()
        return self.known[1]

    def page(self, number: int, start: int, count: int, since: int | None, until: int | None) -> list[tuple]:
        page = self._newest_first(number, since, until).slice(start, count)
        return [(number, a, m) for a, m in zip(page.column("at").to_pylist(), page.column("match_id").to_pylist())]

    def latest(self) -> int:
        """The time in the file ``latest``, which whoever adds rows writes after them."""
        with self.files.open_input_stream(f"{self.path}/latest") as f:
            return int(f.read())
