"""A paged remote source as a Spark data source, with a budget of pages and rows for each request.

The transport is a function (request, cursor, size) -> (records, next cursor or None); it is sent to the executors, so
nothing here opens a connection. Each request is a partition. A request whose budget ends before its pages do is not an
error: its last row says so.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Rows a page, pages and rows a request at most.
PAGE, PAGES, ROWS = 200, 100, 20_000
SCHEMA = "request string, page int, place int, record string, partial boolean"


def fetch_all(fetch: Callable, request: str, page: int = PAGE, pages: int = PAGES, rows: int = ROWS) -> Iterator[tuple]:
    """(request, page, place, record, partial): the records in order, partial on the last row if more were there.

    A page that repeats the cursor it came from would never end; it raises.
    """
    cursor, n, held = None, 0, None
    for k in range(pages):
        records, after = fetch(request, cursor, min(page, rows - n))
        for x in records[: rows - n]:
            if held is not None:
                yield held
            held = (request, k, n, x, False)
            n += 1
        if after is not None and after == cursor:
            raise ValueError(f"{request}: the page after {cursor!r} is that page again")
        cursor = after
        if after is None or n >= rows:
            break
    if held is not None:
        yield (*held[:4], cursor is not None)


def read_paged(spark: SparkSession, name: str, fetch: Callable, requests: list[str], page: int = PAGE, pages: int = PAGES, rows: int = ROWS) -> DataFrame:
    """request, page, place, record, partial of all requests, through a data source registered as ``name``."""
    if not (1 <= page <= PAGE and 1 <= pages <= PAGES and 1 <= rows <= ROWS):
        raise ValueError(f"at most {PAGE} rows a page, {PAGES} pages and {ROWS} rows a request")
    asked = list(requests)

    class One(InputPartition):
        pass

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [One(r) for r in asked]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            yield from fetch_all(fetch, partition.value, page, pages, rows)

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    spark.dataSource.register(Paged)
    return spark.read.format(name).load()
