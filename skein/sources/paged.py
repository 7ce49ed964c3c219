"""A batch source over a paged search service."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MOST_A_PAGE = 50


class _Query(InputPartition):
    def __init__(self, text: str):
        super().__init__(text)
        self.text = text


def paged_search(spark: SparkSession, queries: list[str], fetch: Callable[[str, int, int], list[tuple]], schema: str, key: str, page_size: int = MOST_A_PAGE) -> DataFrame:
    """The rows of all pages of each query, one for each key; a partition for each query.

    fetch(query, offset, limit) gives the rows of one page as tuples in the schema's order
    and runs on the executors. Pages hold 1 to 50 rows; a short page is the last one.
    """
    size = max(1, min(page_size, MOST_A_PAGE))
    columns = schema

    class Reader(DataSourceReader):
        def partitions(self):
            return [_Query(q) for q in queries]

        def read(self, partition) -> Iterator[tuple]:
            offset = 0
            while True:
                page = fetch(partition.text, offset, size)
                yield from page
                if len(page) < size:
                    return
                offset += size

    class PagedSearch(DataSource):
        @classmethod
        def name(cls):
            return "skein_paged_search"

        def schema(self):
            return columns

        def reader(self, schema):
            return Reader()

    spark.dataSource.register(PagedSearch)
    return spark.read.format("skein_paged_search").load().dropDuplicates([key])
