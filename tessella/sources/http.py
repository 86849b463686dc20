"""A Python data source of pages fetched by URL: spark.read.format("pages").option("urls", "u1\\nu2").load().

Each task fetches its URLs with the standard library; `folder` answers from files named by the URL's MD5 instead, for use without a network.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "url string, html string, error string"

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)


class PageReader(DataSourceReader):
    def __init__(self, options):
        self.urls = [u for u in options.get("urls", "").split("\n") if u]
        self.folder, self.timeout = options.get("folder"), float(options.get("timeout", "30"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import urllib.request

        url = partition.value
        try:
            if self.folder:
                with open(f"{self.folder}/{hashlib.md5(url.encode()).hexdigest()}", "rb") as f:
                    yield url, f.read().decode("utf-8", "replace"), None
            else:
                with urllib.request.urlopen(url, timeout=self.timeout) as f:
                    yield url, f.read().decode(f.headers.get_content_charset() or "utf-8", "replace"), None
        except OSError as e:
            yield url, None, str(e)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageSource)
