"""A paged listing as a data source: a partition a page, and a range of pages of which alone are read.

A page is a JSON file page-<number>.json with items of name and id. The range is an option of the source, not a condition pushed down:
Spark 4.1 keeps a Python reader's pushed conditions for other queries over the same DataFrame, which then lose rows.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import collect_list, sort_array, struct, transform

from ..operators.media import flattened
from .container import place

PAGES = "page long, at int, name string, id long"
_NAME = re.compile(r"page-(\d+)\.json")


@dataclass
class Page(InputPartition):
    path: str
    number: int


class Pages(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.first, self.last = int(options.get("first", 0)), int(options.get("last", 1 << 62))

    def partitions(self):
        system, at = place(self.path)
        found = [(int(m[1]), info.base_name) for info in system.get_file_info(fs.FileSelector(at)) if (m := _NAME.fullmatch(info.base_name))]
        return [Page(f"{self.path}/{name}", n) for n, name in sorted(found) if self.first <= n <= self.last] or [Page("", -1)]

    def read(self, partition):
        if partition.number < 0:
            return
        system, at = place(partition.path)
        with system.open_input_stream(at) as f:
            items = json.loads(f.read()).get("items") or []
        for k, item in enumerate(items):
            yield partition.number, k, item.get("name"), item.get("id")


class Listing(DataSource):
    """Options: path; first and last, the pages to read."""

    @classmethod
    def name(cls):
        return "listing"

    def schema(self):
        return PAGES

    def reader(self, schema):
        return Pages(self.options)


def read_listing(spark: SparkSession, path: str, first: int = 0, last: int | None = None) -> DataFrame:
    """page, at, name, id of the items of these pages."""
    spark.dataSource.register(Listing)
    source = spark.read.format("listing").option("path", path).option("first", first)
    return (source if last is None else source.option("last", last)).load()


def latest_ids(listing: DataFrame) -> DataFrame:
    """name, id of the last item of each name, in the order of pages and of the items in them; items without a name go."""
    rows = listing.where("name is not null").groupBy("page").agg(sort_array(collect_list(struct("at", "name", "id"))).alias("items"))
    return flattened(rows.select("page", transform("items", lambda i: struct(i["name"].alias("name"), i["id"].alias("id"))).alias("items")))
