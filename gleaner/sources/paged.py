"""A paged search source as a Python Data Source: one partition per page, filters pushed down.

The pages come from a folder of JSON files (`total.json` with {"total": n, "size": m} and
`page-<k>.json` arrays), which stands for a search service; the result-window guard is the
same: more results than the window fail loudly instead of being cut.
"""

from __future__ import annotations

import json
import math
import os

from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringContains

RESULT_WINDOW = 10_000


class ResultWindowExceeded(RuntimeError):
    pass


class _Page(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)
        self.number = number


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.window = int(options.get("window", RESULT_WINDOW))
        self.tests: list[tuple] = []

    def pushFilters(self, filters):
        """Comparisons of a field with a value are answered at the source; everything else by Spark."""
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1:
                self.tests.append((_TESTS[type(f)], f.attribute[0], f.value))
            else:
                yield f

    def partitions(self):
        with open(os.path.join(self.path, "total.json"), encoding="utf-8") as f:
            head = json.load(f)
        if head["total"] > self.window:
            raise ResultWindowExceeded(f"{head['total']} results, the window holds {self.window}: narrow the query")
        return [_Page(k) for k in range(math.ceil(head["total"] / head["size"]))]

    def read(self, partition):
        name = os.path.join(self.path, f"page-{partition.number}.json")
        if not os.path.exists(name):
            return
        with open(name, encoding="utf-8") as f:
            for row in json.load(f):
                fields = (str(row.get("id")), row.get("canton"), row.get("title"), row.get("workload"), row.get("permanent"), row.get("posted"))
                known = dict(zip(_FIELDS, fields))
                if all(known[k] is not None and _holds(op, known[k], v) for op, k, v in self.tests):
                    yield (*fields, json.dumps(row, ensure_ascii=False))


_FIELDS = ("id", "canton", "title", "workload", "permanent", "posted")
_TESTS = {EqualTo: "=", In: "in", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", StringContains: "has"}


def _holds(op: str, x, v) -> bool:
    if op in ("=", "in", "has"):
        return x == v if op == "=" else x in v if op == "in" else v in x
    return x > v if op == ">" else x >= v if op == ">=" else x < v if op == "<" else x <= v


def count_results(path: str) -> int:
    """How many results there are, without reading a page."""
    with open(os.path.join(path, "total.json"), encoding="utf-8") as f:
        return int(json.load(f)["total"])


def fetch_one(spark, path: str, record_id: str):
    """The record of that id as a frame of one row, or of none where the source doesn't know it."""
    return spark.read.format("paged_search").load(path).where(F.col("id") == record_id)


class PagedSearch(DataSource):
    """`spark.dataSource.register(PagedSearch)`, then `spark.read.format("paged_search").load(folder)`."""

    @classmethod
    def name(cls) -> str:
        return "paged_search"

    def schema(self) -> str:
        return "id string, canton string, title string, workload int, permanent boolean, posted string, json string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)
