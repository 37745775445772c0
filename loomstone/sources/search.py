"""A data source over a search service that gives at most so many hits for one query.

The span of dates is cut into years, months or days, as coarse as the limit allows; each segment is a partition that is read on its own, with a least
interval between requests and retries. The service is anything with count(first, last) and fetch(first, last); `FileService` is one over a
file of JSON lines, for use without a network.
"""

from __future__ import annotations

import calendar
import importlib
import json
import time
from collections.abc import Iterator
from datetime import date, timedelta

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class FileService:
    """Records of a file of JSON lines, each with id, date (ISO) and title."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as lines:
            self.records = [json.loads(x) for x in lines if x.strip()]

    def fetch(self, first: date, last: date) -> list[dict]:
        return [r for r in self.records if first.isoformat() <= r["date"] <= last.isoformat()]

    def count(self, first: date, last: date) -> int:
        return len(self.fetch(first, last))


def slices(first: date, last: date, unit: str) -> Iterator[tuple[date, date]]:
    """Closed years, months or days that make up first to last."""
    while first <= last:
        end = {"year": date(first.year, 12, 31), "month": date(first.year, first.month, calendar.monthrange(first.year, first.month)[1]), "day": first}[unit]
        yield first, min(end, last)
        first = end + timedelta(days=1)


def segments(service, first: date, last: date, most: int, units: tuple[str, ...] = ("year", "month", "day")) -> Iterator[tuple[date, date, int]]:
    """Segments with hits, none over most; a day over it is an error."""
    for a, b in slices(first, last, units[0]):
        n = service.count(a, b)
        if n > most:
            if len(units) == 1:
                raise ValueError(f"{a} alone has {n} hits, more than {most}")
            yield from segments(service, a, b, most, units[1:])
        elif n:
            yield a, b, n


class Segment(InputPartition):
    def __init__(self, first: date, last: date, expected: int):
        super().__init__(None)
        self.first, self.last, self.expected = first, last, expected


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def _service(self):
        module, _, name = self.options.get("service", f"{__name__}:FileService").partition(":")
        return getattr(importlib.import_module(module), name)(self.options["path"])

    def partitions(self) -> list[Segment]:
        first, last = (date.fromisoformat(self.options[k]) for k in ("first", "last"))
        return [Segment(*s) for s in segments(self._service(), first, last, int(self.options.get("most", 9999)))]

    def read(self, partition: Segment) -> Iterator[tuple]:
        service, wait = self._service(), float(self.options.get("interval", 0))
        for attempt in range(int(self.options.get("tries", 4))):
            time.sleep(wait * 2**attempt if attempt or wait else 0)
            try:
                found = service.fetch(partition.first, partition.last)
                break
            except OSError:
                if attempt + 1 == int(self.options.get("tries", 4)):
                    raise
        if len({r["id"] for r in found}) != partition.expected:
            raise ValueError(f"{partition.first} to {partition.last}: {partition.expected} hits counted, {len(found)} fetched")
        for r in found:
            yield str(r["id"]), date.fromisoformat(r["date"]), r.get("title", ""), partition.first, partition.last


class SearchSource(DataSource):
    """spark.read.format("dated_search") with options path, first, last, and service, most, interval, tries if need be."""

    @classmethod
    def name(cls) -> str:
        return "dated_search"

    def schema(self) -> str:
        return "id string, date date, title string, segment_first date, segment_last date"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)
