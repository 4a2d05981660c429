"""Searches by pages and feeds of changes as Spark data sources, over responses that were recorded in a folder.

`paged_search`: each subfolder is a search, with its pages `<number>.json` as they came. A search is a partition; its reader
goes from page to page and stops by the rules of the source: at an empty page, at one that is shorter than a page, when the
reported total is reached, or at the most pages allowed, which makes it truncated. A page with the same ids as the one
before it means that paging has no effect; that is a problem of the search, not an end.

`change_feed`: files `<day>.json` list what changed on a day. Days are the offsets of the stream and each is a partition of
a batch, so a query that is stopped goes on after the last day that it committed. A feed reaches back only some days; to
start earlier is refused, since changes would be missing without a sign.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import date, timedelta

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Pages of a search at most, records of a page, and days that a feed reaches back.
MOST_PAGES, PAGE_SIZE, REACH_DAYS = 40, 100, 10
# Names under which a record's id, and a response's list of records and total, may stand.
IDS, LISTS, TOTALS = ("accessionsnummer", "accessionNumber", "id"), ("results", "items", "documents", "hits"), ("totalCount", "total", "count")


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _names(folder: str, directories: bool = False) -> list[str]:
    system, path = _open(folder)
    kind = fs.FileType.Directory if directories else fs.FileType.File
    return sorted(x.base_name for x in system.get_file_info(fs.FileSelector(path)) if x.type == kind and not x.base_name.startswith((".", "_")))


def _json(folder: str, name: str):
    system, path = _open(folder)
    with system.open_input_stream(f"{path}/{name}") as f:
        return json.loads(f.read())


def _first(record, names):
    return next((record[n] for n in names if isinstance(record, dict) and record.get(n) is not None), None)


class _Whole(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)


class PagedSearch(DataSource):
    """Options: path; what (records or searches); most_pages; page_size."""

    @classmethod
    def name(cls) -> str:
        return "paged_search"

    def schema(self) -> str:
        if self.options.get("what", "records") == "searches":
            return "search string, pages int, records int, total int, truncated boolean, problem string"
        return "search string, page int, position int, id string, record string"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(self.options)


class _PagedReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.what = options["path"], options.get("what", "records")
        self.most, self.size = int(options.get("most_pages", MOST_PAGES)), int(options.get("page_size", PAGE_SIZE))

    def partitions(self) -> list[InputPartition]:
        return [_Whole(n) for n in _names(self.path, directories=True)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        search = partition.value
        folder, rows = f"{self.path.rstrip('/')}/{search}", []
        seen: set[str] = set()
        pages, total, before, ended, problem = 0, None, None, False, None
        # Pages by number: what was asked for comes in that order, whatever the files are called.
        numbers = sorted(int(n.removesuffix(".json")) for n in _names(folder) if n.endswith(".json"))
        for number in numbers[: self.most]:
            answer = _json(folder, f"{number}.json")
            total = total if total is not None else _first(answer, TOTALS)
            records = answer if isinstance(answer, list) else _first(answer, LISTS) or []
            ids = [str(i) if (i := _first(r, IDS)) is not None else None for r in records]
            pages += 1
            if not records:
                ended = True
                break
            named = {i for i in ids if i is not None}
            if named and named == before:
                problem = "repeated_page"
                break
            for position, (i, r) in enumerate(zip(ids, records, strict=True)):
                if i is not None and i not in seen:
                    seen.add(i)
                    rows.append((search, number, position, i, json.dumps(r, ensure_ascii=False, sort_keys=True)))
            before = named
            if len(records) < self.size or total is not None and len(seen) >= total:
                ended = True
                break
        if self.what == "searches":
            yield search, pages, len(seen), total, not ended and problem is None and pages == self.most, problem
        else:
            yield from rows


class ChangeFeed(DataSource):
    """Options: path; since (a day; without it all that the feed has); today, and reach_days back from it."""

    @classmethod
    def name(cls) -> str:
        return "change_feed"

    def schema(self) -> str:
        return "day date, position int, id string, record string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _FeedReader(self.options)

    def reader(self, schema) -> DataSourceReader:
        return _FeedBatch(self.options)


class _FeedReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.reach = options["path"], int(options.get("reach_days", REACH_DAYS))
        self.since, self.today = options.get("since"), options.get("today")

    def _oldest(self) -> str:
        """The last day before those that are read."""
        today = date.fromisoformat(self.today) if self.today else date.today()
        edge = today - timedelta(days=self.reach)
        if self.since and date.fromisoformat(self.since) < edge:
            raise ValueError(f"the feed reaches back to {edge}; changes since {self.since} can't be had from it")
        first = date.fromisoformat(self.since) if self.since else edge
        return str(first - timedelta(days=1))

    def _days(self) -> list[str]:
        return [n.removesuffix(".json") for n in _names(self.path) if n.endswith(".json")]

    def initialOffset(self) -> dict:
        return {"day": self._oldest()}

    def latestOffset(self) -> dict:
        return {"day": max([self._oldest(), *self._days()])}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Whole(d) for d in self._days() if start["day"] < d <= end["day"]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        day = partition.value
        answer = _json(self.path, f"{day}.json")
        for position, r in enumerate(answer if isinstance(answer, list) else _first(answer, LISTS) or []):
            i = _first(r, IDS)
            yield date.fromisoformat(day), position, None if i is None else str(i), json.dumps(r, ensure_ascii=False, sort_keys=True)

    def commit(self, end: dict) -> None:
        """The recorded files stay."""


class _FeedBatch(DataSourceReader):
    def __init__(self, options):
        self.feed = _FeedReader(options)

    def partitions(self) -> list[InputPartition]:
        return self.feed.partitions(self.feed.initialOffset(), self.feed.latestOffset())

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.feed.read(partition)


def register(spark: SparkSession) -> None:
    """Makes both formats known to the session: spark.read.format("paged_search"), spark.readStream.format("change_feed")."""
    for source in (PagedSearch, ChangeFeed):
        spark.dataSource.register(source)
