"""Paged listings as a Spark source, over pages that were recorded in a folder: ``<folder>/source=<source>/page=<n>/`` with one file a page,
or, where pages are many and small, ``<folder>/source=<source>/pages=<k>/`` with the pages from k * bundle on, a line ``<n><tab><payload>`` each.

A listing is read page after page, and no further than it has to be: pages stop at the first one that is empty, that is missing or was refused (its folder
has no file), at the total that a page states, and at ``most`` records. Listings are read side by side, one task each; one whose total is known beforehand
is divided into ranges of pages, which don't depend on each other. A stream takes the pages that came since, listing by listing, from where it stopped.

The folder is one that tasks can open, such as a mounted store. Calls of a network belong in the program that records.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "source string, page int, payload string"
#: Records of a page and of a listing at most; pages of a range.
SIZE, MOST, RANGE = 100, 10_000, 20


@dataclass
class Pages(InputPartition):
    source: str
    first: int
    end: int

    def __init__(self, source: str, first: int, end: int):
        self.source, self.first, self.end = source, first, end


def _file(folder: str, source: str, page: int) -> str | None:
    """Where a page is: none if it is missing or was refused."""
    where = os.path.join(folder, f"source={source}", f"page={page}")
    names = sorted(n for n in os.listdir(where) if n[0] not in "._") if os.path.isdir(where) else []
    return os.path.join(where, names[0]) if names else None


class _Options:
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"].removeprefix("file:").replace("//", "/")
        self.envelope, self.total = options.get("envelope"), options.get("total")
        self.size, self.most = int(options.get("size", SIZE)), int(options.get("most", MOST))
        self.range, self.bundle = int(options.get("range", RANGE)), int(options.get("bundle", 1))
        self._at, self._lines = None, {}
        #: JSON: listing to its total where that is known, else to null.
        self.totals: dict[str, int | None] = json.loads(options["totals"]) if "totals" in options else None

    def listings(self) -> dict[str, int | None]:
        """All that the folder has, unless totals name some."""
        if self.totals is not None:
            return self.totals
        return {n.removeprefix("source="): None for n in sorted(os.listdir(self.folder)) if n.startswith("source=")}

    @property
    def most_pages(self) -> int:
        return -(-self.most // self.size)

    def payload(self, source: str, page: int) -> str | None:
        """What was recorded of a page; of a bundle, the last that was read is held."""
        if self.bundle == 1:
            where = _file(self.folder, source, page)
            if where is None:
                return None
            with open(where, encoding="utf-8") as f:
                return f.read().rstrip("\n")
        if self._at != (at := (source, page // self.bundle)):
            where = os.path.join(self.folder, f"source={source}", f"pages={at[1]}")
            self._at, self._lines = at, {}
            for name in sorted(n for n in os.listdir(where) if n[0] not in "._") if os.path.isdir(where) else []:
                with open(os.path.join(where, name), encoding="utf-8", newline="\n") as f:
                    self._lines |= {int(n): payload for n, _, payload in (line.rstrip("\n").partition("\t") for line in f)}
        return self._lines.get(page)

    def there(self, source: str, page: int) -> bool:
        return (_file(self.folder, source, page) if self.bundle == 1 else self.payload(source, page)) is not None

    def anew(self) -> None:
        """Bundles may have grown."""
        self._at = None

    def read(self, part: Pages) -> Iterator[tuple]:
        """The pages of a part up to its stop; what comes after isn't opened, or, in a bundle, not parsed."""
        for page in range(part.first, min(part.end, self.most_pages)):
            payload = self.payload(part.source, page)
            if payload is None:
                return
            found = json.loads(payload)
            records = found.get(self.envelope) if self.envelope else found
            if not records:
                return
            yield part.source, page, payload
            total = found.get(self.total) if self.total and isinstance(found, dict) else None
            if total is not None and (page + 1) * self.size >= total:
                return


class _Reader(DataSourceReader):
    def __init__(self, options: _Options):
        self.options = options

    def partitions(self) -> list[Pages]:
        o, parts = self.options, []
        for source, total in o.listings().items():
            pages = o.most_pages if total is None else min(-(-total // o.size), o.most_pages)
            step = pages if total is None else o.range
            parts += [Pages(source, a, min(a + step, pages)) for a in range(0, pages, max(1, step))]
        return parts

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.options.read(partition)


class _Stream(DataSourceStreamReader):
    """Offsets: of each listing, the number of pages that were taken."""

    def __init__(self, options: _Options):
        self.options = options
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        self.options.anew()
        for source in self.options.listings():
            at = self.known.get(source, 0)
            while at < self.options.most_pages and self.options.there(source, at):
                at += 1
            self.known[source] = at
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        return [Pages(s, start.get(s, 0), n) for s, n in end.items() if n > start.get(s, 0)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.options.read(partition)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recorded_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(_Options(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(_Options(self.options))


def read_pages(spark: SparkSession, folder: str, envelope: str | None = None, total: str | None = None, stream: bool = False, totals: dict[str, int | None] | None = None, size: int = SIZE, most: int = MOST, range_pages: int = RANGE, bundle: int = 1) -> DataFrame:
    """(source, page, payload) of the folder's listings. ``envelope``: the field that has a page's records, none if the page is a bare list; ``total``: the one that
    states how many records there are; ``totals``: listings to read, with their totals where they are known; ``bundle``: pages that were recorded together in one file."""
    spark.dataSource.register(PagedSource)
    options = {"path": folder, "envelope": envelope, "total": total, "size": size, "most": most, "range": range_pages, "bundle": bundle, "totals": None if totals is None else json.dumps(totals)}
    reader = (spark.readStream if stream else spark.read).format("recorded_pages")
    return reader.options(**{k: str(v) for k, v in options.items() if v is not None}).load()
