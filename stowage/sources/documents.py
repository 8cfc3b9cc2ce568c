"""Feeds as data sources that Spark can plan: one partition for each place and day, filters on both pushed to the listing, days as streaming offsets.

A feed keeps its providers' answers as they came, a document a line, in <path>/place=<place>/day=<yyyy-mm-dd>/. Only the
folders that the filters leave are listed into partitions, so that a route and a day cost what they hold and not what the
feed holds. A place is a route (ATL-JFK), an airport or a weather station. Documents are parsed by column functions
(feeds.py); this source moves them, as Arrow batches.

Defined results: names that are no place or day folder are passed over; an unreadable document is a row, parsed to
nothing; a feed without folders has no rows; a filter that can't be pushed is left to Spark.
"""

from __future__ import annotations

import urllib.parse
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import date

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

SCHEMA = "place string, day date, document string"
BATCH = 1000
#: Partitions of a scan; beyond, days of a place share one.
MOST = 20_000


@dataclass
class Place(InputPartition):
    """Days of one place, each with its folder: one, or a few in a row where a scan would have too many partitions."""

    place: str
    days: tuple[tuple[str, str], ...]


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, by its scheme, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def subfolders(fs: pafs.FileSystem, folder: str, name: str) -> Iterator[tuple[str, str]]:
    """(value, path) of the folders name=value in a folder."""
    for f in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
        if f.type == pafs.FileType.Directory and f.base_name.startswith(f"{name}="):
            yield urllib.parse.unquote(f.base_name.removeprefix(f"{name}=")), f.path


def real_day(text: str) -> bool:
    try:
        return date.fromisoformat(text).isoformat() == text
    except ValueError:
        return False


def holds(f: Filter, value: str | date) -> bool:
    """Whether a pushed filter holds for a place or day."""
    if isinstance(f, EqualTo):
        return value == f.value
    if isinstance(f, In):
        return value in f.value
    if isinstance(f, IsNotNull):
        return True
    return {GreaterThan: value > f.value, GreaterThanOrEqual: value >= f.value, LessThan: value < f.value, LessThanOrEqual: value <= f.value}[type(f)]


def listed(path: str, filters: Sequence[Filter] = (), after: str = "", upto: str = "9999-12-31", most: int = MOST) -> list[Place]:
    """The partitions of places and days for which the filters hold, days after `after` and up to `upto`. Folders of places that are left out aren't looked into."""
    fs, root = opened(path)
    of = lambda name: [f for f in filters if f.attribute == (name,)]
    out = []
    for place, folder in subfolders(fs, root, "place"):
        if all(holds(f, place) for f in of("place")):
            for day, own in subfolders(fs, folder, "day"):
                if real_day(day) and after < day <= upto and all(holds(f, date.fromisoformat(day)) for f in of("day")):
                    out.append((place, day, own))
    together = -(-len(out) // most)
    parts: list[Place] = []
    for place, day, own in sorted(out):
        if parts and parts[-1].place == place and len(parts[-1].days) < together:
            parts[-1].days += ((day, own),)
        else:
            parts.append(Place(place, ((day, own),)))
    return parts


def documents_of(path: str, part: Place | None) -> Iterator[pa.RecordBatch]:
    """The documents of a partition; a scan without partitions is read as one that is none."""
    if part is None:
        return
    fs, _ = opened(path)

    def batch(day: str, lines: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part.place] * len(lines)), pa.array([date.fromisoformat(day)] * len(lines), pa.date32()), pa.array(lines, pa.string())], names=["place", "day", "document"])

    for day, folder in part.days:
        files = [f for f in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if f.type == pafs.FileType.File and not f.base_name.startswith(("_", "."))]
        for f in sorted(files, key=lambda f: f.path):
            held = []
            with fs.open_input_stream(f.path) as raw:
                for line in lines_of(raw):
                    held.append(line)
                    if len(held) == BATCH:
                        yield batch(day, held)
                        held = []
            if held:
                yield batch(day, held)


def lines_of(raw: pa.NativeFile, size: int = 1 << 20) -> Iterator[str]:
    """The lines of a stream that aren't empty, a block of bytes at a time."""
    rest = b""
    while block := raw.read(size):
        *whole, rest = (rest + block).split(b"\n")
        yield from (w.decode("utf-8", "replace") for w in whole if w.strip())
    if rest.strip():
        yield rest.decode("utf-8", "replace")


class FeedReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.filters = path, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes comparisons of place and day; what a partition's folder settles, Spark needn't look at again."""
        known = (EqualTo, In, IsNotNull, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)
        for f in filters:
            value = getattr(f, "value", None)
            fits = isinstance(f, known) and f.attribute in (("place",), ("day",)) and (isinstance(f, IsNotNull) or value is not None)
            kind = str if getattr(f, "attribute", None) == ("place",) else date
            if fits and (isinstance(f, IsNotNull) or all(isinstance(v, kind) for v in (value if isinstance(f, In) else [value]))):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> Sequence[Place]:
        return listed(self.path, self.filters)

    def read(self, partition: Place) -> Iterator[pa.RecordBatch]:
        return documents_of(self.path, partition)


class FeedStream(DataSourceStreamReader):
    """Whole days in order: a batch reads the days after the last one's up to the newest, or with open_last=false up to the one before it, which may still grow."""

    def __init__(self, path: str, open_last: bool):
        self.path, self.open_last = path, open_last

    def initialOffset(self) -> dict:
        return {"day": ""}

    def latestOffset(self) -> dict:
        days = sorted({day for p in listed(self.path) for day, _ in p.days})
        days = days if self.open_last else days[:-1]
        return {"day": days[-1] if days else ""}

    def partitions(self, start: dict, end: dict) -> Sequence[Place]:
        return listed(self.path, after=start["day"], upto=end["day"])

    def read(self, partition: Place) -> Iterator[pa.RecordBatch]:
        return documents_of(self.path, partition)


class Feed(DataSource):
    """Options: path; for streams open_last (true)."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        if not options.get("path"):
            raise ValueError(f"{self.name()} needs a path")
        self.path = options["path"]

    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FeedReader:
        return FeedReader(self.path)

    def streamReader(self, schema) -> FeedStream:
        return FeedStream(self.path, str(self.options.get("open_last", "true")).lower() == "true")


class FlightFeed(Feed):
    @classmethod
    def name(cls) -> str:
        return "flight_feed"


class WeatherFeed(Feed):
    @classmethod
    def name(cls) -> str:
        return "weather_feed"


class EventsFeed(Feed):
    @classmethod
    def name(cls) -> str:
        return "events_feed"


#: Kinds of feeds by name; more are added by register_feed.
FEEDS: dict[str, type[Feed]] = {c.name(): c for c in (FlightFeed, WeatherFeed, EventsFeed)}


def register_feed(kind: type[Feed]) -> None:
    FEEDS[kind.name().lower()] = kind


def feed(spark: SparkSession, kind: str, path: str):
    """(place, day, document) of a registered kind of feed; names don't regard case."""
    if kind.lower() not in FEEDS:
        raise ValueError(f"unknown feed: {kind}; there are {', '.join(sorted(FEEDS))}")
    found = FEEDS[kind.lower()]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(found)
    # Spark keeps the partitions of a table's last pushed filters for scans that push none; so every scan pushes one
    return spark.read.format(found.name()).option("path", path).load().filter("place IS NOT NULL AND day IS NOT NULL")


def feed_stream(spark: SparkSession, kind: str, path: str, open_last: bool = True):
    feed(spark, kind, path)
    return spark.readStream.format(FEEDS[kind.lower()].name()).option("path", path).option("open_last", str(open_last).lower()).load()


def keep(documents, path: str) -> None:
    """Writes (place, day, document) rows as a feed keeps them."""
    documents.select("place", "day", documents["document"].alias("value")).repartition("place", "day").write.partitionBy("place", "day").mode("append").text(path)
