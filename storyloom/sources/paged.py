"""Items of paged services as a Python data source: a partition per channel, filters on the date pushed down.

A client is any object with ``page(channel, cursor, since) -> (items, next cursor or None)``, newest items
first, each item a dict with ``id`` and ``date`` (ISO text). The source reads on while pages bring new items
that are not older than ``since``; items without a readable date stay. ``since`` from a filter goes a day
further back, as services round; Spark applies the filter itself once more.

Options: ``client``, ``channels``, ``since``; ``limit``: most items of each channel, of which ``newest`` takes the newest of
all (none counts where ``since`` is given, as a run from a time on takes all); ``maxpages``: pages of each channel after
which its scan fails, so that a client that never ends is seen instead of rows being lost (none by default); ``all``: go on to
the last page also without ``since``.

As a stream (``spark.readStream``) its offset is a mark for each channel, date and id of the newest item read. A batch
reads what lies between two marks, so one that is run again after a failure reads the same items, and a later
run goes on behind the last mark. Items without a date are placed at the one listed before them;
one that is put before marks already read is for scans by date, which look a day back.
"""

from __future__ import annotations

import importlib
import json
import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition

OVERLAP = timedelta(days=1)


def parse_date(text: str | None) -> datetime | None:
    try:
        found = datetime.fromisoformat((text or "").replace("Z", "+00:00"))
    except ValueError:
        return None
    return found if found.tzinfo else found.replace(tzinfo=timezone.utc)


def client_of(options: dict):  # noqa: ANN201
    module, name = options["client"].split(":")
    return getattr(importlib.import_module(module), name)(options)


def channels_of(options: dict) -> list[str]:
    return [c.strip() for c in options.get("channels", "").split(",") if c.strip()] or [""]


class Channel(InputPartition):
    def __init__(self, name: str, most: int | None):
        self.name, self.most = name, most


class PagedReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.options, self.columns = options, columns
        self.channels = channels_of(options)
        self.since = parse_date(options.get("since"))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("date",):
                given = parse_date(str(f.value))
                if given and (self.since is None or given - OVERLAP > self.since):
                    self.since = given - OVERLAP
            elif isinstance(f, (EqualTo, In)) and f.attribute == ("channel",):
                wanted = [f.value] if isinstance(f, EqualTo) else list(f.value)
                self.channels = [c for c in self.channels if c in wanted]
            yield f

    def partitions(self) -> list[Channel]:
        limit = int(self.options.get("limit", 0)) if self.since is None else 0
        return [Channel(c, limit or None) for c in self.channels]

    def read(self, partition: Channel | None) -> Iterator[tuple]:
        if partition is None:
            return
        client = client_of(self.options)
        most, pages = partition.most, int(self.options.get("maxpages", 0))
        seen: set[str] = set()
        cursor, n = None, 0
        while True:
            n += 1
            if pages and n > pages:
                raise RuntimeError(f"channel {partition.name} has more than {pages} pages")
            items, cursor = client.page(partition.name, cursor, self.since)
            fresh = list({x["id"]: x for x in items if x["id"] not in seen}.values())
            seen.update(x["id"] for x in fresh)
            dates = [d for x in fresh if (d := parse_date(x.get("date")))]
            for x in fresh:
                at = parse_date(x.get("date"))
                if self.since is None or at is None or at >= self.since:
                    yield tuple(x.get(c) if c != "channel" else partition.name for c in self.columns)
                    if most is not None:
                        most -= 1
                        if most == 0:
                            return
            over = self.since is not None and dates and min(dates) < self.since
            if cursor is None or not fresh or over or (self.since is None and not self.options.get("all")):
                return


class Slice(InputPartition):
    """Items of a channel behind one mark and up to another."""

    def __init__(self, channel: str, behind: list, upto: list):
        self.channel, self.behind, self.upto = channel, behind, upto


class PagedStream(DataSourceStreamReader):
    """What channels bring from run to run; each item once."""

    def __init__(self, options: dict, columns: list[str]):
        self.options, self.columns = options, columns

    def _marked(self, channel: str) -> Iterator[tuple[list, dict]]:
        """(mark, item) of a channel's items, newest first, each once."""
        client, cursor, seen, last = client_of(self.options), None, set(), ""
        while True:
            items, cursor = client.page(channel, cursor, None)
            fresh = list({x["id"]: x for x in items if x["id"] not in seen}.values())
            seen.update(x["id"] for x in fresh)
            for x in fresh:
                at = parse_date(x.get("date"))
                last = at.astimezone(timezone.utc).isoformat(timespec="microseconds") if at else last
                yield [last, str(x["id"])], x
            if cursor is None or not fresh:
                return

    def initialOffset(self) -> dict:  # noqa: N802
        return {c: ["", ""] for c in channels_of(self.options)}

    def latestOffset(self) -> dict:  # noqa: N802
        return {c: self._last(c) for c in channels_of(self.options)}

    def _last(self, channel: str) -> list:
        """The highest mark of the newest date."""
        best = ["", ""]
        for mark, _ in self._marked(channel):
            if mark[0] < best[0]:
                break
            best = max(best, mark)
        return best

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        return [Slice(c, start.get(c, ["", ""]), upto) for c, upto in end.items() if upto > start.get(c, ["", ""])]

    def read(self, partition: Slice) -> Iterator[tuple]:
        for mark, x in self._marked(partition.channel):
            if mark[0] < partition.behind[0]:
                return
            if partition.behind < mark <= partition.upto:
                yield tuple(x.get(c) if c != "channel" else partition.channel for c in self.columns)

    def commit(self, end: dict) -> None:
        pass


class PagedItems(DataSource):
    """``spark.read.format("paged_items").option("client", "module:factory").option("channels", "a,b")``."""

    @classmethod
    def name(cls) -> str:
        return "paged_items"

    def schema(self) -> str:
        return self.options.get("schema", "id string, channel string, date string, text string")

    def reader(self, schema) -> PagedReader:  # noqa: ANN001
        return PagedReader(dict(self.options), schema.fieldNames())

    def streamReader(self, schema) -> PagedStream:  # noqa: ANN001, N802
        return PagedStream(dict(self.options), schema.fieldNames())


def newest(items: DataFrame, limit: int) -> DataFrame:
    """The newest items of a whole scan, whichever channels they are of; those without a date come last, ties go by channel and id."""
    return items.orderBy(F.col("date").desc_nulls_last(), "channel", "id").limit(limit)


class SavedPages:
    """A client of pages that were saved as ``path/channel=.../page=...`` with JSON lines; pages in order of their names."""

    def __init__(self, options: dict):
        self.place, self.base = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", options["path"]))

    def _names(self, *parts: str) -> list[str]:
        found = self.place.get_file_info(fs.FileSelector("/".join([self.base, *parts]), allow_not_found=True))
        return sorted(f.base_name for f in found if not f.base_name.startswith(("_", ".")))

    def page(self, channel: str, cursor: int | None, since: datetime | None) -> tuple[list[dict], int | None]:
        own = f"channel={channel}"
        pages, n = self._names(own)[::-1], cursor or 0
        if n >= len(pages):
            return [], None
        items = []
        for name in self._names(own, pages[n]):
            with self.place.open_input_stream("/".join([self.base, own, pages[n], name])) as lines:
                items += [json.loads(x) for x in lines.read().splitlines() if x]
        items.sort(key=lambda x: (x.get("date") or "", x["id"]), reverse=True)
        return items, n + 1 if n + 1 < len(pages) else None
