"""News feeds. Readers give entries (query, query_pos, entry_pos, title, link, summary, published, source_title); these operators turn them into items."""

from __future__ import annotations

import hashlib
import json
import math
import os
import uuid
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from riskloom.functions.text import filled, strip_tags

ENTRIES = "query string, query_pos int, entry_pos int, title string, link string, summary string, published string, source_title string"

REMEMBERED = 10_000  # entries of a query that a stream knows again
FAILURES = 5  # times in a row that a query of a stream may fail, less one


class FeedSource(DataSource):
    """Source ``riskloom_feed``: one partition for each query, read by a function that executors call.

    Options: queries (one to a line). The function (query -> entries) is set with :func:`register`. As a stream it needs
    ``spool`` too, and may have ``most``, ``remember`` and ``failures`` (see :class:`Polls`).
    """

    fetch: Callable[[str], list[dict]] | None = None

    @classmethod
    def name(cls) -> str:
        return "riskloom_feed"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self._queries(), type(self).fetch)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        o = self.options
        if not o.get("spool"):
            raise ValueError("a stream of feeds needs the option spool, a folder that the driver and all executors share")
        return Polls(self._queries(), type(self).fetch, o["spool"], int(o.get("most", 1 << 30)), int(o.get("remember", REMEMBERED)), int(o.get("failures", FAILURES)))

    def _queries(self) -> list[str]:
        return [q for q in self.options.get("queries", "").split("\n") if q]


class _Query(InputPartition):
    def __init__(self, pos: int, query: str):
        super().__init__(pos)
        self.pos, self.query = pos, query


class _Reader(DataSourceReader):
    def __init__(self, queries: list[str], fetch):
        self.queries, self.fetch = queries, fetch

    def partitions(self) -> list[InputPartition]:
        return [_Query(i, q) for i, q in enumerate(self.queries)]

    def read(self, partition) -> Iterator[tuple]:
        for i, e in enumerate(self.fetch(partition.query)):
            yield (partition.query, partition.pos, i, e.get("title"), e.get("link"), e.get("summary"), e.get("published"), e.get("source_title"))


class _Poll(InputPartition):
    def __init__(self, number: int, pos: int, query: str):
        super().__init__((number, pos))
        self.number, self.pos, self.query = number, pos, query


class Polls(DataSourceStreamReader):
    """A feed as a stream: an offset is the number of a poll, and a poll gives those entries that earlier ones of its query didn't.

    What a task reads it first writes into ``spool``, a file for each poll and query that only one attempt can create, and every attempt
    gives what the file holds. So a batch that is made again after a failure has the same entries, whatever the feed says by
    then: none is read twice and none that was read is lost. The file also carries the keys (link and title) of the last ``remember`` entries
    of its query, for the next poll. An older entry that comes back is read again, and is known to the store by its id.

    ``most``: entries that a poll takes of a query; the others stay unknown and come with later polls. A query that fails gives
    nothing and is asked again in the next poll; the ``failures``-th time in a row ends the stream. ``spool`` is a mounted folder with hard links. Files
    of committed polls before the last are removed.
    """

    def __init__(self, queries: list[str], fetch, spool: str, most: int, remember: int, failures: int):
        self.queries, self.fetch, self.spool, self.most, self.remember, self.failures = list(dict.fromkeys(queries)), fetch, spool.removeprefix("file:").rstrip("/"), most, remember, failures
        self.planned = 0

    def _numbers(self) -> list[int]:
        return sorted(int(n) for n in os.listdir(self.spool) if n.isdigit()) if os.path.isdir(self.spool) else []

    def _path(self, number: int, query: str) -> str:
        return f"{self.spool}/{number:012d}/{hashlib.sha256(query.encode()).hexdigest()[:32]}.json"

    def initialOffset(self) -> dict:  # noqa: N802
        return {"poll": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"poll": max([self.planned, *self._numbers()[-1:]]) + 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if end["poll"] < start["poll"]:
            raise ValueError(f"poll {start['poll']} of the stream isn't in {self.spool}: the folder was emptied, the stream needs a new checkpoint")
        numbers = range(start["poll"] + 1, end["poll"] + 1)
        for n in numbers:
            os.makedirs(f"{self.spool}/{n:012d}", exist_ok=True)
        self.planned = end["poll"]
        return [_Poll(n, i, q) for n in numbers for i, q in enumerate(self.queries)]

    def read(self, partition) -> Iterator[tuple]:
        path = self._path(partition.number, partition.query)
        if not os.path.exists(path):
            self._ask(partition, path)
        with open(path, encoding="utf-8") as f:
            for pos, e in json.load(f)["entries"]:
                yield (partition.query, partition.pos, pos, e.get("title"), e.get("link"), e.get("summary"), e.get("published"), e.get("source_title"))

    def _ask(self, p: _Poll, path: str) -> None:
        known, failed, taken = [], 0, {}
        if os.path.exists(before := self._path(p.number - 1, p.query)):
            with open(before, encoding="utf-8") as f:
                old = json.load(f)
            known, failed = old["known"], old["failed"]
        try:
            found = list(self.fetch(p.query))
        except Exception:
            if (failed := failed + 1) >= self.failures:
                raise
            found = []
        else:
            failed = 0
        keys = [hashlib.sha256(f"{e.get('link') or ''}|{e.get('title') or ''}".encode("utf-8", "surrogatepass")).hexdigest()[:32] for e in found]
        seen = set(known)
        for pos, (k, e) in enumerate(zip(keys, found, strict=True)):
            if k not in seen and len(taken) < self.most:
                taken.setdefault(k, (pos, e))
        # what the feed still shows comes first, so that it isn't forgotten
        shown = [k for k in dict.fromkeys(keys) if k in seen or k in taken]
        known = [*shown, *[k for k in known if k not in set(shown)][: max(0, self.remember - len(shown))]] if keys else known
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "w", encoding="utf-8") as f:
            json.dump({"entries": list(taken.values()), "known": known, "failed": failed}, f)
        try:
            os.link(part, path)
        except FileExistsError:  # another attempt was first, and its entries hold
            pass
        finally:
            os.unlink(part)

    def commit(self, end: dict) -> None:
        for n in self._numbers():
            if n < end["poll"]:
                folder = f"{self.spool}/{n:012d}"
                for name in os.listdir(folder):
                    os.unlink(f"{folder}/{name}")
                os.rmdir(folder)


def register(spark: SparkSession, fetch: Callable[[str], list[dict]]) -> None:
    """Make ``spark.read.format("riskloom_feed")`` read with ``fetch``."""
    spark.dataSource.register(type("Feed", (FeedSource,), {"fetch": staticmethod(fetch)}))


def entry_items(entries: DataFrame, brand: str = "Google News") -> DataFrame:
    """Items of feed entries: markup goes from title and summary, a missing source is the feed's."""
    return entries.select("query_pos", "entry_pos", strip_tags(F.col("title")).alias("title"), F.col("link").alias("url"), strip_tags(F.col("summary")).alias("summary"), F.col("published").alias("published_at"), F.coalesce(filled(F.col("source_title")), F.lit(brand)).alias("source"), F.struct("query_pos", "entry_pos").alias("seq"))


def current(entries: DataFrame, max_items: int = 12) -> DataFrame:
    """The first entries over all queries in order: one cap for all."""
    return entry_items(entries).orderBy("query_pos", "entry_pos").limit(max_items)


def historical(entries: DataFrame, queries: int, max_items: int = 140) -> DataFrame:
    """An even share of each query, the first item of each url, then one cap for all.

    The share comes first: later steps see at most (queries x share) rows, whatever the feeds hold.
    """
    if queries <= 0 or max_items <= 0:
        return entry_items(entries).limit(0)
    share = max(1, math.ceil(max_items / queries))
    d = entries.withColumn("_n", F.row_number().over(Window.partitionBy("query_pos").orderBy("entry_pos"))).filter(F.col("_n") <= share).drop("_n")
    d = entry_items(d).withColumn("_n", F.row_number().over(Window.partitionBy("url").orderBy("query_pos", "entry_pos"))).filter("_n = 1").drop("_n")
    return d.orderBy("query_pos", "entry_pos").limit(max_items)


def dated(queries: Sequence[str], since: str, until: str) -> list[str]:
    return [f"{q} after:{since} before:{until}" for q in queries]
