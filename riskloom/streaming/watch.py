"""Watching the feeds: one streaming query whose batches are runs of the engine."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskloom.engine import Engine, utc_now
from riskloom.plans.presets import company_queries, pressure_queries
from riskloom.session import cut
from riskloom.sources import collectors as C
from riskloom.sources import feeds


def dated_feed(feed: Callable[[str], list[dict]], dated: frozenset[str], clock: Callable[[], datetime]) -> Callable[[str], list[dict]]:
    """``feed``, which is asked for the days around now where the query is one of ``dated``."""

    def fetch(query: str) -> list[dict]:
        today = clock().date()
        return feed(feeds.dated([query], str(today - timedelta(days=2)), str(today + timedelta(days=1)))[0] if query in dated else query)

    return fetch


def now() -> datetime:
    return datetime.now(UTC)


def watch(engine: Engine, feed, filing, folder: str, interval: str | None = None, done: Callable[[dict, datetime], None] = lambda out, at: None, clock: Callable[[], datetime] = utc_now) -> StreamingQuery:
    """Poll all feeds at an interval (None: once) and run the engine on the entries that no earlier poll had.

    A poll takes up to ``PER_QUERY`` new entries of each query and leaves the others to the next ones, so nothing is cut off, as the
    limits of a single run do. ``folder``, on a shared mount, holds the checkpoint and the spool: a query that starts again from it goes on where it ended.
    A batch that is made again meets its own items in the store and adds nothing. ``done`` gets each run's summary.
    """
    spark, s = engine.spark, engine.settings
    groups = {"google-news-rss": list(s.queries), "company-economic-news": company_queries(s.companies), "external-competitive-pressure": pressure_queries()}
    queries = list(dict.fromkeys(q for g in groups.values() for q in g))
    feeds.register(spark, dated_feed(feed, frozenset(groups["company-economic-news"]), now))
    entries = spark.readStream.format(feeds.FeedSource.name()).options(queries="\n".join(queries), spool=f"{folder}/spool", most=C.PER_QUERY).load()

    def run(batch: DataFrame, number: int) -> None:
        batch, at = cut(batch), clock()
        part = lambda asked: lambda: feeds.entry_items(batch.filter(F.col("query").isin(asked)))
        given = {name: part(asked) for name, asked in groups.items() if asked}
        if s.filers:
            given["sec-edgar"] = C.recent_filings(spark, s.filers, filing)
        done(engine.run(given, at, s.request_delay_seconds), at)

    out = entries.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/checkpoint")
    return (out.trigger(processingTime=interval) if interval else out.trigger(availableNow=True)).start()
