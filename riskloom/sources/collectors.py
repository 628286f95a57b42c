"""Collectors: named functions from nothing to a table of items, made of queries, a feed reader and a filings reader.

``feed`` maps a query to its entries (see feeds.FeedSource), ``filing`` the name of a filings file to its JSON text. Both
run on executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.plans.presets import Settings, company_queries, pressure_queries
from riskloom.session import cut
from riskloom.sources import feeds, filings

Collector = Callable[[], DataFrame]
#: Most items of a run, fixed values: of each news query, of company news, of external pressure, of a company's filings.
PER_QUERY, COMPANY_NEWS, PRESSURE, FILINGS = 2, 36, 40, 3
RAW = "name string, cik long, file_pos int, json string"


def entries(spark: SparkSession, queries: Sequence[str], feed: Callable[[str], list[dict]]) -> DataFrame:
    feeds.register(spark, feed)
    # read once: a feed may answer otherwise the next time
    return cut(spark.read.format(feeds.FeedSource.name()).option("queries", "\n".join(queries)).load())


def news(spark: SparkSession, queries: Sequence[str], feed, max_items: int) -> Collector:
    """The first entries over all queries."""
    return lambda: feeds.current(entries(spark, queries, feed), max_items)


def dated_news(spark: SparkSession, queries: Sequence[str], feed, since: date, until: date, max_items: int) -> Collector:
    """An even share of each query between two days."""
    asked = feeds.dated(queries, since.isoformat(), until.isoformat())
    return lambda: feeds.historical(entries(spark, asked, feed), len(asked), max_items)


def read_files(files: DataFrame, filing: Callable[[str], str]) -> DataFrame:
    """The JSON text of filings files (name, cik, file_pos, file)."""

    def rows(batches: Iterator) -> Iterator:
        for b in batches:
            yield b.assign(json=[filing(f) for f in b["file"]])[["name", "cik", "file_pos", "json"]]

    return cut(files.select("name", F.col("cik").cast("long").alias("cik"), F.col("file_pos").cast("int").alias("file_pos"), "file").mapInPandas(rows, RAW))


def company_files(spark: SparkSession, filers: Sequence[tuple[str, int]]) -> DataFrame:
    d = spark.createDataFrame([(n, int(c)) for n, c in filers], "name string, cik long")
    return d.select("name", "cik", F.lit(-1).alias("file_pos"), F.concat(F.lit("CIK"), filings.padded(F.col("cik")), F.lit(".json")).alias("file"))


def in_order(found: DataFrame, filers: Sequence[tuple[str, int]], *place: str) -> DataFrame:
    """Items of filings, companies in the order of ``filers``."""
    return filings.filing_items(found, F.struct(F.array_position(F.array(*[F.lit(int(c)).cast("long") for _, c in filers]), F.col("cik")), *place))


def recent_filings(spark: SparkSession, filers: Sequence[tuple[str, int]], filing, since: date | None = None, limit: int = FILINGS) -> Collector:
    def collect() -> DataFrame:
        rows = filings.records(read_files(company_files(spark, filers), filing))
        return in_order(filings.recent_filings(rows, since and since.isoformat(), limit), filers, "pos")

    return collect


def filings_history(spark: SparkSession, filers: Sequence[tuple[str, int]], filing, since: date, limit: int) -> Collector:
    """Filings of the main file of each company and of those archive files that reach past ``since``; others aren't read."""

    def collect() -> DataFrame:
        main = read_files(company_files(spark, filers), filing)
        rest = read_files(filings.archives(main, since.isoformat()), filing)
        found = filings.historical_filings(filings.records(main.unionByName(rest)), since.isoformat(), limit)
        return in_order(found, filers, "place")

    return collect


def hourly(spark: SparkSession, s: Settings, feed, filing, today: date) -> dict[str, Collector]:
    """What a run reads."""
    return {
        "google-news-rss": news(spark, s.queries, feed, PER_QUERY * len(s.queries)),
        "company-economic-news": dated_news(spark, company_queries(s.companies), feed, today - timedelta(days=2), today + timedelta(days=1), COMPANY_NEWS),
        "external-competitive-pressure": news(spark, pressure_queries(), feed, PRESSURE),
        "sec-edgar": recent_filings(spark, s.filers, filing),
    }


def baseline(spark: SparkSession, s: Settings, feed, filing, today: date, years: int = 3, news_limit: int = 500, per_company: int = 24) -> dict[str, Collector]:
    """What a backfill reads: ``years`` of news and filings, within limits."""
    since = today - timedelta(days=365 * years)
    return {
        "google-news-history": dated_news(spark, [*s.queries, *company_queries(s.companies)], feed, since, today + timedelta(days=1), news_limit),
        "sec-edgar-history": filings_history(spark, s.filers, filing, since, per_company),
    }
