"""Commands over a store: ``python -m riskloom.cli --root DIR COMMAND``."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import functions as F

from riskloom.engine import ITEM, Engine, utc_now
from riskloom.operators import sinks
from riskloom.plans.presets import load_settings
from riskloom.session import get_spark
from riskloom.sources import collectors as C
from riskloom.sources import readers
from riskloom.streaming.watch import watch


def within(least: int, most: int):
    def number(text: str) -> int:
        if not least <= (n := int(text)) <= most:
            raise argparse.ArgumentTypeError(f"must be between {least} and {most}")
        return n

    return number


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="riskloom")
    p.add_argument("--root", required=True, help="folder of the tables")
    p.add_argument("--config", help="TOML file of settings")
    p.add_argument("--items", action="append", default=[], metavar="NAME=PATH", help="a collector: JSON lines of items (title, url, source, summary, published_at); without any, feeds and filings are read over HTTP")
    p.add_argument("--reports", default="reports")
    s = p.add_subparsers(dest="command", required=True)
    w = s.add_parser("watch", help="a streaming query over the feeds; recorded items are read anew each time")
    w.add_argument("--once", action="store_true", help="one poll, then end")
    for name in ("run", "report", "db-stats", "freshness", "build-site", "seed-lineage", "rebuild-observations"):
        s.add_parser(name)
    b = s.add_parser("backfill")
    b.add_argument("--years", type=within(1, 10), default=3)
    b.add_argument("--news-limit", type=within(1, 1000), default=500)
    b.add_argument("--sec-per-company", type=within(1, 100), default=24)
    e = s.add_parser("events")
    e.add_argument("--limit", type=int, default=25)
    r = s.add_parser("review")
    r.add_argument("--decisions", required=True, help="JSON lines of decisions")
    r.add_argument("--limit", type=int, default=100)
    r.add_argument("--batch-size", type=int, default=10)
    r.add_argument("--retry-flagged-limit", type=int, default=0)
    return p


def collectors(engine: Engine, a: argparse.Namespace, now, feed=None, filing=None) -> dict:
    """Recorded items if there are any, else what the command reads: the hourly sources, or a baseline."""
    if a.items:
        read = lambda path: lambda: engine.spark.read.schema(", ".join(f"{c} string" for c in ITEM)).json(path)
        return {name: read(path) for name, _, path in (s.partition("=") for s in a.items)}
    s = engine.settings
    feed, filing = feed or readers.feed_reader(s.agent), filing or readers.filings_reader(s.agent)
    if a.command == "backfill":
        return C.baseline(engine.spark, s, feed, filing, now.date(), a.years, a.news_limit, a.sec_per_company)
    return C.hourly(engine.spark, s, feed, filing, now.date())


def main(argv: list[str] | None = None, feed=None, filing=None, fetch=None) -> int:
    """The command line. ``feed``, ``filing`` and ``fetch`` stand in for the readers over HTTP."""
    a = parser().parse_args(argv)
    spark = get_spark()
    settings = load_settings(a.config)
    # recorded items come without documents, unless a reader is given
    engine = Engine(spark, a.root, settings, fetch or (None if a.items else readers.document_reader(settings.agent)))

    def told(out: dict, now) -> None:
        engine.report(a.reports, now)
        print(json.dumps(out | {"facts": engine.counts()["facts"]}))
        for kind in ("degraded", "failed"):
            if out[kind]:
                print(f"{kind}: {', '.join(out[kind])}", file=sys.stderr)

    if a.command == "watch" and not a.items:
        feed, filing = feed or readers.feed_reader(settings.agent), filing or readers.filings_reader(settings.agent)
        interval = None if a.once else f"{max(5, settings.poll_interval_minutes * 60)} seconds"
        watch(engine, feed, filing, f"{a.root}/watch", interval, told).awaitTermination()
        return 0
    if a.command in ("run", "watch", "backfill"):
        while True:
            now = utc_now()
            out = engine.run(collectors(engine, a, now, feed, filing), now, 0 if a.items else settings.request_delay_seconds)
            told(out, now)
            if a.command != "watch" or a.once:
                return int(bool(out["failed"]))
            time.sleep(max(5, engine.settings.poll_interval_minutes * 60))
    if a.command == "report":
        print(*engine.report(a.reports, utc_now()), sep="\n")
    elif a.command == "db-stats":
        print(json.dumps(engine.counts()))
    elif a.command == "freshness":
        rows = sinks.json_lines(engine.freshness(), 1000)
        print("\n".join(rows) or "No collector has run yet.")
    elif a.command == "events":
        print("\n".join(sinks.json_lines(engine.events(a.limit), a.limit)))
    elif a.command == "build-site":
        engine.site(a.reports, utc_now())
    elif a.command == "seed-lineage":
        print(engine.seed_lineage(utc_now()))
    elif a.command == "rebuild-observations":
        print(engine.rebuild_observations())
    elif a.command == "review":
        given = spark.read.schema("fingerprint string, decision string, canonical_fingerprint string, confidence double, reasoning string").json(a.decisions).withColumn("seq", F.monotonically_increasing_id())
        try:
            n = engine.review(lambda rows: given, utc_now(), a.limit, a.batch_size, a.retry_flagged_limit)
            sinks.write_review_status(f"{a.reports}/review-status.json", "ok", n, utc_now().isoformat())
            print(n)
        except Exception as x:
            sinks.write_review_status(f"{a.reports}/review-status.json", "error", 0, utc_now().isoformat(), str(x))
            print(sinks.redact(str(x)), file=sys.stderr)
            return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
