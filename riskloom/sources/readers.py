"""Readers over HTTP, with the standard library: feeds, filings and documents. All may be replaced by any function of the same form."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from urllib.parse import quote_plus
from urllib.request import Request, urlopen
from xml.etree import ElementTree

from pyspark.sql import DataFrame

FEED_URL = "https://news.google.com/rss/search?q={}&hl=en-US&gl=US&ceid=US:en"
FILINGS_URL = "https://data.sec.gov/submissions/{}"


def get(url: str, agent: str, timeout: float) -> tuple[str, bytes]:
    """Content type and body."""
    with urlopen(Request(url, headers={"User-Agent": agent}), timeout=timeout) as r:  # noqa: S310
        return r.headers.get("content-type", "").lower(), r.read()


def feed_entries(xml: bytes) -> list[dict]:
    """Entries of an RSS feed, in order."""
    out = []
    for item in ElementTree.fromstring(xml).iter("item"):
        text = lambda tag, item=item: item.findtext(tag)
        out.append({"title": text("title"), "link": text("link"), "summary": text("description"), "published": text("pubDate"), "source_title": text("source")})
    return out


def feed_reader(agent: str, url: str = FEED_URL, timeout: float = 10) -> Callable[[str], list[dict]]:
    """A function from a query to its entries."""
    return lambda query: feed_entries(get(url.format(quote_plus(query)), agent, timeout)[1])


def filings_reader(agent: str, url: str = FILINGS_URL, timeout: float = 30, delay: float = 0.2) -> Callable[[str], str]:
    """A function from the name of a filings file to its JSON; it waits ``delay`` seconds after each."""

    def read(name: str) -> str:
        body = get(url.format(name), agent, timeout)[1].decode("utf-8", "replace")
        time.sleep(delay)
        return body

    return read


def document_reader(agent: str, timeout: float = 25, read: Callable[[str, str, float], tuple[str, bytes]] = get) -> Callable[[DataFrame], DataFrame]:
    """The engine's ``fetch``: (id, url) to (item_id, content_type, body), read by executors; what can't be read has a null body."""

    def rows(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            out = []
            for i, u in zip(b["id"], b["url"], strict=True):
                try:
                    kind, body = read(u, agent, timeout)
                    out.append((i, kind, body.decode("utf-8", "replace")))
                except Exception:  # a document that can't be read is a result, not an error
                    out.append((i, "", None))
            yield pd.DataFrame(out, columns=["item_id", "content_type", "body"])

    return lambda items: items.select("id", "url").mapInPandas(rows, "item_id string, content_type string, body string")
