"""Reports and exports of limited tables, rendered on the driver."""

from __future__ import annotations

import csv
import html
import json
import re
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(rows: DataFrame, folder: str, now: datetime) -> Path:
    """One file for a limited table, named by the minute; a table without rows gives an empty header line."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    path = Path(folder) / f"risk_report_{now:%Y-%m-%d_%H%M}.csv"
    found = rows.withColumns({c: F.to_json(c) for c, k in rows.dtypes if k.startswith(("array", "map", "struct"))}).collect()
    with path.open("w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(rows.columns if found else [])
        out.writerows(found)
    return path


def json_lines(df: DataFrame, limit: int = 25) -> list[str]:
    return [r[0] for r in df.limit(limit).select(F.to_json(F.struct("*"))).collect()]


def write_html(rows: DataFrame, folder: str, threshold: int) -> Path:
    """A page of the rows of a limited table that score at least ``threshold``."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    e = lambda x: html.escape("" if x is None else str(x))
    cards = [
        f'<article><p><b>{e(r["score"])}</b> {e(r["category"])} · {e(r["source"])} · {e(r["published_at"])}</p><h2><a href="{e(r["url"])}" rel="noopener">{e(r["title"])}</a></h2><p>{e(r["summary"])}</p></article>'
        for r in rows.filter(F.col("score") >= threshold).collect()
    ]
    path = Path(folder) / "latest.html"
    path.write_text('<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Risk report</title></head><body>' + ("\n".join(cards) or "<p>No high-signal items.</p>") + "</body></html>", encoding="utf-8")
    return path


def redact(text: str) -> str:
    return re.sub(r"sk-[A-Za-z0-9_-]+", "[redacted]", text)[:500]


def write_review_status(path: str, status: str, reviewed: int, now: str, error: str | None = None) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps({"status": status, "reviewed": reviewed, "updated_at": now, "error": error and redact(error)}), encoding="utf-8")
