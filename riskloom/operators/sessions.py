"""Facts by a gap in time: reports of the same kind, ends and amount are one fact as long as no more than some days lie between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import text as T
from riskloom.operators.events import iso_month

KEY = ("event_type", "source_entity", "target_entity", "bucket")


def spans(events: DataFrame, to: int = -6) -> DataFrame:
    """(KEY, first, last, mentions) of events: one row for each day that mentions a key; events without a readable date have null ones.

    Days are added up before anything is ordered, so a key that a third of all events share is a row a day.
    """
    none = F.lit("")
    key = [F.col("event_type"), F.coalesce("source_entity", none).alias("source_entity"), F.coalesce("target_entity", none).alias("target_entity"), F.coalesce(T.rounded_text(F.col("amount"), to), F.lit("unknown")).alias("bucket")]
    day = F.to_date(iso_month(F.col("effective_date")).try_cast("date"))
    return events.select(*key, day.alias("first"), day.alias("last")).groupBy(*KEY, "first", "last").agg(F.count(F.lit(1)).alias("mentions"))


def merge_spans(rows: DataFrame, gap_days: int = 14, key: Sequence[str] = KEY) -> DataFrame:
    """Spans (key, first, last, mentions) of which no two of a key are within ``gap_days`` of each other.

    Merging what was merged gives the same as merging all at once, so a batch is merged with the stored spans of its keys alone, and a late
    report may join two of them. Spans without a date are one for each key.
    """
    order = Window.partitionBy(*key).orderBy(F.asc_nulls_first("first"), "last")
    so_far = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("first") > F.date_add(so_far, gap_days), so_far.isNull() & F.col("first").isNotNull(), F.lit(False))
    numbered = rows.withColumn("_new", fresh.cast("int")).withColumn("_span", F.sum("_new").over(order))
    return numbered.groupBy(*key, "_span").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("mentions").alias("mentions")).drop("_span")


def span_fingerprint(key: Sequence[str] = KEY) -> Column:
    """A span's name: its key and first day."""
    return F.sha2(F.concat_ws("|", *key, F.coalesce(F.date_format("first", "yyyy-MM-dd"), F.lit("unknown"))), 256)


def session_stream(events: DataFrame, gap_days: int = 14, late: str = "30 days") -> DataFrame:
    """The same spans of a stream of events with a timestamp ``at``: Spark's session windows, final when the watermark has passed them."""
    none = F.lit("")
    key = [F.col("event_type"), F.coalesce("source_entity", none).alias("source_entity"), F.coalesce("target_entity", none).alias("target_entity"), F.coalesce(T.rounded_text(F.col("amount")), F.lit("unknown")).alias("bucket")]
    days = events.select(*key, F.date_trunc("day", "at").alias("at")).withWatermark("at", late)
    # a session ends before its gap has passed: a second more lets reports that lie the whole gap apart be one
    w = F.session_window("at", f"{gap_days} days 1 second")
    return days.groupBy(*KEY, w.alias("w")).agg(F.count(F.lit(1)).alias("mentions"), F.to_date(F.max("at")).alias("last")).select(*KEY, F.to_date("w.start").alias("first"), "last", "mentions")
