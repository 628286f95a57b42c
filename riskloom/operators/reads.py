"""Read queries: joins of the tables, a filter, an order with a unique end, a limit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import cut

EVENT_COLUMNS = ("event_id", "event_type", "source_entity", "target_entity", "amount", "currency", "effective_date", "confidence", "evidence_text")


def head(df: DataFrame, limit: int | None, *order) -> DataFrame:
    """The first rows in an order; with a limit no more than that from each task is shuffled."""
    df = df.orderBy(*order)
    return df if limit is None else df.limit(limit)


def placed(df: DataFrame, *order: Column, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``place``, the row's number in an order (from 0), in each group of ``by`` or in all.

    The rows are dealt by ranges of the order and written; each task numbers its own, and the counts of the tasks before it, a row for each
    task and group, are added. No task holds a whole group.
    """
    keys = [F.asc(c) for c in by]
    rows = cut(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumns({"_task": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}))
    counts = rows.groupBy("_task", *by).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    shift = {f"_of_{c}": F.col(c) for c in by}
    counts = counts.withColumns(shift).drop(*by)
    on = F.col("t._task") == F.col("c._task")
    for c in by:
        on = on & F.col(f"t.{c}").eqNullSafe(F.col(f"c._of_{c}"))
    joined = rows.alias("t").join(counts.alias("c"), on)
    return joined.select(*[F.col(f"t.{c}") for c in df.columns], (F.col("t._row") - F.col("c._first") + F.col("c._before")).alias("place"))


def top_items(items: DataFrame, limit: int | None = 500) -> DataFrame:
    return head(items, limit, F.desc("score"), F.desc("discovered_at"), F.asc("id"))


def with_items(events: DataFrame, items: DataFrame) -> DataFrame:
    """Events with the title, url and source of their item; events without one go."""
    return events.join(items.select(F.col("id").alias("document_id"), "title", "url", "source", "published_at"), "document_id")


def recent_events(events: DataFrame, items: DataFrame, limit: int | None = 500) -> DataFrame:
    return head(with_items(events, items), limit, F.desc("processed_at"), F.asc("event_id"))


def all_events(events: DataFrame) -> DataFrame:
    return head(events, None, F.asc("processed_at"), F.asc("event_id"))


def facts_with_events(facts: DataFrame, events: DataFrame, items: DataFrame) -> DataFrame:
    """Each fact with its canonical event and that event's item; facts without either go."""
    return facts.join(with_items(events, items), facts["canonical_event_id"] == F.col("event_id"))


def canonical_events(facts: DataFrame, events: DataFrame, items: DataFrame, limit: int | None = 500) -> DataFrame:
    """Facts that aren't merged, newest first."""
    return head(facts_with_events(facts.filter("review_status <> 'merged'"), events, items), limit, F.desc("first_seen"), F.asc("fingerprint"))


def queued(facts: DataFrame, events: DataFrame, items: DataFrame, documents: DataFrame, status: str) -> DataFrame:
    d = facts_with_events(facts.filter(F.col("review_status") == status), events, items)
    return d.join(documents.select(F.col("item_id").alias("document_id"), F.col("text").alias("source_text")), "document_id", "left")


def provisional_events(facts: DataFrame, events: DataFrame, items: DataFrame, documents: DataFrame, limit: int | None = 100) -> DataFrame:
    """The review queue, oldest first, with the source text where there is any."""
    return head(queued(facts, events, items, documents, "provisional"), limit, F.asc("first_seen"), F.asc("fingerprint"))


def review_tallies(reviews: DataFrame) -> DataFrame:
    """(fingerprint, review_count, prior_reasoning): the ledger in one row a fact, with the latest reasoning."""
    return reviews.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("review_count"), F.max_by("reasoning", "review_id").alias("prior_reasoning"))


def flagged_events(facts: DataFrame, events: DataFrame, items: DataFrame, documents: DataFrame, reviews: DataFrame, limit: int | None = 100, max_reviews: int = 2) -> DataFrame:
    """Flagged facts with fewer than ``max_reviews`` reviews, the longest waiting first."""
    d = queued(facts, events, items, documents, "flagged").join(review_tallies(reviews), "fingerprint", "left").withColumn("review_count", F.coalesce("review_count", F.lit(0)))
    return head(d.filter(F.col("review_count") < max_reviews), limit, F.asc_nulls_first("reviewed_at"), F.asc("first_seen"), F.asc("fingerprint"))


def review_counts(facts: DataFrame, reviews: DataFrame, max_reviews: int = 2, statuses: tuple[str, ...] = ("provisional", "confirmed", "flagged")) -> DataFrame:
    """One row: facts of each status, and retry_pending: flagged ones with fewer than ``max_reviews`` reviews."""
    tallied = facts.select("fingerprint", "review_status").join(review_tallies(reviews).select("fingerprint", "review_count"), "fingerprint", "left")
    return tallied.agg(*[F.count_if(F.col("review_status") == s).alias(s) for s in statuses], F.count_if((F.col("review_status") == "flagged") & (F.coalesce("review_count", F.lit(0)) < max_reviews)).alias("retry_pending"))


def confirmed_observations(observations: DataFrame, facts: DataFrame, limit: int | None = 1000) -> DataFrame:
    """Observations whose event is the canonical event of a confirmed fact, newest first. A semi join: nothing of the fact is returned."""
    d = observations.join(facts.filter("review_status = 'confirmed'").select(F.col("canonical_event_id").alias("event_id")), "event_id", "left_semi")
    return head(d, limit, F.desc("observed_at"), F.asc("observation_id"))


def recent_snapshots(snapshots: DataFrame, limit: int | None = 365) -> DataFrame:
    return head(snapshots, limit, F.desc("captured_at"))


def canonical_count(facts: DataFrame) -> int:
    return facts.filter("review_status <> 'merged'").count()
