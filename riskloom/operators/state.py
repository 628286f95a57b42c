"""Writers as pure functions of (state, batch): the new state is returned, never changed in place.

Batches carry ``seq``, the order of arrival. Publishing a state is sources.tables.publish().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(batch: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col(seq).asc()))
    return batch.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def last_per_key(batch: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col(seq).desc()))
    return batch.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def insert_ignore(state: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """The rows of ``batch`` that are new: the first of each key that ``state`` lacks. Append them to the state."""
    return first_per_key(batch, key).join(state.select(key), key, "left_anti")


def upsert(state: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """The state after the batch: the last row of a key wins."""
    new = last_per_key(batch, key).drop("seq")
    return state.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def summarize_mentions(batch: DataFrame) -> DataFrame:
    """One row for each fingerprint of a batch of mentions (fingerprint, event_id, seen_at, seq); every mention counts, repeats too.

    Sums on the map side, so a fact that a third of all mentions repeat is a row a task.
    """
    at = F.struct("seq", "event_id")
    return batch.groupBy("fingerprint").agg(F.min_by("event_id", at).alias("canonical_event_id"), F.min_by("seen_at", at).alias("first_seen"), F.max_by("seen_at", at).alias("last_seen"), F.count(F.lit(1)).alias("mention_count"))


def register_mentions(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Facts after a batch: a known one keeps its canonical event and first_seen, takes the batch's last time and adds its count; a new one is provisional."""
    b = summarize_mentions(batch).select("fingerprint", *[F.col(c).alias(f"b_{c}") for c in ("canonical_event_id", "first_seen", "last_seen", "mention_count")])
    j = state.join(b, "fingerprint", "full")
    made = {
        "canonical_event_id": F.coalesce("canonical_event_id", "b_canonical_event_id"),
        "first_seen": F.coalesce("first_seen", "b_first_seen"),
        "last_seen": F.coalesce("b_last_seen", "last_seen"),
        "mention_count": (F.coalesce("mention_count", F.lit(0)) + F.coalesce("b_mention_count", F.lit(0))).cast("long"),
        "review_status": F.coalesce("review_status", F.lit("provisional")),
    }
    return j.withColumns(made).select(*state.columns)


def rebuild_observations(events: DataFrame, mapping: DataFrame, variables: DataFrame) -> DataFrame:
    """Observations from all mentions, the first of each id in order of processing."""
    from riskloom.operators.events import to_observations

    o = to_observations(events, mapping, variables)
    return first_per_key(o.withColumn("seq", F.struct("observed_at", "event_id")), "observation_id").drop("seq")


def latest_runs(runs: DataFrame) -> DataFrame:
    """The last run of each collector, by name; one pass with map-side maxima."""
    rest = [c for c in runs.columns if c not in ("collector", "id")]
    return runs.groupBy("collector").agg(F.max_by(F.struct("id", *rest), "id").alias("r")).select("collector", "r.*").orderBy("collector")


def current_runs(log: DataFrame) -> DataFrame:
    """The run ledger from its log, where a run is begun by one row and ended by another: the row with the end wins."""
    rest = [c for c in log.columns if c != "id"]
    return log.groupBy("id").agg(F.max_by(F.struct(*rest), F.col("status") != "running").alias("r")).select("id", "r.*")


def run_summary(runs: DataFrame) -> DataFrame:
    """(new_items, degraded, failed): new rows of runs that didn't fail, and the names of those that did."""
    names = lambda s: F.array_sort(F.collect_list(F.when(F.col("status") == s, F.col("collector"))))
    return runs.agg(F.coalesce(F.sum(F.when(F.col("status") != "error", F.col("items_new"))), F.lit(0)).alias("new_items"), names("degraded").alias("degraded"), names("error").alias("failed"))
