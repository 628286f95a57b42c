"""Mentions as a stream: micro-batches go through the same pure functions as batches do."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from riskloom.operators import state
from riskloom.session import cut
from riskloom.sources.tables import Changes, Snapshot, Store


def stream_mentions(mentions: DataFrame, store: Store, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Keep the facts table up to date from a stream of mentions (fingerprint, event_id, seen_at, seq).

    With an interval the query goes on; without one it takes what is there and ends. A micro-batch that is replayed after a
    failure isn't counted twice: the number of the stream's last batch is published with the table. A batch reads and writes the buckets of
    its own facts, and is merged anew if another writer changed one of them.
    """
    spark = mentions.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        batch = cut(batch.select("fingerprint", "event_id", "seen_at", "seq"))

        def merged(snap: Snapshot) -> Changes | None:
            marks = snap.read("stream_marks")
            last = marks.filter(F.col("stream") == checkpoint).first()
            if last and last.batch >= number:
                return None
            mark = spark.createDataFrame([(checkpoint, number, 0)], "stream string, batch long, seq int")
            facts, touched = snap.touched("economic_events", batch)
            return Changes(replace={"stream_marks": state.upsert(marks, mark, "stream")}, buckets={"economic_events": (cut(state.register_mentions(facts, batch)), touched)})

        store.transact(merged)

    out = mentions.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=interval) if interval else out.trigger(availableNow=True)).start()


def distinct_items(items: DataFrame, late: str = "90 days") -> DataFrame:
    """A stream of items (id, discovered_at, ...) with each id once; state older than ``late`` is dropped."""
    return items.withWatermark("discovered_at", late).dropDuplicatesWithinWatermark(["id"])


def discovery_lag(items: DataFrame) -> DataFrame:
    """Items with lag_seconds between publication and discovery, where the publication date is readable."""
    return items.withColumn("lag_seconds", F.unix_timestamp("discovered_at") - F.unix_timestamp(F.col("published_at").try_cast("timestamp")))


class FactProcessor(StatefulProcessor):
    """The state of one fact: its canonical event, when it was first and last seen, and its mentions. Facts that nobody mentions for
    ``ttl_ms`` are forgotten by the store."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fact = handle.getValueState("fact", "canonical_event_id string, first_seen string, last_seen string, mention_count long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        import pandas as pd

        old = self.fact.get() if self.fact.exists() else None
        first = last = None
        n = 0
        for f in rows:  # a hot fact comes in several frames
            order = f.sort_values(["seq", "event_id"])
            head, tail = order.iloc[0], order.iloc[-1]
            n += len(f)
            first = min((x for x in (first, (head["seq"], head["event_id"], head["seen_at"])) if x is not None))
            last = max((x for x in (last, (tail["seq"], tail["event_id"], tail["seen_at"])) if x is not None))
        made = (old[0], old[1], last[2], old[3] + n) if old else (first[1], first[2], last[2], n)
        self.fact.update(made)
        yield pd.DataFrame([(key[0], *made)], columns=["fingerprint", "canonical_event_id", "first_seen", "last_seen", "mention_count"])

    def close(self) -> None:
        pass


def keyed_facts(mentions: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """A stream of facts from a stream of mentions (fingerprint, event_id, seen_at, seq): with each batch the facts that it mentions, as they are
    after it. What is known of a fact is in the stream's own state, so no table is read; a batch that is replayed starts from the state
    before it and gives the same rows. Needs the RocksDB state store."""
    return mentions.select("fingerprint", "event_id", "seen_at", "seq").groupBy("fingerprint").transformWithStateInPandas(FactProcessor(ttl_ms), "fingerprint string, canonical_event_id string, first_seen string, last_seen string, mention_count long", "Update", "ProcessingTime" if ttl_ms else "None")


#: Relative error of a quantile.
ERROR = 0.01


def lag_sketch(items: DataFrame, error: float = ERROR, late: str | None = None) -> DataFrame:
    """(source, day, bucket, n): how many items of a source and day of discovery were found after a lag of a bucket.

    Buckets grow by a fixed factor, so any value in one is within ``error`` of its middle; bucket null holds lags of zero or less. Sketches of parts are
    merged by adding n. On a stream ``late`` sets a watermark, and the sketch of a day is final when that has passed it.
    """
    d = items.withWatermark("discovered_at", late) if late else items
    d = discovery_lag(d).filter("lag_seconds IS NOT NULL")
    bucket = F.when(F.col("lag_seconds") > 0, F.ceil(F.log("lag_seconds") / math.log((1 + error) / (1 - error)) - 1e-9))
    return d.groupBy("source", F.window("discovered_at", "1 day").alias("w"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).select("source", F.to_date("w.start").alias("day"), "bucket", "n")


def lag_quantiles(sketches: DataFrame, by: Sequence[str] = ("source", "day"), q: Sequence[float] = (0.5, 0.95, 0.99), error: float = ERROR) -> DataFrame:
    """(by, items, p50, ...): quantiles of stored sketches, of any grouping: the middle of the bucket in which the item of that rank lies."""
    rows = sketches.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))
    own = Window.partitionBy(*by)
    up_to = F.sum("n").over(own.orderBy(F.asc_nulls_first("bucket")))
    factor = (1 + error) / (1 - error)
    value = F.when(F.col("bucket").isNull(), 0.0).otherwise(2 * F.pow(F.lit(factor), F.col("bucket")) / (1 + factor))
    rows = rows.withColumns({"_up_to": up_to, "_all": F.sum("n").over(own), "_value": value})
    return rows.groupBy(*by).agg(F.sum("n").alias("items"), *[F.min(F.when(F.col("_up_to") >= F.ceil(F.lit(x) * F.col("_all")), F.col("_value"))).alias(f"p{round(100 * x)}") for x in q])
