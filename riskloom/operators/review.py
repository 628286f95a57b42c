"""Adjudication: decisions are an input table, their effects are set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.text import context_window, preflight_reason
from riskloom.operators.state import last_per_key
from riskloom.session import cut

PREFLIGHT_MODEL = "deterministic-preflight-v1"  # fixed value


def preflight(queue: DataFrame, max_usd: float = 5e12) -> DataFrame:
    """Decisions to flag what clearly is no evidence: (fingerprint, decision, canonical_fingerprint, confidence, reasoning)."""
    reason = preflight_reason(F.col("evidence_text"), F.col("amount"), F.col("event_type"), max_usd)
    return queue.withColumn("reasoning", reason).filter("reasoning IS NOT NULL").select("fingerprint", F.lit("flag").alias("decision"), F.lit(None).cast("string").alias("canonical_fingerprint"), F.lit(0.99).alias("confidence"), "reasoning")


def payload(queue: DataFrame, around: int = 1_250) -> DataFrame:
    """What a judge sees: the row with the source text cut down to the evidence's surroundings."""
    return queue.withColumn("source_context", context_window(F.col("source_text"), F.col("evidence_text"), around)).drop("source_text")


def valid_decisions(decisions: DataFrame, asked: DataFrame) -> DataFrame:
    """Decisions (fingerprint, decision, canonical_fingerprint, ..., seq) that may be applied.

    The last of a fingerprint counts, invented fingerprints go, and a merge stands only if its target was asked for too and
    is confirmed in the same batch. What drops out stays in the queue.
    """
    d = last_per_key(decisions, "fingerprint").join(asked.select("fingerprint"), "fingerprint", "left_semi")
    targets = d.filter("decision = 'confirm'").select(F.col("fingerprint").alias("canonical_fingerprint"))
    return d.filter("decision <> 'merge'").unionByName(d.filter("decision = 'merge'").join(targets, "canonical_fingerprint", "left_semi").select(*d.columns))


def bad_merges(facts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Merges whose source is unknown or whose target is missing or merged already: if there is any, the batch isn't applied."""
    m = decisions.filter("decision = 'merge' AND canonical_fingerprint <> '' AND canonical_fingerprint <> fingerprint")
    live = facts.filter("review_status <> 'merged'").select(F.col("fingerprint").alias("canonical_fingerprint"))
    return m.join(live, "canonical_fingerprint", "left_anti").select("fingerprint").unionByName(m.join(facts, "fingerprint", "left_anti").select("fingerprint")).distinct()


def append_ledger(reviews: DataFrame, decisions: DataFrame, model: str, now: str, first_id: int) -> DataFrame:
    """Ledger rows of a batch, numbered on from ``first_id``. Append only; batches are limited."""
    number = F.row_number().over(Window.orderBy("seq", "fingerprint")) + F.lit(first_id - 1)
    return decisions.select(number.cast("long").alias("review_id"), "fingerprint", "decision", "canonical_fingerprint", "confidence", "reasoning", F.lit(model).alias("model"), F.lit(now).alias("reviewed_at"))


def apply_decisions(facts: DataFrame, decisions: DataFrame, model: str, now: str) -> DataFrame:
    """Facts after a batch of valid decisions.

    A merge with another fact adds the source's mentions to the target and marks the source merged. confirm confirms; a
    flag, or a merge with itself or nothing, flags.
    """
    d = decisions.select("fingerprint", "decision", "canonical_fingerprint", F.coalesce((F.col("decision") == "merge") & (F.col("canonical_fingerprint") != "") & (F.col("canonical_fingerprint") != F.col("fingerprint")), F.lit(False)).alias("_merge"))
    gained = d.filter("_merge").join(facts.select("fingerprint", "mention_count"), "fingerprint").groupBy(F.col("canonical_fingerprint").alias("fingerprint")).agg(F.sum("mention_count").alias("_gain"))
    j = facts.join(d, "fingerprint", "left").join(gained, "fingerprint", "left")
    decided = F.col("decision").isNotNull()
    made = {
        "mention_count": F.col("mention_count") + F.coalesce("_gain", F.lit(0)),
        "review_status": F.when(F.col("_merge"), "merged").when(F.col("decision") == "confirm", "confirmed").when(decided, "flagged").otherwise(F.col("review_status")),
        "reviewed_at": F.when(decided, F.lit(now)).otherwise(F.col("reviewed_at")),
        "reviewer_model": F.when(decided, F.lit(model)).otherwise(F.col("reviewer_model")),
        "merged_into": F.when(F.col("_merge"), F.col("canonical_fingerprint")).otherwise(F.col("merged_into")),
    }
    return j.withColumns(made).select(*facts.columns)


def drop_merged_observations(observations: DataFrame, facts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Observations without those of the canonical events that this batch merges away."""
    gone = decisions.filter("decision = 'merge' AND canonical_fingerprint <> '' AND canonical_fingerprint <> fingerprint").join(facts, "fingerprint").select(F.col("canonical_event_id").alias("event_id"))
    return observations.join(gone, "event_id", "left_anti").select(*observations.columns)


def replay(facts: DataFrame, ledger: DataFrame) -> DataFrame:
    """Facts as the whole ledger leaves them, with ``root``, the fact that a chain of merges ends in (itself without one).

    ``facts`` are as the mentions alone make them; ``ledger`` has review_id, fingerprint, decision, canonical_fingerprint, model, reviewed_at. The last
    entry of a fact counts; entries of unknown facts and merges into unknown ones have no effect. A merge takes all that was merged into
    its source before along, so a fact's mentions are those of all facts below it. Chains are walked by doubling: each round sees twice as
    far, so one of 1,000 merges takes ten rounds.
    """
    last = ledger.groupBy("fingerprint").agg(F.max_by(F.struct("decision", "canonical_fingerprint", "model", F.col("reviewed_at").alias("at")), "review_id").alias("r")).select("fingerprint", "r.*")
    last = last.withColumn("_merge", F.coalesce((F.col("decision") == "merge") & (F.col("canonical_fingerprint") != "") & (F.col("canonical_fingerprint") != F.col("fingerprint")), F.lit(False)))
    known = facts.select(F.col("fingerprint").alias("canonical_fingerprint"), F.lit(True).alias("_known"))
    d = cut(facts.join(last, "fingerprint", "left").join(known, "canonical_fingerprint", "left"))
    merged = F.col("_merge") & F.col("_known")
    decided = F.col("decision").isNotNull() & (merged | ~F.col("_merge"))
    at = cut(d.select("fingerprint", F.when(merged, F.col("canonical_fingerprint")).alias("up"), F.when(merged, F.col("canonical_fingerprint")).otherwise(F.col("fingerprint")).alias("root"), F.col("mention_count").alias("total")))
    # a chain has no more merges than there are; only a ring of them goes on
    for _ in range(at.filter("up IS NOT NULL").count().bit_length() + 1):
        moving = at.filter("up IS NOT NULL")
        if not moving.limit(1).count():
            break
        gained = moving.groupBy(F.col("up").alias("fingerprint")).agg(F.sum("total").alias("_gain"))
        above = at.select(F.col("fingerprint").alias("up"), F.col("up").alias("_up"), F.col("root").alias("_root"))
        at = cut(at.join(above, "up", "left").join(gained, "fingerprint", "left").select("fingerprint", F.col("_up").alias("up"), F.coalesce("_root", "root").alias("root"), (F.col("total") + F.coalesce("_gain", F.lit(0))).alias("total")))
    else:
        raise ValueError("merges of the ledger form a ring")
    made = {
        "mention_count": F.col("total"),
        "review_status": F.when(merged, "merged").when(decided & (F.col("decision") == "confirm"), "confirmed").when(decided, "flagged").otherwise(F.col("review_status")),
        "reviewed_at": F.when(decided, F.col("at")).otherwise(F.col("reviewed_at")),
        "reviewer_model": F.when(decided, F.col("model")).otherwise(F.col("reviewer_model")),
        "merged_into": F.when(merged, F.col("canonical_fingerprint")).otherwise(F.col("merged_into")),
    }
    return d.join(at.select("fingerprint", "root", "total"), "fingerprint").withColumns(made).select(*facts.columns, "root")
