"""The engine: a store of tables, and the jobs over them. Clocks are parameters; no operator calls one."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Mapping
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import text as T
from riskloom.operators import events as E
from riskloom.operators import graph as G
from riskloom.operators import indicators as I
from riskloom.operators import reads as R
from riskloom.operators import review as V
from riskloom.operators import sinks, state
from riskloom.plans import presets
from riskloom.plans.presets import Settings
from riskloom.session import cut
from riskloom.sources import lineage
from riskloom.sources.tables import SCHEMAS, Changes, Snapshot, Store

ITEM = ("title", "url", "source", "summary", "published_at")


class Engine:
    """``fetch`` maps new items (id, url) to (item_id, content_type, body); a null or missing body is a failed fetch. ``clock``
    tells when a run ends."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None, fetch: Callable[[DataFrame], DataFrame] | None = None, clock: Callable[[], datetime] | None = None):
        self.spark, self.store, self.settings, self.fetch, self.clock = spark, Store(spark, root), settings or Settings(), fetch, clock or utc_now
        self.variables, self.mapping = I.registry(spark), E.variable_map(spark)

    # -- ingest ------------------------------------------------------------------------------------------------------

    def run(self, collectors: Mapping[str, Callable[[], DataFrame]], now: datetime, delay: float = 0.0) -> dict:
        """Each collector gives items (title, url, source, summary, published_at, seq). A collector's tables are published together or,
        if anything fails, not at all; its run stays in the ledger either way, with what it had counted. Then a snapshot
        is taken. ``delay``: seconds between collectors."""
        first = None
        for name, collect in collectors.items():
            run_id = self._begin(name, now)
            first, seen = run_id if first is None else first, {"seen": 0, "new": 0}
            try:
                failed = self._ingest(collect(), now, seen)
                status, error = ("degraded", f"{failed} of {seen['new']} document fetches failed") if failed else ("ok", None)
            except Exception as x:  # the ledger records it and the other collectors go on
                status, error = "error", f"{type(x).__name__}: {x}"[:500]
            self._log(run_id, name, now, self.clock().isoformat(), status, seen["seen"], seen["new"], error)
            time.sleep(delay)
        self.snapshot(now)
        return state.run_summary(self.runs().filter(F.col("id") >= F.lit(first if first is not None else 1 << 62))).first().asDict()

    def runs(self) -> DataFrame:
        return state.current_runs(self.store.read("collector_runs"))

    def _begin(self, name: str, now: datetime) -> int:
        given = []

        def begun(snap: Snapshot) -> Changes:
            given.append((snap.read("collector_runs").agg(F.max("id")).first()[0] or 0) + 1)
            return Changes(append={"collector_runs": self._run_row(given[-1], name, now, None, "running", 0, 0, None)})

        self.store.transact(begun)
        return given[-1]

    def _run_row(self, run_id: int, name: str, now: datetime, end: str | None, status: str, seen: int, new: int, error: str | None) -> DataFrame:
        return self.spark.createDataFrame([(run_id, name, now.isoformat(), end, status, seen, new, error)], SCHEMAS["collector_runs"])

    def _log(self, run_id: int, name: str, now: datetime, end: str | None, status: str, seen: int, new: int, error: str | None) -> None:
        self.store.publish(append={"collector_runs": self._run_row(run_id, name, now, end, status, seen, new, error)})

    def _ingest(self, items: DataFrame, now: datetime, counts: dict[str, int]) -> int:
        """The number of failed fetches; ``counts`` is kept up to date on the way."""
        at = F.lit(now).cast("timestamp")
        items = cut(items if "seq" in items.columns else items.withColumn("seq", F.monotonically_increasing_id()))
        counts["seen"] = items.count()
        scored = E.score_items(items.withColumn("summary", F.coalesce("summary", F.lit(""))), self.settings.companies).withColumn("discovered_at", at)
        scored = cut(scored)
        asked = cut(state.insert_ignore(self.store.read("items"), scored, "id"))
        counts["new"] = asked.count()
        bodies = cut(self.fetch(asked.select("id", "url"))) if self.fetch else self.spark.createDataFrame([], "item_id string, content_type string, body string")
        failed = [0]

        def ingested(snap: Snapshot) -> Changes:
            """All but the reading of documents is made anew if another writer came in between."""
            new = cut(state.insert_ignore(snap.read("items"), scored, "id"))
            counts["new"] = new.count()
            docs = new.select(F.col("id").alias("item_id")).join(bodies, "item_id", "left").withColumn("d", T.document_text(F.col("body"), F.col("content_type"), self.settings.max_chars))
            docs = cut(docs.select("item_id", at.alias("fetched_at"), F.coalesce("content_type", F.lit("")).alias("content_type"), F.col("d.status").alias("fetch_status"), F.col("d.text").alias("text")))
            failed[0] = docs.filter("fetch_status <> 'ok'").count()
            found = E.extract_events(new.join(docs.select(F.col("item_id").alias("id"), F.col("text").alias("full_text")), "id"), self.settings.companies)
            place = new.select(F.col("id").alias("document_id"), F.col("seq").alias("_item"))
            found = cut(found.join(place, "document_id").withColumns({"processed_at": at, "fingerprint": E.event_fingerprint(), "seen_at": F.lit(now.isoformat()), "seq": F.struct("_item", "sentence_no", "rule_no")}))
            facts, touched = snap.touched("economic_events", found)
            fresh = state.first_per_key(found, "fingerprint").join(facts.select("fingerprint"), "fingerprint", "left_anti")
            measured = E.to_observations(fresh, self.mapping, self.variables).withColumn("seq", F.col("event_id"))
            # items are new, and so are their documents; of the facts only the buckets of this batch are written
            return Changes(
                append={"items": new, "documents": docs, "financial_events": state.insert_ignore(snap.read("financial_events"), found, "event_id"), "observations": state.insert_ignore(snap.read("observations"), measured, "observation_id")},
                buckets={"economic_events": (state.register_mentions(facts, found), touched)},
            )

        self.store.transact(ingested)
        return failed[0]

    def snapshot(self, now: datetime, limit: int = 5000) -> None:
        scores = cut(I.dimension_scores(self._confirmed(limit), self.variables, now))
        c, dims = I.convergence(scores).first(), {r.dimension: r.score for r in scores.collect()}  # one row for each dimension
        row = self.spark.createDataFrame([(now.isoformat(), c.score, c.label, dims, 0)], "captured_at string, score double, label string, dimensions map<string,double>, seq int")
        self.store.transact(lambda snap: Changes(replace={"system_snapshots": state.upsert(snap.read("system_snapshots"), row, "captured_at")}))

    def _confirmed(self, limit: int) -> DataFrame:
        """The limit comes before the latest observation of each entity is taken."""
        o = R.confirmed_observations(self.store.read("observations"), self.store.read("economic_events"), limit)
        return o.withColumn("seq", F.struct((-F.unix_micros("observed_at")).alias("t"), "observation_id"))

    def seed_lineage(self, now: datetime) -> int:
        """Curated facts that aren't there yet: item, document, event, observation and a confirming review."""
        at, counts = F.lit(now).cast("timestamp"), [0]

        def seeded(snap: Snapshot) -> Changes | None:
            new = cut(lineage.curated(self.spark).join(snap.read("items").select("id"), "id", "left_anti").withColumns({"discovered_at": at, "summary": F.col("evidence_text"), "score": F.lit(lineage.SCORE).cast("long")}))
            counts[0] = new.count()
            if not counts[0]:
                return None
            e = new.select("event_id", F.col("id").alias("document_id"), "event_type", "source_entity", "target_entity", "amount", "currency", F.lit(None).cast("string").alias("instrument"), F.col("published_at").alias("effective_date"), F.lit(lineage.CONFIDENCE).alias("confidence"), "evidence_text", F.lit(lineage.EXTRACTOR).alias("extractor"), at.alias("processed_at"))
            e = cut(e.withColumns({"fingerprint": E.event_fingerprint(), "seen_at": F.lit(now.isoformat()), "seq": F.col("event_id")}))
            said = e.select("fingerprint", F.lit("confirm").alias("decision"), F.lit(None).cast("string").alias("canonical_fingerprint"), F.lit(lineage.CONFIDENCE).alias("confidence"), F.lit(lineage.REASONING).alias("reasoning"), "seq")
            docs = new.select(F.col("id").alias("item_id"), at.alias("fetched_at"), F.lit("text/plain").alias("content_type"), F.lit("verified").alias("fetch_status"), F.col("evidence_text").alias("text"), F.lit(0).alias("seq"))
            known = state.first_per_key(E.to_observations(e, self.mapping, self.variables).withColumn("seq", F.col("event_id")), "observation_id")
            facts, touched = snap.touched("economic_events", e)
            return Changes(
                append={"items": new, "financial_events": e, "observations": state.insert_ignore(snap.read("observations"), known, "observation_id"), "evidence_reviews": V.append_ledger(snap.read("evidence_reviews"), said, lineage.EXTRACTOR, now.isoformat(), self._next_review(snap))},
                replace={"documents": state.upsert(snap.read("documents"), docs, "item_id")},
                buckets={"economic_events": (V.apply_decisions(state.register_mentions(facts, e), said, lineage.EXTRACTOR, now.isoformat()), touched)},
            )

        self.store.transact(seeded)
        return counts[0]

    def rebuild_observations(self) -> int:
        counts = [0]

        def rebuilt(snap: Snapshot) -> Changes:
            o = cut(state.rebuild_observations(snap.read("financial_events"), self.mapping, self.variables))
            counts[0] = o.count()
            return Changes(replace={"observations": o})

        self.store.transact(rebuilt)
        return counts[0]

    # -- review ------------------------------------------------------------------------------------------------------

    def _next_review(self, snap: Snapshot) -> int:
        return (snap.read("evidence_reviews").agg(F.max("review_id")).first()[0] or 0) + 1

    def _apply(self, decisions: DataFrame, model: str, now: datetime) -> int:
        decisions = cut(decisions)
        n = decisions.count()

        def applied(snap: Snapshot) -> Changes | None:
            ends = decisions.select("fingerprint").unionByName(decisions.filter("canonical_fingerprint <> ''").select(F.col("canonical_fingerprint").alias("fingerprint")))
            facts, touched = snap.touched("economic_events", ends)
            if V.bad_merges(facts, decisions).count():
                raise ValueError("a merge names an unknown fact, or one that is merged already")
            if not n:
                return None
            return Changes(
                append={"evidence_reviews": V.append_ledger(snap.read("evidence_reviews"), decisions, model, now.isoformat(), self._next_review(snap))},
                replace={"observations": V.drop_merged_observations(snap.read("observations"), facts, decisions)},
                buckets={"economic_events": (V.apply_decisions(facts, decisions, model, now.isoformat()), touched)},
            )

        self.store.transact(applied)
        return n

    def queue(self, status: str, limit: int) -> DataFrame:
        t = [self.store.read(x) for x in ("economic_events", "financial_events", "items", "documents", "evidence_reviews")]
        return R.provisional_events(*t[:4], limit) if status == "provisional" else R.flagged_events(*t, limit)

    def review(self, judge: Callable[[DataFrame], DataFrame], now: datetime, limit: int = 100, batch_size: int = 10, retry_flagged_limit: int = 0, model: str = "judge") -> int:
        """Preflight, then batches of the queue up to ``limit`` facts in all, then up to ``retry_flagged_limit`` flagged facts once
        more. ``judge`` maps payload rows to decisions; the commands here don't call any model. A batch of which nothing can be
        applied is an error. The number of facts that were decided."""
        if batch_size < 1 or max(limit, retry_flagged_limit) < 1:
            return 0
        total = 0
        for status, most in (("provisional", limit), ("flagged", retry_flagged_limit)):
            done = 0
            if status == "provisional" and limit > 0:
                done = self._apply(V.preflight(self.queue(status, limit)).withColumn("seq", F.col("fingerprint")), V.PREFLIGHT_MODEL, now)
            while done < most:
                rows = cut(self.queue(status, min(batch_size, most - done)))
                if not rows.count():
                    break
                applied = self._apply(V.valid_decisions(judge(V.payload(rows)), rows), model, now)
                if not applied:
                    raise RuntimeError("no decision of a batch could be applied")
                done += applied
            total += done
        return total

    # -- reads ------------------------------------------------------------------------------------------------------

    def report(self, folder: str, now: datetime) -> tuple[Path, Path]:
        rows = cut(R.top_items(self.store.read("items"), self.settings.report_limit)).orderBy(F.desc("score"), F.desc("discovered_at"), "id")
        return sinks.write_csv(rows, folder, now), sinks.write_html(rows, folder, self.settings.high_signal_threshold)

    def counts(self) -> dict[str, int]:
        return {"items": self.store.read("items").count(), "facts": R.canonical_count(self.store.read("economic_events")), "mentions": self.store.read("financial_events").count()}

    def freshness(self) -> DataFrame:
        return state.latest_runs(self.runs())

    def events(self, limit: int = 100) -> DataFrame:
        return R.recent_events(self.store.read("financial_events"), self.store.read("items"), limit)

    def site(self, folder: str, now: datetime) -> dict:
        """The dashboard's data as one JSON file. All its lists are limited."""
        t = {k: self.store.read(k) for k in ("items", "economic_events", "financial_events", "evidence_reviews", "system_snapshots")}
        rows = lambda df: [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]
        items = R.top_items(t["items"], 1500)
        facts = cut(R.canonical_events(t["economic_events"], t["financial_events"], t["items"], 5000)).orderBy(F.desc("first_seen"), "fingerprint")
        obs = cut(self._confirmed(2000))
        table = cut(I.dimension_table(obs, self.variables, now))
        readings = I.direction_readings(table)
        nodes, edges = G.network(facts, items.limit(800))
        data = {
            "generated_at": now.isoformat(),
            "convergence": rows(I.convergence(table.select("dimension", "score")))[0],
            "dimensions": {r.dimension: r.score for r in table.collect()},
            "evidence_counts": {r.dimension: r.evidence_count for r in I.evidence_counts(table).collect()},
            "evidence_basis": {r.dimension: r.basis for r in I.evidence_basis(table).collect()},
            "direction": {r.dimension: {"direction": r.direction, "evidence_count": r.evidence_count} for r in readings.collect()},
            "overall_direction": I.overall_direction(readings).first()[0],
            "history": rows(R.recent_snapshots(t["system_snapshots"]).withColumn("dimensions", F.to_json("dimensions"))),
            "network": {"nodes": rows(nodes), "edges": rows(edges)},
            "timeline": rows(G.timeline(facts.withColumn("seq", F.struct("first_seen", "fingerprint")))),
            "dimension_evidence": {r["dimension"]: r["evidence"] for r in rows(G.evidence_lists(G.evidence_rows(obs, facts, self.variables, now)))},
            "items": rows(items),
            "canonical_events": rows(facts),
            "mention_count": t["financial_events"].count(),
            "event_count": R.canonical_count(t["economic_events"]),
            "review_counts": rows(R.review_counts(t["economic_events"], t["evidence_reviews"]))[0],
            "runs": rows(self.freshness()),
            "entities": list(self.settings.companies),
            "variables": rows(self.variables),
        }
        Path(folder).mkdir(parents=True, exist_ok=True)
        (Path(folder) / "data.json").write_text(json.dumps(data, ensure_ascii=False), encoding="utf-8")
        return data


def utc_now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)
