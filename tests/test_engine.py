import json
import sys
import zlib
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from riskloom import cli, queries
from riskloom.engine import Engine
from riskloom.operators import graph as G
from riskloom.operators import reads as R
from riskloom.operators import review as V
from riskloom.operators import state
from riskloom.sources import feeds, filings
from riskloom.plans.presets import Settings, company_queries, load_settings, pressure_queries
from riskloom.sources import collectors as C
from riskloom.sources import readers
from riskloom.sources.tables import MOST_PARTS, SCHEMAS, Changes, Conflict, Store
from riskloom.streaming.mentions import discovery_lag, distinct_items, stream_mentions

NOW = datetime(2026, 9, 5)
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # readers of this file run on executors
SENTENCE = "Nvidia guarantees $30 billion financing for OpenAI."


def items(spark, rows):
    return spark.createDataFrame([(t, u, "s", "", d, i) for i, (t, u, d) in enumerate(rows)], "title string, url string, source string, summary string, published_at string, seq long")


def fetched(df):
    return df.select(F.col("id").alias("item_id"), F.lit("text/plain").alias("content_type"), F.lit("full text.").alias("body"))


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "store"), fetch=fetched, clock=lambda: NOW + timedelta(minutes=5))


def judge(decide):
    """Decisions of a function fingerprint -> (decision, target)."""
    return lambda rows: rows.sparkSession.createDataFrame([(r.fingerprint, *decide(r), 0.9, "because", i) for i, r in enumerate(rows.collect())], "fingerprint string, decision string, canonical_fingerprint string, confidence double, reasoning string, seq long")


def test_twenty_reports_of_one_fact(spark, engine):
    out = engine.run({"news": lambda: items(spark, [(SENTENCE, f"http://x/{i}", "2026-08-31") for i in range(20)])}, NOW)
    assert out == {"new_items": 20, "degraded": [], "failed": []}
    facts = engine.store.read("economic_events").collect()
    assert len(facts) == 1 and facts[0].mention_count == 20 and engine.counts() == {"items": 20, "facts": 1, "mentions": 20}
    assert engine.store.read("observations").count() == 1
    nodes, edges = G.network(R.canonical_events(engine.store.read("economic_events"), engine.store.read("financial_events"), engine.store.read("items")))
    assert [(e.source, e.target, e.weight, e.mentions) for e in edges.collect()] == [("Nvidia", "OpenAI", 1, 20)]
    again = engine.run({"news": lambda: items(spark, [(SENTENCE, "http://x/3", "2026-08-31")])}, NOW + timedelta(hours=1))
    assert again["new_items"] == 0 and engine.counts()["mentions"] == 20
    assert engine.rebuild_observations() == 20


def test_a_failed_source_leaves_only_its_run(spark, engine):
    def broken():
        return items(spark, [(SENTENCE, "http://bad", "2026-08-01")]).withColumn("title", F.raise_error(F.lit("lost")))

    out = engine.run({"bad": broken, "good": lambda: items(spark, [(SENTENCE, "http://1", "2026-08-01"), ("Other", "http://2", None)])}, NOW)
    assert out["failed"] == ["bad"] and out["new_items"] == 2 and engine.counts() == {"items": 2, "facts": 1, "mentions": 1}
    runs = {r.collector: r for r in engine.freshness().collect()}
    assert runs["bad"].status == "error" and "lost" in runs["bad"].error and runs["good"].status == "ok" and runs["good"].items_new == 2
    assert {r.completed_at for r in runs.values()} == {"2026-09-05T00:05:00"} and runs["good"].started_at == "2026-09-05T00:00:00"


def test_a_failed_run_tells_what_it_had_counted(spark, engine):
    engine.fetch = lambda df: fetched(df).withColumn("body", F.raise_error(F.lit("no route")))
    assert engine.run({"bad": lambda: items(spark, [(SENTENCE, "http://1", None), ("Other", "http://2", None), ("Other", "http://2", None)])}, NOW)["failed"] == ["bad"]
    r = engine.freshness().first()
    assert (r.items_seen, r.items_new, engine.counts()["items"]) == (3, 2, 0) and "no route" in r.error


def test_failed_fetches_degrade(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    assert e.run({"n": lambda: items(spark, [("a", "http://1", None), ("b", "http://2", None)])}, NOW)["degraded"] == ["n"]
    assert e.freshness().first().error == "2 of 2 document fetches failed"


def test_merge_keeps_provenance(spark, engine):
    engine.run({"n": lambda: items(spark, [(SENTENCE, "http://1", "2026-08-31"), (SENTENCE, "http://2", "2026-09-01")])}, NOW)
    first, second = sorted(engine.store.read("economic_events").collect(), key=lambda r: r.fingerprint)
    assert engine.review(judge(lambda r: ("confirm", None) if r.fingerprint == first.fingerprint else ("merge", first.fingerprint)), NOW) == 2
    facts = {r.fingerprint: r for r in engine.store.read("economic_events").collect()}
    assert facts[first.fingerprint].mention_count == 2 and facts[second.fingerprint].merged_into == first.fingerprint
    assert engine.counts() == {"items": 2, "facts": 1, "mentions": 2}
    assert R.confirmed_observations(engine.store.read("observations"), engine.store.read("economic_events")).count() == 1
    assert engine.store.read("evidence_reviews").count() == 2


def test_batches_and_one_retry(spark, engine):
    engine.run({"n": lambda: items(spark, [(SENTENCE, f"http://{i}", f"2026-0{i}-01") for i in range(1, 4)])}, NOW)
    calls = []

    def flag(rows):
        calls.append(rows.count())
        return judge(lambda r: ("flag", None))(rows)

    assert engine.review(flag, NOW, batch_size=2) == 3 and calls == [2, 1]
    assert engine.review(flag, NOW, batch_size=0) == engine.review(flag, NOW, limit=0) == 0
    assert engine.review(flag, NOW, retry_flagged_limit=3) == 3
    assert engine.review(flag, NOW, retry_flagged_limit=3) == 0
    counts = R.review_counts(engine.store.read("economic_events"), engine.store.read("evidence_reviews")).first()
    assert (counts.provisional, counts.confirmed, counts.flagged, counts.retry_pending) == (0, 0, 3, 0)


def test_retries_have_a_budget_of_their_own(spark, engine):
    old = [(f"This guarantee for OpenAI could adversely affect Nvidia {i}.", f"http://old{i}", f"2026-0{i}-01") for i in (1, 2)]
    engine.run({"n": lambda: items(spark, old)}, NOW)
    assert engine.review(judge(lambda r: ("confirm", None)), NOW) == 2
    engine.run({"n": lambda: items(spark, [(SENTENCE, f"http://{i}", f"2026-0{i}-01") for i in range(3, 6)])}, NOW + timedelta(hours=1))
    # three provisional facts and two flagged ones, of which one may be tried again, in one call
    assert engine.review(judge(lambda r: ("confirm", None)), NOW, batch_size=2, retry_flagged_limit=1) == 4
    counts = R.review_counts(engine.store.read("economic_events"), engine.store.read("evidence_reviews")).first()
    assert (counts.provisional, counts.confirmed, counts.flagged, counts.retry_pending) == (0, 4, 1, 1)


def test_preflight_comes_before_the_judge(spark, engine):
    engine.run({"n": lambda: items(spark, [("This guarantee for OpenAI could adversely affect Nvidia.", "http://1", None)])}, NOW)
    assert engine.review(judge(lambda r: ("confirm", None)), NOW) == 1
    r = engine.store.read("evidence_reviews").first()
    assert r.decision == "flag" and r.model == V.PREFLIGHT_MODEL and r.confidence == 0.99


def test_decisions(spark):
    d = spark.createDataFrame([("a", "flag", None, 0), ("a", "confirm", None, 1), ("x", "confirm", None, 2), ("b", "merge", "a", 3), ("c", "merge", "b", 4), ("d", "merge", "zz", 5)], "fingerprint string, decision string, canonical_fingerprint string, seq long")
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "fingerprint string")
    assert {(r.fingerprint, r.decision) for r in V.valid_decisions(d, asked).collect()} == {("a", "confirm"), ("b", "merge")}
    facts = spark.createDataFrame([("a", "merged"), ("b", "provisional")], "fingerprint string, review_status string")
    assert {r[0] for r in V.bad_merges(facts, d).collect()} == {"b", "c", "d"}


def test_mentions_merge_by_arrival(spark):
    empty = spark.createDataFrame([], SCHEMAS["economic_events"])
    m = lambda *rows: spark.createDataFrame(rows, "fingerprint string, event_id string, seen_at string, seq long")
    once = state.register_mentions(empty, m(("fp", "e1", "t1", 0), ("fp", "e2", "t0", 1)))
    r = state.register_mentions(once, m(("fp", "e3", "t9", 0), ("new", "e4", "t9", 1))).filter("fingerprint = 'fp'").first()
    assert (r.canonical_event_id, r.first_seen, r.last_seen, r.mention_count, r.review_status) == ("e1", "t1", "t9", 3, "provisional")


def test_stream_equals_batch(spark, tmp_path, engine):
    rows = [("fp", f"e{i}", f"t{i}", i) for i in range(6)] + [("other", "e9", "t9", 9)]
    schema = "fingerprint string, event_id string, seen_at string, seq long"
    for k in range(2):
        spark.createDataFrame(rows[k::2], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream_mentions(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")), engine.store, str(tmp_path / "cp")).awaitTermination(120)
    assert {(r.fingerprint, r.mention_count) for r in engine.store.read("economic_events").collect()} == {("fp", 6), ("other", 1)}
    mark = engine.store.read("stream_marks").collect()
    assert len(mark) == 1 and mark[0].stream == str(tmp_path / "cp") and mark[0].batch == 1 and engine.store.read("system_snapshots").count() == 0


def test_streams_of_items(spark, tmp_path):
    rows = [("a", "2026-01-02 00:00:00", "2026-01-01"), ("a", "2026-01-03 00:00:00", "2026-01-01"), ("b", "2026-01-02 00:00:00", "no date")]
    schema = "id string, discovered_at timestamp, published_at string"
    typed = spark.createDataFrame(rows, "id string, d string, published_at string").selectExpr("id", "CAST(d AS TIMESTAMP) AS discovered_at", "published_at")
    typed.coalesce(1).write.json(str(tmp_path / "in"))
    out = distinct_items(spark.readStream.schema(schema).json(str(tmp_path / "in")))
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
    assert sorted((r.id, r.lag_seconds) for r in discovery_lag(typed).collect() if r.id == "a") == [("a", 86400), ("a", 172800)] and discovery_lag(typed).filter("id = 'b'").first().lag_seconds is None


def test_lineage_is_seeded_once(spark, engine):
    assert engine.seed_lineage(NOW) == 9 and engine.seed_lineage(NOW) == 0
    facts = engine.store.read("economic_events").collect()
    assert len(facts) == 9 and {f.review_status for f in facts} == {"confirmed"}
    assert engine.store.read("financial_events").filter("amount = 20e9").count() == 1
    engine.snapshot(NOW)
    assert engine.store.read("system_snapshots").first().dimensions["cannibalization"] == 54.2


def test_site_of_an_empty_store(spark, engine, tmp_path):
    data = engine.site(str(tmp_path / "site"), NOW)
    assert len(data["variables"]) == 13 and data["event_count"] == data["mention_count"] == 0 and data["convergence"]["score"] is None
    assert set(data["dimensions"].values()) == {None} and json.loads((tmp_path / "site/data.json").read_text()) == data
    csv, html = engine.report(str(tmp_path / "r"), NOW)
    assert csv.name == "risk_report_2026-09-05_0000.csv" and csv.read_text().strip() == "" and "No high-signal" in html.read_text()


def test_site_and_report_of_a_filled_store(spark, engine, tmp_path):
    engine.run({"news": lambda: items(spark, [(SENTENCE, f"http://x/{i}", "2026-08-31") for i in range(3)] + [("Default and distress: refinancing at Oracle", "http://<y>&", None)])}, NOW)
    engine.seed_lineage(NOW)
    engine.review(judge(lambda r: ("confirm", None)), NOW)
    engine.snapshot(NOW + timedelta(hours=1))
    data = engine.site(str(tmp_path / "site"), NOW)
    assert json.loads((tmp_path / "site/data.json").read_text()) == data
    assert data["event_count"] == 11 and data["mention_count"] == 13 and len(data["items"]) == 13 and [h["captured_at"] for h in data["history"]] == ["2026-09-05T01:00:00", "2026-09-05T00:00:00"]
    assert data["review_counts"] == {"provisional": 0, "confirmed": 11, "flagged": 0, "retry_pending": 0} and data["overall_direction"] == "higher_pressure"
    edges = {(e["source"], e["target"], e["type"]): e["mentions"] for e in data["network"]["edges"]}
    assert edges["Nvidia", "OpenAI", "GUARANTEES"] == 3 and any(t == "EVIDENCE" for *_, t in edges)
    assert {n["kind"] for n in data["network"]["nodes"]} == {"company", "index", "evidence"}
    assert [t["date"] for t in data["timeline"]] == sorted(t["date"] for t in data["timeline"]) and len(data["timeline"]) == 10
    rows = [r for rs in data["dimension_evidence"].values() for r in rs]
    assert rows and all([r["date"] or "" for r in rs] == sorted([r["date"] or "" for r in rs], reverse=True) for rs in data["dimension_evidence"].values())
    csv, html = engine.report(str(tmp_path / "r"), NOW)
    lines = csv.read_text().splitlines()
    assert lines[0].startswith("id,") and len(lines) == 14
    page = html.read_text()
    assert "http://&lt;y&gt;&amp;" in page and page.count("<article>") == len([i for i in data["items"] if i["score"] >= engine.settings.high_signal_threshold])


def test_network_evidence(spark):
    events = spark.createDataFrame([("Nvidia", "OpenAI", "GUARANTEES", 7), ("NVIDIA", "OpenAI", "SUPPLIES", None), ("Meta", "Meta", "X", 1)], "source_entity string, target_entity string, event_type string, mention_count long")
    docs = spark.createDataFrame([("i1", "t", '["AWS", "Nvidia"]', None), ("i2", "t2", "bad json", None), (None, "t3", "[]", None)], "id string, title string, companies string, published_at string")
    nodes, edges = G.network(events, docs)
    assert {(e.source, e.type): (e.weight, e.mentions) for e in edges.collect()} == {("Nvidia", "GUARANTEES"): (1, 7), ("Nvidia", "SUPPLIES"): (1, 1), ("Amazon", "EVIDENCE"): (1, 1), ("Nvidia", "EVIDENCE"): (1, 1)}
    assert {n.id: (n.kind, n.weight) for n in nodes.collect()} == {"Nvidia": ("company", 2), "OpenAI": ("company", 2), "Meta": ("company", 2), "Amazon": ("company", 0), "evidence:i1": ("evidence", 1), "evidence:i2": ("evidence", 1)}


def test_filings(spark):
    recent = {"form": ["8-K", "3", "8-K"], "accessionNumber": ["1-1", "2", "9"], "filingDate": ["2026-01-01", "2026-01-02"], "primaryDocument": ["a.htm", "b.htm", "c.htm"]}
    old = {"form": ["10-K", "8-K"], "accessionNumber": ["3-3", "1-1"], "filingDate": ["2024-02-01", "2024-01-01"], "primaryDocument": ["k.htm", "e.htm"]}
    whole = {"filings": {"recent": recent, "files": [{"name": "old.json", "filingTo": "2024-12-31"}, {"name": "older.json", "filingTo": "2009-01-01"}]}}
    raw = spark.createDataFrame([("Co", 42, json.dumps(whole), 0), ("Co", 42, json.dumps(old), 1)], "name string, cik long, json string, file_pos int")
    rows = filings.records(raw)
    assert rows.count() == 4 and [r.file for r in filings.archives(raw.filter("file_pos = 0"), "2020-01-01").collect()] == ["old.json"]
    top = filings.filing_items(filings.historical_filings(rows, "2020-01-01", 1)).first()
    assert top.title == "Co SEC filing: 10-K (2024-02-01)" and top.url.endswith("/data/42/33/k.htm")
    both = filings.historical_filings(rows, "2020-01-01", 5).orderBy("place").collect()
    assert [(r.form, r.filing_date) for r in both] == [("10-K", "2024-02-01"), ("8-K", "2024-01-01")]
    assert [r.accession for r in filings.recent_filings(rows.filter("file_pos = 0"), None, 3).collect()] == ["1-1"]


def test_feed_source(spark):
    feeds.register(spark, lambda q: [{"title": f"<b>{q}</b> {i}", "link": f"http://{i}", "summary": "a&amp;b"} for i in range(5)])
    entries = spark.read.format("riskloom_feed").option("queries", "one\ntwo").load()
    assert [(r.title, r.source, r.summary) for r in feeds.current(entries, 6).collect()][-1] == ("two 0", "Google News", "a&b")
    assert [r.title for r in feeds.historical(entries, 2, 4).collect()] == ["one 0", "one 1"]
    assert feeds.historical(entries, 0).count() == 0 and feeds.dated(["q"], "a", "b") == ["q after:a before:b"]


def test_every_query_has_an_oracle():
    assert queries.QUERIES.keys() == queries.ORACLE.keys()


# -- the store ------------------------------------------------------------------------------------------------------------


def test_publications_are_whole_and_appends_write_their_own_rows(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    mark = lambda *rows: spark.createDataFrame(rows, "stream string, batch long")
    store.publish(stream_marks=mark(("a", 1)))
    store.publish(append={"stream_marks": mark(("b", 2))})
    before = store.manifest()
    assert before["number"] == 2 and len(before["parts"]["stream_marks"]) == 2 and store.read("stream_marks").count() == 2
    broken = mark(("c", 3)).withColumn("stream", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        store.publish(append={"stream_marks": mark(("d", 4))}, system_snapshots=spark.createDataFrame([], SCHEMAS["system_snapshots"]).unionByName(broken.selectExpr("stream AS captured_at", "1D AS score", "'' AS label", "CAST(NULL AS MAP<STRING, DOUBLE>) AS dimensions")))
    assert store.manifest() == before


def mention(spark, fingerprint, i):
    return spark.createDataFrame([(fingerprint, f"e{i}", f"t{i}", i)], "fingerprint string, event_id string, seen_at string, seq long")


def registers(batch, between=None):
    """A transaction that counts a batch's mentions; ``between`` runs once, after the facts were read."""
    todo = [between] if between else []

    def made(snap):
        facts, touched = snap.touched("economic_events", batch)
        if todo:
            todo.pop()()
        return Changes(buckets={"economic_events": (state.register_mentions(facts, batch), touched)})

    return made


def test_two_writers_that_read_the_same_version_lose_nothing(spark, tmp_path):
    first, second = (Store(spark, str(tmp_path), 4) for _ in range(2))
    first.transact(registers(mention(spark, "fp", 1)))
    read = []

    def between():
        read.append(second.manifest()["number"])
        second.transact(registers(mention(spark, "fp", 2)))

    first.transact(registers(mention(spark, "fp", 3), between))
    assert read == [1] and first.manifest()["number"] == 3
    assert [(r.fingerprint, r.mention_count, r.canonical_event_id) for r in first.read("economic_events").collect()] == [("fp", 3, "e1")]
    # without a replay it is a conflict, and nothing is published
    snap = first.snapshot()
    changes = registers(mention(spark, "fp", 4), lambda: second.transact(registers(mention(spark, "fp", 5))))(snap)
    with pytest.raises(Conflict):
        first.commit(snap, changes)
    assert first.read("economic_events").first().mention_count == 4


def test_writers_of_other_buckets_and_tables_are_no_conflict(spark, tmp_path):
    store, calls = Store(spark, str(tmp_path), 64), []
    one, other = next((f"a{i}", f"a{j}") for i in range(9) for j in range(i) if len({r[0] for r in spark.createDataFrame([(f"a{i}",), (f"a{j}",)], "fingerprint string").select(store.bucket("economic_events")).collect()}) == 2)
    inner = registers(mention(spark, one, 1), lambda: (store.transact(registers(mention(spark, other, 2))), store.publish(append={"stream_marks": spark.createDataFrame([("s", 1)], "stream string, batch long")})))
    store.transact(lambda snap: calls.append(1) or inner(snap))
    assert len(calls) == 1 and store.read("economic_events").count() == 2 and store.read("stream_marks").count() == 1


def test_many_writers_at_once(spark, tmp_path):
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda i: Store(spark, str(tmp_path), 2).transact(registers(mention(spark, f"f{i % 2}", i)), 50), range(6)))
    got = {r.fingerprint: r.mention_count for r in Store(spark, str(tmp_path)).read("economic_events").collect()}
    assert got == {"f0": 3, "f1": 3}


def test_a_batch_writes_the_buckets_of_its_facts_only(spark, tmp_path):
    store = Store(spark, str(tmp_path), 16)
    many = spark.range(2_000).selectExpr("CONCAT('f', id) AS fingerprint", "CONCAT('e', id) AS event_id", "'t' AS seen_at", "id AS seq")
    store.transact(registers(many))
    old = {p["part"]: p for p in store.manifest()["parts"]["economic_events"]}
    assert len(old) == 16 and sum(p["rows"] for p in old.values()) == 2_000
    assert all(p["min"] <= p["max"] for p in old.values())
    store.transact(registers(many.filter("seq < 3").withColumn("event_id", F.lit("new"))))
    new = {p["part"] for p in store.manifest()["parts"]["economic_events"]}
    assert len(new) == 16 and 1 <= len(new - old.keys()) <= 3
    facts = store.read("economic_events")
    assert facts.count() == 2_000 and facts.filter("mention_count = 2").count() == 3


def test_a_store_without_buckets_is_read_and_taken_apart(spark, tmp_path):
    store = Store(spark, str(tmp_path), 4)
    facts = state.register_mentions(store.read("economic_events"), mention(spark, "fp", 1).unionByName(mention(spark, "fq", 2)))
    part = store._write("economic_events", facts)
    (tmp_path / "manifests").mkdir()
    (tmp_path / "manifests" / "000000000001.json").write_text(json.dumps({"economic_events": [part]}))
    assert store.read("economic_events").count() == 2
    store.transact(registers(mention(spark, "fp", 3)))
    assert {r.fingerprint: r.mention_count for r in store.read("economic_events").collect()} == {"fp": 2, "fq": 1}
    assert all(p["bucket"] is not None for p in store.manifest()["parts"]["economic_events"])


def test_many_appends_are_written_as_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("riskloom.sources.tables.MOST_PARTS", 3)
    store = Store(spark, str(tmp_path))
    for i in range(6):
        store.publish(append={"stream_marks": spark.createDataFrame([(f"s{i}", i)], "stream string, batch long")})
    assert len(store.manifest()["parts"]["stream_marks"]) <= 3 < MOST_PARTS and store.read("stream_marks").count() == 6


def test_columns_that_old_parts_lack_hold_their_default(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    facts = spark.createDataFrame([("fp", "e", "t", "t")], "fingerprint string, canonical_event_id string, first_seen string, last_seen string")
    store._columns = lambda name: facts.columns
    store.publish(economic_events=facts)
    r = Store(spark, str(tmp_path)).read("economic_events").first()
    assert (r.mention_count, r.review_status, r.merged_into) == (1, "provisional", None)


# -- collectors and commands ------------------------------------------------------------------------------------------------


def feed(query):
    return [{"title": f"{query} <i>{i}</i>", "link": f"http://n/{zlib.crc32(query.encode())}/{i}", "summary": SENTENCE if i == 0 else "x", "published": "2026-08-31", "source_title": "S" if i else ""} for i in range(30)]


def filing(name):
    arrays = lambda n, year: {"form": ["8-K", "4", "10-K"][:n], "accessionNumber": [f"{year}-{i}" for i in range(n)], "filingDate": [f"{year}-0{i + 1}-01" for i in range(n)], "primaryDocument": [f"d{i}.htm" for i in range(n)]}
    if name.startswith("CIK"):
        return json.dumps({"filings": {"recent": arrays(3, 2026), "files": [{"name": f"old-{name}", "filingTo": "2024-12-31"}, {"name": "never", "filingTo": "2001-01-01"}]}})
    assert name != "never"
    return json.dumps(arrays(2, 2024))


SETTINGS = Settings(queries=("q one", "q two"), companies=("Nvidia", "OpenAI", "Nvidia"), filers=(("Nvidia", 1045810), ("Oracle", 1341439)))


def test_hourly_collectors(spark, engine):
    found = {k: c().orderBy("seq").collect() for k, c in C.hourly(spark, SETTINGS, feed, filing, NOW.date()).items()}
    assert {k: len(v) for k, v in found.items()} == {"google-news-rss": 4, "company-economic-news": 36, "external-competitive-pressure": 40, "sec-edgar": 4}
    assert [r.title for r in found["google-news-rss"]] == [f"q one {i}" for i in range(4)] and [r.source for r in found["google-news-rss"]][:2] == ["Google News", "S"]
    assert found["company-economic-news"][0].title.startswith('"Nvidia" (') and "after:2026-09-03 before:2026-09-06" in found["company-economic-news"][-1].title and '"OpenAI"' in found["company-economic-news"][-1].title
    assert [r.title for r in found["sec-edgar"]] == [f"{c} SEC filing: {f} (2026-0{m}-01)" for c in ("Nvidia", "Oracle") for f, m in (("8-K", 1), ("10-K", 3))]
    out = engine.run(C.hourly(spark, SETTINGS, feed, filing, NOW.date()), NOW)
    assert out["failed"] == [] and engine.counts()["items"] == 4 + 36 + 40 + 4 and engine.freshness().count() == 4 and engine.counts()["facts"] > 0
    assert len(company_queries(SETTINGS.companies)) == 2 and len(pressure_queries()) == len(set(pressure_queries())) > 10


def test_baseline_reads_the_archives_that_matter(spark):
    found = {k: c().orderBy("seq").collect() for k, c in C.baseline(spark, SETTINGS, feed, filing, NOW.date(), 3, 20, 3).items()}
    assert {k: len(v) for k, v in found.items()} == {"google-news-history": 20, "sec-edgar-history": 6}
    assert "after:2023-09-06 before:2026-09-06" in found["google-news-history"][0].title and len({r.title.split(" after")[0] for r in found["google-news-history"]}) == 4
    assert [r.title for r in found["sec-edgar-history"]][:3] == ["Nvidia SEC filing: 10-K (2026-03-01)", "Nvidia SEC filing: 8-K (2026-01-01)", "Nvidia SEC filing: 8-K (2024-01-01)"]


def test_commands(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "get_spark", lambda: spark)
    monkeypatch.setenv("RISKLOOM_REQUEST_DELAY_SECONDS", "0")
    (tmp_path / "c.toml").write_text('[news]\nqueries = ["q one"]\n[entities]\ncompanies = ["Nvidia", "OpenAI"]\n[sec]\ncompanies = [{name = "Nvidia", cik = 1045810}]\n')
    base = ["--root", str(tmp_path / "store"), "--config", str(tmp_path / "c.toml"), "--reports", str(tmp_path / "r")]
    said = lambda *a, **k: (cli.main([*base, *a], **k), capsys.readouterr())
    readers_given = {"feed": feed, "filing": filing, "fetch": fetched}
    code, out = said("run", **readers_given)
    assert code == 0 and json.loads(out.out)["new_items"] == 2 + 36 + 40 + 2 and json.loads(out.out)["facts"] > 0
    code, out = said("backfill", "--years", "1", "--news-limit", "6", "--sec-per-company", "2", **readers_given)
    assert code == 0 and json.loads(out.out)["new_items"] == 6 and not out.err
    with pytest.raises(SystemExit):
        said("backfill", "--years", "11")
    (tmp_path / "i.json").write_text(json.dumps({"title": "t", "url": "http://t"}) + "\n")
    code, out = cli.main([*base, "--items", f"file={tmp_path}/i.json", "run"]), capsys.readouterr()
    assert code == 0 and json.loads(out.out)["degraded"] == ["file"] and "degraded: file" in out.err
    assert json.loads(said("db-stats")[1].out)["items"] == 87
    assert {json.loads(x)["collector"] for x in said("freshness")[1].out.splitlines()} == {"google-news-rss", "company-economic-news", "external-competitive-pressure", "sec-edgar", "google-news-history", "sec-edgar-history", "file"}
    assert len(said("events", "--limit", "2")[1].out.splitlines()) == 2
    assert said("seed-lineage")[1].out.strip() == "9" and int(said("rebuild-observations")[1].out) > 9
    assert said("build-site")[0] == 0 and (tmp_path / "r/data.json").exists() and len(said("report")[1].out.splitlines()) == 2
    (tmp_path / "d.json").write_text("")
    code, out = said("review", "--decisions", str(tmp_path / "d.json"))
    assert code == 1 and json.loads((tmp_path / "r/review-status.json").read_text())["status"] == "error"


def test_settings(tmp_path):
    (tmp_path / "c.toml").write_text('[monitor]\nreport_limit = 7\npoll_interval_minutes = 5\nunknown = 1\n[entities]\ncompanies = ["A"]\n')
    s = load_settings(None, {"RISKLOOM_CONFIG_PATH": str(tmp_path / "c.toml"), "RISKLOOM_POLL_INTERVAL_MINUTES": "30", "RISKLOOM_AGENT": "me"})
    assert (s.report_limit, s.poll_interval_minutes, s.agent, s.companies, s.queries) == (7, 30, "me", ("A",), Settings().queries)
    assert load_settings(None, {}) == Settings()


def test_readers(spark, monkeypatch):
    xml = b"<rss><channel><item><title>T &amp; U</title><link>http://l</link><description>&lt;b&gt;d&lt;/b&gt;</description><pubDate>Mon, 31 Aug 2026</pubDate><source url='s'>Src</source></item><item><title>two</title></item></channel></rss>"
    asked = []
    monkeypatch.setattr(readers, "get", lambda url, agent, timeout: asked.append(url) or ("text/xml", xml))
    one, two = readers.feed_reader("me")("a b&c")
    assert one == {"title": "T & U", "link": "http://l", "summary": "<b>d</b>", "published": "Mon, 31 Aug 2026", "source_title": "Src"} and two["link"] is None and "q=a+b%26c&" in asked[0]
    assert readers.filings_reader("me", delay=0)("CIK1.json").startswith("<rss") and asked[1].endswith("/CIK1.json")

    def read(url, agent, timeout):
        if "bad" in url:
            raise OSError("no route")
        return "text/html", b"<p>hi</p>"

    out = readers.document_reader("me", read=read)(spark.createDataFrame([("1", "http://ok"), ("2", "http://bad")], "id string, url string")).orderBy("item_id").collect()
    assert [(r.content_type, r.body) for r in out] == [("text/html", "<p>hi</p>"), ("", None)]
