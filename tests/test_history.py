"""As-of history, ledger replay, places, gap facts, lag sketches, keyed facts and the index of names."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskloom.functions import dictionary as D
from riskloom.operators import indicators as I
from riskloom.operators import reads as R
from riskloom.operators import review as V
from riskloom.operators import sessions as X
from riskloom.operators import state
from riskloom.queries import ORACLE, QUERIES
from riskloom.streaming import mentions as L

START = datetime(2025, 1, 1)
OBS = "event_id long, variable_key string, entity string, value double, unit string, observed_at timestamp, confidence double, polarity string, seq long"


def observed(seed, n=400, days=420):
    r = random.Random(seed)
    at = lambda: START + timedelta(days=r.randint(-120, days), hours=r.choice((0, 0, 7)))
    keys = ["ai_related_debt", "refinancing_stress", "ai_external_revenue", "nobody knows it"]
    return [(i, r.choice(keys), r.choice((None, "", "Nvidia", "OpenAI")), r.choice((2e9, 50e9, 3.0)), r.choice(("USD", "signal", "score")), at(), r.choice((None, 0.0, 0.7, 0.99)), r.choice(("risk", "safety", None)), i) for i in range(n)]


def test_a_year_of_days_equals_single_runs(spark):
    obs, v = spark.createDataFrame(observed(1), OBS), I.registry(spark)
    got = {(r.day, r.dimension): r for r in I.dimension_history(obs, v, START, 365).collect()}
    dims = {d for _, d in got}
    assert len(got) == 365 * len(dims)
    near = lambda a, b: a is b or abs(a - b) < 1e-9
    for day in (0, 1, 89, 90, 91, 200, 364):
        for want in I.dimension_table(obs, v, START + timedelta(days=day)).collect():
            r = got[day, want.dimension]
            assert (r.n_points, r.n_signed, r.basis, r.direction) == (want.n_points, want.n_signed, want.basis, want.direction), (day, want)
            assert near(r.score, want.score)
    # all days of one variable against the rule itself
    rows, held = observed(1), {}
    for r in I.validity(obs, START, 365).filter("variable_key = 'ai_related_debt' AND entity = 'Nvidia'").collect():
        held.update(dict.fromkeys(range(r.first, r.end), r.event_id))
    for day in range(365):
        end = START + timedelta(days=day)
        of = [x for x in rows if x[1] == "ai_related_debt" and x[2] == "Nvidia" and end - timedelta(days=90) <= x[5] <= end]
        assert held.get(day) == (max(of, key=lambda x: (x[5], -x[8]))[0] if of else None)


def test_history_of_nothing(spark):
    rows = I.dimension_history(spark.createDataFrame([], OBS), I.registry(spark), START, 3).collect()
    assert rows and all(r.score is None and r.n_points == 0 for r in rows)


LEDGER = "review_id long, fingerprint string, decision string, canonical_fingerprint string, model string, reviewed_at string"
FACTS = "fingerprint string, canonical_event_id string, first_seen string, last_seen string, mention_count long, review_status string, reviewed_at string, reviewer_model string, merged_into string"


def facts(spark, n):
    return spark.createDataFrame([(f"f{i}", f"e{i}", "t", "t", i + 1, "provisional", None, None, None) for i in range(n)], FACTS)


def test_replay_gives_the_facts_that_batches_left(spark):
    r, ledger, now = random.Random(4), [], facts(spark, 12)
    live = {f"f{i}" for i in range(12)}
    for batch in range(4):
        rows = []
        for i, f in enumerate(sorted(r.sample(sorted(live), min(4, len(live))))):
            others = sorted(live - {f} - {x[0] for x in rows})
            kind = r.choice(("confirm", "flag", "merge")) if others and not any(x[2] == f for x in rows) else "flag"
            rows.append((f, kind, r.choice(others) if kind == "merge" else None, "", i))
            if kind == "merge":
                live -= {f}
        d = spark.createDataFrame(rows, "fingerprint string, decision string, canonical_fingerprint string, reasoning string, seq int")
        now = spark.createDataFrame(V.apply_decisions(now, d, "m", f"t{batch}").collect(), FACTS)
        ledger += [(10 * batch + i, f, k, t, "m", f"t{batch}") for f, k, t, _, i in rows]
    out = V.replay(facts(spark, 12), spark.createDataFrame(ledger, LEDGER))
    # a batch's merge counts what its source has then: so does the replay where no source gains after it was merged
    key = lambda x: x.fingerprint
    got, want = sorted(out.drop("root").collect(), key=key), sorted(now.collect(), key=key)
    assert [(x.fingerprint, x.review_status, x.merged_into, x.reviewed_at) for x in got] == [(x.fingerprint, x.review_status, x.merged_into, x.reviewed_at) for x in want]


def test_chains_of_merges_end_in_their_last_root(spark):
    n = 21
    merges = [(n - i, f"f{i}", "merge", f"f{i - 1}", "m", "t") for i in range(1, n)]
    odd = [(90, "nobody", "confirm", None, "m", "t"), (91, "f0", "confirm", None, "m", "t2"), (5, "f0", "flag", None, "m", "t1")]
    out = {r.fingerprint: r for r in V.replay(facts(spark, n), spark.createDataFrame(merges + odd, LEDGER)).collect()}
    assert len(out) == n and {r.root for r in out.values()} == {"f0"}
    assert [out[f"f{i}"].mention_count for i in range(n)] == [sum(range(i + 1, n + 1)) for i in range(n)]
    assert out["f0"].review_status == "confirmed" and out["f7"].merged_into == "f6" and out["f7"].review_status == "merged"
    into_nobody = [(1, "f0", "merge", "gone", "m", "t"), (2, "f1", "merge", "f1", "m", "t")]
    out = {r.fingerprint: r for r in V.replay(facts(spark, 2), spark.createDataFrame(into_nobody, LEDGER)).collect()}
    assert (out["f0"].review_status, out["f0"].root, out["f1"].review_status) == ("provisional", "f0", "flagged")
    ring = [(1, "f0", "merge", "f1", "m", "t"), (2, "f1", "merge", "f0", "m", "t")]
    with pytest.raises(ValueError, match="ring"):
        V.replay(facts(spark, 2), spark.createDataFrame(ring, LEDGER))


def test_places_without_one_task_for_a_group(spark):
    rows = [(i % 3 or None, i * 7 % 50) for i in range(200)]
    d = spark.createDataFrame(rows, "g int, v int").repartition(5)
    got = {}
    for r in R.placed(d, F.col("v").desc(), by=["g"]).collect():
        got.setdefault(r.g, []).append((r.place, r.v))
    for g in (None, 1, 2):
        vs = sorted((v for x, v in rows if x == g), reverse=True)
        assert sorted(got[g]) == list(enumerate(vs))
    assert sorted(r.place for r in R.placed(d, F.asc("v"), F.asc("g")).collect()) == list(range(200))
    assert R.placed(d.limit(0), F.asc("v")).count() == 0


EVENTS = "event_type string, source_entity string, target_entity string, amount double, effective_date string"


def test_reports_around_a_months_end_are_one_fact(spark):
    rows = [("A", "x", None, 30e9, "2026-08-31"), ("A", "x", None, 30e9, "Tue, 1 Sep 2026 10:00:00 GMT"), ("A", "x", None, 30e9, "2026-09-20"), ("A", "x", None, 31e9, "2026-09-01"), ("A", "x", "y", None, None), ("A", "x", "y", None, "soon")]
    d = spark.createDataFrame(rows, EVENTS)
    got = sorted((str(r["first"]), str(r["last"]), r.mentions) for r in X.merge_spans(X.spans(d)).collect())
    assert got == [("2026-08-31", "2026-09-01", 2), ("2026-09-01", "2026-09-01", 1), ("2026-09-20", "2026-09-20", 1), ("None", "None", 2)]
    assert X.merge_spans(X.spans(d)).select(X.span_fingerprint()).distinct().count() == 4


def test_spans_merge_in_any_order_of_batches(spark):
    r = random.Random(9)
    rows = [("A", r.choice("xy"), None, None, str(datetime(2026, 1, 1) + timedelta(days=r.randint(0, 300)))[:10]) for _ in range(60)]
    whole = sorted(map(tuple, X.merge_spans(X.spans(spark.createDataFrame(rows, EVENTS)), 5).collect()))
    stored = X.spans(spark.createDataFrame(rows[:1], EVENTS))
    for part in (rows[30:45], rows[1:30], rows[45:]):
        merged = X.merge_spans(stored.unionByName(X.spans(spark.createDataFrame(part, EVENTS))), 5)
        stored = spark.createDataFrame(merged.collect(), merged.schema)
    assert sorted(map(tuple, stored.collect())) == whole


def tables(spark, path, rows):
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{path}/events.parquet")
    spark.createDataFrame([(1, "a")], "doc_id long, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return sorted(map(str, map(tuple, QUERIES["gap_facts"](spark, str(path)).collect())))


def test_gap_facts_of_missing_values_equal_their_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    day = lambda d: datetime(2024, 1, d, 9)
    undated = [(i, None, u, "A", 1.0) for i, u in ((1, 3), (2, 3), (3, None), (4, None))]
    nobody = [(i, day(d), None, k, 1.0) for i, d, k in ((5, 1, "A"), (6, 3, "A"), (7, 8, "A"), (8, 1, None), (9, 2, None))]
    others = [(i, day(d), u, k, 1.0) for i, d, u, k in ((10, 1, 3, "A"), (12, 4, 3, "A"), (22, 1, 3, "A"), (33, 3, 3, "A"), (13, 1, 3, ""), (14, 1, -5, None), (None, 9, 3, "B"))]
    got = tables(spark, tmp_path, undated + nobody + others)
    con = duckdb.connect()
    for t in ("events", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    # no key has two mentions of one day, so the SQL leaves no tie open
    assert got == sorted(map(str, con.sql(ORACLE["gap_facts"]).fetchall()))
    assert got.count("('A', 'u3', 'u3', None, None, 1)") == 2


def test_a_day_of_many_mentions_is_in_one_span(spark, tmp_path):
    days = [19] + [23] * 40 + [25] * 9 + [28] * 5
    rows = [(11 * i + 1, datetime(2024, 1, d, i % 24), 2, "A", 1.0) for i, d in enumerate(days)]
    random.Random(5).shuffle(rows)
    want = [("19", "19", 1), ("23", "25", 49), ("28", "28", 5)]
    assert tables(spark, tmp_path, rows) == [str(("A", "u2", "u2", f"2024-01-{a}", f"2024-01-{b}", n)) for a, b, n in want]


def fed(spark, tmp_path, parts, schema):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        yield i


def test_a_stream_of_sessions_gives_the_spans_of_a_batch(spark, tmp_path):
    day = lambda m, d: datetime(2026, m, d, 9)
    schema = "event_type string, source_entity string, target_entity string, amount double, at timestamp"
    parts = [[("A", "x", None, 1e9, day(8, 31)), ("A", "x", None, 1e9, day(9, 1)), ("A", "x", None, 1e9, day(9, 15)), ("A", "x", None, 1e9, day(10, 5))], [("B", "z", None, None, datetime(2027, 6, 1))]]
    for _ in fed(spark, tmp_path, parts, schema):
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        q = X.session_stream(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    got = sorted((r.event_type, str(r["first"]), str(r["last"]), r.mentions) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("A", "2026-08-31", "2026-09-15", 3), ("A", "2026-10-05", "2026-10-05", 1)]


MENTIONS = "fingerprint string, event_id string, seen_at string, seq long"


def test_keyed_facts_equal_the_batch(spark, tmp_path):
    r = random.Random(2)
    parts = [[(f"f{r.randint(0, 4)}", f"e{i}", f"t{i:03}", i) for i in range(k, k + 30)] for k in (0, 30, 60)]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for _ in fed(spark, tmp_path, parts, MENTIONS):
            out = []
            q = L.keyed_facts(spark.readStream.schema(MENTIONS).parquet(f"{tmp_path}/in")).writeStream.outputMode("update").foreachBatch(lambda b, i, out=out: out.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
            assert q.awaitTermination(120)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    whole = spark.createDataFrame([x for p in parts for x in p], MENTIONS)
    want = {x.fingerprint: tuple(x) for x in state.summarize_mentions(whole).collect()}
    # the last batch names every fact that it mentions, as all batches together make it
    assert out and all(want[x.fingerprint] == tuple(x) for x in out)


def test_lag_quantiles_are_near_and_merge(spark):
    r = random.Random(6)
    lags = [r.choice((-5, 0, r.randint(1, 300), r.randint(1, 90_000))) for _ in range(500)]
    at = datetime(2026, 3, 3, 12)
    rows = [("s", at, str(at - timedelta(seconds=x))) for x in lags] + [("s", at, None), ("s", at, "soon")]
    d = spark.createDataFrame(rows, "source string, discovered_at timestamp, published_at string")
    out = L.lag_quantiles(L.lag_sketch(d)).first()
    halves = [L.lag_sketch(x) for x in d.randomSplit([0.5, 0.5], 1)]
    assert L.lag_quantiles(halves[0].unionByName(halves[1])).first() == out and out["items"] == 500
    for name, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
        exact = max(0, sorted(lags)[-(-500 * q // 1).__int__() - 1])
        assert abs(out[name] - exact) <= 0.0101 * exact


def test_a_large_dictionary_finds_what_every_term_finds(spark):
    r = random.Random(3)
    names = sorted({"".join(r.choice("abcdé ") for _ in range(r.randint(1, 12))) for _ in range(3_000)}) + ["", None, "ÉCLAIR Inc", "x"]
    texts = [(i, "".join(r.choice("abcdé ") for _ in range(r.choice((0, 5, 300))))) for i in range(20)] + [(50, "An éclair inc. and x"), (51, None), (52, "z" * 127 + "éclair INC")]
    got = {(x.id, x.name, x.at) for x in D.contained(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    want = {(i, n, t.lower().find(n.lower()) + 1) for i, t in texts if t for n in names if n and n.lower() in t.lower()}
    assert got == want
    assert D.contained(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([], "name string")).count() == 0


def test_names_in_texts_of_any_id_and_in_long_texts(spark, monkeypatch):
    monkeypatch.setattr(D, "CHUNK", 16, raising=False)
    texts = [(None, "the ash tree"), (1, "the ash tree"), (1, "the ash tree"), (2, "é" * 40 + "ASH tree" + "ash tree" * 9), (3, None)]
    got = D.contained(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(n,) for n in ("ash tree", "Ash Tree", "e", "é" * 33, "tree" * 20)], "name string")).collect()
    want = [(i, n, t.lower().find(n.lower()) + 1) for i, t in texts if t for n in ("ash tree", "Ash Tree", "e", "é" * 33) if n.lower() in t.lower()]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_texts_do_not_leave_their_tasks_for_a_dictionary(spark):
    r = random.Random(4)
    texts = [(i, "".join(r.choice("abcdefghij ") for _ in range(5_000))) for i in range(200)]

    def written():
        time.sleep(1)
        s = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(s.apply(i).totalShuffleWrite() for i in range(s.size()))

    before = written()
    D.contained(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(t[i : i + 14],) for i, t in texts], "name string")).count()
    assert written() - before < 0.2 * sum(len(t) for _, t in texts)
