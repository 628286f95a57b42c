from datetime import datetime

import pytest

from riskloom.operators import events as E
from riskloom.operators import indicators as I
from riskloom.plans import presets

AS_OF = datetime(2026, 8, 21)
SCHEMA = "variable_key string, entity string, value double, unit string, observed_at string, confidence double, polarity string, seq long"


@pytest.fixture(scope="module")
def variables(spark):
    return I.registry(spark)


def table(spark, variables, rows, **more):
    full = [(*r, i) if len(r) == 7 else r for i, r in enumerate(rows)]
    return {r.dimension: r for r in I.dimension_table(spark.createDataFrame(full, SCHEMA), variables, AS_OF, **more).collect()}


def usd(entity, value, day="2026-08-10", key="ai_related_debt", conf=1.0):
    return (key, entity, value, "USD", day, conf, "risk")


def gate(spark, **scores):
    rows = [(d, scores.get(d)) for d in (*presets.RISK_DIMENSIONS, presets.COUNTER)]
    return I.convergence(spark.createDataFrame(rows, "dimension string, score double")).first()


def test_nothing_known(spark, variables):
    t = table(spark, variables, [])
    assert len(t) == 9 and all(r.score is None and r.basis is None and r.direction is None for r in t.values())


def test_too_few_dimensions(spark):
    r = gate(spark, capital=80.0)
    assert (r.score, r.label, r.direction, r.gate_passed, r.gate_reason) == (None, "INSUFFICIENT EVIDENCE", "unknown", False, "1 of 3 required dimensions measured")


def test_counter_evidence(spark):
    risks = dict.fromkeys(presets.RISK_DIMENSIONS, 70.0)
    assert gate(spark, **risks).score == 70.0
    assert gate(spark, **risks, counter_evidence=20.0).score == 62.5
    assert gate(spark, **risks, counter_evidence=50.0).score == 70.0


def test_gate_needs_both_groups(spark):
    high = dict.fromkeys(presets.RISK_DIMENSIONS, 90.0)
    r = gate(spark, **high)
    assert r.gate_passed and r.label == "HIGH CONVERGENCE" and r.gate_reason == "material evidence in fragility and monetization"
    r = gate(spark, **high | dict.fromkeys(presets.PROPAGATION, 10.0))
    assert not r.gate_passed and r.label != "HIGH CONVERGENCE" and r.gate_reason.endswith("fragility/stress/transmission")
    r = gate(spark, **high | dict.fromkeys(presets.ECONOMICS, 10.0))
    assert not r.gate_passed and r.gate_reason.endswith("monetization/capital/circularity")


def test_newest_wins(spark, variables):
    rows = [usd("Nvidia", 1e9, "2026-08-20"), usd("Microsoft", 2e9), usd("OpenAI", 3e9)]
    want = table(spark, variables, rows)["fragility"].score
    assert table(spark, variables, [usd("Nvidia", 50e9, "2026-08-01"), *rows])["fragility"].score == want
    assert table(spark, variables, rows * 20)["fragility"].score == want


def test_window_and_unreadable_times(spark, variables):
    for day in ("2026-01-01", "2026-08-22", "not a time", None):
        assert table(spark, variables, [usd("x", 1e9, day)])["fragility"].score is None
    assert table(spark, variables, [usd("x", 1e9, "2026-05-23")])["fragility"].score is not None


def test_first_of_equal_times_wins_and_null_entity_is_empty(spark, variables):
    rows = [("public_market_transmission_stage", None, 2.0, "score", "2026-08-10", 1.0, "risk"), ("public_market_transmission_stage", "", 1.0, "score", "2026-08-10", 1.0, "risk")]
    assert table(spark, variables, rows)["transmission"].score == 40.0


def test_directional_safety(spark, variables):
    r = table(spark, variables, [("ai_external_revenue", e, 1.0, "signal", "2026-08-10", 0.72, "safety") for e in "abc"])["monetization"]
    assert (r.score, r.n_points, r.direction) == (40.6, 0, "lower_pressure")


def test_thin_evidence(spark, variables):
    r = table(spark, variables, [usd("a", 1e9), usd("b", 2e9)])["fragility"]
    assert r.score == 57.1 and r.n_points == 2
    r = table(spark, variables, [usd(e, 1e9) for e in "abcde"])["fragility"]
    assert r.n_points == 5 and r.basis == "aggregate" and abs(r.score - 100 * (1 - 1 / 1.1) * 1.4) < 1e-9


def test_trigger(spark, variables):
    r = table(spark, variables, [("public_market_transmission_stage", "s", 2.0, "score", "2026-08-10", 0.99, "risk")])["transmission"]
    assert abs(r.score - 39.6) < 1e-9 and r.basis == "confirmed_trigger"


def test_qualitative_and_single(spark, variables):
    r = table(spark, variables, [("refinancing_stress", e, 1.0, "signal", "2026-08-10", 0.9, "risk") for e in "ab"])["stress"]
    assert (r.score, r.direction, r.n_signed) == (57.1, "higher_pressure", 2)
    r = table(spark, variables, [("model_price_pressure", "a", 1.0, "signal", "2026-08-10", 0.99, "risk")])["cannibalization"]
    assert (r.score, r.basis) == (54.2, "directional_estimate")


def test_overall_direction(spark):
    ask = lambda rows: I.overall_direction(spark.createDataFrame(rows, "dimension string, direction string, evidence_count long")).first()[0]
    assert ask([("capital", "higher_pressure", 6), ("monetization", "lower_pressure", 2)]) == "higher_pressure"
    assert ask([("a", "higher_pressure", 2), ("b", "lower_pressure", 2)]) == "mixed" and ask([]) == "unknown"


def test_event_to_observation(spark, variables):
    rows = [("e1", "GUARANTEES", 30e9, "USD"), ("e2", "REVENUE_REPORT", None, None), ("e3", "REFINANCES", 20e9, "USD"), ("e4", "ENTERS_INDEX", None, None), ("e5", "SUPPLIES", 1.0, "USD"), ("e6", "PRICE_CUT", 5.0, "USD"), ("e7", "GUARANTEES", 1.0, "EUR")]
    events = spark.createDataFrame([(a, "d", b, "Nvidia", c, d, "2026-08", 0.9, "t", "x") for a, b, c, d in rows], "event_id string, document_id string, event_type string, source_entity string, amount double, currency string, effective_date string, confidence double, evidence_text string, extractor string")
    got = {r.event_id: (r.variable_key, r.value, r.unit) for r in E.to_observations(events, E.variable_map(spark), variables).collect()}
    assert got == {"e1": ("vendor_financing", 30e9, "USD"), "e2": ("ai_external_revenue", 1.0, "signal"), "e3": ("refinancing_stress", 1.0, "score"), "e4": ("public_market_transmission_stage", 2.0, "score"), "e6": ("model_price_pressure", 1.0, "signal"), "e7": ("vendor_financing", 1.0, "signal")}
