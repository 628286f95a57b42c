import time

import pytest
from pyspark.sql import functions as F

from riskloom.functions import text as T
from riskloom.operators import events as E
from riskloom.plans import presets


def one(spark, expression, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return row.select(expression.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "value", "currency"),
    [
        ("$30 billion investment", 30e9, "USD"),
        ("a sum of 7 and €2.5 Mn", 2.5e6, "EUR"),
        ("grew 40 in 2024", None, None),
        ("12 bn raised", 12e9, None),
        ("$1,234", 1.0, "USD"),
        ("version 5.6 Terra", 5.6e12, None),
        ("£ 3", 3.0, "GBP"),
        (None, None, None),
    ],
)
def test_amounts(spark, text, value, currency):
    got = one(spark, T.extract_amount(F.col("t")), t=text)
    assert (got.value, got.currency) == (value, currency)


def test_aliases(spark):
    names = ["AWS", "Google", "Claude", "Qwen", "Kimi", " NVIDIA  Corporation ", "Unknown", "", None, "  "]
    got = [one(spark, T.canonicalize(F.col("n")), n=n) for n in names]
    assert got == ["Amazon", "Alphabet", "Anthropic", "Alibaba", "Moonshot AI", "Nvidia", "Unknown", None, None, ""]
    assert one(spark, T.canonicalize_many(F.col("n")), n=["AWS", None, "Amazon", "", "Qwen"]) == ["Amazon", "Alibaba"]


def test_categories_and_score(spark):
    assert one(spark, T.classify(F.lower("t")), t="Pension 401(k) plans and loans") == "distribution"
    assert one(spark, T.classify(F.lower("t")), t="Refinancing LOAN") == "credit"
    assert one(spark, T.classify(F.lower("t")), t="a public offering") == "ipo"
    assert one(spark, T.classify(F.lower("t")), t="margins fall") == "cannibalization"
    assert one(spark, T.classify(F.lower("t")), t="nothing") == "general"
    items = spark.createDataFrame([("Nvidia guarantee for OpenAI refinancing", "http://a", None)], "title string, url string, summary string")
    r = E.score_items(items, ["Nvidia", "NVIDIA", "Oracle"]).first()
    assert r.score == 4 + 5 + 1 and r.category == "credit" and r.companies == ["Nvidia"]


def test_sentences_and_entities(spark):
    assert one(spark, T.sentences(F.col("t")), t=" One. Two!  Three?four. ") == ["One.", "Two!", "Three?four."]
    assert one(spark, T.sentences(F.col("t")), t=None) == []
    assert one(spark, T.find_entities(F.col("t"), ["Nvidia", "OpenAI", "Google"]), t="OpenAI pays Nvidia - Google News") == ["OpenAI", "Nvidia"]


def test_markup(spark):
    page = "<html><head><style>p{}</style><SCRIPT type='x'>var a='<p>';</script></head><body><nav>menu</nav><p>One &amp; <b>two</b></p><!-- no --><footer>end</footer></body></html>"
    assert one(spark, T.html_to_text(F.col("h")), h=page) == "One & two"
    assert one(spark, T.html_to_text(F.col("h"), max_chars=3), h=page) == "One"
    nested = "x<nav>a<nav>b<footer>f</footer></nav>c<NAV id=1>d</nav></nav>y<nav>open<script>" + "<b>s</b>" * 20_000 + "</script>z"
    assert one(spark, T.html_to_text(F.col("h")), h=nested) == "x y"  # the open nav lasts to the end of the page
    kinds = [("<p>x</p>", "text/html"), ("<p>x</p>", None), ("a  b", "text/plain"), ("{}", "application/json"), ("%PDF", "application/pdf"), (None, "text/html")]
    got = [one(spark, T.document_text(F.col("b"), F.col("k")), b=b, k=k) for b, k in kinds]
    assert [(g.text, g.status) for g in got] == [("x", "ok"), ("x", "ok"), ("a b", "ok"), ("{}", "ok"), ("", "unsupported"), ("", "error")]


def test_broken_markup(spark):
    read = lambda h: one(spark, T.html_to_text(F.col("h")), h=h)
    cases = {
        "<div><nav>a<b>b</div>c</nav>d": "c d",  # the container's end closes the open nav, the stray end does nothing
        "<div><nav>a<div>b</div>c</nav>d</div>e": "d e",
        "<body>a<footer>b<nav>c</footer>d</nav>e</body>f": "a d e f",
        "a</nav></div>b": "a b",
        "a<nav/>b<nav />c<nav-bar>d</nav-bar>": "a b c d",
        "a<!-- <nav> -->b<!-- open <p>c": "a b",
        "a<script>'</nav><script>'</script >b<style>c": "a b",
        "a<script/>b": "a b",
        "1 < 2 and 3 > 2 <p>x<a href='y": "1 < 2 and 3 > 2 x",
        "<NOSCRIPT\n>a</noscript\t>b": "b",
        "": "",
    }
    assert {h: read(h) for h in cases} == cases
    assert read(None) == ""
    assert one(spark, T.html_to_text(F.col("h"), hidden=("script",)), h="<nav>a</nav><script>b</script>") == "a"
    assert one(spark, T.html_to_text(F.col("h"), hidden=("nav",)), h="<nav>a</nav><script>b</script>") == "b"


def test_markup_in_time(spark):
    """Pages that make a reading by repeated patterns quadratic: twice the page takes about twice the time."""
    made = [lambda n: "<script>" * n + "x", lambda n: "<script>a</script>t " * n, lambda n: "<nav>" * n + "x", lambda n: "<nav>a</nav>t " * n, lambda n: "<a " * n, lambda n: "<!--" * n, lambda n: "<script " * n]
    for page in made:
        rows = spark.createDataFrame([(page(5_000),)] * 8, "h string").select(F.length(T.html_to_text(F.col("h"))).alias("n"))
        start = time.perf_counter()
        assert len({r.n for r in rows.collect()}) == 1
        assert time.perf_counter() - start < 10


def test_preflight(spark):
    reason = T.preflight_reason(F.col("e"), F.col("a"), F.col("k"))
    ask = lambda e, a, k: one(spark, reason, e=e, a=a, k=k)
    assert ask(" ", 1.0, "GUARANTEES") == presets.REASONS[0]
    assert ask("Review for  debt, guarantees, capital expenditure, and more", 1.0, "GUARANTEES") == presets.REASONS[1]
    assert ask("fine", 8e12, "GUARANTEES") == presets.REASONS[2]
    assert ask("This could adversely affect us", 1.0, "GUARANTEES") == presets.REASONS[3]
    assert ask("This could adversely affect us", 1.0, "PRICE_CUT") is None and ask("fine", 1.0, "GUARANTEES") is None


def test_context_window(spark):
    text = "left " * 500 + "the  Evidence\nhere" + " right" * 500
    got = one(spark, T.context_window(F.col("t"), F.col("e")), t=text, e="THE evidence here")
    assert "the Evidence here" in got and len(got) == 2 * 1250 + 17
    assert len(one(spark, T.context_window(F.col("t"), F.col("e")), t=text, e="absent")) == 2500
    assert one(spark, T.context_window(F.col("t"), F.col("e")), t=None, e="x") is None


def test_fingerprints(spark):
    f = E.fingerprint(*(F.col(c) for c in "kstad"))
    ask = lambda a, d, s="Nvidia": one(spark, f, k="GUARANTEES", s=s, t="OpenAI", a=a, d=d)
    assert ask(30e9, "2026-08-03") == ask(30_000_100_000.0, "2026-08-11") != ask(30e9, "2026-11-02")
    assert ask(30e9, None) != ask(30e9, "2026-08-03") and ask(30e9, "", None) == ask(30e9, "unknown", "")
    assert one(spark, T.rounded_text(F.col("a")), a=2_500_000.0) == "2000000.0"
    assert one(spark, E.iso_month(F.col("d")), d="Thu, 20 Aug 2026 07:00:00 GMT") == "2026-08-20"


def test_redaction(spark):
    assert one(spark, T.redact_keys(F.col("t")), t="bad key sk-ab_C-1 given") == "bad key [redacted] given"


def test_event_extraction(spark):
    docs = [("a", "Nvidia guarantees $30 billion financing for OpenAI.", None, "2026-08-01"), ("b", "Nvidia announced a new product.", "", None), ("c", "DeepSeek announces price cut - Google News", None, None)]
    d = spark.createDataFrame(docs, "id string, title string, summary string, published_at string")
    got = {(r.document_id, r.event_type): r for r in E.extract_events(d, list(presets.COMPANIES)).collect()}
    assert set(got) == {("a", "GUARANTEES"), ("c", "PRICE_CUT")}
    a, c = got["a", "GUARANTEES"], got["c", "PRICE_CUT"]
    assert (a.source_entity, a.target_entity, a.amount, a.currency, a.instrument, a.effective_date) == ("Nvidia", "OpenAI", 30e9, "USD", "guarantee", "2026-08-01")
    assert (c.source_entity, c.target_entity, c.amount) == ("DeepSeek", None, None)
