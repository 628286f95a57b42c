"""From items to events, facts and observations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import text as T
from riskloom.plans import presets


def score_items(items: DataFrame, companies: Sequence[str], aliases: Mapping[str, str] = presets.ALIASES, weights: Mapping[str, int] = presets.TERM_WEIGHTS, stress: Sequence[str] = presets.STRESS_TERMS, categories=presets.CATEGORY_RULES) -> DataFrame:
    """Items (title, url, summary, ...) with id, score, category and companies."""
    lower = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit(""))))
    d = items.withColumn("_lower", lower).withColumn("companies", T.matched_companies(F.col("_lower"), companies, aliases))
    return d.withColumns({"id": T.stable_id(F.col("url"), F.col("title")), "score": T.term_score(F.col("_lower"), weights, stress) + F.size("companies"), "category": T.classify(F.col("_lower"), categories)}).drop("_lower")


def extract_events(docs: DataFrame, names: Sequence[str], rules=presets.EVENT_RULES, aliases: Mapping[str, str] = presets.ALIASES, extractor: str = presets.EXTRACTOR) -> DataFrame:
    """Every rule that a sentence fits gives an event. ``docs`` has id, title, summary, published_at and full_text (each may be null).

    Narrow until the end: sentences are exploded once, rules sit in the plan as literals, and nothing is shuffled.
    """
    parts = [F.when(F.col(c) != "", F.col(c)) for c in ("title", "summary", "full_text") if c in docs.columns]
    d = docs.select("id", "published_at", F.posexplode(T.sentences(F.concat_ws(" ", *parts))).alias("sentence_no", "sentence"))
    lower = F.lower("sentence")
    fits = F.array(*[F.when(T.any_of(lower, phrases), F.struct(F.lit(i).alias("rule_no"), F.lit(kind).alias("event_type"), F.lit(conf).alias("confidence"), F.lit(tool).cast("string").alias("instrument"))) for i, (kind, phrases, conf, tool) in enumerate(rules)])
    d = d.select("*", F.explode(F.filter(fits, lambda r: r.isNotNull())).alias("r"))
    d = d.withColumns({"_who": T.find_entities(F.col("sentence"), names), "_money": T.extract_amount(F.col("sentence"))})
    d = d.withColumns({"source_entity": T.canonicalize(F.get("_who", F.lit(0)), aliases), "target_entity": T.canonicalize(F.get("_who", F.lit(1)), aliases)})
    key = F.concat_ws("|", "id", "r.event_type", F.coalesce("source_entity", F.lit("")), F.coalesce("target_entity", F.lit("")), "sentence")
    return d.select(F.sha2(key, 256).alias("event_id"), F.col("id").alias("document_id"), "r.event_type", "source_entity", "target_entity", F.col("_money.value").alias("amount"), F.col("_money.currency").alias("currency"), "r.instrument", F.col("published_at").alias("effective_date"), "r.confidence", F.col("sentence").alias("evidence_text"), F.lit(extractor).alias("extractor"), "sentence_no", "r.rule_no")


def fingerprint(event_type: Column, source: Column, target: Column, amount: Column, date: Column, to: int = -6, prefix: int = 7) -> Column:
    """Identity of the fact behind an event: type, both ends, the amount to the nearest million and the month as text."""
    none = F.lit("")
    bucket = F.coalesce(T.rounded_text(amount, to), F.lit("unknown"))
    month = F.substring(F.coalesce(T.filled(date), F.lit("unknown")), 1, prefix)
    return F.sha2(F.concat_ws("|", event_type, F.coalesce(source, none), F.coalesce(target, none), bucket, month), 256)


def event_fingerprint() -> Column:
    return fingerprint(*(F.col(c) for c in ("event_type", "source_entity", "target_entity", "amount", "effective_date")))


def iso_month(date: Column) -> Column:
    """A date in text as yyyy-MM-dd: ISO dates stay, feed dates (weekday, day, month name, year) are read; else null."""
    feed = F.try_to_timestamp(F.regexp_extract(date, r"(\d{1,2} \w{3} \d{4})", 1), F.lit("d MMM yyyy"))
    return F.when(date.rlike(r"^\d{4}-\d{2}"), F.substring(date, 1, 10)).otherwise(F.date_format(feed, "yyyy-MM-dd"))


def variable_map(spark: SparkSession, rows=presets.EVENT_VARIABLES) -> DataFrame:
    return spark.createDataFrame(list(rows), "event_type string, variable_key string, fallback_value double, polarity string")


def to_observations(events: DataFrame, mapping: DataFrame, variables: DataFrame) -> DataFrame:
    """Observations of events whose type has a variable; other events give none."""
    m = mapping.join(variables.select(F.col("key").alias("variable_key"), F.col("unit").alias("_unit")), "variable_key")
    d = events.join(F.broadcast(m), "event_type")  # the map is a fixed table of a few rows
    money = (F.col("_unit") == "USD") & F.col("amount").isNotNull() & (F.col("currency") == "USD")
    value = F.when(F.coalesce(money, F.lit(False)), F.col("amount")).otherwise(F.col("fallback_value"))
    unit = F.when(F.coalesce(money, F.lit(False)), "USD").when(F.col("_unit").isin("USD", "percent"), "signal").otherwise(F.col("_unit"))
    key = F.concat_ws("|", "event_id", "variable_key", F.coalesce("source_entity", F.lit("")), number_text(F.col("value")))
    when = F.col("processed_at") if "processed_at" in events.columns else F.lit(None).cast("timestamp")
    return d.withColumns({"value": value, "unit": unit}).select(F.sha2(key, 256).alias("observation_id"), "event_id", "variable_key", F.col("source_entity").alias("entity"), "value", "unit", when.alias("observed_at"), "effective_date", "confidence", F.col("document_id").alias("source_document_id"), "evidence_text", "extractor", "polarity")


def number_text(x: Column) -> Column:
    """A double as its shortest text without an exponent, as far as decimal text of 15 whole digits goes."""
    whole = F.abs(x) >= 1e7
    return F.when(whole & (x == F.floor(x)), x.cast("decimal(38,1)").cast("string")).otherwise(x.cast("string"))
