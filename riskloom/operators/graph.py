"""Network, timeline and evidence lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.text import canonicalize, canonicalize_many, filled
from riskloom.operators.indicators import latest_observations
from riskloom.operators.reads import placed
from riskloom.plans import presets
from riskloom.session import cut


def companies_of(items: DataFrame, aliases: Mapping[str, str] = presets.ALIASES) -> DataFrame:
    """Items with companies as canonical names; text is read as JSON, bad JSON gives none."""
    names = F.col("companies")
    if dict(items.dtypes)["companies"] == "string":
        names = F.from_json(names, "array<string>")
    return items.withColumn("companies", canonicalize_many(F.coalesce(names, F.array().cast("array<string>")), aliases))


def ends(events: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    return events.select(canonicalize(F.col("source_entity"), aliases).alias("source"), canonicalize(F.col("target_entity"), aliases).alias("target"), F.coalesce(filled(F.col("event_type")), F.lit("RELATIONSHIP")).alias("type"), F.coalesce(F.nullif(F.col("mention_count"), F.lit(0)), F.lit(1)).alias("mention_count"))


def edge_weights(events: DataFrame, aliases: Mapping[str, str] = presets.ALIASES) -> DataFrame:
    """(source, target, type, weight, mentions): facts and mentions between two different ends."""
    e = ends(events, aliases).filter("source <> '' AND target <> '' AND source <> target")
    return e.groupBy("source", "target", "type").agg(F.count(F.lit(1)).alias("weight"), F.sum("mention_count").cast("long").alias("mentions"))


def node_weights(events: DataFrame, items: DataFrame | None = None, aliases: Mapping[str, str] = presets.ALIASES, indexes: Sequence[str] = presets.INDEX_ENTITIES, limit: int | None = 40) -> DataFrame:
    """(id, label, kind, weight): the heaviest entities, equal weights by name. An end counts once for each event; companies of items are there with weight 0."""
    n = ends(events, aliases).select(F.explode(F.array("source", "target")).alias("id"), F.lit(1).alias("w"))
    if items is not None:
        n = n.unionByName(companies_of(items, aliases).select(F.explode("companies").alias("id"), F.lit(0).alias("w")))
    n = n.filter("id <> ''").groupBy("id").agg(F.sum("w").alias("weight")).select("id", F.col("id").alias("label"), F.when(F.col("id").isin(*indexes), "index").otherwise("company").alias("kind"), "weight")
    return n if limit is None else n.orderBy(F.desc("weight"), F.asc("id")).limit(limit)


def network(events: DataFrame, items: DataFrame | None = None, aliases: Mapping[str, str] = presets.ALIASES, indexes: Sequence[str] = presets.INDEX_ENTITIES, limit: int = 40) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges). Edges stay between kept nodes; every item with an id is an evidence node, tied to its kept companies."""
    nodes = cut(node_weights(events, items, aliases, indexes, limit))  # made once, for its own rows and both joins below
    kept = F.broadcast(nodes.select("id"))  # at most ``limit`` rows
    edges = edge_weights(events, aliases).join(kept.withColumnRenamed("id", "source"), "source", "left_semi").join(kept.withColumnRenamed("id", "target"), "target", "left_semi")
    if items is None:
        return nodes, edges
    proof = companies_of(items, aliases).filter("id IS NOT NULL AND id <> ''")
    name = F.concat(F.lit("evidence:"), "id")
    extra = [c for c in ("category", "source", "url", "summary", "score") if c in items.columns]
    evidence = proof.select(name.alias("id"), F.col("title").alias("label"), F.lit("evidence").alias("kind"), F.lit(1).cast("long").alias("weight"), F.col("published_at").alias("date"), *extra)
    ties = proof.select(F.explode("companies").alias("source"), name.alias("target")).join(kept.withColumnRenamed("id", "source"), "source", "left_semi")
    ties = ties.select("source", "target", F.lit("EVIDENCE").alias("type"), F.lit(1).cast("long").alias("weight"), F.lit(1).cast("long").alias("mentions"))
    return nodes.unionByName(evidence, allowMissingColumns=True), edges.unionByName(ties)


def timeline(events: DataFrame, aliases: Mapping[str, str] = presets.ALIASES) -> DataFrame:
    """Dated events in order of their date's text; equal dates keep the order of ``seq``."""
    date = F.coalesce(filled(F.col("effective_date")), filled(F.col("published_at")))
    keep = [c for c in ("amount", "currency", "confidence", "evidence_text", "title", "url", "source") if c in events.columns]
    d = events.withColumn("date", date).filter("date IS NOT NULL").orderBy("date", "seq")
    status = F.coalesce(filled(F.col("review_status")), F.lit("provisional"))
    return d.select("date", "event_type", canonicalize(F.col("source_entity"), aliases).alias("source_entity"), canonicalize(F.col("target_entity"), aliases).alias("target_entity"), F.coalesce(F.nullif(F.col("mention_count"), F.lit(0)), F.lit(1)).alias("mentions"), status.alias("review_status"), *keep)


def evidence_rows(observations: DataFrame, events: DataFrame, variables: DataFrame, as_of, window_days: int = 90, aliases: Mapping[str, str] = presets.ALIASES) -> DataFrame:
    """The latest observations of known variables, with what their event says of them, if it is there."""
    v = F.broadcast(variables.select(F.col("key").alias("variable_key"), F.col("label").alias("variable"), "dimension"))  # a fixed table of a few rows
    o = latest_observations(observations, as_of, window_days).join(v, "variable_key")
    e = events.select("event_id", "event_type", F.coalesce(filled(F.col("effective_date")), filled(F.col("published_at"))).alias("date"), F.col("title").alias("_title"), "source", "url")
    return o.drop("effective_date").join(e, "event_id", "left").select("dimension", "variable", canonicalize(F.col("entity"), aliases).alias("entity"), "value", F.coalesce("unit", F.lit("")).alias("unit"), F.when(F.col("unit") == "signal", "directional signal").otherwise("measured value").alias("role"), F.when(F.col("polarity") == "risk", "raises the warning").otherwise("lowers the warning").alias("effect"), "confidence", "date", "event_type", F.coalesce(filled(F.col("_title")), F.col("evidence_text")).alias("title"), "source", "url", F.col("evidence_text").alias("evidence"))


def ranked_evidence(rows: DataFrame) -> DataFrame:
    """All evidence with its place in its dimension, newest first; equal dates by what comes next in the row, greatest first."""
    rest = [c for c in rows.columns if c != "dimension"]
    return placed(rows, F.coalesce("date", F.lit("")).desc(), *[F.col(c).desc() for c in rest], by=["dimension"])


def evidence_lists(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """(dimension, evidence): the evidence of each dimension as one list, newest first, for writers of small results.

    With a limit the rows are ranked before they are gathered. Use ``ranked_evidence`` where a dimension may have many.
    """
    rest = [c for c in rows.columns if c != "dimension"]
    if limit is not None:
        rows = ranked_evidence(rows).filter(F.col("place") < limit)
    keyed = F.struct(F.coalesce("date", F.lit("")).alias("_date"), *rest)
    lists = rows.select("dimension", keyed.alias("x")).groupBy("dimension").agg(F.sort_array(F.collect_list("x"), asc=False).alias("x"))
    return lists.select("dimension", F.transform("x", lambda x: F.struct(*[x[c].alias(c) for c in rest])).alias("evidence"))
