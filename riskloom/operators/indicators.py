"""Dimension scores and the gated overall reading, from observations.

An observation has variable_key, entity, value, unit, observed_at, confidence, polarity and ``seq``, its place in the
order in which equal times are resolved (the first wins). A registry has the columns of presets.VARIABLE_SCHEMA.
Null is never zero: what isn't known stays null.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.plans import presets
from riskloom.plans.presets import Indicators

P = Indicators()


def registry(spark: SparkSession, rows: Sequence[tuple] = presets.VARIABLES) -> DataFrame:
    return spark.createDataFrame(list(rows), presets.VARIABLE_SCHEMA)


def parsed_time(c: Column) -> Column:
    """A timestamp from text; null where it can't be read. Text without a zone is in the session's, UTC."""
    return c.try_cast("timestamp")


def latest_observations(obs: DataFrame, as_of: datetime | Column, window_days: int = P.window_days) -> DataFrame:
    """The newest observation of each (variable, entity) within the window, both ends included.

    Null and empty entities are one. The filter comes first and reaches the scan; the rank's sort needs the
    rows of one (variable, entity) only.
    """
    end = as_of if isinstance(as_of, Column) else F.lit(as_of)
    seen = parsed_time(F.col("observed_at")) if dict(obs.dtypes)["observed_at"] == "string" else F.col("observed_at")
    rows = obs.withColumn("_seen", seen).filter(F.col("_seen").between(end - F.make_dt_interval(F.lit(window_days)), end))
    newest = Window.partitionBy("variable_key", F.coalesce("entity", F.lit(""))).orderBy(F.col("_seen").desc(), F.col("seq").asc())
    return rows.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank", "_seen")


def normalize(value: Column, scale: float) -> Column:
    """0 to 100, saturating."""
    return F.when(value <= 0, 0.0).otherwise(100.0 * (1.0 - 1.0 / (1.0 + value / scale)))


def points(latest: DataFrame, variables: DataFrame, p: Indicators = P) -> DataFrame:
    """One row for each latest observation of a known variable: dimension, minimum_points, evidence_basis, point (null if it isn't
    numeric evidence) and signed (confidence, negative for safety; null without confidence)."""
    v = F.broadcast(variables.select(F.col("key").alias("variable_key"), "dimension", F.col("unit").alias("_unit"), "direction", "weight", "minimum_points", "evidence_basis"))  # a registry is a fixed table of a few rows
    d = latest.join(v, "variable_key")
    raw, conf = F.coalesce("value", F.lit(0.0)), F.coalesce("confidence", F.lit(0.0))
    clamp = lambda c: F.least(F.lit(100.0), F.greatest(F.lit(0.0), c))
    usd = F.when((F.col("unit") == "USD") & (raw > 0) & (raw <= p.max_usd), normalize(raw, p.usd_scale))
    percent = F.when(F.col("unit") == "percent", clamp(raw))
    score = F.when(F.col("unit").isin("score", "signal"), clamp(F.when(raw <= p.score_step, raw * (100.0 / p.score_step)).otherwise(raw)))
    n = F.when(F.col("_unit") == "USD", usd).when(F.col("_unit") == "percent", percent).otherwise(score)
    n = F.when(F.col("direction") == "higher_is_safer", 100.0 - n).otherwise(n)
    signed = F.when(conf > 0, F.when(F.coalesce("polarity", F.lit("risk")) == "safety", -conf).otherwise(conf))
    return d.withColumns({"point": n * conf * F.col("weight"), "signed": signed})


def dimension_table(obs: DataFrame, variables: DataFrame, as_of, window_days: int | None = None, p: Indicators = P) -> DataFrame:
    """One row for each dimension of the registry, with all that is known of it: n_points, needed, mean_point, n_signed, sum_signed,
    sum_abs, triggered, and score, basis, direction.

    One pass: latest observations, a broadcast join and one aggregation with map-side sums to a few rows.
    """
    rows = points(latest_observations(obs, as_of, p.window_days if window_days is None else window_days), variables, p)
    sums = rows.groupBy("dimension").agg(
        F.count("point").alias("n_points"),
        F.min(F.when(F.col("point").isNotNull(), F.col("minimum_points"))).alias("needed"),
        F.avg("point").alias("mean_point"),
        F.count("signed").alias("n_signed"),
        F.sum("signed").alias("sum_signed"),
        F.sum(F.abs("signed")).alias("sum_abs"),
        F.max(F.when(F.col("point").isNotNull(), F.col("evidence_basis") == "confirmed_trigger")).alias("triggered"),
    )
    return judged(variables.select("dimension").distinct().join(sums, "dimension", "left"), p)


def judged(out: DataFrame, p: Indicators = P) -> DataFrame:
    """Sums of dimensions with score, basis and direction."""
    out = out.withColumns({"n_points": F.coalesce("n_points", F.lit(0)), "n_signed": F.coalesce("n_signed", F.lit(0)), "needed": F.coalesce("needed", F.lit(p.min_points))})
    enough, directed = (F.col("n_points") >= F.col("needed")) & (F.col("n_points") > 0), F.col("n_signed") >= p.min_directional
    balance = F.try_divide("sum_signed", "sum_abs")
    estimate = F.bround(50.0 + p.max_deviation * balance * (F.col("n_signed") / (F.col("n_signed") + p.prior)), 1)
    mean = F.try_divide("sum_signed", "n_signed")
    return out.withColumns(
        {
            "score": F.when(enough, F.least(F.lit(100.0), F.col("mean_point"))).when(directed, estimate),
            "basis": F.when(F.coalesce("triggered", F.lit(False)), "confirmed_trigger").when(enough, "aggregate").when(directed, "directional_estimate").when(F.col("n_points") > 0, "aggregate"),
            "direction": F.when(~directed, F.lit(None)).when(mean > 0.2, "higher_pressure").when(mean < -0.2, "lower_pressure").otherwise("mixed"),
        }
    )


def validity(obs: DataFrame, start: datetime, days: int, window_days: int = P.window_days) -> DataFrame:
    """Observations with ``first`` and ``end``: as_of the days first to end - 1 after ``start``, the row is the latest one of its
    (variable, entity) within the window; rows that are so on none of the ``days`` go.

    A row holds from its own time until the next newer one or the end of its window. Null and empty entities are one; of equal times
    the row that comes first by ``seq`` holds.
    """
    seen = parsed_time(F.col("observed_at")) if dict(obs.dtypes)["observed_at"] == "string" else F.col("observed_at")
    begin, day = F.lit(start).cast("timestamp"), 86_400_000_000
    span = F.make_dt_interval(F.lit(window_days))
    rows = obs.withColumn("_seen", seen).filter(F.col("_seen").between(begin - span, begin + F.make_dt_interval(F.lit(days - 1))))
    own = Window.partitionBy("variable_key", F.coalesce("entity", F.lit("")))
    # of equal times only the first has a time before the next row's: the others end where they begin
    rows = rows.withColumn("_next", F.lead("_seen").over(own.orderBy(F.col("_seen").asc(), F.col("seq").desc())))
    since = lambda t: F.unix_micros(t) - F.unix_micros(begin)
    first = F.greatest(F.lit(0), F.ceil(since(F.col("_seen")) / F.lit(day)))
    over = F.when(F.col("_next").isNotNull(), F.greatest(F.lit(0), F.ceil(since(F.col("_next")) / F.lit(day)))).otherwise(days)
    end = F.least(F.floor(since(F.col("_seen") + span) / F.lit(day)) + 1, over, F.lit(days))
    return rows.withColumns({"first": first.cast("int"), "end": end.cast("int")}).filter("first < end").drop("_seen", "_next")


def dimension_history(obs: DataFrame, variables: DataFrame, start: datetime, days: int, window_days: int | None = None, p: Indicators = P) -> DataFrame:
    """``dimension_table`` as of each of so many days from ``start`` on, with the column ``day`` (0 at the start), in one pass.

    Each observation adds its point on the first day that it holds and takes it back on the day after its last; running sums of these
    over the days give every day's table. What is shuffled are the observations, once, then a row for each variable and day, so the
    work grows with rows plus days. Sums run in decimals: what is added and taken back leaves nothing behind.
    """
    rows = points(validity(obs, start, days, p.window_days if window_days is None else window_days), variables, p)
    exact = lambda c: F.coalesce(c.cast("decimal(28,12)"), F.lit(0))
    made = {"n_points": F.col("point").isNotNull().cast("long"), "points": exact(F.col("point")), "n_signed": F.col("signed").isNotNull().cast("long"), "sum_signed": exact(F.col("signed")), "sum_abs": exact(F.abs("signed"))}
    both = rows.select("variable_key", "first", "end", *[c.alias(k) for k, c in made.items()])
    deltas = both.select("variable_key", F.col("first").alias("day"), *made).unionByName(both.filter(F.col("end") < days).select("variable_key", F.col("end").alias("day"), *[(-F.col(k)).alias(k) for k in made]))
    deltas = deltas.groupBy("variable_key", "day").agg(*[F.sum(k).alias(k) for k in made])
    v = variables.select(F.col("key").alias("variable_key"), "dimension", "minimum_points", "evidence_basis")
    grid = v.withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(days - 1)))).join(deltas, ["variable_key", "day"], "left")
    so_far = Window.partitionBy("variable_key").orderBy("day")
    sums = grid.withColumns({k: F.sum(F.coalesce(k, F.lit(0))).over(so_far) for k in made})
    has = F.col("n_points") > 0
    daily = sums.groupBy("day", "dimension").agg(
        F.min(F.when(has, F.col("minimum_points"))).alias("needed"),
        F.max(F.when(has, F.col("evidence_basis") == "confirmed_trigger")).alias("triggered"),
        F.sum("n_points").alias("n_points"),
        F.try_divide(F.sum("points").cast("double"), F.sum("n_points")).alias("mean_point"),
        F.sum("n_signed").alias("n_signed"),
        F.when(F.sum("n_signed") > 0, F.sum("sum_signed").cast("double")).alias("sum_signed"),
        F.when(F.sum("n_signed") > 0, F.sum("sum_abs").cast("double")).alias("sum_abs"),
    )
    return judged(daily, p)


def dimension_scores(obs: DataFrame, variables: DataFrame, as_of, window_days: int | None = None, p: Indicators = P) -> DataFrame:
    """(dimension, score) for every dimension; null where nothing is known."""
    return dimension_table(obs, variables, as_of, window_days, p).select("dimension", "score")


def evidence_counts(table: DataFrame) -> DataFrame:
    """(dimension, evidence_count): numeric points; dimensions without any aren't listed."""
    return table.filter("n_points > 0").select("dimension", F.col("n_points").alias("evidence_count"))


def evidence_basis(table: DataFrame) -> DataFrame:
    return table.filter("basis IS NOT NULL").select("dimension", "basis")


def direction_readings(table: DataFrame) -> DataFrame:
    return table.filter("direction IS NOT NULL").select("dimension", "direction", F.col("n_signed").alias("evidence_count"))


def overall_direction(readings: DataFrame) -> DataFrame:
    """One row, overall: the sign of the balance of readings, weighted by their counts."""
    balance = F.sum(F.when(F.col("direction") == "higher_pressure", F.col("evidence_count")).when(F.col("direction") == "lower_pressure", -F.col("evidence_count")).otherwise(0))
    return readings.agg(balance.alias("b"), F.count(F.lit(1)).alias("n")).select(F.when(F.col("b") > 0, "higher_pressure").when(F.col("b") < 0, "lower_pressure").when(F.col("n") > 0, "mixed").otherwise("unknown").alias("overall"))


def convergence(scores: DataFrame, p: Indicators = P, risks: Sequence[str] = presets.RISK_DIMENSIONS, propagation: Sequence[str] = presets.PROPAGATION, economics: Sequence[str] = presets.ECONOMICS, counter: str = presets.COUNTER, by: Sequence[str] = ()) -> DataFrame:
    """One row, or one for each value of ``by`` (the day of a history): score, label, direction, known_dimensions, gate_passed, gate_reason. ``scores`` has (dimension, score).

    The highest label needs material evidence in one dimension of each group. A null score with too few dimensions known.
    """
    risk = F.col("dimension").isin(*risks)

    def first_material(group: Sequence[str]) -> Column:
        order = F.array_position(F.array(*[F.lit(d) for d in group]), F.col("dimension"))
        return F.min(F.when(F.col("dimension").isin(*group) & (F.col("score") >= p.material), F.struct(order.alias("at"), F.col("dimension").alias("d"))))["d"]

    s = scores.groupBy(*by).agg(F.count(F.when(risk, F.col("score"))).alias("known"), F.avg(F.when(risk, F.col("score"))).alias("mean"), F.max(F.when(F.col("dimension") == counter, F.col("score"))).alias("counter"), first_material(propagation).alias("prop"), first_material(economics).alias("econ"))
    s = s.withColumn("base", F.when(F.col("counter").isNull(), F.col("mean")).otherwise(F.greatest(F.lit(0.0), F.col("mean") - F.greatest(F.lit(0.0), 50.0 - F.col("counter")) * p.counter_weight)))
    enough, gate = F.col("known") >= p.min_known, F.col("prop").isNotNull() & F.col("econ").isNotNull()
    label = F.when(~enough, "INSUFFICIENT EVIDENCE")
    for top, name in p.bands[:-1]:
        label = label.when(F.col("base") < top, name)
    label = label.when((F.col("base") < p.bands[-1][0]) | ~gate, p.bands[-1][1]).otherwise(p.top)
    reason = F.when(~enough, F.format_string(f"%d of {p.min_known} required dimensions measured", "known"))
    reason = reason.when(gate, F.format_string("material evidence in %s and %s", "prop", "econ")).when(F.col("prop").isNull(), f"no material evidence in {'/'.join(propagation)}").otherwise(f"no material evidence in {'/'.join(economics)}")
    return s.select(*by, F.when(enough, F.bround("base", 1)).alias("score"), label.alias("label"), F.lit("unknown").alias("direction"), F.col("known").alias("known_dimensions"), (enough & gate).alias("gate_passed"), reason.alias("gate_reason"))
