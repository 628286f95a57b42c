"""Mixing sources to target weights by systematic sampling (operator 9, native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import shielded, sized, table, word_count
from riskloom.session import cut

WEIGHTS = (5, 2, 1)
SHARE = (3, 2)  # the mix takes 3/2 of all words
MOST = 2  # copies of one document, and words of a source against its size
ROWS_A_BUCKET = 10_000
SEED = 20240501
OFFSETS = 32  # random offsets of a source, of which the one whose words come nearest to the target is taken


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> DataFrame:
    """Words to take from each source.

    ``sizes`` has one row (source, source_size) for each source. Sources in code-point order, null last,
    get the weights in turn. A target stops at ``most`` times the source's size and the excess is shared
    again by weight. That is water-filling: with sources in order of cap / weight, the first k are full and
    the others take weight * level, where k is the smallest count whose level stays below the next cap. All
    sums are integers, so that reruns and the SQL oracle agree to the last bit.
    """
    a, b = share
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy((F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before, after = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    out = sizes.withColumn("w", turn.cast("long")).withColumn("total", F.sum("source_size").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    # words left for this source and those after it, times b, and their weights
    out = out.withColumn("left", F.lit(a) * F.col("total") - F.lit(b * most) * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    out = out.withColumn("w_left", F.sum("w").over(after))
    full = F.col("w") * F.col("left") >= F.lit(b * most) * F.col("source_size") * F.col("w_left")
    # once a source isn't full, none after it is: its level holds for all of them
    out = out.withColumn("full", full)
    first = F.min(F.when(~F.col("full"), F.struct(F.col("source_size") / F.col("w"), F.col("source").isNull(), "source", "left", "w_left"))).over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = out.withColumn("level", first)
    level = F.col("w") * F.col("level.left") / (F.lit(b) * F.col("level.w_left"))
    target = F.when(F.col("full") | F.col("level").isNull(), (F.lit(most) * F.col("source_size")).cast("double")).otherwise(level)
    return out.select("source", "source_size", F.col("w").alias("weight"), target.cast("double").alias("target"))


MADE = ["mix_size", "mix_source_size", "mix_target", "mix_copies"]


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """Rows of ``docs`` with mix_size, mix_source_size, mix_target, mix_copies (0 to ``most``).

    Systematic sampling: every document of a source expects target / source_size copies; their prefix sum
    over the source plus one random offset crosses an integer once for each copy emitted. Documents of a source go
    in order of size class (largest first), bucket, size and doc_id, so that copies are spread over
    all sizes. Of ``OFFSETS`` seeded offsets a source gets the one whose words come nearest to its target (ties: the first); the words of all are
    summed in one pass. The rank in a source is the rank in a bucket plus the sizes of the buckets before it: no task holds a source. A
    size class of a source has as many buckets as it has times ``ROWS_A_BUCKET`` rows.

    Null source: a source of its own, the last. Null or empty text: size 0, and copies as any other; a text of any length
    counts whole. Repeated rows and doc_ids: each row is a document; equal rows can swap places, and share a bucket. No rows:
    no rows. Columns of ``docs`` with the names made here are overwritten, all others kept.
    """
    inner, back = shielded(docs, "doc_id", "text", "source", made=MADE)
    inner = inner.withColumns({"mix_size": word_count(F.col("text")), "mix_key": F.xxhash64(F.coalesce(F.col("text"), F.lit("")))})
    return placed(inner, weights, share, most, seed).select(*back, *MADE)


def placed(d: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """``mix`` of rows that have doc_id, source, mix_size and mix_key, a hash of the text."""
    # a name of the source that is never null: window and join then ask for the same distribution, and rows move once
    name = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), F.col("source")))
    d = d.withColumns({"mix_name": name, "mix_class": F.floor(F.log2(F.col("mix_size") + 1)).cast("int")})
    classes = cut(d.groupBy("source", "mix_name", "mix_class").agg(F.count(F.lit(1)).alias("n"), F.sum("mix_size").alias("words")))
    wanted = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most).withColumnsRenamed({"source": "b_source", "source_size": "mix_source_size", "target": "mix_target"})
    parts = sized(cut(classes.select("mix_name", "mix_class", F.ceil(F.col("n") / ROWS_A_BUCKET).alias("mix_parts"))))
    d = d.join(parts, ["mix_name", "mix_class"]).withColumn("mix_bucket", F.pmod(F.xxhash64("doc_id", "mix_key", F.lit(seed)), "mix_parts").cast("int")).drop("mix_parts")
    at = ["mix_name", "mix_class", "mix_bucket"]
    buckets = cut(d.groupBy("source", *at).agg(F.count(F.lit(1)).alias("n")))
    inside = Window.partitionBy("source").orderBy(F.col("mix_class").desc(), "mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = buckets.withColumn("b_ahead", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(wanted, F.col("source").eqNullSafe(F.col("b_source")))
    ahead = cut(ahead.select(*at, "b_ahead", "mix_source_size", "mix_target"))
    rank = F.row_number().over(Window.partitionBy(*at).orderBy(F.col("mix_size").desc(), F.col("doc_id").asc_nulls_last(), "mix_key"))
    expected = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(F.lit(0.0))
    place = F.col("b_ahead") + F.col("mix_rank")

    def crossed(offset: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.floor(place * expected + offset) - F.floor((place - 1) * expected + offset), F.lit(most))).cast("int")

    def offset(i: Column) -> Column:
        return F.pmod(F.xxhash64("mix_name", F.lit(seed), i), F.lit(1 << 30)) / F.lit(float(1 << 30))

    slim = d.select("doc_id", "mix_size", "mix_key", *at).withColumn("mix_rank", rank).join(sized(ahead), at)
    words = [F.sum(F.col("mix_size") * crossed(offset(F.lit(i)))).alias(f"w{i}") for i in range(OFFSETS)]
    sums = slim.groupBy("mix_name").agg(F.first("mix_target").alias("t"), *words)
    nearest = F.array_min(F.array(*[F.struct(F.abs(F.col(f"w{i}") - F.col("t")).alias("miss"), F.lit(i).alias("i")) for i in range(OFFSETS)]))["i"]
    chosen = ahead.join(cut(sums.select("mix_name", offset(nearest).alias("mix_offset"))), "mix_name")
    d = d.withColumn("mix_rank", rank).join(sized(cut(chosen)), at)
    return d.withColumn("mix_copies", crossed(F.col("mix_offset")))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, whatever their names, each row as often as it is taken.

    Null and empty texts, null sources, repeated rows and empty tables: as in ``mix``.
    """
    inner, back = shielded(docs, "doc_id", "text", "source")
    return mix(inner, **options).withColumn("mix_copy", F.explode(F.array_repeat(F.lit(1), F.col("mix_copies")))).select(*back)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    slim = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("mix_size"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("mix_key")))
    out = placed(slim)
    return out.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).cast("long").alias("taken"), F.col("mix_copies").alias("copies"))
