"""Quality rules with hashed n-gram likelihood ratios (operator 8, native)."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import SPACE, each, shielded, sized, table, words
from riskloom.session import cut

BUCKETS = 10_000
MISSED = 0.02  # share of the trusted documents that the ratio's limit may miss, whatever the table's size
DIGITS = 4  # ratios of trusted texts are ranked by so many decimals: their quantiles are exact and the same on any partitions
LEAST_WORDS = 50
MOST_REPEATED = 50  # percent of words
SYMBOLS = "#*$%&|<>"


def base_rules(docs: DataFrame) -> DataFrame:
    """Adds q_words and q_hash (the words and their hashes), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    n_repeat_words: windows of three words, hashed, that occur twice or more in the text; the words that they cover.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.withColumn("q_words", words(F.col("text"))).withColumn("q_hash", hashes("q_words"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    runs = F.transform("q_hash", lambda h, i: F.xxhash64(h, F.get("q_hash", i + 1), F.get("q_hash", i + 2)))
    d = d.withColumn("q_lines", lines).withColumn("q_runs", F.slice(runs, 1, F.greatest(F.size("q_hash") - 2, F.lit(0))))
    placed = F.sort_array(F.transform("q_runs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("q_sorted", F.when(F.size(F.array_distinct("q_runs")) < F.size("q_runs"), placed))
    same = lambda x, j: (x["h"] == F.get("q_sorted", j - 1)["h"]) | (x["h"] == F.get("q_sorted", j + 1)["h"])
    # beside the ends of the array the neighbour is null, and null or true is true
    repeated = F.transform(F.filter("q_sorted", same), lambda x: F.coalesce(x["i"], F.lit(0)))
    d = d.withColumn("q_starts", F.sort_array(repeated))
    step = lambda acc, i: F.struct((acc["n"] + 3 - F.greatest(F.lit(0), acc["end"] - i)).alias("n"), (i + 3).alias("end"))
    cover = F.aggregate("q_starts", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step)["n"]
    d = d.withColumns(
        {
            "n_words": F.size("q_words").cast("long"),
            "word_chars": F.length(F.regexp_replace(text, SPACE, "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long"),
            "n_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"),
            "n_repeat_words": F.coalesce(cover, F.lit(0)).cast("long"),
        }
    )
    return d.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def hashes(words: str) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def features(buckets: int) -> Column:
    """Hash buckets of the words and word pairs of a text, from the hashes of its words (q_hash). None is null, also by its
    type: then they are sorted as plain numbers, many times faster."""
    bucket = lambda h: F.coalesce(F.pmod(h, F.lit(buckets)).cast("int"), F.lit(0))
    one = F.transform("q_hash", lambda h: bucket(h))
    two = F.transform("q_hash", lambda h, i: bucket(F.xxhash64(h, F.get("q_hash", i + 1))))
    return F.concat(one, F.slice(two, 1, F.greatest(F.size("q_hash") - 1, F.lit(0))))


def trusted_ids(trusted: DataFrame) -> DataFrame:
    ids = trusted.select(F.col("doc_id").alias("q_id")).filter(F.col("q_id").isNotNull()).distinct()
    return sized(cut(ids))


def counted(docs: DataFrame, ids: DataFrame, buckets: int = BUCKETS) -> tuple[list[int], list[int]]:
    """Count of each bucket in all documents, and in those of ``ids``.

    All words of all documents are counted; what reaches the driver is one row for each of the ``buckets``.
    """
    d = docs.select("doc_id", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("q_hash")).select("doc_id", features(buckets).alias("f"))
    d = each(d.join(ids, F.col("doc_id") == F.col("q_id"), "left"), F.col("f"), "b", F.col("q_id").isNotNull().cast("long").alias("t"))
    raw, target = [0] * buckets, [0] * buckets
    for r in d.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("t")).collect():
        raw[r.b], target[r.b] = r.n, r.t
    return raw, target


def log_ratios(raw: list[int], target: list[int]) -> list[float]:
    """Log ratio of target to raw probability of each bucket, both with one added."""
    n, t = sum(raw) + len(raw), sum(target) + len(raw)
    return [math.log((b + 1) / t) - math.log((a + 1) / n) for a, b in zip(raw, target, strict=True)]


def ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """``log_ratios`` of the trusted documents, whose doc_id ``trusted`` has, to all documents."""
    return log_ratios(*counted(docs, trusted_ids(trusted), buckets))


def literal(values: list) -> Column:
    """One literal of a fixed length, whatever the input. The planner folds it only outside of branches."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def own_ratio(raw: list[int], target: list[int]) -> Column:
    """The mean ratio of a trusted text's n-grams (q_f) with the text itself taken out of the target."""
    counts, logs = literal(target), literal([math.log(a + 1) for a in raw])
    # a bucket's n of the text come one after the other; what it adds is known where it ends
    part = lambda acc: acc["n"] * (F.log(F.get(counts, acc["b"]) - acc["n"] + 1) - F.get(logs, acc["b"]))
    row = lambda b, n, s: F.struct(b.alias("b"), n.alias("n"), s.alias("s"))
    # products in place of branches, for the literals
    step = lambda acc, b: row(b, acc["n"] * (acc["b"] == b).cast("double") + 1, acc["s"] + part(acc) * (acc["b"] != b).cast("double"))
    total = F.aggregate(F.sort_array("q_f"), row(F.lit(0), F.lit(0.0), F.lit(0.0)), step, lambda acc: acc["s"] + part(acc))
    size = F.greatest(F.size("q_f"), F.lit(1))
    return total / size - F.log(F.lit(float(sum(target) + len(raw))) - size) + math.log(sum(raw) + len(raw))


def limits(docs: DataFrame, ids: DataFrame, raw: list[int], target: list[int], scored: DataFrame, by: str = "lang", missed: float = MISSED) -> DataFrame:
    """(``by``, q_limit): the least ratio at which a text of the group is kept, for each group of ``scored`` with a text that passes the base rules.

    A trusted text is compared as an unlabelled one is, with itself taken out of the target (``own_ratio``). A group's
    centre is the median of its trusted texts' ratios, so that how many labels a group has shifts nothing; below all
    centres lies the same distance, the ``missed`` quantile of what trusted texts lie below theirs. A clean text is lost
    with a chance of about ``missed``, however large the table is.

    Trusted texts may be few, so both lean on what all texts of the group (``scored``: their llr) say: on the mean for the centre, and for
    the distance on the spread, as the ``missed`` quantile of a normal law. The weight of that is the chance that none of n trusted texts
    lies below the quantile sought: 1 / 2 ^ n of the group's for the median, (1 - ``missed``) ^ n of all for the distance. So it is 1 without
    trusted texts, fades as they come, and at no number does the rule change.
    """
    d = base_rules(docs.join(ids, F.col("doc_id") == F.col("q_id")).select(by, "text")).withColumn("q_f", features(len(raw)))
    own = cut(d.select(F.col(by).alias("q_by"), "base_failed", F.round(own_ratio(raw, target), DIGITS).alias("q_own"))).filter("NOT base_failed")
    exact = lambda e: F.sum(e.cast("decimal(38,9)")).cast("double")
    typical = scored.filter("NOT base_failed").groupBy(by).agg(F.count(F.lit(1)).alias("q_all"), exact(F.col("llr")).alias("q_sum"), exact(F.col("llr") * F.col("llr")).alias("q_squares"))
    mean = F.col("q_sum") / F.col("q_all")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("q_squares") / F.col("q_all") - mean * mean))
    middle = own.groupBy("q_by").agg(F.count(F.lit(1)).alias("q_n"), F.percentile("q_own", 0.5).alias("q_median"))
    unsure = F.pow(F.lit(0.5), F.coalesce("q_n", F.lit(0)))
    centre = unsure * mean + (1 - unsure) * F.coalesce("q_median", F.lit(0.0))
    groups = cut(typical.join(middle, F.col(by).eqNullSafe(F.col("q_by")), "left").select(by, centre.alias("q_centre"), spread.alias("q_spread")))
    centres = sized(groups.select(F.col(by).alias("c_by"), "q_centre"))
    below = own.join(centres, F.col("q_by").eqNullSafe(F.col("c_by"))).select(F.round(F.col("q_own") - F.col("q_centre"), DIGITS).alias("q_below"))
    n, least = below.agg(F.count(F.lit(1)), F.percentile("q_below", missed)).first()
    weight = (1 - missed) ** n
    distance = weight * NormalDist().inv_cdf(missed) * F.col("q_spread") + (1 - weight) * (least or 0.0)
    return groups.select(by, (F.col("q_centre") + distance).alias("q_limit"))


def decided(scored: DataFrame, limit: DataFrame) -> DataFrame:
    """``scored``, which ``judge`` made, with kept as the limits of its groups (from ``limits``) have it."""
    by = limit.columns[0]
    d = scored.join(sized(cut(limit.select(F.col(by).alias("q_by"), "q_limit"))), F.col(by).eqNullSafe(F.col("q_by")), "left")
    return d.select(*[F.col(c) for c in scored.columns if c != "kept"], (~F.col("base_failed") & F.coalesce(F.col("llr") >= F.col("q_limit"), F.lit(True))).alias("kept"))


def judge(docs: DataFrame, weights: list[float], threshold: float | DataFrame | None = None) -> DataFrame:
    """``docs`` with the base counts, base_failed, llr (mean over a text's n-grams) and kept.

    kept: not base_failed, and llr at least ``threshold``: a number, or what ``limits`` gives for the document's group;
    without one the base rules decide. The same text always gets the same verdict in a group. Null, empty and blank
    texts: counts 0, llr 0, base_failed. Repeated rows and doc_ids: each row by itself. No rows: no rows. Columns of
    ``docs`` with these names are overwritten, all others kept.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    by = threshold.columns[0] if isinstance(threshold, DataFrame) else None
    d, back = shielded(docs, "text", *filter(None, [by]), made=[*made, "llr", "kept"])
    limit = F.lit(None if by else threshold).cast("double")
    if by:
        limit = F.col("q_limit")
        d = d.join(sized(threshold.withColumnRenamed(by, "q_by")), F.col(by).eqNullSafe(F.col("q_by")), "left").drop("q_by")
    table_of = literal(weights)
    d = base_rules(d).withColumn("q_f", features(len(weights)))
    total = F.aggregate("q_f", F.lit(0.0), lambda acc, b: acc + F.get(table_of, b))
    # no condition around it: the planner folds the literal only outside of branches
    d = d.withColumn("llr", total / F.greatest(F.size("q_f"), F.lit(1)))
    return d.select(*back, *made, "llr", (~F.col("base_failed") & F.coalesce(F.col("llr") >= limit, F.lit(True))).alias("kept"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    ids = trusted_ids(table(spark, sf_dir, "labels").filter("quality = 1"))
    raw, target = counted(docs, ids)
    scored = cut(judge(docs, log_ratios(raw, target)).drop("text"))
    return decided(scored, limits(docs, ids, raw, target, scored)).drop("lang")
