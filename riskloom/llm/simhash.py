"""SimHash near-dedup by meet-in-the-middle ball hashing (operator 2)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.common import by_value, each, shielded, sized, table
from riskloom.llm.components import components
from riskloom.session import cut

SHINGLE = 3
SEED = 42
RADIUS = 3
#: A variant that more fingerprints share is not resolved in pairs; see links().
PAIRS_UP_TO = 256
CHUNK = 1 << 16
VARIANTS_A_TASK = 1_000_000
#: The three parts of 64 bits, of which each key leaves one out.
PARTS = (range(0, 21), range(21, 43), range(43, 64))


def simhash(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint as an unsigned number; 0 for a null text and for one without words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    whole = [b" ".join(w)] if len(w) < shingle else map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False))
    h = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in whole), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), CHUNK):
        ones += np.unpackbits(h[i : i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


@F.pandas_udf(T.LongType())
def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series(np.array([simhash(t) for t in texts], np.uint64).view(np.int64))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _variants(fp: Column, masks: list[tuple[int, list[int]]]) -> Column:
    """(fp & keep) ^ flip for each mask and each of its flips, mixed with the mask: one number that only equal variants share.

    The flips are a literal array and a lambda runs over it: written out, the expressions would make a method so long
    that compiling it takes more memory than the data.
    """
    out = []
    for keep, flips in masks:
        rest = F.lit(_signed(keep))
        values = F.array(*[F.lit(_signed(f)) for f in flips])
        out.append(_flipped(fp, rest, values))
    return F.concat(*out)


def _flipped(fp: Column, keep: Column, flips: Column) -> Column:
    return F.transform(flips, lambda f: F.xxhash64(keep, fp.bitwiseAND(keep).bitwiseXOR(f)))


def middle_masks() -> list[tuple[int, list[int]]]:
    """Leave out one part and flip none or one of the other bits.

    Of three differing bits at most two are outside the part that holds most of them, so two fingerprints within
    RADIUS agree there in a variant that is one flip, half of two, from both.
    """
    out = []
    for part in PARTS:
        rest = [b for b in range(64) if b not in part]
        keep = sum(1 << b for b in rest)
        out.append((keep, [0, *(1 << b for b in rest)]))
    return out


def links(nodes: DataFrame) -> DataFrame:
    """(a, b): edges between fingerprints (column fp, each once) that join exactly those within RADIUS bits of a common chain.

    Every fingerprint emits its variants, which are counted first: sums on the map side, so a crowded variant is a row a
    task. A variant held by 2 to PAIRS_UP_TO fingerprints gives its pairs, which are verified. The fingerprints in fuller ones are
    few values close together: they are linked without pairs, by hubs. Each emits all values within one bit (near) and, two
    bits away, within two (far). All near holders of a value lie within 2 of each other and within 3 of all its far
    holders, so a value with a near holder links all its holders to one near holder; two at distance 3 always meet as near
    and far. A pair either shares a variant that was resolved in pairs, or both ends are among those with hubs: none is lost.
    """
    masks = middle_masks()
    parts = -(-nodes.count() * sum(len(flips) for _, flips in masks) // VARIANTS_A_TASK)
    rows = each(nodes.select("fp").repartition(max(parts, 1), "fp"), _variants(F.col("fp"), masks), "v", "fp")
    crowded = cut(rows.groupBy("v").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > PAIRS_UP_TO).select("v"))
    any_crowded = crowded.count() > 0
    few = rows.join(sized(crowded), "v", "left_anti") if any_crowded else rows
    ahead = F.collect_list("fp").over(Window.partitionBy("v").orderBy("fp").rowsBetween(1, PAIRS_UP_TO - 1))
    near = F.filter(F.col("next"), lambda x: F.bit_count(F.col("fp").bitwiseXOR(x)) <= RADIUS)
    # only verified links leave the task
    found = few.withColumn("next", ahead).filter(F.size("next") > 0).select("fp", near.alias("next")).filter(F.size("next") > 0)
    pairs = each(found, F.col("next"), "b", F.col("fp").alias("a")).distinct()
    if not any_crowded:
        return pairs
    return pairs.unionByName(hub_links(cut(rows.join(sized(crowded), "v", "left_semi").select("fp").distinct())))


def hub_links(dense: DataFrame) -> DataFrame:
    """Links of fingerprints that crowd together; see links()."""
    full = (1 << 64) - 1
    near = [(full, [0, *(1 << i for i in range(64))])]
    far = [(full, [1 << i | 1 << j for i in range(64) for j in range(i)])]
    balls = each(dense, _variants(F.col("fp"), near), "v", "fp")
    hubs = balls.groupBy("v").agg(F.min("fp").alias("hub"), F.count(F.lit(1)).alias("n"))
    close = balls.join(hubs.filter("n > 1"), "v").filter("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()
    # what one bit already joins needs no second ring within itself: only members outside the largest group emit it
    close = cut(close)
    group = cut(components(close))
    largest = group.groupBy("root").count().orderBy(F.desc("count"), "root").limit(1).select("root")
    inside = group.join(F.broadcast(largest), "root", "left_semi").select(F.col("node").alias("fp"))
    rest = cut(dense.join(inside, "fp", "left_anti"))
    ring = each(rest, _variants(F.col("fp"), far), "v", "fp")
    return close.unionByName(ring.join(hubs, "v").select(F.col("fp").alias("a"), F.col("hub").alias("b")).filter("a <> b").distinct())


MADE = ["fp", "component_id", "alone"]


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with fp (the signed fingerprint), component_id (least doc_id reachable) and alone (nothing is linked to it).

    Links are between fingerprints, so copies cost one row and no pairs. Null, empty and blank texts have fingerprint 0,
    linked like any other; a text of any length counts whole. Rows with a null doc_id take their component's id; a
    component of such rows only has a null one. Repeated doc_ids: each row by itself. No rows: no rows. Columns with these
    names are overwritten, all others kept.
    """
    inner, back = shielded(docs, "doc_id", "text", made=MADE)
    return joined(cut(inner.select("*", fingerprint(F.col("text")).alias("fp")))).select(*back, *MADE)


def joined(marked: DataFrame) -> DataFrame:
    """A written table that has doc_id and fp, with component_id, alone and root (the component's name among fingerprints)."""
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    found = components(links(nodes.select("fp")))
    roots = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    groups = roots.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("members"))
    more = cut(roots.join(groups.filter("members > 1"), "root").select("fp", "component_id", "root", F.lit(True).alias("linked")))
    out = marked.join(sized(more), "fp", "left")
    return out.withColumns({"component_id": F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("doc_id")), "alone": F.col("linked").isNull()}).drop("linked")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, whatever their names, one row of each component: that of its least doc_id.

    Null, empty and long texts, repeated rows and null or repeated ids: as in ``near_duplicates``; of rows that share the least
    doc_id, or have none, one stays. No rows: no rows.
    """
    inner, back = shielded(docs, "doc_id", "text")
    out = joined(cut(inner.select("*", fingerprint(F.col("text")).alias("fp"))))
    first = out.filter(F.col("alone") | F.col("doc_id").eqNullSafe(F.col("component_id")))
    # rows that repeat a doc_id, or have none, stand in for each other
    repeated = cut(first.filter("not alone").groupBy("root").count().filter("count > 1").select("root"))
    if not repeated.count():
        return first.select(*back)
    single = first.filter("alone").unionByName(first.filter("not alone").join(sized(repeated), "root", "left_anti"), allowMissingColumns=True)
    several = first.filter("not alone").join(sized(repeated), "root", "left_semi").dropDuplicates(["root"])
    return single.select(*back).unionByName(several.select(*back))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = joined(cut(docs.select("doc_id", fingerprint(F.col("text")).alias("fp"))))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


by_value(__name__)
