"""Sharding by sampled splitters (operator 10, native)."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from riskloom.llm.common import shielded, sized, table
from riskloom.session import cut

SHARDS = 24
RANGES_A_SHARD = 64  # fine ranges: a shard's size is off by about half of one
SAMPLES_A_RANGE = 16
BYTES_A_TASK = 128 << 20  # a unit is numbered in parts of about so much
UNITS = T.StructType([T.StructField("u_range", T.IntegerType()), T.StructField("u_part", T.IntegerType()), T.StructField("u_shard", T.IntegerType()), T.StructField("u_ahead", T.LongType())])


def byte_size(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) plus 8."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def splitters(d: DataFrame, ranges: int, total: int) -> list[int]:
    """Quantiles of keys drawn with chances in proportion to size.

    A row is drawn by a hash of its own values, so a lost task draws the same rows again. The sample holds about
    ``ranges * SAMPLES_A_RANGE`` keys whatever the input, and that is all that reaches the driver.
    """
    rate = min(1.0, ranges * SAMPLES_A_RANGE / max(1, total))
    draw = F.pmod(F.xxhash64("s_key", "s_id", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = F.floor(F.col("s_size") * rate + draw)
    sample = d.withColumn("s_copies", copies).filter("s_copies > 0").groupBy("s_key").agg(F.sum("s_copies").alias("s_weight"))
    picked = sorted((r.s_key, r.s_weight) for r in sample.collect())
    all_weight, out, seen = sum(w for _, w in picked), [], 0
    for key, weight in picked:
        seen += weight
        while len(out) < ranges - 1 and seen * ranges >= (len(out) + 1) * all_weight:
            out.append(key)
    return sorted(set(out))


def place(units: list[tuple[int, int, int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """(range, part, bytes, rows) of every unit to (range, part, shard, rows ahead of it in its shard).

    Units of at least a hundredth of a shard go first, largest first, each to the emptiest shard; the others
    follow in key order, each shard filled to its even share before the next.
    """
    total = sum(u[2] for u in units)
    share, held, out, homes = total / shards, [(0, s) for s in range(shards)], [], {}
    small = []
    for u in sorted(units, key=lambda u: (-u[2], u[0], u[1])):
        if u[2] * 100 * shards >= total and u[2]:
            size, s = heapq.heappop(held)
            heapq.heappush(held, (size + u[2], s))
            homes[u[:2]] = s
        else:
            small.append(u)
    full = {s: size for size, s in held}
    s = 0
    for u in sorted(small):
        while s < shards - 1 and full[s] + u[2] / 2 > share:
            s += 1
        full[s] += u[2]
        homes[u[:2]] = s
    ahead = dict.fromkeys(range(shards), 0)
    for r, p, _, rows in sorted(units):
        s = homes[r, p]
        out.append((r, p, s, ahead[s]))
        ahead[s] += rows
    return out


MADE = ["shard", "slot"]


def keyed(docs: DataFrame) -> DataFrame:
    """Adds s_key (hash of the text), s_id (hash of the row) and s_size."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"s_key": F.xxhash64(text), "s_id": F.xxhash64("doc_id", text, F.lit(11)), "s_size": byte_size(F.col("text"))})


def shard(docs: DataFrame, shards: int = SHARDS, ranges_a_shard: int = RANGES_A_SHARD, bytes_a_task: int = BYTES_A_TASK) -> DataFrame:
    """``docs`` with shard (0 to ``shards`` - 1) and slot (0, 1, ... in each shard); law: near equal bytes.

    The key is a 64-bit hash of the text, so equal texts stand together. Keys sampled by size give the splitters of
    fine ranges; exact sizes of all ranges are summed in one pass; a range above twice the mean is cut into parts
    by a hash of the key, and a key that alone is more than a shard becomes a range of its own, cut by a hash of the row.
    Whole units then go to shards. The driver holds only the units, of which there are at most a few times
    shards * ranges_a_shard, whatever the input. A unit is numbered in parts of about ``bytes_a_task``, whose counts are
    summed where they are: no task holds a shard, a unit or a text's copies. Copies of one text stay in one shard unless
    they don't fit in one; rows that are equal in id and text can't be told apart and are never parted.

    Null text: like the empty text; a text of any length counts whole. Null doc_id: as any other value. Repeated rows: each
    gets a slot of its own, equal ones can swap theirs. No rows: no rows. Columns of ``docs`` named shard or slot are
    overwritten, all others kept.
    """
    inner, back = shielded(docs, "doc_id", "text", made=MADE)
    d = keyed(inner)
    return assigned(d, cut(d.select("s_key", "s_id", "s_size")), shards, ranges_a_shard, bytes_a_task).select(*back, *MADE)


def assigned(d: DataFrame, sizes: DataFrame, shards: int = SHARDS, ranges_a_shard: int = RANGES_A_SHARD, bytes_a_task: int = BYTES_A_TASK) -> DataFrame:
    """``d``, which has doc_id, s_key, s_id and s_size, with shard and slot; ``sizes`` is a written table of its last three."""
    spark, ranges = d.sparkSession, shards * ranges_a_shard
    total = sizes.agg(F.sum("s_size")).first()[0] or 0
    cuts = splitters(sizes, ranges, total)

    u_range = rank_in(F.col("s_key"), cuts) if cuts else F.lit(0)
    even = lambda b, n: -(-b * n // max(1, total))  # noqa: E731  parts of about total / n
    per = {r.u_range: r.b for r in sizes.groupBy(u_range.alias("u_range")).agg(F.sum("s_size").alias("b")).collect()}
    over = {r: even(b, ranges) for r, b in per.items() if b * ranges > 2 * total}
    keys = sizes.filter(u_range.isin(list(over))).groupBy("s_key").agg(F.sum("s_size").alias("b")) if over else None
    heavy = sorted((r.s_key, even(r.b, shards * 4)) for r in keys.filter(F.col("b") * shards > total).collect()) if over else []  # fewer than ``shards``
    look = lambda pairs: F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    u_part = F.pmod(F.xxhash64("s_key", F.lit(3)), F.coalesce(F.try_element_at(look(over.items()), u_range), F.lit(1))) if over else F.lit(0)
    if heavy:  # a range of its own for each, cut by the hash of the row
        own, n = (F.try_element_at(look([(F.lit(k).cast("long"), v) for k, v in pairs]), F.col("s_key")) for pairs in ([(k, ranges + i) for i, (k, _) in enumerate(heavy)], heavy))
        u_range, u_part = F.coalesce(own, u_range), F.coalesce(F.pmod(F.col("s_id"), n), u_part)
    # a row's piece of its unit: by the row, so that one text's copies are spread too
    pieces = max(1, -(-total // (ranges * bytes_a_task)))
    unit = {"u_range": u_range.cast("int"), "u_part": u_part.cast("int"), "u_piece": F.pmod(F.xxhash64("s_id", F.lit(5)), F.lit(pieces)).cast("int")}
    counts = cut(sizes.withColumns(unit).groupBy(*unit).agg(F.sum("s_size").alias("b"), F.count(F.lit(1)).alias("n")))
    units = counts.groupBy("u_range", "u_part").agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
    homes = spark.createDataFrame(place([(r.u_range, r.u_part, r.b, r.n) for r in units.collect()], shards), UNITS)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("u_range", "u_part").orderBy("u_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = cut(counts.join(F.broadcast(homes), ["u_range", "u_part"]).select(*unit, F.col("u_shard").alias("shard"), (F.col("u_ahead") + before).alias("u_ahead")))
    order = Window.partitionBy(*unit).orderBy("s_key", F.col("doc_id").asc_nulls_last(), "s_id")
    out = d.withColumns(unit).withColumn("u_row", F.row_number().over(order)).join(sized(starts), list(unit))
    return out.withColumn("slot", (F.col("u_ahead") + F.col("u_row") - 1).cast("long"))


def rank_in(key: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are at most ``key``, as nested halvings in a few array look-ups."""
    width = max(1, round(len(cuts) ** 0.5))
    tops = cuts[::width]
    literal = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    top = F.size(F.filter(literal(tops), lambda c: c <= key))
    rows = [cuts[i * width : (i + 1) * width] for i in range(len(tops))]
    row = F.element_at(F.array(*[literal(r) for r in rows]), F.greatest(top, F.lit(1)))
    return F.when(top == 0, 0).otherwise((top - 1) * width + F.size(F.filter(row, lambda c: c <= key))).cast("int")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = keyed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    crc = F.crc32(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8"))
    slim = cut(docs.select("doc_id", "s_size", crc.alias("text_crc32"), "s_key", "s_id"))
    out = assigned(slim, slim)
    return out.select("doc_id", F.col("s_size").alias("size"), "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
