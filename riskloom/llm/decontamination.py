"""Benchmark decontamination by winnowing (operator 1, native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import LOWER, UPPER, ascii_lower, each, fresh, kept_columns, sized, table, words
from riskloom.session import cut

SPAN = 13  # words of a shared span that must be found
GRAM = 6  # words of a gram; a window has SPAN - GRAM + 1 grams, so each span holds one whole window
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def grams(hashes: str, n: int) -> Column:
    """A hash of the run of ``n`` words at each position; the last n - 1 are of fewer words and mean nothing."""
    return F.transform(hashes, lambda _, i: F.xxhash64(*[F.get(hashes, i + k) for k in range(n)]))


def least_of_runs(df: DataFrame, column: str, run: int) -> DataFrame:
    """``column`` with each value replaced by the least of the ``run`` values from there on, by doubling."""
    ahead = lambda step: F.transform(column, lambda v, i: F.least(v, F.get(column, i + step)))
    width = 1
    while width < run:
        step = min(width, run - width)
        df, width = df.withColumn(column, ahead(step)), width + step
    return df


def with_marks(df: DataFrame, span: int, gram: int, short: list[int]) -> DataFrame:
    """Adds mark_<n>: at each position the hash that stands for the run of n words there.

    For n = ``span`` that is the least gram hash in the run (winnowing: neighbouring runs mostly share it); for
    the lengths of items shorter than ``span`` it is the hash of the run. Each word is hashed once. The last n - 1
    positions, where no whole run starts, hold values without meaning.
    """
    df = df.withColumn("g_hash", F.transform("g_words", lambda w: F.xxhash64(w)))
    df = least_of_runs(df.withColumn(f"mark_{span}", grams("g_hash", gram)), f"mark_{span}", span - gram + 1)
    return df.withColumns({f"mark_{n}": grams("g_hash", n) for n in short})


def hits(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """For each text of ``docs`` that shares a window with an item: g_key (MD5 of the text), spans, items.

    spans: array of (start, length), every occurrence in the text of a window of ``span`` consecutive words of an
    item, or of a whole shorter item. items: the ids of those items, as sorted strings.

    1. Each text gives the winnowing fingerprints of its windows, once for each stretch that shares one. They are
       joined with the benchmark's; what fits is the set of candidate texts with their shared fingerprints.
    2. Candidates alone are split again. A window whose fingerprint is shared is extended to its ``span`` words and
       joined with the items' windows on the words themselves, so hash collisions do no harm.
    Equal windows have equal fingerprints, so no shared window is lost.
    """
    items = cut(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(ascii_lower(F.col("text")), SEPARATORS).alias("g_words")).filter(F.size("g_words") > 0))
    lengths = sorted(r[0] for r in items.select(F.least(F.size("g_words"), F.lit(span))).distinct().collect())  # at most ``span`` numbers
    short = [n for n in lengths if n < span]
    n_item = F.least(F.size("g_words"), F.lit(span))
    marked_items = with_marks(items, span, gram, short)
    whole = F.coalesce(*[F.when(n_item == n, F.slice(f"mark_{n}", 1, F.size("g_words") - (n - 1))) for n in lengths] or [F.array().cast("array<bigint>")])
    of_items = cut(each(marked_items, whole, "mark").distinct())
    run = lambda i, n: F.array_join(F.slice("g_words", i + 1, n), " ")
    starts = F.sequence(F.lit(0), F.size("g_words") - n_item)
    of_windows = cut(each(items, F.transform(starts, lambda i: run(i, n_item)), "window", "item_id").distinct())

    texts = docs.filter(F.col("text").isNotNull()).select("text", F.unhex(F.md5(F.col("text"))).alias("g_key"))
    split = lambda df: df.select("*", words(ascii_lower(F.col("text")), SEPARATORS).alias("g_words")).drop("text")
    once = lambda name: F.filter(name, lambda m, i: ~m.eqNullSafe(F.get(name, i - 1)))
    marks = F.concat(*[once(f"mark_{n}") for n in lengths] or [F.array().cast("array<bigint>")])
    own = each(with_marks(split(texts), span, gram, short), marks, "mark", "g_key")
    found = cut(own.join(sized(of_items), "mark").groupBy("g_key").agg(F.collect_set("mark").alias("g_found")))
    again = with_marks(split(texts.join(sized(found), "g_key")), span, gram, short)
    fits = lambda n: F.filter(F.transform(F.col(f"mark_{n}"), lambda m, i: F.when((i <= F.size("g_words") - n) & F.array_contains("g_found", m), i)), lambda i: i.isNotNull())
    shown = lambda n: F.transform(fits(n), lambda i: F.struct(i.alias("start"), F.lit(n).alias("length"), run(i, n).alias("window")))
    windows = F.flatten(F.array(*map(shown, lengths))) if lengths else F.expr("array(named_struct('start', 0, 'length', 0, 'window', ''))")
    rows = each(again, windows, "x", "g_key").select("g_key", F.struct("x.start", "x.length").alias("span"), "x.window")
    # copies of a text, and items that share a window, meet in the sets of each task before anything is shuffled
    return rows.join(sized(of_windows), "window").groupBy("g_key").agg(F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items"))


def covered(spans: Column) -> Column:
    """Words in the union of sorted (start, length) spans."""
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(s["start"], acc["end"]))).alias("n"), F.greatest(acc["end"], s["start"] + s["length"]).alias("end"))
    return F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step)["n"]


MADE = ["n_words", "n_hit", "spans", "items", "contaminated"]


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """``docs`` with n_words, n_hit, spans, items, contaminated (n_hit > 0 and 20 * n_hit >= n_words).

    A word is a run of [0-9a-z] or non-ASCII characters, A-Z lower-cased. A function of the text alone: copies and rows
    with a null or repeated doc_id each get their text's result. Null and empty texts have no words and no hits; a text
    may be as long as a value may be. An item with a null id counts under the empty id, an item without words is passed
    over. Empty tables: no rows, or no hits. Columns of ``docs`` with the five names are overwritten, all others kept.
    """
    keep = kept_columns(docs.columns, MADE)
    g_key, g_spans, g_items = fresh([*docs.columns, *MADE], "g_key", "g_spans", "g_items")
    found = cut(hits(docs.select("text"), benchmark, span, gram).toDF(g_key, g_spans, g_items))
    out = docs.select(*keep, F.unhex(F.md5(F.col("text"))).alias(g_key), F.size(words(F.col("text"), ANY_CASE_SEPARATORS)).cast("long").alias("n_words"))
    out = out.join(sized(found), g_key, "left").withColumn("n_hit", F.coalesce(covered(F.col(g_spans)), F.lit(0)).cast("long"))
    contaminated = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return out.select(*keep, "n_words", "n_hit", F.col(g_spans).alias("spans"), F.col(g_items).alias("items"), contaminated.alias("contaminated"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = contamination(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), "contaminated")


OP1_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g FROM b, unnest(range(1, greatest(len(w) - 13, 0) + 2)) t(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM bw) s, unnest(range(1, len(w) - n + 2)) t(i) WHERE len(w) >= n),
h AS (SELECT DISTINCT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) x GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM h) x GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(m.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(m.s, '')) AS items_sha256,
  coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""
