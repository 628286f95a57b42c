"""Line dedup by site-relative frequency (operator 3, native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import LOWER, UPPER, ascii_lower, each, shielded, sized, table
from riskloom.session import cut

RATIO = 0.3
LEAST_HOLDERS = 2  # a line on one page is not repeated, however few pages the host has
SALTS = 64  # parts of a host's lines where the page totals are too many to broadcast
BREAKS = r"(?i)<(?:br|p|div|li|ul|ol|tr|table|h[1-6]|nav|footer|header|article|section|title|script|style)\b[^>]*>|</(?:p|div|li|ul|ol|tr|table|h[1-6]|nav|footer|header|article|section|title|script|style)\s*>"


def host_of(url: Column) -> Column:
    """After the first :// up to a slash, question mark, hash or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def lines_of(html: Column) -> Column:
    """A page's lines: block tags end a line; white space at the ends goes; empty lines go."""
    broken = F.split(F.regexp_replace(F.coalesce(html, F.lit("")), BREAKS, "\n"), "\n")
    return F.filter(F.transform(broken, lambda x: F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")), lambda x: x != "")


def line_key(line: Column) -> Column:
    return F.unhex(F.md5(line))


def boilerplate(pages: DataFrame, ratio: float = RATIO, least_holders: int = LEAST_HOLDERS) -> DataFrame:
    """(host, b_lines): keys of the lines that stand on more than ``ratio`` of a host's pages, and on ``least_holders`` at least.

    ``pages`` has host and b_keys, the keys of a page's lines. Counts are summed on the map side, so a hot line or host
    is one row for each task. Lines on one page go before anything is joined; the others meet their host's total where
    they are, if the totals are small, else in SALTS parts a host. Only lines above the ratio are dealt by host, and a
    host has at most (mean lines a page) / ratio of those: b_lines is bounded, and no task holds a host.
    """
    totals = cut(pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages")))
    counts = each(pages, F.array_distinct("b_keys"), "line", "host").groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_holders)
    return met(counts, totals).filter(F.col("n") > ratio * F.col("pages")).groupBy("host").agg(F.collect_list("line").alias("b_lines"))


def met(counts: DataFrame, totals: DataFrame, **bound: int) -> DataFrame:
    """``counts`` joined with ``totals`` by host."""
    small = sized(totals, **bound)
    if small is not totals:
        return counts.join(small, "host")
    salted = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return counts.withColumn("salt", F.pmod(F.xxhash64("line"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"]).drop("salt")


MADE = ["host", "n_lines", "n_dropped", "text"]


def dedup_lines(pages: DataFrame, ratio: float = RATIO, least_holders: int = LEAST_HOLDERS) -> DataFrame:
    """``pages`` with host, n_lines, n_dropped and text: the kept lines, joined by newlines.

    Null url or one without ://: the empty host, a site as any other. Null or empty html: no lines; html of any length
    is split whole. Each row counts as a page, also when rows repeat or page_id is null. No rows: no rows. Columns of
    ``pages`` named host, n_lines, n_dropped or text are overwritten, all others kept.
    """
    inner, back = shielded(pages, "url", "html", made=MADE)
    split = inner.select("*", host_of(F.col("url")).alias("host"), lines_of(F.col("html")).alias("b_all"))
    common = cut(boilerplate(split.select("host", F.transform("b_all", line_key).alias("b_keys")), ratio, least_holders))
    # beyond the bound the join shuffles, and adaptive execution splits a hot host's pages
    out = split.join(sized(common), "host", "left").withColumn("b_kept", F.when(F.col("b_lines").isNull(), F.col("b_all")).otherwise(F.filter("b_all", lambda x: ~F.array_contains("b_lines", line_key(x)))))
    return out.select(*back, "host", F.size("b_all").cast("long").alias("n_lines"), (F.size("b_all") - F.size("b_kept")).cast("long").alias("n_dropped"), F.array_join("b_kept", "\n").alias("text"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return dedup_lines(pages).select("page_id", "host", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5"))


_TAGS = "p|div|li|ul|ol|tr|table|h[1-6]|nav|footer|header|article|section|title|script|style"
OP3_SQL = rf"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
  list_filter(list_transform(string_split(regexp_replace(coalesce(html, ''), '(?i)<(?:br|{_TAGS})\b[^>]*>|</(?:{_TAGS})\s*>', chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')), lambda x: x <> '') AS l FROM pages),
t AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
c AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(l)) AS line FROM p) x GROUP BY host, line),
b AS (SELECT c.host, list(c.line) AS bad FROM c JOIN t ON c.host = t.host WHERE c.n >= {LEAST_HOLDERS} AND c.n > {RATIO}::DOUBLE * t.pages GROUP BY c.host),
k AS (SELECT p.page_id, p.host, p.l, CASE WHEN b.bad IS NULL THEN p.l ELSE list_filter(p.l, lambda x: NOT list_contains(b.bad, x)) END AS kept FROM p LEFT JOIN b ON p.host = b.host)
SELECT page_id, host, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(kept) AS BIGINT) AS n_dropped, CAST(length(array_to_string(kept, chr(10))) AS BIGINT) AS kept_chars, md5(array_to_string(kept, chr(10))) AS kept_md5 FROM k
"""
