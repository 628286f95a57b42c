"""Token counts: the exact histogram of encoded lengths (operator 6)."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.common import by_value, table
from riskloom.session import cut

#: Vocabulary file (a parameter of every function here), and the split pattern that belongs to it, a fixed value.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space in the sense of the pattern's \\s.
SPACES = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LONG_RUN = re.compile(SPACES + "{1000,}")  # the encoder's own matcher runs out of stack on runs of some 500,000
LIMITS = (512, 1024, 2048, 4096, 8192, 16384, 32768, 131072)
QUANTILES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999)


def read_vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}


def parts(text: str) -> Iterator[tuple[str, bool]]:
    """The text in parts, and whether a part is one piece of the split pattern.

    A long run of white space is cut out where the pattern itself ends a piece: a run at the end of the text is one
    piece, any other is one piece but for its last character, which may belong to the word that follows. So the
    tokens of the parts are the tokens of the text.
    """
    at = 0
    for run in LONG_RUN.finditer(text):
        end = run.end() - (run.end() < len(text))
        yield text[at : run.start()], False
        yield text[run.start() : end], True
        at = end
    yield text[at:], False


def counter(ranks: dict[bytes, int]):
    """A function from a list of texts to their numbers of tokens; null and empty texts have none."""
    import tiktoken

    encoding = tiktoken.Encoding("riskloom", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    one = lambda t, whole: len(encoding._encode_single_piece(t) if whole else encoding.encode_ordinary(t))

    def count(texts: list[str | None]) -> list[int]:
        return [sum(one(*p) for p in parts(t) if p[0]) if t else 0 for t in texts]

    return count


def token_count(spark: SparkSession, vocabulary: str = VOCABULARY):
    """A column function from text to number of tokens. The driver reads the file; executors get it by broadcast (1 MB).

    Texts are encoded whole, however long, long runs of white space included; null and empty texts have no tokens.
    """
    ranks = spark.sparkContext.broadcast(read_vocabulary(vocabulary))

    @F.pandas_udf(T.LongType())
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(ranks.value)
        for texts in batches:
            yield pd.Series(count([t if isinstance(t, str) else None for t in texts]), dtype="int64")

    return counted


def length_histogram(lengths: DataFrame, length: Column, limits: tuple[int, ...] = (), quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """(length, n_docs, n_at_least, tokens_at_least, n_total, tokens_total, truncated_total, below_share, quantiles) of all rows.

    One row for each length that occurs and each of ``limits`` (n_docs is 0 where no document is of that length).
    n_at_least and tokens_at_least are suffix sums; truncated_total is the number of tokens that remain if every document
    is cut to ``length``; below_share is the share of documents shorter; quantiles names those of ``quantiles`` that the
    length is: the least length that such a share of the documents doesn't exceed. The documents are reduced to one
    row a length before the sums, so the single task that adds them up holds as many rows as there are different
    lengths, not documents. Null lengths count as 0. Repeated rows: each counts. No rows: no rows.
    """
    h = lengths.groupBy(F.coalesce(length, F.lit(0)).cast("long").alias("length")).agg(F.count(F.lit(1)).alias("n_docs"))
    if limits:
        extra = h.agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(F.explode(F.array(*[F.lit(x).cast("long") for x in limits])).alias("length"), F.lit(0).cast("long").alias("n_docs"))
        h = h.unionByName(extra).groupBy("length").agg(F.sum("n_docs").alias("n_docs"))
    up = Window.orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    h = h.withColumns({"n_at_least": F.sum("n_docs").over(up), "tokens_at_least": F.sum(F.col("n_docs") * F.col("length")).over(up), "n_total": F.sum("n_docs").over(whole), "tokens_total": F.sum(F.col("n_docs") * F.col("length")).over(whole)})
    below = F.col("n_total") - F.col("n_at_least")
    wanted = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(str(q)).alias("name")) for q in quantiles] or [F.struct(F.lit(2.0).alias("q"), F.lit("").alias("name"))])
    is_here = lambda x: (below < x["q"] * F.col("n_total")) & (below + F.col("n_docs") >= x["q"] * F.col("n_total"))
    return h.withColumns({"truncated_total": F.col("tokens_total") - F.col("tokens_at_least") + F.col("length") * F.col("n_at_least"), "below_share": below / F.col("n_total"), "quantiles": F.array_join(F.transform(F.filter(wanted, is_here), lambda x: x["name"]), ",")})


def at_limits(histogram: DataFrame, limits: tuple[int, ...] = LIMITS) -> DataFrame:
    """(limit, n_longer, tokens_kept, tokens_total) for any context limits, from the histogram alone."""
    limit = F.explode(F.array(*[F.lit(x).cast("long") for x in limits])).alias("limit")
    rows = histogram.select(limit, "length", "n_docs")
    return rows.groupBy("limit").agg(F.sum(F.when(F.col("length") > F.col("limit"), F.col("n_docs")).otherwise(0)).alias("n_longer"), F.sum(F.least("length", "limit") * F.col("n_docs")).alias("tokens_kept"), F.sum(F.col("length") * F.col("n_docs")).alias("tokens_total"))


def quantile(histogram: DataFrame, q: float) -> int | None:
    """The least length that at least ``q`` of the documents don't exceed; None without documents."""
    return histogram.filter(F.col("n_total") - F.col("n_at_least") + F.col("n_docs") >= F.lit(q) * F.col("n_total")).agg(F.min("length")).first()[0]


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("text")
    counted = cut(docs.select(token_count(spark)(F.col("text")).alias("n")))
    return length_histogram(counted, F.col("n"), LIMITS)


by_value(__name__)
