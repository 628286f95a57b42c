"""Spelling variant grouping by a trie self-join with active-node sets (operator 13)."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import by_value, sized, table
from riskloom.session import cut

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Words have at least so many code points and occurrences; a form has at least so many times the occurrences of its word.
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: One run in so many loses a code point.
DROP = 199
#: Words that a task counts before it passes them on; most words of a trie in one task.
HELD, MOST = 200_000, 20_000
#: Written in place of a code point that two words don't share; no word holds it.
GAP = "\x00"


def spelled(doc_id: str, text: str, least: int = LEAST_LENGTH) -> Counter:
    """Words of a text of at least ``least`` code points: its runs, lower-cased, some without one code point."""
    runs: Counter = Counter()
    for run, n in Counter(RUN.findall(text)).items():
        if len(run) >= least:
            runs[run.lower() if run.isascii() else run.translate(LOWER)] += n
    head, out = zlib.crc32(f"{doc_id}:".encode()), Counter()
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), head)
        if h % DROP == 0:
            i = h % len(run)
            run = run[:i] + run[i + 1 :]
        if len(run) >= least:
            out[run] += n
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()
    for b in batches:
        for doc_id, text in zip(b.column(0), b.column(1), strict=True):
            held.update(spelled(doc_id.as_py(), text.as_py()))
            if len(held) >= HELD:
                yield pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())})
                held.clear()
    yield pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})


def vocabulary(docs: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the distinct words of all documents with at least ``least_count`` occurrences. Tasks add up before the shuffle,
    so a word that is everywhere is some rows a task."""
    d = docs.filter("text IS NOT NULL").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return d.mapInArrow(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def trie_pairs(words: list[str]) -> Iterator[tuple[int, int]]:
    """Pairs of places in ``words`` (each once) whose words are at distance one.

    A trie of all words is walked from its root. With each node goes the set of nodes whose prefixes are within distance one of
    its own, apart from itself: those come from the parent's set by equal letters, and from the parent, the node's siblings and
    its children by one letter deleted, replaced or inserted. Where a word ends at a node and another at one of its set, they are a pair.
    """
    below, ends = [{}], [-1]
    for i, w in enumerate(words):
        at = 0
        for c in w:
            at = below[at].get(c) or below[at].setdefault(c, len(below))
            if at == len(below):
                below.append({})
                ends.append(-1)
        ends[at] = i
    todo = [(0, c, x, set(below[0].values())) for c, x in below[0].items()]
    while todo:
        parent, letter, node, near = todo.pop()
        active = {below[b][letter] for b in near if letter in below[b]}
        active.add(parent)
        active.update(below[parent].values(), below[node].values())
        active.discard(node)
        if ends[node] >= 0:
            yield from ((ends[node], ends[b]) for b in active if ends[b] > ends[node])
        todo += [(node, c, x, active) for c, x in below[node].items()]


def _joined(group: pd.DataFrame) -> pd.DataFrame:
    words = group["w"].tolist()
    pairs = [(words[i], words[j]) for i, j in trie_pairs(words)]
    return pd.DataFrame(pairs, columns=["a", "b"])


def _at_split(words: DataFrame, k: int) -> DataFrame:
    """Pairs with the same first ``k`` code points that differ in the next one alone: replaced there, or there in one of them only."""
    head, tail = F.substring("w", 1, k), F.expr(f"substring(w, {k + 2})")
    longer = words.filter(F.length("w") > k)
    gaps = longer.select("side", F.concat(head, F.lit(GAP), tail).alias("key"), "w")  # a key has one word for each letter at most
    replaced = gaps.join(gaps.withColumnRenamed("w", "v"), ["side", "key"]).filter("w < v").select("side", F.col("w").alias("a"), F.col("v").alias("b"))
    shorter = longer.select("side", F.concat(head, tail).alias("v"), "w").join(words.select("side", F.col("w").alias("v")), ["side", "v"])
    return replaced.unionByName(shorter.select("side", F.col("w").alias("a"), F.col("v").alias("b")))


def near_pairs(words: DataFrame, least: int = LEAST_LENGTH, most: int = MOST) -> DataFrame:
    """(word, other), both ways: words (column word, each once, ``least`` code points or more) at distance one.

    Two such words share their first or their last ``least // 2`` code points, so two tries hold all pairs: one of the words, one of
    the words read backwards, each cut by prefix into parts that a task takes whole. A prefix with more than ``most`` words is cut
    again by one more code point; pairs that differ right at the cut are joined there, all others stay within a part.
    """
    rows = words.select(F.lit(0).alias("side"), F.col("word").alias("w")).unionByName(words.select(F.lit(1).alias("side"), F.reverse("word").alias("w")))
    found, k = [], least // 2
    while True:
        keyed = rows.withColumn("key", F.substring("w", 1, k))
        crowded = cut(keyed.groupBy("side", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("side", "key"))
        more = crowded.count() > 0
        light = keyed.join(sized(crowded), ["side", "key"], "left_anti") if more else keyed
        parts = light.groupBy("side", "key").applyInPandas(lambda key, g: _joined(g).assign(side=key[0])[["side", "a", "b"]], "side int, a string, b string")
        found.append(cut(parts))
        if not more:
            break
        rows = cut(keyed.join(sized(crowded), ["side", "key"], "left_semi").select("side", "w"))
        found.append(cut(_at_split(rows, k)))
        k += 1
    way = lambda c: F.when(F.col("side") == 1, F.reverse(c)).otherwise(F.col(c))
    pairs = reduce(DataFrame.unionByName, found).select(way("a").alias("word"), way("b").alias("other"))
    return pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("word").alias("other"))).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms (word, form) followed to the last, by doubling the steps until all have arrived. A form has RATIO times
    the occurrences of its word, so a chain has some 20 steps at most and this five rounds."""
    at = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if not at.join(on, "root", "left_semi").limit(1).count():
            return at
        at = cut(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")))


def variants(docs: DataFrame, least_count: int = LEAST_COUNT, most: int = MOST) -> DataFrame:
    """A row for each word of the documents (doc_id, text): word, form, root, n, n_near, form_n.

    Null and empty texts have no words; a null doc_id counts as empty text; repeated rows count each; texts and words of any
    length count whole; other columns aren't read. Of near words with equal n the first in code-point order is the form. No words: no rows.
    """
    words = cut(vocabulary(docs, least_count))
    near = near_pairs(words, most=most).join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = F.min_by(F.struct("other", "other_n"), F.struct((-F.col("other_n")).alias("n"), "other"))
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    is_form = F.col("best.other_n") >= RATIO * F.col("n")
    out = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, F.col("best.other_n")).alias("form_n"))
    out = cut(out)
    last = roots(out.filter("form IS NOT NULL"))
    return out.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


by_value(__name__)
