"""Stupid-backoff language-model scores by joins of hash-partitioned n-gram counts (operator 4).

Every document is scored by a model of all the others: its own n-grams are taken out of the counts. So no count needs a
floor, a copy is told from a text that stands alone, and a pair that only its own document has backs off to the word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import LOWER as LOWER_LETTERS
from riskloom.llm.common import UPPER, by_value, sized, table
from riskloom.session import cut

ALPHA = 0.4
CODES = (1 << 16) - 2  # most frequent words, known to every task by a two-byte code
START, UNCODED = CODES, CODES + 1  # in place of a code: before the first word; a word that has none
PAIRS_A_BUCKET = 600_000  # mean
HOT_PAIRS = 1 << 20  # bound of the pairs whose counts every task knows
CHUNK_BYTES = 3_000_000
LONGEST_LANES = 8  # words of more bytes than eight times this are hashed one by one
FLUSH_ROWS = 1_000_000

SPACE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the low k bytes
ONE, TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * TWO
    return h ^ (h >> np.uint64(29))


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of every word of every text, and the place of its text; words are maximal runs of bytes other
    than ASCII white space, A-Z lower-cased."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    data = np.zeros(offsets[-1] - offsets[0] + 8, np.uint8)
    if len(data) > 8:
        data[:-8] = LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
    ends = offsets - offsets[0]
    word = ~SPACE[data[:-8]]
    full = np.flatnonzero(np.diff(ends))
    before, after = np.zeros(len(word), bool), np.zeros(len(word), bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    before[ends[full]] = after[ends[full + 1] - 1] = False
    starts = np.flatnonzero(word & ~before)
    sizes = np.flatnonzero(word & ~after) + 1 - starts
    lanes = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    h = sizes.astype(np.uint64) * ONE
    on = np.arange(len(sizes))
    for k in range(LONGEST_LANES):
        on = on[sizes[on] > 8 * k]
        h[on] = mixed(h[on] ^ (lanes[starts[on] + 8 * k] & KEEP[np.minimum(sizes[on] - 8 * k, 8)]))
    for i in on[sizes[on] > 8 * LONGEST_LANES]:
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + sizes[i]].tobytes())
    return h, np.searchsorted(ends, starts, side="right") - 1


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
    """The columns of about CHUNK_BYTES of text (the last column) at a time, of fewer than 65,536 rows; no text is cut."""
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(b.num_columns - 1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // CHUNK_BYTES
        edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
        for i, j in zip(edges, [*edges[1:], len(size)], strict=True):
            for k in range(i, j, 65_000):
                rows = b.slice(k, min(65_000, j - k))
                yield [pa.concat_arrays([c]) for c in rows.columns]


class Sums:
    """Counts by 64-bit key, added up as far as FLUSH_ROWS different keys allow."""

    def __init__(self):
        self.held, self.rows = [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(np.unique(keys, return_counts=True))
        self.rows += len(self.held[-1][0])
        if self.rows > 2 * FLUSH_ROWS:
            self.squeeze()
            if self.rows > FLUSH_ROWS:
                yield from self.drain()

    def squeeze(self) -> None:
        keys, place = np.unique(np.concatenate([k for k, _ in self.held]), return_inverse=True)
        self.held = [(keys, np.bincount(place, np.concatenate([n for _, n in self.held]), len(keys)).astype(np.int64))]
        self.rows = len(keys)

    def drain(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self.squeeze()
            keys, counts = self.held[0]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["h", "n"])
        self.held, self.rows = [], 0


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, n): counts of word hashes, added up in the task."""
    sums = Sums()
    for (texts,) in chunks(batches):
        yield from sums.add(hashed_words(texts)[0])
    yield from sums.drain()


def place_in(table: np.ndarray, x: np.ndarray, missing: int = -1) -> np.ndarray:
    """Where each number stands in the sorted table; ``missing`` where it doesn't."""
    if not len(table):
        return np.full(len(x), missing, np.int64)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return np.where(table[at] == x, at, missing)


def count_pairs(heavy: np.ndarray):
    """(h, n): counts of the pairs of ``heavy`` words, by place * size + place, added up in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for (texts,) in chunks(batches):
            h, doc = hashed_words(texts)
            at = place_in(heavy, h)
            both = (at[:-1] >= 0) & (at[1:] >= 0) & (doc[:-1] == doc[1:])
            yield from sums.add((at[:-1][both] * len(heavy) + at[1:][both]).astype(np.uint64))
        yield from sums.drain()

    return run


def packed(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join([np.array([a.nbytes for a in arrays], np.int64).tobytes(), *(a.tobytes() for a in arrays)]))


def unpacked(data: bytes, *kinds) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(data)
    at, out = 8 * len(kinds), []
    for size, kind in zip(np.frombuffer(data, np.int64, len(kinds)), kinds, strict=True):
        out.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
        at += int(size)
    return out


def group_edges(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where groups of equal keys begin, and the end."""
    n = len(sorted_keys[0])
    return np.flatnonzero(np.r_[np.logical_or.reduce([np.r_[True, k[1:] != k[:-1]] for k in sorted_keys]), True]) if n else np.zeros(1, int)


def own_counts(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How often the word at each place stands in its own document."""
    order = np.lexsort((h, doc))
    edges = group_edges(doc[order], h[order])
    out = np.empty(len(h), np.int64)
    out[order] = np.repeat(np.diff(edges), np.diff(edges))
    return out


class Known:
    """What every task knows of frequent words and pairs, all of bounded size."""

    def __init__(self, words: list, total: int, alpha: float):
        self.h, self.n = np.array([h for h, _ in words], np.int64).view(np.uint64), np.array([n for _, n in words], float)
        order = np.argsort(self.h)
        self.h, self.n = self.h[order], self.n[order]
        self.total, self.alpha = max(total, 1), alpha
        self.pair, self.pair_n = np.zeros(0, np.int64), np.zeros(0)

    def add_pairs(self, heavy: np.ndarray, rows: list) -> None:
        """Counts of hot pairs, whose keys are places in ``heavy``; here they are places among all known words."""
        key, n = np.array([k for k, _ in rows], np.int64), np.array([n for _, n in rows], float)
        key = place_in(self.h, heavy[key // len(heavy)]) * (CODES + 2) + place_in(self.h, heavy[key % len(heavy)])
        order = np.argsort(key)
        self.pair, self.pair_n = key[order], n[order]

    @classmethod
    def of(cls, parts: tuple) -> Known:
        """From what ``vars`` gives: a broadcast holds plain arrays, so that executors need not have this class."""
        out = cls.__new__(cls)
        out.__dict__.update(parts)
        return out

    def rest(self, code: np.ndarray, own: np.ndarray) -> np.ndarray:
        """log10 of what is left of known words' counts, ``alpha`` at least."""
        return np.log10(np.maximum(self.n[code] - own, self.alpha))


class Entries:
    """Distinct pairs of documents: codes and hashes of both words, how often the document has the pair and each word."""

    def __init__(self, ca, cb, a, b, n, own_a, own_b, doc):
        self.ca, self.cb, self.a, self.b, self.n, self.own_a, self.own_b, self.doc = ca, cb, a, b, n, own_a, own_b, doc

    def take(self, rows: np.ndarray) -> Entries:
        return Entries(*(x[rows] for x in vars(self).values()))

    def scored(self, all_n: np.ndarray, known: Known, docs: int):
        """Words, backed-off words and log10 sum of each document, but for what words that aren't known add: (doc, h, own, times),
        to be times * log10(count - own)."""
        first = self.ca == START
        seen = (all_n > self.n) & ~first
        value = np.where(seen, np.log10(np.maximum(all_n - self.n, 1)), np.where(first, 0.0, np.log10(known.alpha)) - np.log10(known.total))
        code, own, sign = np.where(seen, self.ca, self.cb), np.where(seen, self.own_a, self.own_b), np.where(seen, -1, 1)
        done = code < CODES
        value[done] += sign[done] * known.rest(code[done], own[done])
        n = np.bincount(self.doc, self.n, docs).astype(np.int64)
        backed = np.bincount(self.doc, self.n * (~seen & ~first), docs).astype(np.int64)
        score = np.bincount(self.doc, self.n * value, docs)
        open_ = ~done
        return n, backed, score, (self.doc[open_], np.where(seen, self.a, self.b)[open_], own[open_], (sign * self.n)[open_])


KINDS = (np.uint16, np.uint16, np.uint64, np.uint64, np.uint32, np.uint32, np.uint32, np.uint16, np.int64, np.int64, np.int64, np.float64)


def pair_rows(known, buckets: int):
    """Chunks of documents to (bucket, data): distinct pairs of documents, by the hash of the pair; what is known of all of
    a document's hot pairs and hot first words is summed on the spot."""
    none = [np.zeros(0, k) for k in KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = Known.of(known.value)
        for ids, texts in chunks(batches):
            ids = ids.to_numpy()
            h, doc = hashed_words(texts)
            if not len(h):
                continue
            code = place_in(k.h, h, UNCODED)
            own = own_counts(h, doc)
            begins = np.r_[True, doc[1:] != doc[:-1]]
            a, ca, own_a = (np.r_[x[:1], x[:-1]] for x in (h, code, own))
            a[begins], ca[begins], own_a[begins] = 0, START, 0
            pair = mixed(mixed(a + ONE) ^ h)
            order = np.lexsort((pair, doc))
            edges = group_edges(doc[order], pair[order], a[order], h[order])
            top = order[edges[:-1]]
            e = Entries(ca[top], code[top], a[top], h[top], np.diff(edges), own_a[top], own[top], doc[top])
            pair = pair[top]
            both = (e.ca < CODES) & (e.cb < CODES)
            at = np.where(both, place_in(k.pair, e.ca * (CODES + 2) + e.cb), -1)
            easy = (at >= 0) | ((e.ca == START) & (e.cb < CODES))
            n, backed, score, _ = e.take(easy).scored(k.pair_n[at[easy]] if len(k.pair) else np.zeros(easy.sum()), k, len(ids))
            has = n > 0
            homes = [int(pair[0] % np.uint64(buckets))]
            out = [packed(*none[:8], ids[has], n[has], backed[has], score[has])]
            e, bucket = e.take(~easy), (pair[~easy] % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            e, bucket = e.take(order), bucket[order]
            edges = group_edges(bucket)
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                p = e.take(slice(i, j))
                used, place = np.unique(p.doc, return_inverse=True)
                homes.append(int(bucket[i]))
                out.append(packed(p.ca.astype(np.uint16), p.cb.astype(np.uint16), p.a[p.ca == UNCODED], p.b[p.cb == UNCODED], p.n.astype(np.uint32), p.own_a.astype(np.uint32), p.own_b.astype(np.uint32), place.astype(np.uint16), np.diff(ids[used], prepend=0), *none[9:]))
            yield pa.RecordBatch.from_arrays([pa.array(homes, pa.int32()), pa.array(out, pa.binary())], ["bucket", "data"])

    return run


SCORED = "doc bigint, n bigint, n_backoff bigint, score double, h bigint, own bigint, times bigint"


def score_buckets(known):
    """A bucket's pairs, counted over all documents and joined back: rows of SCORED, sums where h is null, else what an
    unknown word is still to add."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        k = Known.of(known.value)
        parts = [unpacked(x, *KINDS) for x in group["data"]]
        ca, cb = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in (0, 1))
        word = np.zeros(CODES + 2, np.uint64)
        word[: len(k.h)] = k.h
        a, b = word[ca], word[cb]
        a[ca == UNCODED], b[cb == UNCODED] = (np.concatenate([p[i] for p in parts]) for i in (2, 3))
        n, own_a, own_b = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in (4, 5, 6))
        ids, doc = np.unique(np.concatenate([p[8].cumsum()[p[7]] if len(p[7]) else p[8][:0] for p in parts]), return_inverse=True)
        done = [np.concatenate([p[i] for p in parts if len(p[9])] or [parts[0][i][:0]]) for i in (8, 9, 10, 11)]
        del parts
        order = np.lexsort((b, a, ca == START))
        e = Entries(ca, cb, a, b, n, own_a, own_b, doc).take(order)
        edges = group_edges(e.a, e.b, e.ca == START)
        all_n = np.repeat(np.add.reduceat(e.n, edges[:-1]), np.diff(edges)) if len(order) else e.n
        sums = e.scored(all_n, k, len(ids))
        none = pd.array([None], "Int64")
        rows = lambda doc, n, backed, score, h, own, times: pd.DataFrame({"doc": doc, "n": n, "n_backoff": backed, "score": score, "h": h, "own": own, "times": times})
        left = sums[3]
        out = [rows(*x, none.repeat(len(x[0])), 0, 0) for x in (done, (ids, *sums[:3])) if len(x[0])]
        if len(left[0]):
            out.append(rows(ids[left[0]], 0, 0, 0.0, pd.array(left[1].view(np.int64), "Int64"), left[2], left[3]))
        return pd.concat(out, ignore_index=True) if out else rows([], [], [], [], none[:0], [], [])

    return run


def plain(df: DataFrame) -> bool:
    """Whether ``df`` only reads Parquet files and maps or filters their rows, alike in each run."""
    plans = [df._jdf.queryExecution().optimizedPlan()]
    while plans:
        plan = plans.pop()
        children = plan.children()
        read = plan.nodeName() == "LogicalRelation" and df.inputFiles()
        if not (plan.deterministic() and plan.nodeName() in ("Project", "Filter")) and not read:
            return False
        plans += [children.apply(i) for i in range(children.size())]
    return True


def placed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, doc): doc is a row's place, the number of its file and of the row there.

    Files are split anew in each run, by the cores that are there then, so a number by partition would name another row the next
    time. What isn't a plain table is written first.
    """
    path, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    try:
        where = (docs if plain(docs) else cut(docs)).select("doc_id", "text", path.alias("path"), row.alias("row"))
    except AnalysisException:  # files without row numbers
        where = cut(docs).select("doc_id", "text", path.alias("path"), row.alias("row"))
    files = cut(where.select("path").distinct().select("path", F.row_number().over(Window.orderBy("path")).cast("long").alias("file")))
    return where.join(sized(files), "path").select("doc_id", "text", (F.col("file") * (1 << 40) + F.col("row")).alias("doc"))


def lm_scores(docs: DataFrame, alpha: float = ALPHA, pairs_a_bucket: int = PAIRS_A_BUCKET) -> DataFrame:
    """(doc_id, n_words, n_backoff, log10_sum, lm_score) for each row of ``docs``, by a model of all the other rows.

    Counts c are those of all rows but the one that is scored. A word after a word scores log10(c(pair) / c(first)) if c(pair)
    isn't 0, else log10(alpha * max(c(word), alpha) / N), and a document's first word log10(max(c(word), alpha) / N), N being the
    number of all words. lm_score is the mean a word; n_backoff the number of pairs that no other row has.

    1. Word counts, summed in each task, then by hash: the unigram table. Its CODES most frequent words go to all tasks.
       So do the hot pairs, those too many for a bucket: their number is at most HOT_PAIRS.
    2. Each document's distinct pairs go to the bucket of the pair's hash, whatever their words, so that no word is too
       frequent for a bucket. A bucket counts its pairs, joins the counts back and sums by document.
    3. Words that aren't among the known ones are joined with the unigram table by their hash; none of them is hot.
    A bucket's mean size is fixed, and no pair in it is more than a quarter of that or a HOT_PAIRS-th of all words.

    Words are white-space words, A-Z lower-cased, known by 64 bits of a hash. Null, empty and blank texts: n_words 0,
    lm_score null. Each row is a document, also if doc_id is null, repeated or of another type, and equal rows are
    told from each other: each is in the other's model. A text is held whole by one task. No rows: no rows. Rows are
    known by their place; what isn't a plain table is written first. Other columns are left out.
    """
    numbered = placed(docs.select("doc_id", "text"))
    spark, texts = docs.sparkSession, numbered.select("text")
    words = cut(texts.mapInArrow(count_words, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")))
    total = words.agg(F.sum("n")).first()[0] or 0
    known = Known([tuple(r) for r in words.orderBy(F.desc("n"), "h").limit(CODES).collect()], total, alpha)
    hot = max(pairs_a_bucket // 4, total // HOT_PAIRS, 1)
    heavy = known.h[known.n >= hot]
    if len(heavy):
        pairs = texts.mapInArrow(count_pairs(heavy), "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
        known.add_pairs(heavy, [tuple(r) for r in pairs.filter(F.col("n") >= hot).collect()])
    shared = spark.sparkContext.broadcast(tuple(vars(known).items()))
    buckets = max(1, -(-total // pairs_a_bucket))
    dealt = numbered.select("doc", "text").mapInArrow(pair_rows(shared, buckets), "bucket int, data binary")
    judged = cut(dealt.groupBy("bucket").applyInPandas(score_buckets(shared), SCORED))
    rest = F.log10(F.greatest(F.col("c") - F.col("own"), F.lit(alpha)))
    closed = judged.filter("h IS NOT NULL").join(words.withColumnRenamed("n", "c"), "h").groupBy("doc").agg(F.sum(F.col("times") * rest).alias("score"))
    sums = judged.filter("h IS NULL").select("doc", "n", "n_backoff", "score").unionByName(closed.selectExpr("doc", "0L AS n", "0L AS n_backoff", "score"))
    sums = sums.groupBy("doc").agg(F.sum("n").alias("n_words"), F.sum("n_backoff").alias("n_backoff"), F.sum("score").alias("log10_sum"))
    out = numbered.select("doc_id", "doc").join(sums, "doc", "left")
    whole = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", whole("n_words"), whole("n_backoff"), F.round("log10_sum", 6).alias("log10_sum"), F.round(F.col("log10_sum") / F.col("n_words"), 6).alias("lm_score"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


OP4_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER_LETTERS}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
o AS (SELECT k, w[i] AS b, CASE WHEN i > 1 THEN w[i - 1] END AS a FROM d, unnest(range(1, len(w) + 1)) t(i)),
wd AS (SELECT k, b AS w, count(*) AS n FROM o GROUP BY k, b),
wa AS (SELECT w, sum(n) AS n FROM wd GROUP BY w),
pd AS (SELECT k, a, b, count(*) AS n FROM o GROUP BY k, a, b),
pa AS (SELECT a, b, sum(n) AS n FROM pd WHERE a IS NOT NULL GROUP BY a, b),
t AS (SELECT greatest(sum(n), 1)::DOUBLE AS n FROM wa),
s AS (SELECT pd.k, pd.n, pd.a IS NOT NULL AND pa.n = pd.n AS back,
    CASE WHEN pa.n > pd.n THEN log10((pa.n - pd.n)::DOUBLE / (aa.n - ad.n)::DOUBLE)
    ELSE log10(CASE WHEN pd.a IS NULL THEN 1 ELSE {ALPHA}::DOUBLE END * greatest((ba.n - bd.n)::DOUBLE, {ALPHA}::DOUBLE) / t.n) END AS v
  FROM pd CROSS JOIN t LEFT JOIN pa ON pa.a = pd.a AND pa.b = pd.b LEFT JOIN wa aa ON aa.w = pd.a LEFT JOIN wd ad ON ad.k = pd.k AND ad.w = pd.a
  JOIN wa ba ON ba.w = pd.b JOIN wd bd ON bd.k = pd.k AND bd.w = pd.b),
f AS (SELECT k, sum(n * back::INT) AS back, sum(n * v) AS v FROM s GROUP BY k)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(f.back, 0)::BIGINT AS n_backoff, round(f.v, 6) AS log10_sum, round(f.v / len(d.w), 6) AS lm_score
FROM d LEFT JOIN f ON f.k = d.k
"""

by_value(__name__)
