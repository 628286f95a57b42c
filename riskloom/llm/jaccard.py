"""N-gram Jaccard join as a T-occurrence search over inverted lists (operator 12).

Two sets within the threshold share at least T = 85 % of the larger one's shingles. With all shingles in one order, by hash, of the
first s - T + m of a set of s at least m stand among the first ones of its partner too (m as in ``matches``). So each set puts
only those into the inverted lists. Lists of up to SHORT sets are short. A set's short lists are merged with a heap, which counts how often
each other set occurs; of the m matches those in long lists may be missing, so a pair needs m less the number of long lists of that
one of its sets that has fewer. What reaches the count is verified on whole sets.

Sets of which almost all matches may lie in long lists are left: they are indexed anew among themselves, with all their shingles. Those that are
left again have most of their shingles in common with many others. Two of them either share a shingle of a short list too, which finds
them, or only some of long lists; those ``crowd`` links without listing their pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import by_value, each, shielded, sized, table
from riskloom.llm.components import components
from riskloom.session import cut

SHINGLE = 4
SEED = 42
#: Least share of the union, in hundredths.
SHARE = 85
SHORT = 64
#: Most nodes of a component, and most nodes that look for partners there, in one task.
BLOCK = 1_000


def hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The set of a text: 64-bit hashes of its distinct shingles, in order. One shingle for fewer words, none without words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    whole = {b" ".join(w)} if len(w) < shingle else set(map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False)))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in whole), np.uint64, len(whole)))


def overlap(n: int, share: int = SHARE) -> int:
    """What a set of n shingles has to share at least with any partner; also the least size of a partner."""
    return -(-share * n // 100)


def matches(n: int, share: int = SHARE) -> int:
    """How many shared shingles are looked for among the first ones of a set of n."""
    return min(overlap(n, share), 8 + n // 24)


def _overlap(n: Column, share: int) -> Column:
    return F.ceil(n * share / F.lit(100.0)).cast("long")


def _matches(n: Column, share: int, full: bool) -> Column:
    most = _overlap(n, share)
    return most if full else F.least(most, 8 + F.floor(n / F.lit(24)).cast("long"))


def _marked(share: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, names, firsts = [], [], []
            for t in b.column("text"):
                h = hashes(t.as_py())
                sizes.append(len(h))
                names.append(xxhash.xxh3_128_digest(h.tobytes()))
                firsts.append(h[: len(h) - overlap(len(h), share) + matches(len(h), share)].view(np.int64))
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, firsts)], dtype=np.int32), np.concatenate([np.zeros(0, np.int64), *firsts]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("t"), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), lists], ["doc_id", "t", "s", "name", "firsts"])

    return rows


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [hashes(t.as_py()).view(np.int64) for t in b.column("text")]
        lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, sets)], dtype=np.int32), np.concatenate([np.zeros(0, np.int64), *sets]))
        yield pa.RecordBatch.from_arrays([b.column("uid"), lists], ["uid", "set"])


def whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(uid, set): the sets of the ``wanted`` rows (t, uid), made anew from the texts: only few rows need theirs."""
    texts = docs.filter("text IS NOT NULL").select(F.unhex(F.md5("text")).alias("t"), "text")
    sets = texts.join(sized(wanted), "t").select("uid", "text").mapInArrow(_whole, "uid long, set array<long>")
    return cut(sets.groupBy("uid").agg(F.first("set").alias("set")))


def _merged(lists: list[list[int]], least: int) -> list[tuple[int, int]]:
    """Members of sorted lists and how often they occur, ``least`` times or more."""
    out, last, n = [], None, 0
    for x in heapq.merge(*lists):
        if x == last:
            n += 1
            continue
        if last is not None and n >= least:
            out.append((last, n))
        last, n = x, 1
    if last is not None and n >= least:
        out.append((last, n))
    return out


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        pairs = []
        for uid, least, lists in zip(b.column("uid"), b.column("least"), b.column("lists"), strict=True):
            pairs += [(uid.as_py(), other, n) for other, n in _merged(lists.as_py(), least.as_py())]
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in range(3)], ["a", "b", "n"])


def search(nodes: DataFrame, rows: DataFrame, share: int, short: int, full: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, left, long rows) of sets (uid, s) and their index (g, uid, s).

    Candidates (a, b, n) hold all pairs within the threshold but those of two sets that are both ``left`` (column uid); with a ``full``
    index (all shingles), those of them too that share one of a short list. Lists are counted
    first, with sums on the map side: a list longer than ``short`` is never gathered, its rows only count how many such lists a set has.
    """
    counts = cut(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    long_lists = cut(counts.filter(F.col("n") > short).select("g"))
    long_rows = cut(rows.join(sized(long_lists), "g", "left_semi").select("g", "uid", "s"))
    many = long_rows.groupBy("uid", "s").agg(F.count(F.lit(1)).alias("skipped"))
    left = cut(many.filter(F.col("skipped") >= _matches(_overlap(F.col("s"), share), share, full)).select("uid"))
    skipped = cut(many.select("uid", "skipped"))
    few = rows.join(sized(long_lists), "g", "left_anti").join(sized(cut(counts.filter(F.col("n") <= short).select("g"))), "g", "left_semi")
    lists = few.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("uid", "s"))).alias("x"))
    ids = F.transform("x", lambda y: y["uid"])
    later = F.transform("x", lambda x, i: F.struct(x["uid"].alias("uid"), x["s"].alias("s"), F.slice(ids, i + 2, F.size("x")).alias("tail")))
    tails = each(lists, later, "y")
    merged = tails.filter(F.size("y.tail") > 0).groupBy("y.uid", "y.s").agg(F.collect_list("y.tail").alias("lists"))
    least = F.greatest(F.lit(1), _matches(_overlap(F.col("s"), share), share, full) - F.coalesce("skipped", F.lit(0)))
    found = merged.join(sized(skipped), "uid", "left").select("uid", least.cast("long").alias("least"), "lists").mapInArrow(_candidates, "a long, b long, n long")
    # what both sets of a pair ask for
    of = nodes.join(sized(skipped), "uid", "left").select("uid", _matches(F.col("s"), share, full).alias("m"), F.coalesce("skipped", F.lit(0)).alias("k"))
    of = cut(of)
    both = found.join(sized(of.toDF("a", "ma", "ka")), "a").join(sized(of.toDF("b", "mb", "kb")), "b")
    need = F.least("ma", "mb") - F.least("ka", "kb")
    # of whole sets two that are left are candidates too if any short list holds both
    enough = F.col("n") >= F.greatest(need, F.lit(1)) if full else (need >= 1) & (F.col("n") >= need)
    return cut(both.filter(enough).select("a", "b", "n")), left, long_rows


def verified(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets are within the threshold."""
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    met = F.size(F.array_intersect("x", "y"))
    return both.filter(100 * met >= share * (F.size("x") + F.size("y") - met)).select("a", "b")


def linked(candidates: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Links among the candidates that join what all their links join. First each set's likeliest partner is verified, then
    the pairs that this left in different components."""
    ways = candidates.unionByName(candidates.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    best = ways.groupBy("a").agg(F.max_by("b", F.struct("n", -F.col("b"))).alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    first = cut(verified(best, sets, share))
    known = cut(components(first))
    apart = candidates.join(sized(known.toDF("a", "ra")), "a", "left").join(sized(known.toDF("b", "rb")), "b", "left").filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
    apart = cut(apart.join(sized(best), ["a", "b"], "left_anti"))
    return first.unionByName(verified(apart, sets, share)) if apart.count() else first


def divide_skip(index: np.ndarray, owner: np.ndarray, query: np.ndarray, least: int) -> list[int]:
    """Owners that share at least ``least`` hashes with the query. ``index``: sorted hashes, ``owner``: whose, in order within a hash.

    The longest of the query's lists are set aside; the short ones are merged with a heap, and what occurs there often enough is
    looked for in the long ones by binary search, until it can't reach ``least`` any more.
    """
    lo, hi = np.searchsorted(index, query, "left"), np.searchsorted(index, query, "right")
    lists = sorted((owner[a:b] for a, b in zip(lo, hi, strict=True) if b > a), key=len)
    aside = max(0, min(least - max(1, least // 16), len(lists)))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    out = []
    for x, n in _merged([s.tolist() for s in short], least - aside):
        for i, s in enumerate(long):
            if n >= least or n + len(long) - i < least:
                break
            at = int(np.searchsorted(s, x))
            n += at < len(s) and s[at] == x
        if n >= least:
            out.append(x)
    return out


def _searched(share: int):
    def pairs(members: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(members) and len(asking):
            sets, sizes = [np.asarray(x, np.int64) for x in members["in_hot"]], members["in_s"].tolist()
            index, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            order = np.lexsort((owner, index))
            index, owner = index[order], owner[order]
            for node, hot, s in zip(asking["node"], asking["hot"], asking["s"], strict=True):
                for i in divide_skip(index, owner, np.asarray(hot, np.int64), overlap(s, share)):
                    met = len(np.intersect1d(sets[i], hot, assume_unique=True))
                    if 100 * met >= share * (s + sizes[i] - met):
                        out.append((node, members["member"].iloc[i]))
                        break  # one link to this part of the component joins it
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return pairs


def crowd(rows: DataFrame, share: int, block: int) -> DataFrame:
    """Links (a, b) that join what all links join among sets of size s that share no shingle but those of ``rows`` (g, uid, s: their long lists).

    Such links depend on sizes and on shingles of long lists alone, so sets alike in both are one node: thousands of texts around one
    passage are some nodes. A node of which two sets would be linked, or that is linked to another, joins all its sets.
    """
    own = rows.groupBy("uid", "s").agg(F.array_sort(F.collect_list("g")).alias("hot"))
    # what is shared has to be in long lists
    own = cut(own.filter(F.size("hot") >= _overlap(F.col("s"), share)))
    nodes = cut(own.groupBy("hot", "s").agg(F.min("uid").alias("node"), F.count(F.lit(1)).alias("sets")))
    found = cut(node_links(nodes.select("node", "s", "hot"), share, block))
    alike = nodes.filter((F.col("sets") > 1) & (100 * F.size("hot") >= share * (2 * F.col("s") - F.size("hot")))).select("node")
    joined = cut(found.select(F.explode(F.array("a", "b")).alias("node")).unionByName(alike).distinct())
    members = own.join(nodes.filter("sets > 1"), ["hot", "s"]).filter("uid <> node").select("uid", "node")
    return found.unionByName(members.join(sized(joined), "node", "left_semi").select(F.col("node").alias("a"), F.col("uid").alias("b")))


def node_links(nodes: DataFrame, share: int, block: int) -> DataFrame:
    """Links (a, b) that join what all links of nodes (node, s, hot) join; pairs within a list are never listed.

    The least node of each list is its hub. Each node is held against the hub that it meets in most lists; that joins most of a crowd. Then a
    node and a component that meet in a list and are not joined yet are taken together: the node (of the smaller component) is searched for in
    the component's index, in blocks of members and of nodes. For that a node stands only in its shortest lists, all but T - 1 of them.
    """
    rows = each(nodes, F.col("hot"), "g", "node", "s", F.size("hot").alias("lists"))
    hubs = cut(rows.groupBy("g").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("held")))
    met = rows.join(sized(hubs), "g").filter("node <> hub").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("n"))
    picked = met.groupBy("node").agg(F.max_by("hub", F.struct("n", -F.col("hub"))).alias("hub"))
    both = picked.join(nodes.toDF("node", "s", "x"), "node").join(nodes.toDF("hub", "t", "y"), "hub")
    shared = F.size(F.array_intersect("x", "y"))
    first = cut(both.filter(100 * shared >= share * (F.col("s") + F.col("t") - shared)).select(F.col("node").alias("a"), F.col("hub").alias("b")))
    known = cut(components(first))
    of = nodes.select("node", F.col("s").alias("size"), F.size("hot").alias("reach")).join(sized(known.toDF("node", "root")), "node", "left")
    of = cut(of.select("node", F.coalesce("root", "node").alias("c"), "size", "reach"))
    sizes = of.groupBy("c").agg(F.count(F.lit(1)).alias("members"), F.min("size").alias("least"), F.max("reach").alias("most"))
    of = cut(of.join(sizes, "c"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("held", "g"))
    least = rows.join(sized(hubs.select("g", "held")), "g").withColumn("place", place).filter(F.col("place") <= F.col("lists") - _overlap(F.col("s"), share) + 1)
    placed = cut(least.select("g", "node").join(sized(of), "node"))
    parts = cut(placed.groupBy("g", "c", "members", "least", "most").agg(F.count(F.lit(1)).alias("n")))
    mixed = cut(parts.groupBy("g").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("g"))
    if not mixed.limit(1).count():
        return first
    others = parts.join(sized(mixed), "g", "left_semi").select("g", F.col("c").alias("into"), F.col("members").alias("of_into"), F.col("least").alias("into_least"), F.col("most").alias("into_most"))
    # links need share / (100 + share) of both sizes in common, which has to be in long lists of both
    can = f"{100 + share} * least(reach, into_most) >= {share} * (size + into_least)"
    meeting = placed.join(sized(mixed), "g", "left_semi").join(others, "g").filter(f"(of_into > members OR (of_into = members AND into < c)) AND {can}")
    asks = cut(meeting.select("node", "into").distinct())
    loads = asks.groupBy(F.col("into").alias("c")).agg(F.count(F.lit(1)).alias("asking"))
    # both sides of a cogroup need the same type
    blocks = lambda n: F.ceil(F.col(n) / block).cast("long")
    spread = lambda n: F.sequence(F.lit(0).cast("long"), blocks(n) - 1)
    plan = cut(of.select("c", "members").distinct().join(loads, "c"))
    inside = each(of.select("node", "c").join(sized(plan), "c"), spread("asking"), "part", "c", "node", F.pmod(F.xxhash64("node"), blocks("members")).alias("block"))
    outside = each(asks.select("node", F.col("into").alias("c")).join(sized(plan), "c"), spread("members"), "block", "c", "node", F.pmod(F.xxhash64("node"), blocks("asking")).alias("part"))
    key = ["c", "block", "part"]
    members = inside.join(nodes, "node").select(*key, "node", "hot", "s").toDF("in_c", "in_block", "in_part", "member", "in_hot", "in_s")
    asking = outside.join(nodes, "node").select(*key, "node", "hot", "s").toDF(*key, "node", "hot", "s")
    more = members.groupBy("in_c", "in_block", "in_part").cogroup(asking.groupBy(*key)).applyInPandas(_searched(share), "a long, b long")
    return first.unionByName(more)


def links(docs: DataFrame, reps: DataFrame, share: int, short: int, block: int) -> DataFrame:
    """(a, b): links among different sets (``reps``: uid, t, s, firsts) that join what all links join."""
    rows = each(reps, F.col("firsts"), "g", "uid", "s")
    found, left, _ = search(reps.select("uid", "s"), rows, share, short, False)
    wanted = found.select(F.explode(F.array("a", "b")).alias("uid")).unionByName(left).distinct()
    sets = whole_sets(docs, cut(reps.select("uid", "t").join(sized(cut(wanted)), "uid", "left_semi")))
    out = linked(found, sets, share)
    if not left.limit(1).count():
        return out
    few = sets.join(sized(left), "uid", "left_semi").withColumn("s", F.size("set").cast("long"))
    again, crowded, long_rows = search(few.select("uid", "s"), each(few, F.col("set"), "g", "uid", "s"), share, short, True)
    out = out.unionByName(linked(again, sets, share))
    if not crowded.limit(1).count():
        return out
    return out.unionByName(crowd(cut(long_rows.join(sized(crowded), "uid", "left_semi")), share, block))


MADE = ["n_shingles", "component_id"]


def similar(docs: DataFrame, share: int = SHARE, short: int = SHORT, block: int = BLOCK) -> DataFrame:
    """``docs`` with n_shingles (size of the text's set) and component_id (least doc_id that links reach, its own included).

    Copies of a set are one node. Null, empty and blank texts have an empty set and are linked with nothing; a text of any length counts whole.
    Rows with a null doc_id take their component's id, null if none has one; repeated doc_ids: each row by itself. Shingles are told
    apart by 64 bits, sets by 128. No rows: no rows. Columns with these names are overwritten, all others kept.
    """
    inner, back = shielded(docs, "doc_id", "text", made=MADE)
    texts = inner.select("doc_id", "text", F.unhex(F.md5("text")).alias("t"))
    kind = dict(inner.dtypes)["doc_id"]
    marked = texts.mapInArrow(_marked(share), f"doc_id {kind}, t binary, s long, name binary, firsts array<long>").withColumn("uid", F.monotonically_increasing_id())
    out = components_of(docs, cut(marked), share, short, block)
    # a row's text and id tell all that is made of it
    made = out.groupBy("doc_id", "t").agg(F.first("n_shingles").alias("n_shingles"), F.first("component_id").alias("component_id"))
    inner = inner.withColumn("own_t", F.unhex(F.md5("text")))
    made = made.select(F.col("doc_id").alias("made_id"), F.col("t").alias("made_t"), "n_shingles", "component_id")
    return inner.join(made, inner["doc_id"].eqNullSafe(made["made_id"]) & inner["own_t"].eqNullSafe(made["made_t"]), "left").select(*back, *MADE)


def components_of(docs: DataFrame, marked: DataFrame, share: int = SHARE, short: int = SHORT, block: int = BLOCK) -> DataFrame:
    """(doc_id, t, n_shingles, component_id) for each row of ``marked`` (doc_id, t, s, name, firsts, uid: written)."""
    groups = cut(marked.filter("s > 0").groupBy("name").agg(F.min("uid").alias("rep"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    alike = groups.filter("n > 1")
    copies = cut(marked.filter("s > 0").select("uid", "name").join(sized(cut(alike.select("name", "rep"))), "name").select("uid", "rep"))
    reps = marked.filter("s > 0").select("uid", "t", "s", "firsts").join(sized(cut(copies.filter("uid <> rep").select("uid"))), "uid", "left_anti")
    joined = components(links(docs, reps, share, short, block))
    roots = cut(groups.select("rep", "least", "n").join(joined.toDF("rep", "found"), "rep", "left").select("rep", "least", "n", F.coalesce("found", "rep").alias("root")))
    classes = roots.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("members")).filter("members > 1")
    known = cut(roots.join(classes, "root").select("rep", "component_id"))
    of = marked.select("doc_id", "t", "s", "uid").join(sized(copies), "uid", "left").withColumn("rep", F.coalesce("rep", "uid"))
    out = of.join(sized(known.withColumn("found", F.lit(True))), "rep", "left")
    return out.select("doc_id", "t", F.col("s").alias("n_shingles"), F.when(F.col("found"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op12_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = docs.select("doc_id", "text", F.unhex(F.md5("text")).alias("t")).mapInArrow(_marked(SHARE), "doc_id long, t binary, s long, name binary, firsts array<long>")
    return components_of(docs, cut(marked.withColumn("uid", F.monotonically_increasing_id()))).select("doc_id", "n_shingles", "component_id")


by_value(__name__)
