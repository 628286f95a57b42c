"""Prefix trie of conversations by a Cartesian tree over the LCP array of the sorted conversations (operator 11).

Distinct conversations are sorted into blocks; L[i] is the number of first turns that conversation i shares with the one before it (-1
at the first). A branching node of the trie is an interval [l, r) of conversations: for a position i, l is the nearest position before i with
a smaller L, r the nearest one behind, and L[i] the node's depth; positions with equal L and l are one node. These all-nearest-smaller-values
are found within each block with a stack. What has none there looks for it in the nearest block whose minimum is smaller; only
minima and staircases of minima go between blocks. All that is told of a node is a sum or minimum over its interval.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import by_value, each, sized, table
from riskloom.session import cut

#: Conversations of a block; bytes of a conversation's key (16 a turn) that deal it to a block.
BLOCK, CLIP = 20_000, 4_096
#: Conversations that the rebuilding draws on: those of ids divisible by BASE give up to LEND - 1 first turns to others.
BASE, LEND = 100, 6
#: Ids that stand in one row on their way to a digest.
IDS = 4_096
NONE = hashlib.sha256(b"").hexdigest()
FAR = 1 << 62
SUMS = ["n", "leaves", "w", "d", "least"]


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, key, chars) of each conversation after rebuilding: 16 bytes of digest and the text's code points for each turn.

    Turns travel as digests, so a conversation is one row of some 30 bytes a turn, however long its texts are.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    turns = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", digest.alias("digest"), F.length(text).alias("chars")).alias("x"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("own"))
    heads = turns.filter(F.col("conv_id") % BASE == 0).groupBy("conv_id").agg(F.slice(F.sort_array(F.collect_list("x")), 1, LEND - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % LEND).cast("int")
    both = whole.withColumn("base", F.col("conv_id") - F.col("conv_id") % BASE).join(heads.withColumnRenamed("conv_id", "base"), "base", "left")
    none = F.slice("own", 1, 0)
    seq = F.concat(F.slice(F.coalesce("head", none), F.lit(1), h), F.slice("own", h + 1, F.size("own")))
    out = both.select("conv_id", seq.alias("seq"))
    return out.select("conv_id", F.unhex(F.array_join(F.transform("seq", lambda x: x["digest"]), "")).alias("key"), F.transform("seq", lambda x: x["chars"].cast("long")).alias("chars"))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (name, conv_id) as rows (name, first, ids) of up to IDS ids."""
    name, ids = None, []
    rows: list[tuple] = []
    for b in batches:
        for x, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if ids and (x != name or len(ids) == IDS):
                rows.append((name, ids[0], ",".join(map(str, ids))))
                ids = []
            name = x
            ids.append(i)
        yield _rows(rows, LISTED)
        rows = []
    if ids:
        yield _rows([(name, ids[0], ",".join(map(str, ids)))], LISTED)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (name, first, ids) as (name, ends): one running digest, whatever the number of ids."""
    name, sha = None, None
    for b in batches:
        rows = []
        for x, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            if sha is not None and x != name:
                rows.append((name, sha.hexdigest()))
                sha = None
            if sha is None:
                name, sha = x, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
        yield _rows(rows, DIGESTS)
    if sha is not None:
        yield _rows([(name, sha.hexdigest())], DIGESTS)


LISTED = pa.schema([("name", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
DIGESTS = pa.schema([("name", pa.binary()), ("ends", pa.string())])
LCP = pa.schema([("block", pa.int64()), ("idx", pa.int64()), ("lcp", pa.int64()), ("len", pa.int64()), ("n", pa.int64()), ("least", pa.int64()), ("total", pa.int64()), ("d", pa.int64()), ("cum", pa.list_(pa.int64())), ("ends", pa.string()), ("edge", pa.binary())])
EDGE = pa.schema([("block", pa.int64()), ("lcp", pa.int64()), ("d", pa.int64())])


def _rows(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def ends_of(members: DataFrame) -> DataFrame:
    """(name, ends): SHA-256 of each name's conv_ids, ascending. Ids are joined in ranges first, so a name of many copies is
    a row for each IDS of them."""
    listed = members.select("name", "conv_id").repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id").mapInArrow(_listed, "name binary, first long, ids string")
    return listed.repartition("name").sortWithinPartitions("name", "first").mapInArrow(_digests, "name binary, ends string")


def common(a: bytes, b: bytes) -> int:
    """Turns that two keys share from the start."""
    n = min(len(a), len(b)) // 8
    if not n:
        return 0
    differ = np.nonzero(np.frombuffer(a, np.uint64, n) != np.frombuffer(b, np.uint64, n))[0]
    return (int(differ[0]) if len(differ) else n) // 2


def _lcps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted conversations of a block with what each shares with the one before; the first and last keep their key."""
    block, held, last, i = TaskContext.get().partitionId(), None, None, 0
    for b in batches:
        out = []
        for key, chars, n, least, ends in zip(*(b.column(c).to_pylist() for c in ("key", "chars", "n", "least", "ends")), strict=True):
            cum = np.cumsum(chars, dtype=np.int64).tolist()
            shared, total = None if last is None else common(last, key), cum[-1] if cum else 0
            row = [block, i, shared, len(cum), n, least, total, total - (cum[shared - 1] if shared else 0), cum, ends, None if i else key]
            if held is not None:
                out.append(held)
            held, last, i = row, key, i + 1
        yield _rows(out, LCP)
    if held is not None:
        yield _rows([[*held[:-1], last]], LCP)


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for block, key, before, cum in zip(*(b.column(c).to_pylist() for c in ("block", "edge", "before", "cum")), strict=True):
            shared = -1 if before is None else common(before, key)
            rows.append((block, shared, (cum[-1] if cum else 0) - (cum[shared - 1] if shared > 0 else 0)))
        yield _rows(rows, EDGE)


def nearest_smaller(x: list[int]) -> tuple[list[int], list[int]]:
    """For each place the nearest one before and behind it with a smaller value; -1 and len(x) where there is none."""
    left, right, stack = [-1] * len(x), [len(x)] * len(x), []
    for i, v in enumerate(x):
        while stack and x[stack[-1]] > v:
            right[stack.pop()] = i
        if stack:
            # of equal values the one on the stack has this one's left neighbour too
            left[i] = left[stack[-1]] if x[stack[-1]] == v else stack[-1]
        stack.append(i)
    return left, right


def _minimum(x: np.ndarray):
    """A function from intervals [lo, hi) to the least of x there; FAR for empty ones."""
    levels = [np.append(x, FAR)]
    while 2 ** len(levels) <= len(x):
        half = 2 ** (len(levels) - 1)
        last = levels[-1]
        levels.append(np.minimum(last, np.append(last[half:], np.full(half, FAR))))

    def least(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        out = np.full(len(lo), FAR)
        size = hi - lo
        for k, level in enumerate(levels):
            on = (size >= 2**k) & (size < 2 ** (k + 1))
            out[on] = np.minimum(level[lo[on]], level[hi[on] - 2**k])
        return out

    return least


#: kind 0: a position; 1: a node; 2: positions of a node that isn't whole within the block (state: 1 if its left end is known, 2 if its
#: right end is, else 0; idx: that end, lv: the value there, sums: from it to the block's end or from its start up to it); 3, 4: staircases of
#: minima from the block's end and start; 5: the block.
PIECES = ["kind", "block", "idx", "v", "k", "state", "lv", "pb", "pi", "u", *SUMS]


def _pieces(first: dict[int, tuple[int, int]]):
    order = sorted(first)
    after = dict(zip(order, order[1:], strict=False))

    def pieces(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("idx")
        b, m = int(g["block"].iloc[0]), len(g)
        value, own = g["lcp"].to_numpy(np.float64, na_value=0).astype(np.int64), g["d"].to_numpy(np.int64).copy()
        value[0], own[0] = first[b]
        length, n, ids = (g[c].to_numpy(np.int64) for c in ("len", "n", "least"))
        follows = np.append(value[1:], first[after[b]][0] if b in after else -1)
        leaf = (length > follows).astype(np.int64)
        sums = [np.append(0, np.cumsum(x)) for x in (n, leaf, n * g["total"].to_numpy(np.int64), own)]
        least = _minimum(ids)
        left, right = (np.array(x, np.int64) for x in nearest_smaller(value.tolist()))

        def frame(kind: int, size: int, **x) -> pd.DataFrame:
            return pd.DataFrame({c: np.broadcast_to(x.get(c, kind if c == "kind" else b if c == "block" else 0), size) for c in PIECES})

        def over(lo, hi) -> dict:
            """Sums over [lo, hi); d leaves out the first."""
            out = {c: s[hi] - s[lo] for c, s in zip(SUMS, sums, strict=False)}
            out["d"] = out["d"] - np.where(hi > lo, own[np.minimum(lo, m - 1)], 0)
            return out | {"least": least(lo, hi)}

        at = np.arange(m)
        up, go = np.maximum(value, follows), value >= follows
        nxt = np.append(at[1:], 0), np.append(np.full(m - 1, b), after.get(b, -1))
        leaves = frame(1, m, idx=at, v=length, k=-1, pb=np.where(go, b, nxt[1]), pi=np.where(go, at, nxt[0]), u=up, **over(at, at + 1))[(leaf == 1) & (length > value)]
        whole = (left >= 0) & (right < m) & (value >= 0)
        state = np.where(left >= 0, 1, np.where(right < m, 2, 0))
        places = frame(0, m, idx=at, v=value, state=state, least=FAR)
        groups = pd.DataFrame({"left": left, "right": right, "v": value, "whole": whole})[value >= 0].groupby(["left", "right", "v", "whole"]).size().reset_index(name="k")
        found = groups[groups["whole"]]
        lo, hi = found["left"].to_numpy(), found["right"].to_numpy()
        go = value[lo] >= value[hi] if len(lo) else np.zeros(0, bool)
        nodes = frame(1, len(lo), idx=lo, v=found["v"].to_numpy(), k=found["k"].to_numpy(), pb=b, pi=np.where(go, lo, hi), u=np.maximum(value[lo], value[hi]), **over(lo, hi))
        if len(lo):
            names = {(i, v): x for i, v, x in zip(lo.tolist(), found["v"].tolist(), nodes["least"].tolist(), strict=True)}
            places["least"] = [names[i, v] if w else FAR for i, v, w in zip(left.tolist(), value.tolist(), whole.tolist(), strict=True)]
        part = groups[~groups["whole"]]
        lo, hi = part["left"].to_numpy(), part["right"].to_numpy()
        known = np.where(lo >= 0, 1, np.where(hi < m, 2, 0))
        a, z = np.where(known == 1, lo, 0), np.where(known == 1, m, np.where(known == 2, hi, 0))
        s = over(a, z)
        s["d"] = s["d"] + np.where(known == 2, own[0], 0)  # what comes before the block's start isn't the node's first
        ends = np.where(known == 1, lo, np.where(known == 2, hi, 0))
        parts = frame(2, len(lo), idx=ends, v=part["v"].to_numpy(), k=part["k"].to_numpy(), state=known, lv=value[ends], **s)
        low = np.minimum.accumulate(value)
        heads = at[np.append(True, value[1:] < low[:-1])]
        low = np.minimum.accumulate(value[::-1])[::-1]
        tails = at[np.append(value[:-1] < low[1:], True)]
        s = over(np.zeros_like(heads), heads)
        s["d"] = s["d"] + np.where(heads > 0, own[0], 0)
        total = frame(5, 1, idx=m, v=value.min(), **{c: x[m] for c, x in zip(SUMS, sums, strict=False)}, least=ids.min())
        return pd.concat([leaves, places, nodes, parts, frame(3, len(tails), idx=tails, v=value[tails], **over(tails, np.full(len(tails), m))), frame(4, len(heads), idx=heads, v=value[heads], **s), total])[PIECES].astype("int64")

    return pieces


def _sought(order: list[int], minima: list[int]):
    """Open ends with the block where they are to be looked for; a right end that no block has is at the end of all (block -1)."""
    place = {b: i for i, b in enumerate(order)}
    back, ahead = nearest_smaller(minima)

    def sought(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for b, v, state in zip(f["block"], f["v"], f["state"], strict=True):
                i = place[b]
                if state != 1:
                    j = i - 1
                    while j >= 0 and minima[j] >= v:
                        j = back[j]
                    out.append((b, v, state, 3, order[j]))
                if state != 2:
                    j = i + 1
                    while j < len(order) and minima[j] >= v:
                        j = ahead[j]
                    out.append((b, v, state, 4, order[j] if j < len(order) else -1))
            yield pd.DataFrame(out, columns=["block", "v", "state", "stairs", "at"]).astype("int64")

    return sought


def _answers(asked: pd.DataFrame, stairs: pd.DataFrame) -> pd.DataFrame:
    """For each end sought in a block the step of its staircase where it is: the smaller value that is nearest."""
    cols = ["block", "v", "state", "stairs", "at", "idx", "lv", *SUMS]
    if not len(asked):
        return pd.DataFrame([], columns=cols).astype("int64")
    if not len(stairs):  # beyond the last block
        return asked.assign(idx=0, lv=-1, n=0, leaves=0, w=0, d=0, least=FAR)[cols]
    stairs = stairs.sort_values("step_v")
    at = np.searchsorted(stairs["step_v"].to_numpy(), asked["v"].to_numpy(), "left") - 1
    found = stairs.iloc[at]
    made = {"idx": found["step_idx"].to_numpy(), "lv": found["step_v"].to_numpy()} | {c: found[f"step_{c}"].to_numpy() for c in SUMS}
    return asked.assign(**made)[cols]


def _spanning(order: list[int], totals: dict[str, list[int]]):
    """Nodes over more than one block: the end of the first, all those between, the start of the last."""
    place = {b: i for i, b in enumerate(order)} | {-1: len(order)}
    sums = {c: np.append(0, np.cumsum(totals[c])) for c in SUMS[:-1]}
    least = _minimum(np.array(totals["least"], np.int64))

    def nodes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for side, state, own in (("l", 1, "idx"), ("r", 2, "idx")):
                on = (f["state"] == state).to_numpy()
                for c in ("idx", "lv", *SUMS):
                    f[f"{side}_{c}"] = np.where(on, f[own if c == "idx" else c], f[f"{side}_{c}"].fillna(0)).astype(np.int64)
                f[f"{side}_b"] = np.where(on, f["block"], f[f"{side}_b"].fillna(0)).astype(np.int64)
            lo, hi = (np.array([place[b] for b in f[c]], np.int64) for c in ("l_b", "r_b"))
            out = {"block": f["l_b"], "idx": f["l_idx"], "v": f["v"], "k": f["k"], "from_block": f["block"], "state": f["state"]}
            out |= {c: f[f"l_{c}"] + f[f"r_{c}"] + s[hi] - s[lo + 1] for c, s in sums.items()}
            out["least"] = np.minimum(np.minimum(f["l_least"], f["r_least"]), least(lo + 1, hi))
            go = f["l_lv"] >= f["r_lv"]
            out |= {"pb": np.where(go, f["l_b"], f["r_b"]), "pi": np.where(go, f["l_idx"], f["r_idx"]), "u": np.maximum(f["l_lv"], f["r_lv"])}
            yield pd.DataFrame(out)[SPANNING].astype("int64")

    return nodes


NODE = ["block", "idx", "v", "k", "pb", "pi", "u", *SUMS]
SPANNING = [*NODE, "from_block", "state"]
longs = lambda names: ", ".join(f"{c} long" for c in names)


def tree(rows: DataFrame, first: dict[int, tuple[int, int]]) -> tuple[DataFrame, DataFrame]:
    """(nodes, names): intervals with their depth v, children k (at other depths than v there is one), the depth u and a position
    (pb, pi) of the node above, and the least conversation of the node of each position.

    Of each block, its minimum and sums go to the driver: a row for BLOCK conversations.
    """
    pieces = cut(rows.select("block", "idx", "lcp", "len", "n", "least", "total", "d").groupBy("block").applyInPandas(_pieces(first), longs(PIECES)))
    blocks = pieces.filter("kind = 5").orderBy("block").collect()
    order = [r.block for r in blocks]
    parts = pieces.filter("kind = 2")
    asked = parts.select("block", "v", "state").mapInPandas(_sought(order, [r.v for r in blocks]), "block long, v long, state long, stairs long, at long")
    steps = pieces.filter("kind IN (3, 4)").select("kind", "block", *[F.col(c).alias(f"step_{c}") for c in ("v", "idx", *SUMS)])
    found = asked.groupBy("stairs", "at").cogroup(steps.groupBy("kind", "block")).applyInPandas(_answers, longs(["block", "v", "state", "stairs", "at", "idx", "lv", *SUMS]))
    found = cut(found)
    side = lambda name, kind: found.filter(F.col("stairs") == kind).select("block", "v", "state", F.col("at").alias(f"{name}_b"), *[F.col(c).alias(f"{name}_{c}") for c in ("idx", "lv", *SUMS)])
    open_ends = parts.join(side("l", 3), ["block", "v", "state"], "left").join(side("r", 4), ["block", "v", "state"], "left")
    spanning = cut(open_ends.mapInPandas(_spanning(order, {c: [r[c] for r in blocks] for c in SUMS}), longs(SPANNING)))
    # every block that a node touches at one of its own positions has made it
    rest = [F.first(c).alias(c) for c in NODE if c not in ("block", "idx", "v", "k")]
    across = spanning.groupBy("block", "idx", "v").agg(F.sum("k").alias("k"), *rest).select(*NODE)
    nodes = pieces.filter("kind = 1").select(*NODE).unionByName(across)
    places = pieces.filter("kind = 0").select("block", "idx", "v", "state", "least")
    inside = places.filter(F.col("least") < FAR).select("block", "idx", "least")
    outside = places.filter((F.col("least") == FAR) & (F.col("v") >= 0)).drop("least").join(spanning.select(F.col("from_block").alias("block"), "v", "state", "least"), ["block", "v", "state"])
    return nodes, inside.unionByName(outside.select("block", "idx", "least"))


def prefix_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each distinct sequence of first turns of the rebuilt conversations (conv_id, turn, role, text); see ``rebuilt``.

    Turns are in order of turn, nulls first; of equal ones the order is that of a digest of role and text, so that repeated rows
    are turns like any other. Null roles and texts are empty. Rows without a conv_id belong to no conversation. Texts of any length
    count whole; other columns aren't read. No conversations: no rows. Many copies of a conversation are one row with a number, and a
    node of many conversations is an interval: neither is gathered. The turns of one conversation, as digests, are one row.
    """
    members = cut(rebuilt(conversations).withColumn("name", F.unhex(F.md5("key"))))
    copies = members.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.first(F.struct("key", "chars")).alias("x"))
    distinct = cut(copies.join(ends_of(members), "name").select("x.key", "x.chars", "n", "least", "ends"))
    blocks = max(1, -(-distinct.count() // block))
    rows = cut(distinct.repartitionByRange(blocks, F.substring("key", 1, CLIP)).sortWithinPartitions("key").mapInArrow(_lcps, "block long, idx long, lcp long, len long, n long, least long, total long, d long, cum array<long>, ends string, edge binary"))
    # two rows a block
    edges = rows.filter("edge IS NOT NULL").select("block", "idx", "edge", "cum").withColumn("before", F.lag("edge").over(Window.orderBy("block", "idx"))).filter("idx = 0")
    first = {r.block: (r.lcp, r.d) for r in edges.select("block", "edge", "before", "cum").mapInArrow(_firsts, "block long, lcp long, d long").collect()}
    nodes, names = tree(rows, first)
    named = nodes.join(names.toDF("pb", "pi", "above"), ["pb", "pi"], "left")
    full = named.join(rows.select("block", "idx", "len", "cum", "total", "ends"), ["block", "idx"])
    before = lambda d: F.coalesce(F.try_element_at("cum", F.nullif(F.greatest(d - 1, F.lit(0)), F.lit(0)).cast("int")), F.lit(0))
    depths = F.transform(F.sequence(F.col("u") + 1, F.col("v")), lambda d: F.struct(d.alias("depth"), before(d).alias("c")))
    out = each(full, depths, "x", *NODE[2:4], "u", "above", "len", F.col("total"), "ends", *SUMS)
    depth, own = F.col("x.depth"), F.col("x.depth") == F.col("v")
    saved = F.col("w") - F.col("n") * F.col("x.c") - (F.col("d") + F.col("total") - F.col("x.c"))
    return out.select(
        F.col("least").alias("conv_id"),
        depth.alias("depth"),
        F.when(depth == 0, F.lit(None)).when(depth > F.col("u") + 1, F.col("least")).otherwise(F.col("above")).cast("long").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(~own, 1).when(F.col("k") < 0, 0).otherwise(F.col("k") + 1 - (F.col("len") == F.col("v")).cast("long")).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        saved.alias("saved_tokens"),
        F.when(own & (F.col("len") == F.col("v")), F.col("ends")).otherwise(NONE).alias("ends_sha256"),
    )


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


by_value(__name__)
