"""Brute-force counterparts of the conversation trie, the Jaccard join and the spelling groups, at small block and list sizes."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_operators import VOCAB, words

from riskloom.llm import conversation_trie, jaccard, spelling

CONV = "conv_id long, turn long, role string, text string, conv_id_ string, n long"
DOCS = "doc_id long, text string, source string, component_id string, `a.b` int"
lower = lambda t: re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


# -- conversation trie -------------------------------------------------------------------------------------------------


def brute_trie(rows):
    own = defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [y[2:] for y in sorted(s, key=lambda y: y[:2])] for c, s in own.items()}
    full = {}
    for c, s in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + s[h:])
    nodes = defaultdict(list)
    for c, s in full.items():
        for d in range(len(s) + 1):
            nodes[s[:d]].append(c)
    kids = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(members) - 1) * (len(p[-1][1]) if p else 0)
    sha = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(nodes[p]) if len(full[c]) == len(p)).encode()).hexdigest()
    return sorted(((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], sha(p)) for p, m in nodes.items()), key=str)


def talk(seed, convs=150, long=0):
    r = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(r.choice((0, 1, 2, 4, 7))):
            rows.append((c, t, r.choice("ua"), r.choice(("hi", "", "ä long one", "x" * 50)), "mine", 1))
    rows += [(1000, t, "u", f"turn {t}", None, None) for t in range(long)] + [(1001, t, "u", f"turn {t}", None, None) for t in range(long)]
    rows += [(2000 + i, 0, "u", "the same", None, 1) for i in range(40)]  # copies
    rows += [(3000, None, None, None, None, 1), (3000, None, None, None, None, 1), (3000, 4, "u", "z", None, 1), (None, 1, "u", "nobody's", None, 1), (-7, 1, "u", "hi", None, 1)]
    return rows


@pytest.mark.parametrize(("seed", "block", "long"), [(1, 1, 0), (2, 3, 300), (3, 17, 5), (4, 10_000, 0)])
def test_trie_matches_brute_force(spark, seed, block, long):
    rows = talk(seed, long=long)
    got = conversation_trie.prefix_trie(spark.createDataFrame(rows, CONV).repartition(3), block).collect()
    assert sorted((tuple(x) for x in got), key=str) == brute_trie(rows)


def test_trie_of_few_conversations(spark):
    for rows in ([], [(5, 0, "u", "only")], [(5, 0, "u", "a"), (6, 0, "u", "a")], [(1, 0, "u", "x"), (2, 0, "u", "x"), (2, 1, "a", "y")]):
        got = conversation_trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), 1).collect()
        assert sorted((tuple(x) for x in got), key=str) == brute_trie(rows)


def test_nearest_smaller():
    r = random.Random(5)
    for _ in range(50):
        x = [r.randint(0, 4) for _ in range(r.randint(1, 30))]
        left, right = conversation_trie.nearest_smaller(x)
        assert left == [max((j for j in range(i) if x[j] < x[i]), default=-1) for i in range(len(x))]
        assert right == [min((j for j in range(i + 1, len(x)) if x[j] < x[i]), default=len(x)) for i in range(len(x))]


# -- Jaccard join ------------------------------------------------------------------------------------------------------


def shingles(t):
    w = words(lower(t))
    return {tuple(w)} if 0 < len(w) < 4 else {tuple(w[i : i + 4]) for i in range(len(w) - 3)}


def brute_similar(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    at = list(range(len(rows)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                at[root(i)] = root(j)
    least = {}
    for i, x in enumerate(rows):
        least.setdefault(root(i), []).append(x[0])
    return Counter((x[0], x[1], len(sets[i]), min((c for c in least[root(i)] if c is not None), default=None)) for i, x in enumerate(rows))


def near_copies(seed):
    """Near copies, exact copies, a passage that many share, crowds of near copies that are linked in chains, and odd rows."""
    r = random.Random(seed)
    new = lambda n: [f"{r.choice(VOCAB)}{r.randint(0, 40)}" for _ in range(n)]
    rows = [(i, " ".join(new(r.choice((3, 8, 40, 150)))), "s", "mine", i) for i in range(60)]
    passage, base = new(60), new(120)
    rows += [(100 + i, " ".join([*new(r.choice((2, 4, 40))), *passage, *new(r.choice((1, 3, 30)))]), "s", "mine", i) for i in range(40)]
    for i in range(40):
        w = list(base)
        for _ in range(r.choice((0, 1, 2, 4, 6))):
            w[r.randint(0, len(w) - 1)] = "edit" + str(r.randint(0, 9))
        rows.append((200 + i, " ".join(w).upper() if i % 3 else "  ".join(w), "s", "mine", i))
    rows += [(300, rows[3][1], "s", "mine", 1), (None, rows[3][1], "s", None, 1), (None, "alone here with nobody", "s", None, 1), (301, None, None, None, None), (302, "", None, None, None), (303, " \n", None, None, None), (304, "One two", "s", "m", 1), (305, "one TWO", "s", "m", 1), (305, "one TWO", "s", "m", 1), (306, " ".join(new(20_000)), "s", "m", 1)]
    return rows


@pytest.mark.parametrize(("seed", "short", "block"), [(1, 64, 1000), (2, 2, 3), (3, 4, 1000), (4, 8, 7)])
def test_similar_matches_brute_force(spark, seed, short, block):
    rows = near_copies(seed)
    out = jaccard.similar(spark.createDataFrame(rows, DOCS).repartition(3), short=short, block=block)
    assert out.columns == ["doc_id", "text", "source", "a.b", "n_shingles", "component_id"]
    assert Counter((x.doc_id, x.text, x.n_shingles, x.component_id) for x in out.collect()) == brute_similar(rows)


def test_similar_of_no_rows(spark):
    assert jaccard.similar(spark.createDataFrame([], DOCS)).count() == 0


def test_divide_skip_finds_what_counting_finds():
    r = np.random.default_rng(3)
    for _ in range(40):
        sets = [np.unique(r.integers(0, 60, r.integers(1, 50))) for _ in range(20)]
        index, owner = np.concatenate(sets), np.repeat(np.arange(20), [len(s) for s in sets])
        order = np.lexsort((owner, index))
        q = np.unique(r.integers(0, 60, 30))
        for least in (1, 5, 12, len(q)):
            want = [i for i, s in enumerate(sets) if len(np.intersect1d(s, q)) >= least]
            assert sorted(jaccard.divide_skip(index[order], owner[order], q, least)) == want


# -- spelling ----------------------------------------------------------------------------------------------------------


def brute_words(rows, least=5):
    n = Counter()
    for doc_id, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= least}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_spelling(rows):
    n = brute_words(rows)
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def last(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], last(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def spelled_rows(seed):
    r = random.Random(seed)
    stems = ["colour", "Center", "straße", "naïveté", "aaaaaa", "accommodate", "übermut", "x" * 12]
    rows = []
    for i in range(300):
        out = []
        for _ in range(r.choice((0, 5, 60))):
            w = list(r.choice(stems) if r.random() < 0.8 else r.choice(("colours", "colourss", "coloursss")))
            for _ in range(r.choice((0, 0, 0, 1, 1, 2))):
                p, k = r.randrange(len(w)), r.random()
                w[p : p + 1] = [w[p], r.choice("abé")] if k < 0.3 else [] if k < 0.6 else [r.choice("abÉ")]
            out.append("".join(w))
        rows.append((i, r.choice((" ", "-", "\n")).join(out), "s", None, None))
    chain = ["rooted", "rootedx", "rootedxy"]
    rows += [(900, " ".join(w for w, k in zip(chain, (500, 60, 7), strict=True) for _ in range(k)), "s", None, None), (None, "colour " * 30, None, None, None), (901, None, None, None, None), (902, "", None, None, None), (1, rows[5][1], "s", None, None)]
    return rows


@pytest.mark.parametrize("most", [3, 20_000])
def test_spelling_matches_brute_force(spark, most):
    rows = spelled_rows(most)
    got = spelling.variants(spark.createDataFrame(rows, DOCS).repartition(4), most=most).collect()
    assert {(x.word, x.form, x.root, x.n, x.n_near, x.form_n) for x in got} == brute_spelling(rows) and len(got) == len(brute_words(rows))
    assert any(x.root != x.form for x in got if x.form) and max(x.n_near for x in got) > 3


def test_spelling_of_no_words(spark):
    assert spelling.variants(spark.createDataFrame([], DOCS)).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, "one two", "s", "", 1)], DOCS)).count() == 0


def test_the_trie_walk_lists_each_pair_once():
    r = random.Random(8)
    ws = list({"".join(r.choice("ab") for _ in range(r.randint(1, 7))) for _ in range(120)})
    got = [tuple(sorted((ws[i], ws[j]))) for i, j in spelling.trie_pairs(ws)]
    want = {tuple(sorted((a, b))) for a in ws for b in ws if a < b and one_apart(a, b)}
    assert len(got) == len(set(got)) and set(got) == want
