"""Brute-force counterparts and edge cases of the training-data operators."""

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from riskloom.llm import components, decontamination, line_dedup, lm_scoring, mixing, quality, sharding, simhash, token_counts, toxicity, urls

VOCAB = [f"w{i}" for i in range(60)]
PAGES = "page_id long, url string, html string"
SCHEMA = "doc_id long, text string, source string"


def corpus(n=120, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        text = " ".join(r.choice(VOCAB) for _ in range(r.choice((5, 20, 80))))
        rows.append((i, text, f"s{i % 4}"))
    rows += [(n, rows[0][1], "s0"), (n + 1, None, None), (n + 2, "", "s1"), (n + 3, " \n\t ", "s1"), (None, "null id", "s2"), (n + 4, rows[3][1], None), (n + 4, rows[3][1], None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# -- decontamination ----------------------------------------------------------------------------------------------


def brute_contamination(rows, bench, span=13):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    windows = {}
    for item, t in bench:
        w = split(t)
        n = min(span, len(w))
        for i in range(len(w) - n + 1) if w else ():
            windows.setdefault((n, *w[i : i + n]), set()).add(str(item))
    out = []
    for doc_id, t, *_ in rows:
        w, hit, items = split(t), set(), set()
        for n in {k[0] for k in windows}:
            for i in range(len(w) - n + 1):
                if found := windows.get((n, *w[i : i + n])):
                    hit |= set(range(i, i + n))
                    items |= found
        out.append((doc_id, len(w), len(hit), sorted(items), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def test_decontamination_matches_brute_force(spark):
    r = random.Random(3)
    text = lambda n: " ".join(r.choice(VOCAB) for _ in range(n))
    bench = [(i, text(r.choice((20, 40, 13, 14)))) for i in range(12)] + [(90, "Alpha, beta!"), (91, "solo"), (92, ""), (93, None)]
    rows = [(i, text(300), "s") for i in range(20)]
    for i in range(20, 50):
        w, b = text(60).split(), r.choice(bench[:12])[1].split()
        cut = r.randint(5, len(b))
        at = r.randint(0, 50)
        rows.append((i, " ".join([*w[:at], *b[:cut], *w[at:]]).upper() if i % 2 else ", ".join([*w[:at], *b[-cut:], *w[at:]]), "s"))
    rows += [(60, "ALPHA-BETA solo", "s"), (61, None, None), (62, "", None), (62, bench[0][1], None), (None, bench[0][1], None)]
    got = decontamination.contamination(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(bench, "item_id int, text string")).collect()
    key = lambda x: (str(x[0]), x[1:])
    assert sorted([(g.doc_id, g.n_words, g.n_hit, g["items"] or [], g.contaminated) for g in got], key=key) == sorted(brute_contamination(rows, bench), key=key)


def test_decontamination_of_empty_tables(spark, docs, empty):
    none = spark.createDataFrame([], "item_id int, text string")
    assert decontamination.contamination(empty, none).count() == 0
    assert decontamination.contamination(docs, none).filter("contaminated or n_hit > 0").count() == 0


# -- simhash --------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    w = words(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if hs and sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(fps, radius=3):
    todo, out = list(range(len(fps))), list(range(len(fps)))

    def root(i):
        while out[i] != i:
            i = out[i]
        return i

    for i in todo:
        for j in todo[:i]:
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = sorted((root(i), root(j)))
                out[b] = a
    return [root(i) for i in todo]


def test_simhash_matches_brute_force(spark):
    rows = [r for r in corpus() if r[0] is not None]
    rows += [(1000 + i, rows[2][1] + " " + VOCAB[i], "s") for i in range(20)] + [(2000, "One TWO", "s"), (2001, "one two", "s")]
    out = {(r.doc_id, r.fp & (2**64 - 1)): r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    least = {}
    for (i, _, _), c in zip(rows, brute_components(fps), strict=True):
        least[c] = min(i, least.get(c, i))
    assert out == {(i, f): least[c] for (i, _, _), f, c in zip(rows, fps, brute_components(fps), strict=True)}


@pytest.mark.parametrize("pairs_up_to", [16, 256])
def test_crowded_fingerprints_link_exactly(spark, pairs_up_to, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRS_UP_TO", pairs_up_to)
    r, fps = random.Random(9), set()
    for _ in range(3):
        centre = r.getrandbits(64)
        for _ in range(150):
            x = centre
            for b in r.sample(range(30), r.randint(0, 4)):
                x ^= 1 << b
            fps.add(x)
    fps |= {r.getrandbits(64) for _ in range(50)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"))
    of = {x.node: x.root for x in components.components(edges).collect()}
    groups = lambda roots: sorted(sorted(s for s, c in zip(signed, roots, strict=True) if c == k) for k in set(roots))
    assert groups([of.get(s, s) for s in signed]) == groups(brute_components(fps))
    for e in edges.collect():
        assert bin((e.a ^ e.b) & (2**64 - 1)).count("1") <= 3


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    assert {(r.node, r.root) for r in components.components(edges).collect()} == {(i, 0) for i in range(61)} | {(100, 100), (101, 100)}


def test_one_of_each_keeps_whole_rows(spark, docs, empty):
    out = simhash.one_of_each(docs).collect()
    texts = [r.text for r in out]
    assert sum(not words(t) for t in texts) == 1 and len({brute_fingerprint(t) for t in texts}) == len(texts)
    assert simhash.one_of_each(empty).count() == 0


def test_one_of_each_of_null_ids_and_clashing_names(spark):
    a, b = corpus()[2][1], " ".join(reversed(corpus()[2][1].split()))
    rows = [(None, a, "x"), (None, a, "y"), (None, b, "x"), (None, b, "y"), (3, "one two three", "z"), (3, "one two three", "z"), (4, "one two three", "z"), (5, None, "n"), (6, "", "n")]
    d = spark.createDataFrame(rows, "doc_id long, text string, fp string").selectExpr("*", "1 AS linked", "'q' AS root", "2L AS component_id", "true AS alone", "'r' AS r_id", "0 AS own_0", "7 AS `a.b`")
    out = simhash.one_of_each(d).collect()
    assert sorted(str(r.text) for r in out) == sorted(map(str, (a, b, "one two three", None))) and simhash.one_of_each(d).columns == d.columns
    assert all((r.linked, r.root, r.component_id, r["a.b"]) == (1, "q", 2, 7) for r in out) and {r.doc_id for r in out} == {None, 3, 5}


# -- line dedup -------------------------------------------------------------------------------------------------------


def test_line_dedup_drops_what_a_host_repeats(spark):
    rows = [(i, f"https://A.example.org/{i}?q", f"<nav>menu</nav><p>only {i}</p><p>twice {i // 2}</p>") for i in range(20)]
    rows += [(100 + i, f"http://b.example/{i}", "<p>menu</p>") for i in range(3)] + [(200, None, None), (None, "no scheme", "<p>menu</p>")]
    out = {r.page_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "page_id long, url string, html string"), 0.3, 10).collect()}
    assert all(out[i].text == f"only {i}\ntwice {i // 2}" and (out[i].n_lines, out[i].n_dropped) == (3, 1) for i in range(20))
    assert out[0].host == "a.example.org" and out[101].text == "menu" and out[None].host == "" and out[200].n_lines == 0


def test_line_dedup_cleans_small_hosts(spark, tmp_path):
    rows = [(100 * n + i, f"http://h{n}.example/{i}", f"<nav>menu</nav><p>only {i}</p>") for n in (1, 2, 3, 4, 9, 10) for i in range(n)]
    # on two pages of four, and of nine
    rows += [(900 + i, f"http://pair{n}.example/{i}", f"<p>only {i}</p>" + "<p>pair</p>" * (i % n < 2)) for n, at in ((4, 0), (9, 4)) for i in range(at, at + n)]
    spark.createDataFrame([(k, u, h) for k, (_, u, h) in enumerate(rows)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    out = line_dedup.op3_line_dedup(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    dropped = Counter()
    for r in out:
        dropped[r.host] += r.n_dropped
    assert dropped == {"h1.example": 0} | {f"h{n}.example": n for n in (2, 3, 4, 9, 10)} | {"pair4.example": 2, "pair9.example": 0}


@pytest.mark.parametrize("bound", [0, line_dedup.sized.__defaults__[0]])
def test_line_dedup_of_a_hot_host_matches_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(line_dedup.sized, "__defaults__", (bound,))
    r = random.Random(4)
    rows = [(i, f"http://{'hot' if r.random() < 0.6 else f'h{r.randrange(9)}'}.example/{i}", "".join(f"<p>{r.choice('abcdefgh') * 3}</p>" for _ in range(r.randint(0, 6))) + f"<div>own {i}</div>") for i in range(300)]
    lines = {i: [x for x in re.split(r"</?(?:p|div)>", h) if x] for i, _, h in rows}
    host = {i: u.split("/")[2] for i, u, _ in rows}
    pages, holds = Counter(host.values()), Counter((host[i], x) for i in lines for x in set(lines[i]))
    bad = {k for k, n in holds.items() if n >= 2 and n > 0.3 * pages[k[0]]}
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, PAGES)).collect()
    assert len(out) == 300 and {r.page_id: r.text for r in out} == {i: "\n".join(x for x in lines[i] if (host[i], x) not in bad) for i in lines}


# -- language model ---------------------------------------------------------------------------------------------------


def brute_scores(rows, alpha=0.4):
    split = [words(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t, *_ in rows]
    uni, pair = Counter(), Counter()
    for w in split:
        uni.update(w)
        pair.update(zip(w, w[1:], strict=False))
    out = []
    for w in split:
        own, own_pair, s, back = Counter(w), Counter(zip(w, w[1:], strict=False)), 0.0, 0
        alone = lambda b, own=own: max(uni[b] - own[b], alpha) / uni.total()
        if w:
            s += math.log10(alone(w[0]))
        for a, b in zip(w, w[1:], strict=False):
            n = pair[a, b] - own_pair[a, b]
            back += not n
            s += math.log10(n / (uni[a] - own[a]) if n else alpha * alone(b))
        out.append((len(w), back, s))
    return out


@pytest.mark.parametrize("codes, bucket", [(lm_scoring.CODES, 500), (8, 500), (8, 40), (lm_scoring.CODES, 10**6)])
def test_lm_scores_match_brute_force(spark, docs, empty, codes, bucket, monkeypatch):
    monkeypatch.setattr(lm_scoring, "CODES", codes)
    monkeypatch.setattr(lm_scoring, "START", codes)
    monkeypatch.setattr(lm_scoring, "UNCODED", codes + 1)
    monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", 3000)
    rows = [*corpus(), (7000, "W1 w2 \u00c9t\u00e9 w2 w2\x0bw1 " + "long" * 30 + " " + "long" * 30 + "x", "s"), (7001, "nowhere else w1 " + "w2 " * 400, "s"), (7002, "w2 " * 400, "s")]
    key = lambda x: (-1 if x[0] is None else x[0], x[1:])
    want = sorted(((i, n, back, s / n if n else 0.0) for (i, *_), (n, back, s) in zip(rows, brute_scores(rows), strict=True)), key=key)
    got = lm_scoring.lm_scores(spark.createDataFrame(rows, SCHEMA).repartition(3), pairs_a_bucket=bucket).collect()
    assert all((r.lm_score is None) == (r.n_words == 0) for r in got)
    got = sorted(((r.doc_id, r.n_words, r.n_backoff, r.lm_score or 0.0) for r in got), key=key)
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-6)
    assert lm_scoring.lm_scores(empty).count() == 0


def test_lm_scores_stand_when_files_are_split_otherwise(spark, tmp_path):
    rows = [r for r in corpus(400) if r[0] is not None]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/d")
    key, want = (lambda r: (r.doc_id, str(r))), lm_scoring.lm_scores(spark.createDataFrame(rows, SCHEMA)).collect()
    try:
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        out = lm_scoring.lm_scores(spark.read.parquet(f"{tmp_path}/d"))
        spark.conf.set("spark.sql.files.minPartitionNum", "7")
        assert sorted(out.collect(), key=key) == sorted(want, key=key)
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_what_is_broadcast_needs_no_class_of_the_library(spark):
    import pickle

    known = lm_scoring.Known([(3, 4), (1, 2)], 6, 0.4)
    sent = pickle.dumps(tuple(vars(known).items()))
    assert b"riskloom" not in sent and vars(lm_scoring.Known.of(pickle.loads(sent))).keys() == vars(known).keys()


def test_lm_scores_of_string_ids_and_clashing_columns(spark):
    d = spark.createDataFrame([("a", "x y z", 1, "q"), ("a", "x y z", 2, "q"), (None, None, 3, "q")], "doc_id string, text string, doc int, h string")
    out = sorted(lm_scoring.lm_scores(d).collect(), key=lambda r: r.doc_id or "")
    assert [(r.doc_id, r.n_words, r.n_backoff) for r in out] == [(None, 0, 0), ("a", 3, 0), ("a", 3, 0)]


def test_word_hashes_follow_the_words():
    r = random.Random(3)
    texts = [None, "", " ", "a", "a b", "ab\tAB\x0b\u00e9\u3000x", " lead", "trail ", *(" ".join("".join(r.choice("abcXYZ\u00e9") for _ in range(r.randint(1, 90))) for _ in range(30)) for _ in range(20))]
    h, doc = lm_scoring.hashed_words(lm_scoring.pa.array(["skipped words", *texts]).slice(1))
    want = [(i, re.sub("[A-Z]", lambda m: m[0].lower(), w)) for i, t in enumerate(texts) for w in words(t)]
    assert doc.tolist() == [i for i, _ in want]
    of = {}
    for (_, w), x in zip(want, h.tolist(), strict=True):
        assert of.setdefault(w, x) == x
    assert len(set(of.values())) == len(of) > 300


# -- toxicity -----------------------------------------------------------------------------------------------------------


def test_network_gradients_match_finite_differences():
    net = toxicity.Net(1)
    r = np.random.default_rng(0)
    x, mask = r.normal(size=(5, 3, 6 * toxicity.HIDDEN)), np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 1, 0], [1, 0, 0]], bool)
    for k in net.p:
        net.p[k] = net.p[k].astype(float)
    x = x.astype(np.float32)
    weight = np.array([0.3, -1.0, 0.7], np.float32)
    f = lambda: float((net.run(x, mask) * weight).sum())
    _, kept = net.run(x, mask, keep=True)
    g, dx = net.back(weight, kept)
    for k in ("uf", "ub", "wa", "va", "wo", "ba"):
        at = tuple(r.integers(s) for s in net.p[k].shape)
        net.p[k][at] += 1e-2
        up = f()
        net.p[k][at] -= 2e-2
        down = f()
        net.p[k][at] += 1e-2
        assert abs((up - down) / 2e-2 - g[k][at]) < 2e-3, k
    x[1, 0, 3] += 1e-2
    up = f()
    x[1, 0, 3] -= 2e-2
    assert abs((up - f()) / 2e-2 - dx[1, 0, 3]) < 2e-3


def test_toxicity_learns_and_scores_whole_texts(spark):
    r = random.Random(5)
    plain = lambda n: " ".join("".join(r.choice(("th", "er", "on", "re", "an", "ha")) for _ in range(3)) for _ in range(n))
    rows = [(plain(60) if i % 2 else plain(30) + " vilgar" + r.choice(("a", "o", "en")) + " " + plain(30), 1 - i % 2) for i in range(400)]
    net = toxicity.Net().fit([t for t, _ in rows], [y for _, y in rows], epochs=8)
    tests = [(1, plain(5000) + " vilgaras " + plain(5000)), (2, plain(3000)), (3, None), (4, ""), (5, "VILGARO!!")]
    out = {x.doc_id: x.score for x in toxicity.toxicity(spark.createDataFrame(tests, "doc_id long, text string"), net).collect()}
    assert out[1] >= 0.5 > out[2] and out[3] == out[4] == 0.0 and out[5] > 0.5
    assert list(toxicity.windows(33)) == [0, 16] and list(toxicity.windows(32)) == [0] and list(toxicity.windows(1)) == [0]


def slow_score(net, text):
    """The network word by word and unit by unit."""
    p, h = {k: v.astype(float).tolist() for k, v in net.p.items() if k not in ("word", "char")}, toxicity.HIDDEN
    sig = lambda x: 1 / (1 + math.exp(-x))
    ws = toxicity.tokens(text)
    best = None
    for at in toxicity.windows(len(ws)):
        xs = []
        for w in ws[at : at + toxicity.WINDOW]:
            word, char, _ = toxicity.word_inputs([w])
            v, n = np.zeros(toxicity.DIM), 0
            for row in char.tolist():
                for c in row:
                    if c < toxicity.CHAR_ROWS:
                        v, n = v + net.p["char"][c], n + 1
            v = v / math.sqrt(max(n, 1)) + net.p["word"][word[0]]
            xs.append([sum(v[i] * p["wx"][i][j] for i in range(toxicity.DIM)) + p["bx"][j] for j in range(6 * h)])
        both = []
        for d, u in ((0, p["uf"]), (1, p["ub"])):
            state, out = [0.0] * h, {}
            for t in range(len(xs)) if d == 0 else reversed(range(len(xs))):
                x = xs[t][3 * h * d : 3 * h * (d + 1)]
                g = [sum(state[i] * u[i][j] for i in range(h)) for j in range(3 * h)]
                z, r = [sig(x[j] + g[j]) for j in range(h)], [sig(x[h + j] + g[h + j]) for j in range(h)]
                new = [math.tanh(x[2 * h + j] + r[j] * g[2 * h + j]) for j in range(h)]
                state = [(1 - z[j]) * new[j] + z[j] * state[j] for j in range(h)]
                out[t] = state
            both.append(out)
        hs = [both[0][t] + both[1][t] for t in range(len(xs))]
        say = [sum(math.tanh(sum(x[i] * p["wa"][i][k] for i in range(2 * h)) + p["ba"][k]) * p["va"][k] for k in range(toxicity.ATTENTION)) for x in hs]
        e = [math.exp(v - max(say)) for v in say]
        pooled = [sum(e[t] * hs[t][i] for t in range(len(hs))) / sum(e) for i in range(2 * h)]
        logit = sum(a * b for a, b in zip(pooled, p["wo"], strict=True)) + p["bo"][0]
        best = logit if best is None else max(best, logit)
    return 0.0 if best is None else sig(best)


@pytest.fixture(scope="module")
def toxic_tables(spark, tmp_path_factory):
    r = random.Random(12)
    plain = lambda n: " ".join("".join(r.choice(("th", "er", "on", "re", "an", "ha")) for _ in range(3)) for _ in range(n))
    docs = [(i, plain(r.choice((5, 40, 400))) + (" you vilgar scumlet " + plain(20) if i % 4 == 0 else "")) for i in range(400)] + [(900, None), (901, ""), (902, " \n"), (None, "null id"), (4, "the id twice"), (903, plain(4000) + " vilgar scumlet " + plain(4000))]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(400) if i % 3] + [(7, 1, 0), (7, 0, 0), (None, 1, 1), (8, None, None), (5000, 1, 1)]
    d = tmp_path_factory.mktemp("toxic")
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d), docs


def test_toxicity_query_matches_a_slow_network(spark, toxic_tables, monkeypatch):
    d, docs = toxic_tables
    net = toxicity.trained(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    monkeypatch.setattr(toxicity, "trained", lambda docs, labels: net)
    out = toxicity.op5_toxicity(spark, d).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(i) for i, _ in docs) and out[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"}
    text = {i: t for i, t in docs if i not in (4, None)}
    for r in out:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5)
        if r.doc_id in text and (r.doc_id % 40 == 0 or 900 <= r.doc_id < 903):
            assert abs(r.score - slow_score(net, text[r.doc_id])) < 1e-4
    held = [(r.predicted, r.doc_id % 4 == 0) for r in out if r.held_out and r.doc_id < 400]
    assert sum(p for p, y in held if y) >= 0.9 * sum(y for _, y in held) and sum(p for p, y in held if not y) <= 1
    assert next(r.predicted for r in out if r.doc_id == 903) == 1


def test_inputs_of_a_word_don_t_depend_on_its_neighbours():
    ws = [b"a", b"scum", b"vilgar", b"scumlet", b"x" * 40, b"scum"]
    word, char, starts = toxicity.word_inputs(ws)
    for i, w in enumerate(ws):
        alone, grams, _ = toxicity.word_inputs([w])
        assert word[i] == alone[0] and (char[starts[i] : starts[i] + len(w) + 2] == grams).all()
    assert word[1] == word[5] and len(set(word.tolist())) == 5


def test_toxicity_scores_many_texts_in_little_memory():
    r = random.Random(8)
    texts = [" ".join("".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(500)) for _ in range(700)]
    score = toxicity.Net().scorer()
    score(texts[:1])
    tracemalloc.start()
    many = score(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 35e6
    assert np.allclose(many, [x for t in texts for x in score([t])], atol=1e-6)


def test_toxicity_sample_is_bounded_and_never_held_out(spark, toxic_tables):
    d, docs = toxic_tables
    tables = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    texts, classes = toxicity.labelled_sample(*tables)
    learnt = {t for i, t in docs if i is not None and t is not None and zlib.crc32(str(i).encode()) % 5}
    assert set(texts) <= learnt and 50 < sum(classes) < len(classes) - 50
    few = toxicity.labelled_sample(*tables, per_class=7)
    assert sum(few[1]) == 7 and len(few[1]) == 14
    small = toxicity.labelled_sample(*tables, most_bytes=4000)
    for c in (0, 1):
        assert 0 < sum(len(t.encode()) for t, y in zip(*small, strict=True) if y == c) <= 4000
    none = spark.createDataFrame([], "doc_id long, toxic int")
    net = toxicity.trained(tables[0], none)
    assert toxicity.toxicity(tables[0], net).filter("score >= 0.5").count() == 0


# -- token counts --------------------------------------------------------------------------------------------------------


def test_histogram_answers_every_limit(spark, docs, empty):
    count = token_counts.counter(token_counts.read_vocabulary(token_counts.VOCABULARY))
    n = count([t for _, t, _ in corpus()])
    h = token_counts.length_histogram(docs.select(token_counts.token_count(spark)("text").alias("n")), token_counts.F.col("n"))
    for r in h.collect():
        assert r.n_docs == n.count(r.length) and r.n_at_least == sum(x >= r.length for x in n) and r.tokens_at_least == sum(x for x in n if x >= r.length)
        assert r.truncated_total == sum(min(x, r.length) for x in n) and r.tokens_total == sum(n)
    for r in token_counts.at_limits(h, (10, 50)).collect():
        assert (r.n_longer, r.tokens_kept) == (sum(x > r.limit for x in n), sum(min(x, r.limit) for x in n))
    assert token_counts.quantile(h, 0.5) == sorted(n)[math.ceil(len(n) / 2) - 1]
    named = {float(q): r.length for r in h.collect() for q in r.quantiles.split(",") if q}
    assert named == {q: sorted(n)[max(0, math.ceil(q * len(n)) - 1)] for q in token_counts.QUANTILES}
    assert token_counts.length_histogram(empty.selectExpr("doc_id AS n"), token_counts.F.col("n")).count() == 0


def slow_tokens(text, ranks):
    """Byte pairs merged one at a time, the least rank first."""
    regex = pytest.importorskip("regex")
    n = 0
    for piece in regex.findall(token_counts.PATTERN, text or ""):
        parts = [bytes([b]) for b in piece.encode()]
        while len(parts) > 1:
            rank, at = min((ranks.get(parts[i] + parts[i + 1], math.inf), i) for i in range(len(parts) - 1))
            if rank == math.inf:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        n += len(parts)
    return n


def test_token_query_matches_a_slow_encoder(spark, tmp_path):
    texts = [t for _, t, _ in corpus(30)] + ["It's  a \n\n tab\there, don't 123,456!! \u00e9t\u00e9 \u4f60\u597d \U0001f600", "a" + " " * 1500 + "b", "x\u3000" + "\n" * 1200, " " * 1100, "\t" * 1001 + " word", "a" * 300]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    n = [slow_tokens(t, token_counts.read_vocabulary(token_counts.VOCABULARY)) for t in texts]
    out = token_counts.op6_token_counts(spark, str(tmp_path)).collect()
    assert {r.length: r.n_docs for r in out} == {x: n.count(x) for x in (*n, *token_counts.LIMITS)}
    for r in out:
        assert (r.n_at_least, r.tokens_at_least, r.truncated_total, r.n_total, r.tokens_total) == (sum(x >= r.length for x in n), sum(x for x in n if x >= r.length), sum(min(x, r.length) for x in n), len(n), sum(n))


def test_very_long_runs_are_counted(spark):
    rows = [(i, c * 1_000_000 + "x") for i, c in enumerate((" ", "\n", "a", "-", "1"))] + [(9, "b" + " " * 1_000_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r.n > 1 for r in d.select(token_counts.token_count(spark)("text").alias("n")).collect())


# -- URLs -------------------------------------------------------------------------------------------------------------------


def made_pages(n, seed=8):
    """Pages on plain and hyphenated hosts; which of them the rules cover has nothing to do with the hyphens."""
    r = random.Random(seed)
    name = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    hosts = [f"{r.choice(('', 'www.', 'm.'))}{name()}{r.choice(('', '', '-' + name()))}.example.{('net', 'com', 'org', 'info')[k % 4]}" for k in range(60)]
    return [(i, f"https://{r.choice(hosts)}/{r.choice(('en', 'en', 'de', 'fr'))}/{r.randint(1, 9999)}{r.choice(('', '?page=2&ref=x', '#top'))}", "") for i in range(n)]


def test_url_rules_of_odd_urls(spark):
    urls_ = ["https://x.Example.NET/en/1", "http://example.net/fr/1", "https://m.example.com/de/", "http://a.org/fr/x?y", "http://notexample.org.uk/fr/", None, "plain text", "http://", "https://host?x://y", "", "ftp://É.NET/\n", "x" * 100_000]
    rows = list(enumerate(urls_)) + [(0, urls_[0]), (None, urls_[1])]
    pages = spark.createDataFrame([(i, u, 1, "mine") for i, u in rows], "page_id long, url string, u_out int, Verdict string")
    out = [r for _, r in sorted(((-1 if r.page_id is None else r.page_id, r) for r in urls.judge_urls(pages).collect()), key=lambda x: x[0])][1:]
    assert len(out) == len(rows) - 1 and out[0] == out[1] and out.pop(0)
    assert [r.rule for r in out[:5]] == ["example.net/en/", "net/", "example.com/de/", "org/fr/", None] and {r.u_out for r in out} == {1}
    assert [r.verdict for r in out[:4]] == ["allow", "block", "block", "allow"]
    assert (out[0].host, out[0].path) == ("x.example.net", "/en/1") and all((r.host, r.path) == ("", "") for r in (*out[5:8], out[9])) and (out[8].host, out[8].path) == ("host", "")
    assert urls.judge_urls(spark.createDataFrame([], PAGES)).count() == 0


def test_url_query_matches_brute_force(spark, tmp_path):
    rows = [*made_pages(3000), (9000, None, None), (9001, "no scheme", ""), (9002, "http://q.biz/de/1", "")]
    spark.createDataFrame(rows, PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    seen = {u for _, u, _ in rows if u and "://" in u}
    truth = {u: int((urls.rule_for(*urls.split_url(u)[:2]) or ("", "allow"))[1] == "block") for u in seen}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    h = lambda s, seed=42: xxhash.xxh64_intdigest(s.encode(), seed)
    # the hash of the host seeds that of the number 17, four bytes
    held = lambda u: signed(xxhash.xxh64_intdigest((17).to_bytes(4, "little"), h(urls.split_url(u)[0]))) % urls.HELD_OUT == 0
    learn = [(u, c) for c in (0, 1) for u in sorted((u for u in seen if not held(u) and truth[u] == c), key=lambda u: signed(h(u)))[: urls.PER_CLASS]]
    model = urls.Trees.fit([u for u, _ in learn], [c for _, c in learn])
    out = urls.op7_urls(spark, str(tmp_path)).collect()
    assert sorted(r.page_id for r in out) == sorted(i for i, _, _ in rows)
    of = {i: u for i, u, _ in rows}
    score = dict(zip(of, model.score(list(of.values())), strict=True))
    for r in out:
        host, path, _ = urls.split_url(of[r.page_id])
        rule = urls.rule_for(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[0]) and abs(r.block_score - score[r.page_id]) < 1e-9
        assert r.verdict == (rule[1] if rule else "block" if score[r.page_id] > 0.5 else "allow")


def test_trees_learn_from_several_features_and_hold_on_unseen_hosts(spark):
    pages = spark.createDataFrame(made_pages(4000), PAGES)
    model = urls.trained(pages)
    assert sum(g > 0 for g in model.gains.values()) >= 4 and model.gains["hyphens"] < 0.2 * sum(model.gains.values())
    held = urls.labelled(pages).filter(urls.is_held_out(urls.F.col("host"))).collect()
    guess, label = model.score([r.url for r in held]) > 0.5, np.array([r.label for r in held], bool)
    assert len(held) > 200 and (guess & label).sum() >= 0.9 * label.sum() and (guess & label).sum() >= 0.9 * guess.sum()
    # what no rule blocks stays, hyphens or not
    plain = ["https://new-york.example.com/en/1", "https://jean-paul.example.org/fr/3", "https://newyork.example.com/en/1", "https://st-petersburg-museum.example.org/en/2"]
    assert (model.score(plain) < 0.5).all() and model.score(["https://new-york.sample.net/fr/1"])[0] > 0.5


def test_url_parts_agree_with_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    rows = [*made_pages(300), (500, "HTTP://WWW.A.ORG", ""), (501, "x", ""), (502, None, ""), (503, "a://b://c/d?e#f", ""), (504, "http://net/?", ""), (505, "http://a.net?b/c", "")]
    at = "regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', {})"
    sql = f"""SELECT page_id, host, path, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/' WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
      FROM (SELECT page_id, lower({at.format(1)}) AS host, {at.format(2)} AS path FROM p) x ORDER BY page_id"""
    con = duckdb.connect()
    con.execute("CREATE TABLE p (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO p VALUES (?, ?)", [r[:2] for r in rows])
    out = urls.judge_urls(spark.createDataFrame(rows, PAGES)).orderBy("page_id").collect()
    assert [(r.page_id, r.host, r.path, r.rule) for r in out] == con.execute(sql).fetchall()


def test_suffixes_and_folders_are_learnt_out_of_fold():
    hosts = ("shop.com", "a.b.shop.com", "x.co.uk", "x.example.org:80", "10.0.0.1", "", "x.net.")
    assert [urls.suffix(h) for h in hosts] == ["com", "com", "co.uk", "org", "", "", "net"]
    assert [urls.folder(p) for p in ("/en/1", "/en/", "/en", "/", "", "//x")] == ["/en/", "/en/", "", "", "", "//"]
    r = random.Random(8)
    made = lambda n: [f"http://{''.join(r.choice('abcdefgh') for _ in range(9))}.{('com', 'biz')[i % 2]}/p" for i in range(n)]
    model = urls.Trees.fit(made(400), [i % 2 for i in range(400)])
    score = model.score(made(100))
    assert ((score >= 0.5) == np.array([i % 2 for i in range(100)])).mean() > 0.95
    assert set(model.stats[0]) == {"com", "biz", ""} and abs(model.stats[0]["biz"][0] - (200 + 2) / 204) < 1e-9 and set(model.stats[1]) == {""}
    # an ending seen less often than the floor is unknown
    assert set(urls.Trees.fit(made(400) + ["http://q.rare/p"] * 19, [i % 2 for i in range(419)]).stats[0]) == {"com", "biz", ""}


# -- quality --------------------------------------------------------------------------------------------------------------------


def brute_base(t):
    t = t or ""
    w = words(t)
    runs = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if runs[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def pair_hashes(w):
    """The hash of one word's hash seeds that of the next."""
    word, number = (lambda s: xxhash.xxh64_intdigest(s.encode(), 42)), (lambda x, seed: xxhash.xxh64_intdigest(x.to_bytes(8, "little"), seed))
    return [number(word(b), number(word(a), 42)) for a, b in zip(w, w[1:], strict=False)]


def test_quality_counts_and_ratio(spark, empty):
    texts = [t for _, t, _ in corpus()] + ["a b c a b c d\na b c\nx\nx\n \n \nx# %é\U0001f600", "a a a a", ("the cat sat on a mat " * 20), " ".join(VOCAB)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    trusted = spark.createDataFrame([(i,) for i in range(0, 100, 3)] + [(3,), (None,)], "doc_id long")
    weights = quality.ratios(docs, trusted, 64)
    h = lambda s, seed=42: xxhash.xxh64_intdigest(s.encode(), seed)

    def buckets(t):
        w = words(t)
        return [(x - (1 << 64) if x >> 63 else x) % 64 for x in [*map(h, w), *pair_hashes(w)]]

    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(buckets(t))
        if i < 100 and i % 3 == 0:
            target.update(buckets(t))
    n, k = sum(raw.values()) + 64, sum(target.values()) + 64
    want = [math.log((target[b] + 1) / k) - math.log((raw[b] + 1) / n) for b in range(64)]
    assert np.allclose(weights, want)
    for r in quality.judge(docs, weights, 0.0).collect():
        t = texts[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_base(t)
        b = buckets(t)
        llr = sum(want[x] for x in b) / max(1, len(b))
        assert abs(r.llr - llr) < 1e-9 and r.kept == (not r.base_failed and r.llr >= 0)
    assert quality.judge(empty, quality.ratios(empty, trusted, 8)).count() == 0


@pytest.mark.parametrize("n_trusted", [0, 1, 20, 60, 1000])
def test_quality_limits_match_brute_force(spark, n_trusted):
    r = random.Random(4)
    text = lambda g: " ".join(f"{g}{r.randrange(90)}" for _ in range(60))
    rows = [(i, text("xyz"[i % 3]), "xyz"[i % 3]) for i in range(240)] + [(240 + i, text("u"), None) for i in range(9)] + [(250, "too short", "x"), (251, None, "x"), (252, text("v"), "v")]
    # x is labelled in full, y in part, z hardly, null once, v never
    trusted = [i for i, _, g in rows if g == "x" or (g == "y" and i % 2) or i in (2, 5, 240)][:n_trusted]
    docs, ids = spark.createDataFrame(rows, "doc_id long, text string, lang string"), quality.trusted_ids(spark.createDataFrame([(i,) for i in trusted], "doc_id long"))
    raw, target = quality.counted(docs, ids, 64)
    h = lambda s, seed=42: xxhash.xxh64_intdigest(s.encode(), seed)
    own = {}
    for i, t, g in rows:
        if i in trusted and not brute_base(t)[-1]:
            w = words(t)
            f = Counter((x - (1 << 64) if x >> 63 else x) % 64 for x in [*map(h, w), *pair_hashes(w)])
            rest = [x - f[b] for b, x in enumerate(target)]
            weights = quality.log_ratios(raw, rest)
            own.setdefault(g, []).append(sum(n * weights[b] for b, n in f.items()) / f.total())
    scored = quality.judge(docs, quality.log_ratios(raw, target))
    llr = {}
    for x in scored.collect():
        if not x.base_failed:
            llr.setdefault(x.lang, []).append(x.llr)
    unsure = {g: 0.5 ** len(own.get(g, [])) for g in llr}
    centre = {g: unsure[g] * np.mean(v) + (1 - unsure[g]) * np.median(own.get(g, [0.0])) for g, v in llr.items()}
    below = [x - centre[g] for g, v in own.items() for x in v]
    weight = 0.98 ** len(below)
    want = {g: centre[g] - weight * 2.0537489 * np.std(llr[g]) + ((1 - weight) * np.quantile(below, 0.02) if below else 0) for g in llr}
    limits = [quality.limits(docs.repartition(k), ids, raw, target, scored.repartition(k)) for k in (1, 32)]
    got, again = ({x.lang: x.q_limit for x in f.collect()} for f in limits)
    assert got == again and got.keys() == want.keys() == {"x", "y", "z", "v", None} and all(abs(got[g] - want[g]) < 1e-3 for g in got)
    out = quality.decided(scored, limits[0]).collect()
    assert len(out) == len(rows) and all(x.kept == (not x.base_failed and x.llr >= got[x.lang]) for x in out)
    assert sorted(map(str, out)) == sorted(map(str, quality.judge(docs, quality.log_ratios(raw, target), limits[0]).collect()))
    assert quality.limits(docs.limit(0), ids, raw, target, quality.judge(docs.limit(0), [0.0] * 64)).count() == 0


@pytest.mark.parametrize("n_docs, labelled", [(150, (0.5, 0.5)), (600, (0.5, 0.5)), (600, (0.5, 0.05)), (600, (0.5, 0.0))])
def test_quality_keeps_clean_texts_of_any_table(spark, tmp_path, n_docs, labelled):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(n_docs):
        g = i % 2
        junk = i % 10 == 9
        vocab = [f"junk{g}{k}" for k in range(300)] if junk else [f"{'de' if g else 'en'}{k}" for k in range(3000)]
        rows.append((i, " ".join(r.choice(vocab) for _ in range(120)), "de" if g else "en"))
        if not junk and r.random() < labelled[g]:
            labels.append((i, 1))
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {x.doc_id: x.kept for x in quality.op8_quality(spark, str(tmp_path)).collect()}
    for g in (0, 1):
        clean = [kept[i] for i in range(n_docs) if i % 10 != 9 and i % 2 == g]
        assert sum(clean) >= 0.93 * len(clean), (g, sum(clean), len(clean))
    assert not any(kept[i] for i in range(9, n_docs, 10) if labelled[i % 2])  # without trusted texts a language has only its own spread


# -- mixing ----------------------------------------------------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, out, free = 1.5 * sum(sizes.values()), {}, list(names)
    while free:
        level = left / sum(w[s] for s in free)
        over = [s for s in free if w[s] * level > 2 * sizes[s]]
        if not over:
            return out | {s: w[s] * level for s in free}
        for s in over:
            out[s] = 2 * sizes[s]
            left -= out[s]
        free = [s for s in free if s not in over]
    return out


def test_mixing_meets_targets(spark, docs, empty):
    rows = corpus()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want = brute_targets(sizes)
    out = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(3)).collect()
    assert Counter((r.doc_id, r.text, r.mix_copies) for r in out) == Counter((r.doc_id, r.text, r.mix_copies) for r in again)
    taken = Counter()
    for r in out:
        assert r.mix_size == len(words(r.text)) and r.mix_source_size == sizes[r.source] and abs(r.mix_target - want[r.source]) < 1e-6 and 0 <= r.mix_copies <= 2
        taken[r.source] += r.mix_size * r.mix_copies
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 160
    assert mixing.mixed(docs).count() == sum(r.mix_copies for r in out)
    assert mixing.mix(empty).count() == 0 and mixing.mixed(docs).columns == docs.columns


def test_targets_reshare_the_excess(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 300, None: 5}, {"a": 1}, {"a": 0, "b": 0}, {"x": 5, "y": 0, "z": 7}):
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = brute_targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-9 for s in want)


# -- sharding -------------------------------------------------------------------------------------------------------------------


def test_shards_are_even_gapless_and_keep_copies(spark, empty):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(VOCAB) for _ in range(40)), "s") for i in range(3000)]
    rows += [(5000 + i, "copy " * 30, "s") for i in range(1500)] + [(9000, None, None), (9001, "", "s"), (None, "x", "s"), (1, rows[1][1], "s")]
    rows += [(9100 + i, rows[i][1], "s") for i in range(20)]
    out = sharding.shard(spark.createDataFrame(rows, SCHEMA), 6).collect()
    assert len(out) == len(rows)
    size = Counter()
    for x in out:
        size[x.shard] += len((x.text or "").encode()) + 8
    mean = sum(size.values()) / 6
    assert len(size) == 6 and all(abs(v / mean - 1) < 0.1 for v in size.values())
    for s in range(6):
        assert sorted(x.slot for x in out if x.shard == s) == list(range(sum(x.shard == s for x in out)))
    homes = {}
    for x in out:
        homes.setdefault(x.text, set()).add(x.shard)
    assert all(len(v) == 1 for t, v in homes.items() if not (t or "").startswith("copy"))
    assert sharding.shard(empty).count() == 0


@pytest.mark.parametrize("bytes_a_task", [sharding.BYTES_A_TASK, 40])
def test_groups_stay_whole_up_to_a_shard(spark, bytes_a_task):
    r = random.Random(3)
    rest = [(i, " ".join(r.choice(VOCAB) for _ in range(40)), "s") for i in range(2400)]
    mean = sum(len(t.encode()) + 8 for _, t, _ in rest)
    copy, big = "whole " * 20, "split " * 20
    n = round(mean / 4 * 0.6 / (len(copy) + 8))
    rows = rest + [(5000 + i, copy, "s") for i in range(n)] + [(9000 + i, big, "s") for i in range(3 * n)]
    out = sharding.shard(spark.createDataFrame(rows, SCHEMA), 6, bytes_a_task=bytes_a_task).collect()
    assert len(out) == len(rows) and len({x.shard for x in out if x.text == copy}) == 1 and len({x.shard for x in out if x.text == big}) > 1
    size = Counter()
    for x in out:
        size[x.shard] += len(x.text) + 8
    assert len(size) == 6 and max(size.values()) < 1.1 * sum(size.values()) / 6
    for s in range(6):
        assert sorted(x.slot for x in out if x.shard == s) == list(range(sum(x.shard == s for x in out)))


def test_size_and_crc(spark):
    d = spark.createDataFrame([(1, "é"), (2, None)], "doc_id long, text string")
    assert [r[0] for r in d.select(sharding.byte_size(sharding.F.col("text"))).collect()] == [10, 8]
    assert d.selectExpr("crc32(encode(text, 'UTF-8'))").first()[0] == zlib.crc32("é".encode())
