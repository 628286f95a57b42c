"""Toxicity by a bidirectional gated recurrent network with attention pooling (operator 5), in numpy."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import by_value, shielded, table

WINDOW, STRIDE = 32, 16  # words; neighbouring windows share half
WORD_ROWS, CHAR_ROWS, DIM, HIDDEN, ATTENTION = 1 << 13, 1 << 14, 16, 16, 16
GRAMS = (3, 4, 5)
#: Bounds of the labelled sample, for each class: ids drawn, rows kept, and UTF-8 bytes of all their texts together.
DRAWN, PER_CLASS, BYTES = 12_000, 1_000, 2_000_000
EPOCHS, LEAST_STEPS, BATCH, STEP, SEED = 6, 300, 40, 4e-3, 5
MOST_WINDOWS = 1_500  # windows of a step, whose states are kept in memory; a longer document makes a step by itself
LEAST_SHARE = 3  # the rarer class is repeated until it is one in so many
KNOWN_WORDS = 100_000  # words whose inputs a worker remembers
WORDS = 4_000  # words whose inputs are made at a time
CHUNK = 1024  # windows that run side by side
PART = 500_000  # characters of text that a worker lays out at a time
EDGE = b"".join(bytes([c]) for c in range(128) if not chr(c).isalnum())


def tokens(text: str | None) -> list[bytes]:
    """White-space words, A-Z lower-cased, without ASCII punctuation at their ends."""
    return [w for w in (x.strip(EDGE) for x in (text or "").encode("utf-8", "surrogatepass").lower().split()) if w]


def word_inputs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word its row of the word table; for each byte of all words, edges marked, the rows of the character
    table for the grams that start there (CHAR_ROWS: none); where each word starts."""
    joined = np.frombuffer(b"".join(b"<" + w + b">" for w in words) + b"\0" * max(GRAMS), np.uint8).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    starts = np.concatenate([[0], sizes.cumsum()[:-1]]).astype(np.int64)
    left = np.repeat(starts + sizes, sizes) - np.arange(sizes.sum())
    rows, h = [], np.zeros(sizes.sum(), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        h = (h ^ joined[n - 1 : n - 1 + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if n == 1:  # a word's hash: its bytes' hashes by their places; longer grams run on into the next word
            whole = np.add.reduceat(h * (np.arange(len(h)) - np.repeat(starts, sizes) + 1).astype(np.uint64), starts) * np.uint64(0x9E3779B97F4A7C15)
        if n in GRAMS:
            rows.append(np.where(left >= n, (h * np.uint64(n * 2 + 1) >> np.uint64(20)) % np.uint64(CHAR_ROWS), np.uint64(CHAR_ROWS)).astype(np.int32))
    return ((whole >> np.uint64(17)) % np.uint64(WORD_ROWS)).astype(np.int32), np.stack(rows, 1), starts


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def windows(n: int) -> range:
    """Starts of the windows that together cover ``n`` words."""
    return range(0, max(n - (WINDOW - STRIDE), 1), STRIDE) if n else range(0)


def laid_out(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Word ids of every window of every document, padded with 0, and the document of each window."""
    rows, owner = [], []
    for i, ids in enumerate(docs):
        starts = windows(len(ids))
        if len(starts):
            wide = np.zeros(starts[-1] + WINDOW, np.int32)
            wide[: len(ids)] = ids
            rows.append(np.lib.stride_tricks.sliding_window_view(wide, WINDOW)[:: STRIDE])
            owner.append(np.full(len(starts), i))
    return (np.concatenate(rows), np.concatenate(owner)) if rows else (np.zeros((0, WINDOW), np.int32), np.zeros(0, int))


def batches(order: np.ndarray, sizes: list[int]) -> Iterator[np.ndarray]:
    """Parts of ``order`` of at most BATCH documents and, as far as single ones allow, MOST_WINDOWS windows."""
    at = held = 0
    for i, n in enumerate(sizes):
        if i > at and (i - at == BATCH or held + n > MOST_WINDOWS):
            yield order[at:i]
            at, held = i, 0
        held += n
    yield order[at:]


class Net:
    """The network's parameters by name, and its passes over windows."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        init = lambda *s: (r.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        h = HIDDEN
        self.p = {"word": np.zeros((WORD_ROWS, DIM), np.float32), "char": r.normal(size=(CHAR_ROWS + 1, DIM), scale=0.3).astype(np.float32), "wx": init(DIM, 6 * h), "bx": np.zeros(6 * h, np.float32), "uf": init(h, 3 * h), "ub": init(h, 3 * h), "wa": init(2 * h, ATTENTION), "ba": np.zeros(ATTENTION, np.float32), "va": init(ATTENTION, 1)[:, 0], "wo": init(2 * h, 1)[:, 0], "bo": np.zeros(1, np.float32)}
        self.p["char"][CHAR_ROWS] = 0

    def embed(self, word: np.ndarray, char: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An input vector for each word, and one over the root of its number of grams."""
        parts = self.p["char"][char[:, 0]]
        for j in range(1, char.shape[1]):
            parts += self.p["char"][char[:, j]]
        scale = 1 / np.sqrt(np.maximum(np.add.reduceat((char < CHAR_ROWS).sum(1), starts), 1)).astype(np.float32)[:, None]
        return np.add.reduceat(parts, starts, axis=0) * scale + self.p["word"][word], scale

    def projected(self, words: list[bytes]) -> np.ndarray:
        """What each word gives to both directions' gates: the window passes only gather these rows."""
        out = [self.embed(*word_inputs(words[i : i + 20_000]))[0] @ self.p["wx"] + self.p["bx"] for i in range(0, len(words), 20_000)]
        return np.concatenate(out) if out else np.zeros((0, 6 * HIDDEN), np.float32)

    def run(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows. x: (time, window, 6 * HIDDEN); mask: (time, window), false on padding."""
        h, t_all, b = HIDDEN, x.shape[0], x.shape[1]
        out, m, past = np.empty((t_all, b, 2 * h), np.float32), mask[:, :, None].astype(np.float32), []
        full = mask.all(1)
        for d, u in enumerate((self.p["uf"], self.p["ub"])):
            s, saved = np.zeros((b, h), np.float32), []
            for t in range(t_all) if d == 0 else range(t_all - 1, -1, -1):
                xt = x[t, :, 3 * h * d : 3 * h * (d + 1)]
                g = s @ u
                zr = sigmoid(xt[:, : 2 * h] + g[:, : 2 * h])
                n = np.tanh(xt[:, 2 * h :] + zr[:, h:] * g[:, 2 * h :])
                new = n + zr[:, :h] * (s - n)
                if not full[t]:
                    new = s + m[t] * (new - s)
                if keep:
                    saved.append((t, s, g, zr, n))
                s = out[t, :, h * d : h * (d + 1)] = new
            past.append(saved)
        act = np.tanh(out @ self.p["wa"] + self.p["ba"])
        score = np.where(mask, act @ self.p["va"], np.float32(-1e9))
        e = np.exp(score - score.max(0))
        a = e / e.sum(0)
        pooled = np.einsum("tb,tbh->bh", a, out)
        logit = pooled @ self.p["wo"] + self.p["bo"][0]
        return (logit, (x, m, out, past, act, a, pooled)) if keep else logit

    def back(self, dlogit: np.ndarray, kept) -> tuple[dict, np.ndarray]:
        """Gradients of the dense parameters, and of x."""
        x, m, out, past, act, a, pooled = kept
        h, g = HIDDEN, {}
        g["wo"], g["bo"] = pooled.T @ dlogit, dlogit.sum(keepdims=True)
        dpool = dlogit[:, None] * self.p["wo"]
        da = np.einsum("tbh,bh->tb", out, dpool)
        dscore = a * (da - (a * da).sum(0))
        dact = dscore[:, :, None] * self.p["va"] * (1 - act**2)
        g["va"], g["ba"] = np.einsum("tba,tb->a", act, dscore), dact.sum((0, 1))
        g["wa"] = np.einsum("tbh,tba->ha", out, dact)
        dout, dx = a[:, :, None] * dpool + dact @ self.p["wa"].T, np.zeros_like(x)
        for d, name in enumerate(("uf", "ub")):
            u, du, ds = self.p[name], np.zeros_like(self.p[name]), 0
            for t, s, gate, zr, n in reversed(past[d]):
                dnew = dout[t, :, h * d : h * (d + 1)] + ds
                carry, dnew = dnew * (1 - m[t]), dnew * m[t]
                z, r = zr[:, :h], zr[:, h:]
                dn = dnew * (1 - z) * (1 - n**2)
                dz = dnew * (s - n) * z * (1 - z)
                dr = dn * gate[:, 2 * h :] * r * (1 - r)
                dgate = np.concatenate([dz, dr, dn * r], 1)
                dx[t, :, 3 * h * d : 3 * h * (d + 1)] = np.concatenate([dz, dr, dn], 1)
                du += s.T @ dgate
                ds = carry + dnew * z + dgate @ u.T
            g[name] = du
        return g, dx

    def fit(self, texts: list[str], labels: list[int], epochs: int = EPOCHS, least_steps: int = LEAST_STEPS) -> Net:
        """Learns from whole documents: a document's logit is the greatest of its windows, so only that window is learnt from
        (early on a soft maximum, and so all windows). Without texts of both labels all scores are low."""
        vocab: dict[bytes, int] = {b"": 0}
        docs = [np.array([vocab.setdefault(w, len(vocab)) for w in tokens(t)], np.int32) for t in texts]
        y, r = np.asarray(labels, np.float32), np.random.default_rng(SEED)
        classes = sorted(([i for i, d in enumerate(docs) if len(d) and y[i] == c] for c in (0, 1)), key=len)
        if not classes[0]:
            self.p["bo"][:] = -4.0
            self.p["wo"][:] = 0
            return self
        word, char, starts = word_inputs(list(vocab))
        ends = np.append(starts[1:], len(char))
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        step, rare = 0, max(len(classes[0]), len(classes[1]) // (LEAST_SHARE - 1))
        size = rare + len(classes[1])
        epochs = max(epochs, -(-least_steps * BATCH // size))  # a small sample is gone through more often
        for epoch in range(epochs):
            rate = STEP * (0.5 + 0.5 * np.cos(np.pi * epoch / epochs))
            often = np.concatenate([r.permutation(classes[0]) for _ in range(-(-rare // len(classes[0])))])[:rare]
            order = r.permutation(np.concatenate([often, classes[1]]))
            for chosen in batches(order, [len(windows(len(docs[i]))) for i in order]):
                ids, owner = laid_out([docs[i] for i in chosen])
                inputs = self.inputs(ids, word, char, starts, ends)
                if epoch >= 2:
                    logit = self.run(inputs[-1][inputs[1]], (ids > 0).T)
                    edges = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                    top = np.flatnonzero(logit == np.maximum.reduceat(logit, edges)[owner])
                    ids = ids[top[np.r_[True, owner[top][1:] != owner[top][:-1]]]]  # the first, if windows are equal
                    owner = np.arange(len(chosen))
                    inputs = self.inputs(ids, word, char, starts, ends)
                seen, flat, span, sizes, vectors, scale, proj = inputs
                logit, kept = self.run(proj[flat], (ids > 0).T, keep=True)
                edges = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                top = np.maximum.reduceat(logit, edges)
                soft = np.exp(logit - top[owner])
                total = np.add.reduceat(soft, edges)
                g, dx = self.back(((sigmoid(top + np.log(total)) - y[chosen]) / len(chosen))[owner].astype(np.float32) * soft / total[owner], kept)
                dproj = np.zeros_like(proj)
                np.add.at(dproj, flat.ravel(), dx.reshape(-1, dx.shape[2]))
                g["wx"], g["bx"] = vectors.T @ dproj, dproj.sum(0)
                dvec = dproj @ self.p["wx"].T
                g["word"], g["char"] = np.zeros_like(self.p["word"]), np.zeros_like(self.p["char"])
                np.add.at(g["word"], word[seen], dvec)
                spread = np.repeat(dvec * scale, sizes, axis=0)
                for j in range(char.shape[1]):
                    np.add.at(g["char"], char[span, j], spread)
                g["char"][CHAR_ROWS] = 0
                step += 1
                for k, v in self.p.items():
                    first[k] += 0.1 * (g[k] - first[k])
                    second[k] += 0.002 * (g[k] ** 2 - second[k])
                    v -= (rate / (1 - 0.9**step) * first[k] / (np.sqrt(second[k] / (1 - 0.998**step)) + 1e-7)).astype(np.float32)
        return self

    def inputs(self, ids: np.ndarray, word: np.ndarray, char: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Of some windows of words: the different words, which of them stands where (time, window), their characters, how many
        each has, their input vectors and scales, and what they give to the gates."""
        seen, flat = np.unique(ids, return_inverse=True)
        sizes = ends[seen] - starts[seen]
        begin = np.concatenate([[0], sizes.cumsum()[:-1]])
        span = np.repeat(starts[seen] - begin, sizes) + np.arange(sizes.sum())
        vectors, scale = self.embed(word[seen], char[span], begin)
        return seen, flat.reshape(ids.shape).T, span, sizes, vectors, scale, vectors @ self.p["wx"] + self.p["bx"]

    def scorer(self):
        """A function from texts to scores; it remembers the inputs of words that it has met, up to KNOWN_WORDS. Texts are gone
        through PART characters at a time, so its memory depends on the longest text alone."""
        vocab: dict[bytes, int] = {b"": 0}
        held = [np.empty((KNOWN_WORDS * 5 // 4, 6 * HIDDEN), np.float32)]  # memory is only taken for the rows that are filled
        held[0][:1] = self.projected([b""])

        def part_score(texts: list[str | None]) -> np.ndarray:
            out = np.zeros(len(texts))
            if len(vocab) > KNOWN_WORDS:
                vocab.clear()
                vocab[b""] = 0
            known, put = len(vocab), vocab.setdefault
            docs = [np.array([put(w, len(vocab)) for w in tokens(t)], np.int32) for t in texts]
            if len(vocab) > len(held[0]):
                held[0] = np.concatenate([held[0][:known], np.empty((len(vocab) - known, 6 * HIDDEN), np.float32)])
            new = list(itertools.islice(vocab, known, None))
            for i in range(0, len(new), WORDS):
                some = new[i : i + WORDS]
                held[0][known + i : known + i + len(some)] = self.projected(some)
            ids, owner = laid_out(docs)
            logit = np.concatenate([self.run(held[0][ids[i : i + CHUNK].T], ids[i : i + CHUNK].T > 0) for i in range(0, len(ids), CHUNK)] or [np.zeros(0, np.float32)])
            if len(ids):
                edges = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                out[owner[edges]] = sigmoid(np.maximum.reduceat(logit, edges).astype(float))
            return out

        def score(texts: Iterable[str | None]) -> np.ndarray:
            out, part, size = [], [], 0
            for t in texts:
                part.append(t)
                size += len(t or "")
                if size > PART:
                    out.append(part_score(part))
                    part, size = [], 0
            return np.concatenate([*out, part_score(part)])

        return score


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most_bytes: int = BYTES) -> tuple[list[str], list[int]]:
    """Texts and labels to learn from, drawn by a hash of doc_id: of each class at most ``per_class`` rows of at most ``most_bytes`` in all.

    Rows with crc32(doc_id as text) mod 5 = 0 are held out. Labels pick the ids first (DRAWN a class, so the join's small
    side is bounded). Texts of any length are drawn whole, in the order of the hash, up to the first that doesn't fit.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    drawn = [known.filter(F.col("toxic") == c).orderBy(order, "doc_id").limit(DRAWN) for c in (0, 1)]
    both = docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(drawn[0].unionByName(drawn[1])), "doc_id")
    place = Window.orderBy("h", "doc_id", "k")
    texts, classes = [], []
    for c in (0, 1):
        keys = both.filter(F.col("toxic") == c).select("doc_id", order.alias("h"), F.xxhash64("text").alias("k"), F.octet_length("text").alias("b"))
        # the first rows in order, without their texts: at most ``per_class``
        first = keys.orderBy("h", "doc_id", "k").limit(per_class).withColumn("sum", F.sum("b").over(place)).filter(F.col("sum") <= most_bytes)
        chosen = first.groupBy("doc_id", "k").agg(F.count(F.lit(1)).alias("n"))
        rows = docs.select("doc_id", "text").withColumn("k", F.xxhash64("text")).join(F.broadcast(chosen), ["doc_id", "k"]).select("doc_id", "text", "k", "n").distinct().collect()
        for r in sorted(rows, key=lambda r: (r.doc_id, r.k)):
            texts += [r.text] * r.n
            classes += [c] * r.n
    return texts, classes


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def toxicity(docs: DataFrame, net: Net) -> DataFrame:
    """``docs`` with score: the greatest over all overlapping windows of the whole text.

    Null, empty and wordless texts score 0. Only the text is used: copies and rows with null or repeated ids get
    their text's score. No rows: no rows. A column named score is overwritten, all others are kept.
    """

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        score = net.scorer()
        for texts in batches:
            yield pa.array(score(t.as_py() for t in texts))

    inner, back = shielded(docs, "text", made=["score"])
    return inner.select(*back, scored(F.col("text")).alias("score"))


def trained(docs: DataFrame, labels: DataFrame) -> Net:
    return Net().fit(*labelled_sample(docs, labels))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity(docs, trained(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


by_value(__name__)
