"""URL filter: rules first, then gradient-boosted trees on lexical features (operator 7).

No table labels URLs, so the trees learn from the pages themselves: a page that a rule blocks is a 1, one that no rule
blocks is a 0. They carry what the rules say about hosts, endings and folders over to URLs that no rule covers.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.common import ascii_lower, by_value, shielded, table

#: (host, path, verdict), fixed values.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
FEATURES = ("length", "host_length", "depth", "host_depth", "digit_ratio", "host_digits", "hyphens", "entropy", "host_entropy", "params", "query_length", "suffix_rate", "suffix_count", "folder_rate", "folder_count")
TREES, DEPTH, RATE, LEAST_LEAF, BINS = 60, 3, 0.2, 5, 32
PRIOR = 4.0  # pseudo-rows behind a suffix's or a folder's rate of blocked URLs
LEAST_SEEN = 20  # labelled URLs without which a suffix or folder counts as unknown
FOLDS = 10  # a labelled URL's rates are those of the other folds; one fold is learnt from as if they were unknown
PER_CLASS = 4_000  # bound of the labelled sample: URLs of each class, drawn by a hash
HELD_OUT = 5  # one host in so many is never learnt from

#: Public endings of two labels, fixed values; of any other host the last label is the ending.
PUBLIC = frozenset("co.uk org.uk ac.uk gov.uk me.uk net.uk com.au net.au org.au edu.au co.nz org.nz co.jp ne.jp or.jp ac.jp co.kr or.kr com.br org.br com.cn org.cn com.tw com.hk com.sg com.my co.id co.in co.th com.tr com.mx com.ar com.co co.za co.il com.ua co.example".split())

def split_url(url: str | None) -> tuple[str, str, str]:
    """Host, path and what follows the path; empty without ://. Only A-Z of the host are lower-cased."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", "", ""
    end = re.search(r"[/?#]", rest)
    host, tail = (rest[: end.start()], rest[end.start() :]) if end else (rest, "")
    end = re.search(r"[?#]", tail)
    path, more = (tail[: end.start()], tail[end.start() :]) if end else (tail, "")
    return re.sub("[A-Z]+", lambda m: m[0].lower(), host), path, more


def entropy(s: str) -> float:
    if not s:
        return 0.0
    p = np.array([s.count(c) for c in sorted(set(s))]) / len(s)
    return float(-(p * np.log2(p)).sum())


def suffix(host: str) -> str:
    """The public ending, without a port; empty for numeric hosts."""
    labels = re.sub(r":[0-9]*$", "", host).rstrip(".").split(".")
    two = ".".join(labels[-2:])
    return two if two in PUBLIC else "" if re.fullmatch(r"[0-9]+|.*\]", labels[-1]) else labels[-1]


def folder(path: str) -> str:
    """The first folder of a path, slashes included; empty if the path has none."""
    head = path[1:].partition("/")
    return f"/{head[0]}/" if path[:1] == "/" and head[1] else ""


def describe(url: str | None, stats: tuple[dict, dict]) -> list[float]:
    """The lexical features of one URL. ``stats``: blocked rate and log count of suffixes, and of folders, among the labelled."""
    host, path, more = split_url(url)
    body = (host + path + more) or (url or "")
    query = more.partition("#")[0].removeprefix("?")
    known = [x for s, key in zip(stats, (suffix(host), folder(path)), strict=True) for x in s.get(key, s[""])]
    return [len(body), len(host), len([p for p in path.split("/") if p]), host.count("."), sum(c in "0123456789" for c in body) / max(1, len(body)), sum(c in "0123456789" for c in host), host.count("-"), entropy(body), entropy(host), len([p for p in query.split("&") if p]), len(query), *known]


class Trees:
    """Gradient boosting for log loss: histogram splits, trees as arrays (feature, cut, left, right, value)."""

    def __init__(self, base: float, trees: list, stats: tuple[dict, dict], gains: dict[str, float]):
        self.base, self.trees, self.stats, self.gains = base, trees, stats, gains

    @classmethod
    def fit(cls, urls: list[str], labels: list[int], trees: int = TREES, depth: int = DEPTH) -> Trees:
        y = np.asarray(labels, float)
        mean = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
        parts = [split_url(u) for u in urls]
        folds = [zlib.crc32(h.encode("utf-8", "surrogatepass")) % FOLDS for h, _, _ in parts]

        def rates(keys: list[str]):
            """A function from a fold to the statistics of keys with the rates of all folds but it."""
            groups: dict[str, list[tuple[int, float]]] = {}
            for key, k, v in zip(keys, folds, y, strict=True):
                groups.setdefault(key, []).append((k, v))

            def known(out: int) -> dict[str, tuple[float, float]]:
                stats = {}
                for s, rows in groups.items():
                    rest = [v for k, v in rows if k != out]
                    if s and len(rows) >= LEAST_SEEN:
                        stats[s] = ((sum(rest) + PRIOR * mean) / (len(rest) + PRIOR), float(np.log1p(len(rows))))
                return stats | {"": (mean, 0.0)}

            return known

        both = [rates([suffix(h) for h, _, _ in parts]), rates([folder(p) for _, p, _ in parts])]
        unknown = {"": (mean, 0.0)}
        stats, apart = tuple(f(-1) for f in both), [(unknown, unknown), *(tuple(f(k) for f in both) for k in range(1, FOLDS))]
        gains = dict.fromkeys(FEATURES, 0.0)
        x = np.array([describe(u, apart[k]) for u, k in zip(urls, folds, strict=True)], float).reshape(len(urls), len(FEATURES))
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1) if len(x) else np.zeros((0, len(FEATURES)), int)
        score, base, out = np.full(len(y), np.log(mean / (1 - mean))), float(np.log(mean / (1 - mean))), []
        for _ in range(trees if len(y) else 0):
            p = 1 / (1 + np.exp(-score))
            g, h, nodes = y - p, p * (1 - p), []

            def grow(rows: np.ndarray, level: int, g=g, h=h, nodes=nodes) -> int:
                at = len(nodes)
                nodes.append([-1, 0.0, 0, 0, RATE * g[rows].sum() / (h[rows].sum() + 1.0)])
                best, all_g, all_h = (1e-6, 0, 0), g[rows].sum(), h[rows].sum()
                for j, e in enumerate(edges) if level < depth else ():
                    gs, hs, ns = (np.bincount(binned[rows, j], w, len(e) + 1).cumsum()[:-1] for w in (g[rows], h[rows], None))
                    gain = gs**2 / (hs + 1) + (all_g - gs) ** 2 / (all_h - hs + 1) - all_g**2 / (all_h + 1)
                    gain = np.where((ns >= LEAST_LEAF) & (len(rows) - ns >= LEAST_LEAF), gain, 0)
                    if len(gain) and gain.max() > best[0]:
                        best = (float(gain.max()), j, int(gain.argmax()))
                if best[0] > 1e-6:
                    go = binned[rows, best[1]] <= best[2]
                    nodes[at][:2] = [best[1], float(edges[best[1]][best[2]])]
                    gains[FEATURES[best[1]]] += best[0]
                    nodes[at][2] = grow(rows[go], level + 1)
                    nodes[at][3] = grow(rows[~go], level + 1)
                return at

            grow(np.arange(len(y)), 0)
            tree = [np.array(c) for c in zip(*nodes, strict=True)]
            out.append(tree)
            score += cls.walk(tree, x)
        return cls(base, out, stats, gains)

    @staticmethod
    def walk(tree: list[np.ndarray], x: np.ndarray) -> np.ndarray:
        feature, cut, left, right, value = tree
        at = np.zeros(len(x), int)
        for _ in range(DEPTH + 1):
            f = feature[at]
            down = np.where(x[np.arange(len(x)), f] <= cut[at], left[at], right[at])
            at = np.where(f >= 0, down, at)
        return value[at]

    def score(self, urls: list[str | None]) -> np.ndarray:
        """Chance that a URL is to be blocked."""
        x = np.array([describe(u, self.stats) for u in urls], float).reshape(len(urls), len(FEATURES))
        return 1 / (1 + np.exp(-sum((self.walk(t, x) for t in self.trees), np.full(len(x), self.base))))


def rule_for(host: str, path: str, rules=RULES) -> tuple[str, str] | None:
    """(name, verdict) of the longest rule whose host is the URL's or a parent of it and whose path begins the URL's."""
    fit = [(len(h) + len(p), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else None


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What ``split_url`` gives, as expressions."""
    part = lambda i: F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)([^?#]*)", i), F.lit(""))
    return ascii_lower(part(1)), part(2)


def ruled(host: Column, path: Column, rules=RULES) -> Column:
    """The verdict of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("string")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r[0] + r[1])):
        out = F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)), verdict).otherwise(out)
    return out


def labelled(pages: DataFrame, rules=RULES) -> DataFrame:
    """(url, host, label): distinct URLs with a host; 1 if a rule blocks it, else 0."""
    host, path = host_and_path(F.col("url"))
    return pages.select("url", host.alias("host"), (F.coalesce(ruled(host, path, rules), F.lit("allow")) == "block").cast("int").alias("label")).filter("host <> ''").distinct()


def is_held_out(host: Column) -> Column:
    return F.pmod(F.xxhash64(host, F.lit(17)), F.lit(HELD_OUT)) == 0


def trained(pages: DataFrame, rules=RULES, per_class: int = PER_CLASS) -> Trees:
    """Trees learnt from at most ``per_class`` URLs of each class; the hosts of ``is_held_out`` are never among them.

    URLs are drawn by a hash, so that reruns draw the same. Without any URL the trees say 0.5 of all.
    """
    known = labelled(pages, rules).filter(~is_held_out(F.col("host")))
    draw = lambda c: known.filter(F.col("label") == c).orderBy(F.xxhash64("url"), "url").limit(per_class).collect()
    rows = [r for c in (0, 1) for r in draw(c)]
    return Trees.fit([r.url for r in rows], [r.label for r in rows])


VERDICT = T.StructType([T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("rule", T.StringType()), T.StructField("block_score", T.DoubleType()), T.StructField("verdict", T.StringType())])


def judge_urls(pages: DataFrame, model: Trees | None = None, rules=RULES) -> DataFrame:
    """``pages`` with host, path, rule, block_score and verdict.

    A rule's verdict stands; else the trees' (block above 0.5). Null urls and those without :// have an empty host
    and path, no rule, and the trees' verdict on their other features. Rows are judged one by one, a url of any
    length whole: repeated rows repeat their verdict, no rows give none. Columns with these names are overwritten, all
    others kept.
    """
    model = model or trained(pages, rules)

    @F.pandas_udf(VERDICT)
    def verdicts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for urls in batches:
            urls = [u if isinstance(u, str) else None for u in urls]
            parts = [split_url(u) for u in urls]
            fits = [rule_for(h, p, rules) for h, p, _ in parts]
            score = model.score(urls)
            yield pd.DataFrame({"host": [p[0] for p in parts], "path": [p[1] for p in parts], "rule": [r and r[0] for r in fits], "block_score": score, "verdict": [r[1] if r else "block" if s > 0.5 else "allow" for r, s in zip(fits, score, strict=True)]})

    inner, back = shielded(pages, "url", made=VERDICT.names)
    return inner.withColumn("u_out", verdicts(F.col("url"))).select(*back, "u_out.*")


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "block_score")


by_value(__name__)
