"""URL filter: host and path rules first, gradient-boosted trees for the rest.

The trees see lexical features only: lengths, depth, digit ratio, entropy,
parameter counts, hyphens, and statistics of the host's suffix among the
labelled URLs.  Suffix statistics count all labelled URLs, in a fixed number
of hash buckets and ``FOLDS`` folds, so that a training URL's own label is in
none of its features; the trees are fitted on at most ``SAMPLE`` URLs, those
with the smallest hashes.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ocellus.llm._arrow import hash_sample, map_batches

SAMPLE = 20_000
BUCKETS = 4096
FOLDS = 5
#: Lexical features of a URL; two suffix statistics follow.
LEXICAL = 14
JUDGED = "page_id long, host string, path string, rule string, score double, verdict string"

#: The rules of the query, as (verdict, host, path).
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as struct (rule, verdict); null if none does.

    A rule fits its host and all subdomains, if the path starts with the rule's.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def suffix_bucket(host: str) -> int:
    return zlib.crc32(host.rpartition(".")[2].encode()) % BUCKETS


def lexical(url: str | None) -> tuple[float, ...]:
    """Lexical features of a URL; a null URL is empty."""
    url = url or ""
    rest = url.partition("://")[2]
    cut = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    host, tail = rest[:cut].lower(), rest[cut:]
    path, query = tail.partition("#")[0].partition("?")[::2]
    n = max(1, len(url))
    counts = Counter(host)
    entropy = -sum(v / len(host) * math.log2(v / len(host)) for v in counts.values()) if host else 0.0
    names = host.split(".")
    return (
        len(url), len(host), len(path), len(query), sum(1 for x in path.split("/") if x), len(names), max(map(len, names)), host.count("-"),
        sum(c.isdigit() for c in url) / n, sum(c.isdigit() for c in host), entropy, query.count("=") + query.count("&"), float("#" in tail), float(url.startswith("https")),
    )


def host_text(url: str | None) -> str:
    """The host of a URL as :func:`host_of` finds it."""
    return (url or "").partition("://")[2].split("/", 1)[0].split("?", 1)[0].split("#", 1)[0].lower()


def features(urls: list[str | None], suffix: np.ndarray, own: list[int] | None = None) -> np.ndarray:
    """Lexical features and the suffix's smoothed share of blocked URLs, without the fold ``own`` of each URL if given.

    ``suffix`` has allowed and blocked URLs by bucket and fold.
    """
    total = suffix.sum(axis=1)
    rows = []
    for i, u in enumerate(urls):
        bucket = suffix_bucket(host_text(u))
        allowed, blocked = total[bucket] - (suffix[bucket, own[i]] if own else 0)
        rows.append((*lexical(u), (blocked + 1) / (allowed + blocked + 2), math.log1p(allowed + blocked)))
    return np.array(rows, np.float64).reshape(len(urls), LEXICAL + 2)


@dataclass
class BoostedTrees:
    """Logistic gradient boosting with depth-limited trees over quantile bins."""

    rate: float = 0.15
    rounds: int = 60
    depth: int = 3
    least: float = 8.0
    ridge: float = 1.0
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
        self.base = math.log(share / (1 - share))
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)[1:-1])) if len(y) else np.zeros(0) for j in range(x.shape[1])]
        bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        raw = np.full(len(y), self.base)
        for _ in range(self.rounds if len(y) else 0):
            p = 1 / (1 + np.exp(-raw))
            tree, leaf = self._grow(bins, edges, p - y, p * (1 - p))
            self.trees.append(tree)
            raw += tree[2][leaf]
        return self

    def _grow(self, bins: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> tuple[tuple, np.ndarray]:
        """A tree as arrays in heap order: feature (-1: none), cut, value; and each row's leaf."""
        nodes = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
        at = np.zeros(len(g), np.int64)
        for node in range(nodes):
            rows = np.flatnonzero(at == node)
            if not len(rows):
                continue
            gs, hs = g[rows].sum(), h[rows].sum()
            value[node] = -self.rate * gs / (hs + self.ridge)
            if 2 * node + 2 >= nodes:
                continue
            best = (1e-6, -1, 0)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                gl = np.cumsum(np.bincount(bins[rows, j], g[rows], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(bins[rows, j], h[rows], len(e) + 1))[:-1]
                gain = gl**2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - gs**2 / (hs + self.ridge)
                gain[(hl < self.least / 4) | (hs - hl < self.least / 4)] = 0
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k)
            if best[1] >= 0:
                feature[node], cut[node] = best[1], edges[best[1]][best[2]]
                at[rows] = 2 * node + 1 + (bins[rows, best[1]] > best[2])
        return (feature, cut, value), at

    def predict(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                go = f >= 0
                at = np.where(go, 2 * at + 1 + (x[np.arange(len(x)), np.maximum(f, 0)] > cut[at]), at)
            raw += value[at]
        return 1 / (1 + np.exp(-raw))


@dataclass
class UrlModel:
    suffix: np.ndarray
    trees: BoostedTrees

    def score(self, urls: list[str | None]) -> np.ndarray:
        return self.trees.predict(features(urls, self.suffix)) if urls else np.zeros(0)


def fit(labelled: DataFrame, sample: int = SAMPLE) -> UrlModel:
    """Fits the trees on ``labelled`` (url, blocked 0/1).

    Rows with a null label are left out, null URLs count as empty.  Without
    labels every score is 0.5.
    """
    rows = labelled.select(F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.col("blocked").cast("int")).where("blocked is not null")
    bucket = F.pmod(F.crc32(F.element_at(F.split(host_of(F.col("url")), r"\."), -1).cast("binary")), F.lit(BUCKETS)).cast("int")
    fold = F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")
    suffix = np.zeros((BUCKETS, FOLDS, 2))
    for r in rows.groupBy(bucket.alias("b"), fold.alias("f")).agg(F.sum(1 - F.col("blocked")), F.sum("blocked")).collect():
        suffix[r[0], r[1]] = r[2], r[3]
    got = hash_sample(rows.select("url", "blocked", fold.alias("fold")), ["url", "blocked"], sample, int(suffix.sum())).collect()
    x = features([r.url for r in got], suffix, [r.fold for r in got])
    return UrlModel(suffix, BoostedTrees().fit(x, np.array([r.blocked for r in got], np.float64)))


def labelled_by_rules(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """The URLs of ``pages`` as labelled by block and allow rules: blocked if a block rule decides, else not.

    The rules are a site's own judgement, so URLs that no rule names count as
    allowed; the trees learn which of them look like the blocked ones.
    """
    url = F.col("url").cast("string")
    rule = rule_of(host_of(url), path_of(url), rules)
    return pages.select(url.alias("url"), F.coalesce(rule["verdict"] == "block", F.lit(False)).cast("int").alias("blocked"))


def judge(pages: DataFrame, model: UrlModel, rules: list[tuple[str, str, str]] = RULES, threshold: float = 0.5) -> DataFrame:
    """Each page's host, path, rule and verdict.

    The longest rule that fits decides, of equally long ones the last by name; else a URL is blocked if the model's
    score is ``threshold`` or more.  A null url, or one without ``://``, has an
    empty host and path and is judged by the model; each row gives one row,
    whatever the length of its URL.
    """
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = sent.value.score(batch.column(5).to_pylist())
            method = np.where(score >= threshold, "block", "allow").tolist()
            verdict = [a or b for a, b in zip(batch.column(4).to_pylist(), method, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(score), pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "score", "verdict"])

    url = F.col("url").cast("string")
    split = pages.select(F.col("page_id").cast("long"), host_of(url).alias("host"), path_of(url).alias("path"), url.alias("url"))
    ruled = split.select("page_id", "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("r"), "url")
    return map_batches(ruled.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict"), "url"), scored, JUDGED)
