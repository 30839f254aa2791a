"""URL filter: suffix and path rules, and gradient-boosted trees on lexical features for what no rule decides."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import hot_join, sampled, written

FEATURES = ["length", "host_length", "labels", "depth", "path_length", "digit_share", "host_digit_share", "hyphens", "entropy", "params", "query_length", "has_fragment", "suffix_block_share", "suffix_log_count"]
#: Weight of the overall share of blocked urls in a suffix's share.
PRIOR = 5.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null and without `://`. Only A-Z are lower-cased."""
    parts = r"(?s)^.*?://([^/?#]*+)([^?#]*+)"
    host = F.translate(F.regexp_extract(url, parts, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, parts, 2), F.lit(""))


def first_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of rules `host/path` -> verdict that fits; null without one. Ties: the first given."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, what in sorted(reversed(rules), key=lambda r: len(r[0])):
        h, slash, p = name.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def lexical(d: DataFrame) -> DataFrame:
    """d (url, host, path) with the features that need nothing but the url; null urls count as empty."""
    url = F.coalesce("url", F.lit(""))
    n = F.length(url).cast("double")
    share = lambda c, of: F.when(F.length(of) > 0, F.regexp_count(of, F.lit(c)) / F.length(of)).otherwise(F.lit(0.0))
    chars = F.array_remove(F.split(url, "(?!^)"), "")
    bits = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s - _plogp((n - F.length(F.replace(url, c, F.lit("")))) / n))
    query = F.coalesce(F.regexp_extract(url, r"(?s)\?([^#]*+)", 1), F.lit(""))
    return d.select(
        "*", n.alias("length"), F.length("host").cast("double").alias("host_length"), F.size(F.split("host", r"\.")).cast("double").alias("labels"),
        F.regexp_count("path", F.lit("/[^/]")).cast("double").alias("depth"), F.length("path").cast("double").alias("path_length"),
        share("[0-9]", url).alias("digit_share"), share("[0-9]", F.col("host")).alias("host_digit_share"), F.regexp_count("host", F.lit("-")).cast("double").alias("hyphens"),
        F.when(n > 0, bits).otherwise(F.lit(0.0)).alias("entropy"), F.when(query == "", 0.0).otherwise((F.regexp_count(query, F.lit("&")) + 1).cast("double")).alias("params"),
        F.length(query).cast("double").alias("query_length"), url.contains("#").cast("double").alias("has_fragment"),
        F.regexp_extract("host", r"([^.]+(?:\.[^.]+)?)$", 1).alias("suffix"),
    )


def _plogp(p: Column) -> Column:
    return F.when(p > 0, p * F.log2(p)).otherwise(F.lit(0.0))


@dataclass
class Trees:
    """Gradient-boosted regression trees on the logistic loss, grown on histograms of quantile bins."""

    rounds: int = 60
    depth: int = 3
    rate: float = 0.2
    bins: int = 32
    ridge: float = 1.0
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree, step = self._grow(binned, edges, p - y, p * (1 - p))
            self.trees.append(tree)
            score += step
        return self

    def _grow(self, binned, edges, grad, hess):
        nodes = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
        at = np.zeros(len(grad), np.int64)
        for node in range(nodes):
            rows = np.flatnonzero(at == node)
            if not len(rows):
                continue
            g, h = grad[rows], hess[rows]
            value[node] = -self.rate * g.sum() / (h.sum() + self.ridge)
            if node >= nodes // 2:
                continue
            best = (1e-6, -1, -1)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                gl = np.cumsum(np.bincount(binned[rows, j], g, len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, j], h, len(e) + 1))[:-1]
                gain = gl**2 / (hl + self.ridge) + (g.sum() - gl) ** 2 / (h.sum() - hl + self.ridge) - g.sum() ** 2 / (h.sum() + self.ridge)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], j, k)
            _, j, k = best
            if j >= 0:
                feature[node], cut[node] = j, edges[j][k]
                at[rows] = 2 * node + 1 + (binned[rows, j] > k)
        return (feature, cut, value), value[at]

    def score(self, x: np.ndarray) -> np.ndarray:
        """The log odds of y = 1."""
        out = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                goes = x[np.arange(len(x)), np.maximum(f, 0)] > cut[at]
                at = np.where(f >= 0, 2 * at + 1 + goes, at)
            out += value[at]
        return out


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]], sample: int = 20_000) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score for every row of pages.

    Urls that a rule decides are the labelled ones. Each suffix (the host's last two labels) has its share and number of
    blocked ones among all of them, a labelled url itself left out of its own share. The trees are fitted on at most
    `sample` labelled urls, those with the least hashes. Where no rule fits, a url is blocked from even odds on; with no
    labelled urls at all, none is. Null urls have empty host and path. Repeated rows stay; other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    d = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), path.alias("path"))
    rule, known = first_rule(F.col("host"), F.col("path"), rules)
    d = written(lexical(d.select("*", rule.alias("rule"), known.alias("known"))), "urls")
    stats = d.where("rule is not null").groupBy("suffix").agg(F.count("*").alias("n"), F.count(F.when(F.col("known") == "block", 1)).alias("blocked"))
    total = stats.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("b")).head()
    share = total["b"] / total["n"] if total["n"] else 0.5
    d = hot_join(d, stats, "suffix")
    own = F.col("rule").isNotNull().cast("int")
    n = F.coalesce("n", F.lit(0)) - own
    blocked = F.coalesce("blocked", F.lit(0)) - F.when(F.col("known") == "block", 1).otherwise(0)
    d = d.withColumns({"suffix_block_share": (blocked + PRIOR * share) / (n + PRIOR), "suffix_log_count": F.log1p(n.cast("double"))})

    labelled = d.where("rule is not null").select((F.col("known") == "block").cast("double").alias("y"), *FEATURES, F.concat_ws(" ", "page_id", "url").alias("key"))
    rows = sampled(labelled, F.col("key"), total["n"], sample).drop("key").collect()
    model = None
    if rows:
        model = Trees().fit(np.array([[r[f] for f in FEATURES] for r in rows]), np.array([r["y"] for r in rows]))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(5, 5 + len(FEATURES))], axis=1)
            score = model.score(x) if model else np.full(len(x), -1.0)
            guess = np.where(score >= 0, "block", "allow")
            verdict = [v if v is not None else str(g) for v, g in zip(batch.column(4).to_pylist(), guess, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(verdict, pa.string()), pa.array(score)], ["page_id", "host", "path", "rule", "verdict", "block_score"])

    return d.select("page_id", "host", "path", "rule", "known", *FEATURES).mapInArrow(decide, "page_id long, host string, path string, rule string, verdict string, block_score double")
