"""URL filtering: rules first, then logistic regression on hashed character n-grams of host and path.

Rules are `host/path` prefixes with a verdict; a rule fits its host and all subdomains where the path begins with the
rule's, and the longest fitting rule wins. Without one, a model decides: the distinct n-grams of `host` + `path`
(host between a begin and an end mark) are hashed to `buckets` features by md5, and the integer weights of the
features present are summed. The model is trained on a small labelled URL table (at most MAX_LABELLED rows, an error
beyond it) by full-batch gradient descent, so training and scoring are the same on every run and engine.

A null url, or one without "://", has an empty host and path: no rule fits and the intercept decides. Very long urls are
judged whole. Every row is judged by itself, repeated ones too; of rules of equal length the earlier wins. Empty tables
give empty results, and no rules mean that the model decides everything. A column of the input that is called host, path,
rule or verdict is kept as `input_<name>`.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import given_names, own_names

MAX_LABELLED = 100_000
#: Weights are kept as integers of this many parts of one, so that sums are exact.
SCALE = 10_000


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) as the columns below have them."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: min([i for c in "?#" if (i := path.find(c)) >= 0], default=len(path))]


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_host_and_path(df: DataFrame, url: str = "url") -> DataFrame:
    u = F.coalesce(F.col(url), F.lit(""))
    host = _ascii_lower(F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1))
    path = F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return df.withColumn("host", host).withColumn("path", path)


def matching_rule(rules: list[Rule]) -> Column:
    """The name of the longest rule that fits, else null; equal lengths: the earlier."""
    out = None
    for r in sorted(rules, key=lambda r: -len(r.name)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        out = F.when(fits, F.lit(r.name)) if out is None else out.when(fits, F.lit(r.name))
    return F.lit(None).cast("string") if out is None else out


def grams(host: str, path: str, sizes: tuple[int, ...]) -> set[str]:
    text = f"^{host}${path}"
    return {text[i : i + n] for n in sizes for i in range(len(text) - n + 1)}


def bucket(gram: str, buckets: int) -> int:
    return int(hashlib.md5(gram.encode()).hexdigest()[:4], 16) % buckets


@dataclass(frozen=True)
class UrlModel:
    intercept: int
    weights: tuple[int, ...]
    sizes: tuple[int, ...]

    def score(self, host: str, path: str) -> int:
        n = len(self.weights)
        return self.intercept + sum(self.weights[bucket(g, n)] for g in grams(host, path, self.sizes))

    def blocks(self) -> Column:
        """Whether the model blocks host and path; one projection, no Python on executors."""
        text = F.concat(F.lit("^"), F.col("host"), F.lit("$"), F.col("path"))
        table = F.split(F.lit(",".join(map(str, self.weights))), ",").cast("array<bigint>")  # folded to one literal

        def of_size(n: int) -> Column:
            return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))

        pieces = F.flatten(F.array(*[of_size(n) for n in self.sizes]))
        known = F.filter(F.array_distinct(pieces), lambda g: F.length(g) >= min(self.sizes))
        total = F.aggregate(known, F.lit(self.intercept).cast("long"), lambda acc, g: acc + F.get(table, (F.conv(F.substring(F.md5(g.cast("binary")), 1, 4), 16, 10).cast("int") % len(self.weights))))
        return total > 0


def train(labelled: list[tuple[str, int]], buckets: int = 4096, sizes: tuple[int, ...] = (3, 4, 5), steps: int = 400, rate: float = 0.5, ridge: float = 1e-3) -> UrlModel:
    """labelled: (url, 1 to block or 0 to allow). Features are presence of hashed n-grams, scaled by their number."""
    if len(labelled) > MAX_LABELLED:
        raise ValueError(f"more than {MAX_LABELLED} labelled urls")
    x = np.zeros((len(labelled), buckets))
    for i, (url, _) in enumerate(labelled):
        for g in grams(*split_url(url), sizes):
            x[i, bucket(g, buckets)] += 1
    y = np.array([label for _, label in labelled], float)
    # balanced classes: each has half of the weight
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    w, b = np.zeros(buckets), 0.0
    scale = 1 / math.sqrt(max(1.0, x.sum(1).mean())) if len(labelled) else 1.0
    x = x * scale
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        g = (p - y) * share
        w -= rate * 10 * (x.T @ g + ridge * w)
        b -= rate * g.sum()
    return UrlModel(round(b * SCALE), tuple(int(v) for v in np.round(w * scale * SCALE)), sizes)


RESULTS = ("host", "path", "rule", "verdict")


def filter_urls(pages: DataFrame, rules: list[Rule], model: UrlModel, url: str = "url") -> DataFrame:
    """The rows with host, path, rule and verdict (`allow` or `block`) added."""
    plain, named = own_names(pages)
    out = with_host_and_path(plain, named[url]).withColumn("rule", matching_rule(rules))
    by_rule = F.lit(None).cast("string")
    for r in rules:
        by_rule = F.when(F.col("rule") == r.name, F.lit(r.verdict)).otherwise(by_rule)
    out = out.withColumn("verdict", F.coalesce(by_rule, F.when(model.blocks(), F.lit("block")).otherwise(F.lit("allow"))))
    taken = set(named)

    def free(name: str) -> str:
        while name in taken or name in RESULTS:
            name = f"input_{name}"
        taken.add(name)
        return name

    kept = {free(c) if c in RESULTS else c: u for c, u in named.items()}
    return given_names(out, kept, *map(F.col, RESULTS))
