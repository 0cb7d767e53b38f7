"""Budget selection: candidates in rank order; one that breaks a limit is skipped, later ones may still fit.

A request of any length is cut into ranges of ranks. Each range has a summary: its rows, the sum and the least of their work,
and the least bytes and tokens that could be selected in it. A walk over the summaries, in order, passes ranges whose outcome
they settle: nothing in them can be paid, or all of it can and nothing fits. It stops at a range where something may be
selected; that range's rows (and those of the next few) are folded one by one, and the walk goes on from what they left. What
was passed is decided afterwards, by all tasks at once. With the width of ranges growing as the root of the longest request,
a task holds as many rows or summaries as that root, and the rounds follow the number of selections and not of candidates.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import cut

#: Ranks of a range at least, and how many ranges one visit folds.
RANGE = 10_000
VISIT = 4
_TOTALS = ("spent", "n", "doubtful", "size", "used")
_KINDS = ", ".join(f"{c} long" for c in _TOTALS)


@dataclass(frozen=True)
class Limits:
    """records: certain ones at most; reserve: uncertain ones; work: the ledger, charged first; depth: the greatest."""

    records: int
    bytes: int
    tokens: int
    reserve: int = 0
    depth: int = 2**31
    work: int = 2**62


class _Fold:
    """The running totals of one request."""

    __slots__ = (*_TOTALS, "limits")

    def __init__(self, limits: Limits, totals=(0, 0, 0, 0, 0)):
        self.limits = limits
        self.spent, self.n, self.doubtful, self.size, self.used = totals

    def totals(self) -> tuple[int, ...]:
        return self.spent, self.n, self.doubtful, self.size, self.used

    def take(self, work: int, depth: int, unsure: bool, size: int, tokens: int) -> str:
        """The decision on the next candidate: the first limit that it breaks, or `selected`."""
        most = self.limits
        if self.spent + work > most.work:
            return "work_units"  # it costs nothing; any other is paid for
        self.spent += work
        if depth > most.depth:
            return "depth"
        if unsure and self.doubtful >= most.reserve:
            return "uncertainty_reserve"
        if not unsure and self.n >= most.records:
            return "records"
        if self.size + size > most.bytes:
            return "bytes"
        if self.used + tokens > most.tokens:
            return "tokens"
        self.size, self.used = self.size + size, self.used + tokens
        if unsure:
            self.doubtful += 1
        else:
            self.n += 1
        return "selected"

    def may_select(self, sure: tuple, unsure: tuple) -> bool:
        """Whether a row of a range with these least (bytes, tokens) might fit; null where it has no such row."""
        fits = lambda least: least[0] is not None and self.size + least[0] <= self.limits.bytes and self.used + least[1] <= self.limits.tokens
        return (self.n < self.limits.records and fits(sure)) or (self.doubtful < self.limits.reserve and fits(unsure))


def _folded(rows: DataFrame, limits: Limits, kind: str) -> DataFrame:
    """rows: request, rank, item, work, depth, uncertain, bytes, tokens and the totals before each request's first row.

    The rows of a request are sorted in one partition and streamed."""
    names = ["request", "work", "depth", "uncertain", "bytes", "tokens", *[f"s_{t}" for t in _TOTALS]]

    def run(batches):
        request, fold = object(), None
        for batch in batches:
            decisions, totals = [], []
            for g, work, depth, unsure, size, tokens, *start in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if fold is None or g != request:
                    request, fold = g, _Fold(limits, start)
                decisions.append(fold.take(work, depth, unsure, size, tokens))
                totals.append(fold.totals())
            out = [batch.column(c) for c in ("request", "rank", "item")] + [pa.array(decisions, pa.string())]
            columns = list(zip(*totals, strict=True)) or [[] for _ in _TOTALS]
            yield pa.RecordBatch.from_arrays([*out, *[pa.array(c, pa.int64()) for c in columns]], names=["request", "rank", "item", "decision", *_TOTALS])

    return rows.repartition("request").sortWithinPartitions("request", "rank").mapInArrow(run, f"request {kind}, rank long, item string, decision string, {_KINDS}")


def _walked(summaries: DataFrame, limits: Limits, kind: str) -> DataFrame:
    """request, r, how (`unpaid`, `passed`, `visit`) and the totals at the range's start, up to the next visit of each request."""
    names = ["request", "r", "work", "least_work", "sure_bytes", "sure_tokens", "unsure_bytes", "unsure_tokens", *[f"s_{t}" for t in _TOTALS]]

    def run(batches):
        request, fold, visits = object(), None, 0
        for batch in batches:
            found = []
            for g, r, work, least, sb, st, ub, ut, *start in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if fold is None or g != request:
                    request, fold, visits = g, _Fold(limits, start), 0
                if visits:  # the ranges behind a visited one go with it, up to VISIT of them
                    how = "visit" if visits < VISIT else None
                elif fold.spent + least > limits.work:
                    how = "unpaid"
                elif fold.spent + work <= limits.work and not fold.may_select((sb, st), (ub, ut)):
                    how = "passed"
                else:
                    how = "visit"
                if how:
                    found.append((g, r, how, *fold.totals()))
                visits += how == "visit"
                if how == "passed":
                    fold.spent += work
            columns = list(zip(*found, strict=True)) or [[] for _ in range(8)]
            types = [batch.schema.field("request").type, pa.int64(), pa.string(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["request", "r", "how", *_TOTALS])

    return summaries.repartition("request").sortWithinPartitions("request", "r").mapInArrow(run, f"request {kind}, r long, how string, {_KINDS}")


def fold(candidates: DataFrame, limits: Limits, width: int = RANGE, start: DataFrame | None = None) -> DataFrame:
    """request, rank, item, decision and the totals after each candidate: spent, n, doubtful, size, used.

    candidates: request, rank (unique in a request, from 1), item, work (0 or more), depth, uncertain, bytes, tokens. start: the
    totals of each request before its first candidate, as `state_after` gives them; requests that aren't in it begin at zero.
    """
    long = [F.col(c).cast("long").alias(c) for c in ("rank", "work", "depth", "bytes", "tokens")]
    rows = candidates.select("request", F.col("item").cast("string").alias("item"), "uncertain", *long)
    kind = rows.schema["request"].dataType.simpleString()
    begin = {f"s_{t}": F.lit(0).cast("long") for t in _TOTALS}
    if start is not None:
        rows = rows.hint("merge").join(start.select("request", *[F.col(t).alias(f"s_{t}") for t in _TOTALS]), "request", "left")
        begin = {c: F.coalesce(c, F.lit(0)) for c in begin}
    rows = cut(rows.withColumns(begin), "budget-rows")
    longest = rows.groupBy("request").count().agg(F.max("count").alias("n")).first().n or 0
    if longest <= width:
        return _folded(rows, limits, kind)

    width = max(width, math.isqrt(longest))
    rows = rows.withColumn("r", F.expr(f"(rank - 1) div {width}"))
    least = lambda unsure, c: F.min(F.when((F.col("depth") <= limits.depth) & (F.col("uncertain") == unsure), F.col(c)))
    ends = [least(u, c).alias(f"{'unsure' if u else 'sure'}_{c}") for u in (False, True) for c in ("bytes", "tokens")]
    summaries = cut(rows.groupBy("request", "r").agg(F.sum("work").alias("work"), F.min("work").alias("least_work"), *ends), "budget-ranges")

    state = rows.groupBy("request").agg(F.lit(0).cast("long").alias("next"), *[F.max(c).alias(c) for c in begin])
    rows = rows.drop(*begin)
    settled, visited = [], []
    while True:
        left = summaries.join(state, "request").where(F.col("r") >= F.col("next"))
        walk = cut(_walked(left, limits, kind), "budget-walk")
        settled.append(walk.where("how != 'visit'"))
        visits = walk.where("how = 'visit'")
        if visits.isEmpty():
            break
        begun = visits.groupBy("request").agg(*[F.min_by(t, "r").alias(f"s_{t}") for t in _TOTALS])
        some = rows.join(visits.select("request", "r"), ["request", "r"]).join(begun, "request")
        done = cut(_folded(some.select(*[c for c in some.columns if c != "r"]), limits, kind), "budget-folded")
        visited.append(done)
        after = done.groupBy("request").agg(*[F.max_by(t, "rank").alias(f"s_{t}") for t in _TOTALS])
        state = cut(after.join(visits.groupBy("request").agg((F.max("r") + 1).alias("next")), "request"), "budget-state")

    passed = settled[0]
    for more in settled[1:]:
        passed = passed.unionByName(more)
    # nothing was selected in these ranges, so their totals, work apart, are those of their start
    some = rows.join(passed, ["request", "r"])
    before = F.sum("work").over(Window.partitionBy("request", "r").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    paid = F.col("how") == "passed"
    why = F.when(~paid, "work_units").when(F.col("depth") > limits.depth, "depth").when(F.col("uncertain") & (F.col("doubtful") >= limits.reserve), "uncertainty_reserve")
    why = why.when(~F.col("uncertain") & (F.col("n") >= limits.records), "records").when(F.col("size") + F.col("bytes") > limits.bytes, "bytes").otherwise("tokens")
    out = some.select("request", "rank", "item", why.alias("decision"), (F.col("spent") + F.when(paid, before).otherwise(0)).alias("spent"), *_TOTALS[1:])
    for done in visited:
        out = out.unionByName(done)
    return out


def state_after(folded: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """request and its totals after its last candidate; requests of `start` without candidates keep theirs."""
    last = folded.groupBy("request").agg(F.max_by(F.struct(*_TOTALS), "rank").alias("t")).select("request", "t.*")
    if start is None:
        return last
    return last.unionByName(start.select("request", *_TOTALS).join(last.select("request"), "request", "left_anti"))


def select(candidates: DataFrame, limits: Limits, width: int = RANGE) -> DataFrame:
    """request, rank, item, decision, ledger (work spent so far): `fold` from zero."""
    return fold(candidates, limits, width).select("request", "rank", "item", "decision", F.col("spent").alias("ledger"))


def greedy_select(candidates: DataFrame, group: str, max_records: int, max_bytes: int, max_tokens: int, width: int = RANGE) -> DataFrame:
    """group, rank, item, decision (`selected`, or the first limit broken: records, bytes, tokens).

    candidates: group, rank (unique in a group), item, bytes, tokens.
    """
    none = {"work": F.lit(0), "depth": F.lit(0), "uncertain": F.lit(False)}
    rows = candidates.select(F.col(group).alias("request"), "rank", "item", "bytes", "tokens").withColumns(none)
    return select(rows, Limits(max_records, max_bytes, max_tokens), width).drop("ledger").withColumnRenamed("request", group)


def deep_budget(candidates: DataFrame, max_records: int, max_bytes: int, max_tokens: int, max_depth: int, max_work: int, reserve_percent: int, width: int = RANGE) -> DataFrame:
    """request, rank, item, decision, ledger: the work ledger first, then depth, the uncertainty reserve, records, bytes, tokens.

    A candidate that the ledger can't pay is `work_units` and costs nothing; any other is paid for, even if it is left out.
    """
    reserve = math.ceil(max_records * reserve_percent / 100)
    return select(candidates, Limits(max_records - reserve, max_bytes, max_tokens, reserve, max_depth, max_work), width)
