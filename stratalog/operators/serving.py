"""The serving projection: symbol cards, edges, coverage rollups, and whether a build can be served."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import expressions as X
from .find import OPEN_CONFLICT, UNRESOLVED


def preferred_symbols(facts: DataFrame, exact_too: bool = True) -> DataFrame:
    """One fact of each symbol: semantic, then exact (if asked for), then confidence, then the least fact id.

    The least struct by key, combined in the tasks; no window over a key's facts.
    """
    order = [F.col("method") != "semantic"] + ([F.col("method") != "exact"] if exact_too else []) + [-F.col("confidence"), F.col("fact_id")]
    names = [c for c in facts.columns if c != "symbol_key"]
    best = F.min_by(F.struct(*names), F.struct(*order)).alias("best")
    return facts.groupBy("symbol_key").agg(best).select("symbol_key", "best.*")


def last_fact(facts: DataFrame) -> DataFrame:
    """The delta's variant: the greatest fact id of each symbol."""
    names = [c for c in facts.columns if c != "symbol_key"]
    return facts.groupBy("symbol_key").agg(F.max_by(F.struct(*names), "fact_id").alias("best")).select("symbol_key", "best.*")


COUNTS = ("callers", "callees", "references", "tests", "configs", "effects", "conflicts", "unresolved")


def symbol_counts(symbols: DataFrame, edges: DataFrame, effects: DataFrame, conflicts: DataFrame) -> DataFrame:
    """The eight counts of each symbol.

    Every edge gives (symbol, role) rows, a self loop counting once for `tests` and `configs`; one grouped count of all.
    """
    kind, both = F.col("type"), F.array_distinct(F.array("source", "target"))
    one = lambda key, role: F.struct(key.alias("symbol_key"), F.lit(role).alias("role"))
    pair = lambda role: F.transform(both, lambda k: one(k, role))
    none = F.array().cast("array<struct<symbol_key: string, role: string>>")
    roles = F.when(kind == "calls", F.array(one(F.col("target"), "callers"), one(F.col("source"), "callees"))).when(kind == "references", F.array(one(F.col("target"), "references")))
    roles = roles.when(kind == "tests", pair("tests")).when(kind == "configures", pair("configs")).otherwise(none)
    lost = F.when(F.col("status").isin(*UNRESOLVED), F.array(one(F.col("source"), "unresolved"))).otherwise(none)
    rows = edges.select(F.explode(F.concat(roles, lost)).alias("x")).select("x.*")
    rows = rows.unionByName(effects.select(F.col("subject").alias("symbol_key"), F.lit("effects").alias("role")))
    rows = rows.unionByName(conflicts.where(F.col("status").isin(*OPEN_CONFLICT)).select(F.col("subject_key").alias("symbol_key"), F.lit("conflicts").alias("role")))
    counted = rows.groupBy("symbol_key").agg(*[F.count_if(F.col("role") == c).alias(c) for c in COUNTS])
    return symbols.select("symbol_key").distinct().join(counted, "symbol_key", "left").select("symbol_key", *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS])


def coverage_rollup(coverage: DataFrame, scopes: dict[str, Column]) -> DataFrame:
    """scope_kind, scope_key and counts by status; `stale` counts as failed, and the workspace row is there even if empty."""
    pairs = F.array(*[F.struct(F.lit(k).alias("scope_kind"), v.alias("scope_key")) for k, v in scopes.items()])
    rows = coverage.select("status", F.explode(pairs).alias("s")).select("status", "s.*")
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    counts = [n("complete").alias("complete"), n("partial").alias("partial"), n("unsupported").alias("unsupported"), n("excluded").alias("excluded"), n("failed", "stale").alias("failed")]
    each = rows.groupBy("scope_kind", "scope_key").agg(F.count(F.lit(1)).alias("eligible"), *counts)
    whole = coverage.agg(F.count(F.lit(1)).alias("eligible"), *counts).select(F.lit("workspace").alias("scope_kind"), F.lit("").alias("scope_key"), "*")
    return each.unionByName(whole)


def ordered_digest(rows: DataFrame, key: Column, groups: int = 4096) -> DataFrame:
    """One row, n and digest: sha256 over all keys in order, as digests of key ranges by hash that are digested again.

    No task holds more than one range, and the driver none.
    """
    parts = rows.select(key.alias("k")).withColumn("g", F.pmod(F.xxhash64("k"), F.lit(groups)))
    each = parts.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("k")), "\n"), 256).alias("d"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "d"))), lambda x: x["d"]), "")
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sha2(joined, 256).alias("digest"))


def cards(facts: DataFrame, counts: DataFrame, coverage: DataFrame) -> DataFrame:
    """One card for each symbol: its preferred fact, counts, coverage and cost, and a hash of them."""
    known = coverage.where("status != 'unsupported'").select("file_id", F.col("status").alias("coverage_state"))
    rows = preferred_symbols(facts).join(counts, "symbol_key").join(known, "file_id", "left")
    rows = rows.withColumns({"coverage_state": F.coalesce("coverage_state", F.lit("complete")), "tokens": X.token_estimate(F.col("end_byte") - F.col("start_byte"))})
    body = ["symbol_key", "fact_id", *COUNTS, "coverage_state", "tokens"]
    return rows.select(*body, F.sha2(F.concat_ws("\u001f", *body), 256).alias("card_hash"))


def adjacency(edges: DataFrame, outbound: bool, types: list[str], limit: int) -> DataFrame:
    """The first edges of each node, resolved ones first, then by fact id; inbound ones count only where resolved."""
    side = "source" if outbound else "target"
    rows = edges.where(F.col("type").isin(*types))
    if not outbound:
        rows = rows.where("status = 'resolved_symbol'")
    order = Window.partitionBy(side).orderBy(~F.col("status").startswith("resolved_"), "fact_id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def first_few(rows: DataFrame, key: str, order: list[str], kept: int) -> DataFrame:
    """At most `kept` rows of each key and whether there were more: reads kept + 1 of each."""
    w = Window.partitionBy(key)
    found = rows.withColumn("place", F.row_number().over(w.orderBy(*order))).where(F.col("place") <= kept + 1)
    return found.withColumn("truncated", F.max("place").over(w) > kept).where(F.col("place") <= kept)


def merge_slices(first: DataFrame, second: DataFrame, limit: int) -> DataFrame:
    """Two slices (priority, id) as one: by priority and then id, each id once at its best priority, cut to `limit`."""
    best = first.unionByName(second).groupBy("id").agg(F.min("priority").alias("priority"))
    return best.orderBy("priority", "id").limit(limit).select("priority", "id")
