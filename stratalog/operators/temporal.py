"""Differences between two snapshots and their summary: symbols, effects, coverage, contracts, risk, leases, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import expressions as X

#: Order of risk levels, and the levels of the signals.
LEVELS = ("none", "unknown", "low", "moderate", "high")
SIGNALS = {
    "live_source_stale": "high", "live_source_unavailable": "high", "delta_uncertainty": "high", "open_evidence_conflicts": "high", "failed_or_stale_coverage": "high",
    "validity_evidence_omitted": "moderate", "change_evidence_omitted": "moderate", "disruptive_changes": "moderate", "unresolved_relationships": "moderate",
    "additive_changes": "low", "unchanged_contracts_unavailable": "unknown",
}
#: Kinds of change that count as disruptive.
DISRUPTIVE = ("removed", "renamed", "retargeted", "state_changed", "modified")


def symbol_states(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """symbol_key, path, file_id, semantic and evidence digest, outbound targets; lines have no part in it."""
    out = edges.groupBy(F.col("source").alias("symbol_key")).agg(F.array_join(F.array_sort(F.collect_set("target")), ",").alias("outbound"))
    digest = lambda *c: F.sha2(F.concat_ws("\u001f", *c), 256)
    rows = symbols.select("symbol_key", "path", "file_id", digest("kind", "display_name", "qualified_name", "signature").alias("semantic"), digest("method", F.col("confidence").cast("string")).alias("evidence"))
    return rows.join(out, "symbol_key", "left").withColumn("outbound", F.coalesce("outbound", F.lit("")))


def symbol_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """symbol_key, change, reason: path, then file, then semantic and evidence digest, then outbound targets."""
    old = before.select("symbol_key", *[F.col(c).alias(f"old_{c}") for c in ("path", "file_id", "semantic", "evidence", "outbound")], F.lit(True).alias("was"))
    new = after.withColumn("is", F.lit(True))
    differs = lambda c: F.col(c) != F.col(f"old_{c}")
    row = lambda change, reason: F.struct(F.lit(change).alias("change"), F.lit(reason).alias("reason"))
    what = F.when(F.col("was").isNull(), row("added", "symbol_added")).when(F.col("is").isNull(), row("removed", "symbol_removed")).when(differs("path"), row("renamed", "path_changed"))
    what = what.when(differs("file_id"), row("modified", "file_changed")).when(differs("semantic"), row("modified", "semantic_changed")).when(differs("evidence"), row("modified", "evidence_changed"))
    what = what.when(differs("outbound"), row("modified", "outbound_changed"))
    return old.join(new, "symbol_key", "full_outer").withColumn("what", what).where("what is not null").select("symbol_key", "what.*")


def state_changes(before: DataFrame, after: DataFrame, key: str, status: str, item: list[str]) -> DataFrame:
    """key, change: added, removed, state_changed (another set of statuses) or modified (other items under the same ones)."""
    side = lambda df, old, new: df.select(F.col(key).alias("_key"), F.col(status).alias("_status"), F.struct(*item).alias("_item"), F.lit(old).alias("_old"), F.lit(new).alias("_new"))
    # counted by item, then by status, then by key, after one shuffle by key; no key's items are gathered
    rows = side(before, 1, 0).unionByName(side(after, 0, 1)).repartition("_key")
    on = [F.col("_key"), F.when(F.col("_key").isNull(), F.col("_old")).alias("_lone")]  # a null key has no counterpart
    items = rows.groupBy(*on, "_status", "_item").agg(F.sum("_old").alias("_old"), F.sum("_new").alias("_new"))
    any_of = lambda: [F.max("_old").alias("_old"), F.max("_new").alias("_new")]
    states = items.groupBy("_key", "_lone", "_status").agg(*any_of(), F.max(F.col("_old") != F.col("_new")).alias("_differs"))
    moved = F.col("_status").isNotNull() & ((F.col("_old") > 0) != (F.col("_new") > 0))
    keys = states.groupBy("_key", "_lone").agg(*any_of(), F.max(moved).alias("_moved"), F.max("_differs").alias("_differs"))
    change = F.when(F.col("_old") == 0, "added").when(F.col("_new") == 0, "removed").when(F.col("_moved"), "state_changed").when(F.col("_differs"), "modified")
    return keys.select(F.col("_key").alias(key), change.alias("change")).where("change IS NOT NULL")


def unchanged_contracts(symbols: DataFrame, changes: DataFrame, old_coverage: DataFrame, new_coverage: DataFrame, live: DataFrame) -> DataFrame:
    """symbol_key, status: verified where nothing changed, coverage is complete on both sides and the live hash is the indexed
    one; else why that is uncertain. symbols: symbol_key, file_id, content_hash, old_provider, new_provider."""
    done = lambda df, name: df.where("status = 'complete'").select("file_id", F.lit(True).alias(name))
    rows = symbols.join(changes.select("symbol_key"), "symbol_key", "left_anti").join(done(old_coverage, "c1"), "file_id", "left").join(done(new_coverage, "c2"), "file_id", "left")
    rows = rows.join(live.select("file_id", "live_hash"), "file_id", "left")
    status = F.when(F.col("old_provider") != F.col("new_provider"), "provider_changed").when(F.col("c1").isNull() | F.col("c2").isNull(), "coverage_incomplete")
    status = status.when(F.col("live_hash").isNull(), "source_unavailable").when(F.col("live_hash") != F.col("content_hash"), "source_stale").otherwise("verified")
    return rows.select("symbol_key", status.alias("status"))


def category_totals(changes: DataFrame, categories: list[str], kept: int) -> DataFrame:
    """category, total, kept, omitted for every category, empty ones too."""
    every = changes.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    n = changes.groupBy("category").agg(F.count(F.lit(1)).alias("total"))
    total = F.coalesce("total", F.lit(0))
    return F.broadcast(every).join(n, "category", "left").select("category", total.alias("total"), F.least(total, F.lit(kept)).alias("kept"), F.greatest(total - kept, F.lit(0)).alias("omitted"))


def first_details(changes: DataFrame, kept: int) -> DataFrame:
    """The first `kept` changes of each category, with the category's full total."""
    w = Window.partitionBy("category")
    rows = changes.withColumn("place", F.row_number().over(w.orderBy("key", "change")))
    totals = changes.groupBy("category").agg(F.count(F.lit(1)).alias("total"))
    return rows.where(F.col("place") <= kept).drop("place").join(F.broadcast(totals), "category")  # a row a category


def omissions(decisions: DataFrame) -> DataFrame:
    """One row a request: how many candidates each reason left out, as a map in order of reason."""
    n = decisions.where("decision != 'selected'").groupBy("request", "decision").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("decision", "n")))
    return n.groupBy("request").agg(F.map_from_entries(pairs).alias("by_reason"), F.sum("n").alias("omitted"))


def risk_summary(counters: DataFrame) -> DataFrame:
    """code, level, count of the signals above 0, and the highest level, of one row with a column for each signal."""
    rank = {level: i for i, level in enumerate(LEVELS)}
    listed = F.array(*[F.struct(F.lit(code).alias("code"), F.lit(level).alias("level"), F.col(code).cast("long").alias("count"), F.lit(rank[level]).alias("rank")) for code, level in SIGNALS.items()])
    rows = counters.select(F.explode(listed).alias("s")).select("s.*").where("count > 0")
    return rows.withColumn("overall", F.get(F.array(*map(F.lit, LEVELS)), F.max("rank").over(Window.partitionBy()))).drop("rank")  # 11 rows


def sealed(changes: DataFrame) -> DataFrame:
    """The changes with an id each, and one digest of all of them: equal deltas have equal digests."""
    from .serving import ordered_digest

    key = F.concat_ws("\u001f", "category", "key", "change")
    digest = ordered_digest(changes, key).select("digest")
    return changes.withColumn("change_id", X.framed_id(F.col("category"), F.col("key"), F.col("change"))).crossJoin(F.broadcast(digest))


def bounded(changes: DataFrame, budget: int) -> DataFrame:
    """All changes if there are at most `budget`, else none: a count decides before anything is given."""
    n = changes.agg(F.count(F.lit(1)).alias("n"))
    return changes.crossJoin(F.broadcast(n)).where(F.col("n") <= budget).drop("n")


def verify_leases(leases: DataFrame, current: DataFrame) -> DataFrame:
    """lease_id, valid, broken: declared digests of dependencies against the ones now; a missing one breaks too."""
    rows = leases.join(current.select("dependency", F.col("digest").alias("now")), "dependency", "left")
    bad = F.coalesce(F.col("now") != F.col("digest"), F.lit(True))
    return rows.groupBy("lease_id").agg((F.count_if(bad) == 0).alias("valid"), F.count_if(bad).alias("broken"))


def invalid_changes(changes: DataFrame, kinds: list[str]) -> DataFrame:
    """Changes that a delta must not hold: unknown kinds, empty or repeated keys."""
    n = F.count(F.lit(1)).over(Window.partitionBy("category", "key"))
    why = F.when(~F.col("change").isin(kinds), "unknown_kind").when(F.coalesce("key", F.lit("")) == "", "empty_key").when(F.col("n") > 1, "repeated_key")
    return changes.withColumn("n", n).withColumn("why", why).where("why is not null").drop("n")


def reusable(documents: DataFrame, earlier: DataFrame) -> DataFrame:
    """document, reused_from: the latest complete or partial execution with the same fingerprint, if there is one."""
    good = earlier.where(F.col("status").isin("complete", "partial"))
    best = good.groupBy("fingerprint").agg(F.max_by("execution_id", F.struct("done_at", "execution_id")).alias("reused_from"))
    return documents.join(best, "fingerprint", "left")


def explain(changes: dict[str, DataFrame]) -> DataFrame:
    """All changes (key, change of each category) as category, key, change."""
    rows = [df.select(F.lit(category).alias("category"), "key", "change") for category, df in changes.items()]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def provider_set_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """key, change: one row if the providers (provider, version) of two generations are not the same, else none."""
    side = lambda df, name: df.select("provider", F.col("version").alias(name))
    both = side(before, "old").join(side(after, "new"), "provider", "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    return both.limit(1).select(F.lit("provider-set").alias("key"), F.lit("modified").alias("change"))


def changed_sources(changes: DataFrame, symbols: DataFrame, live: DataFrame) -> DataFrame:
    """symbol_key, status of changed symbols whose file's bytes now are not those indexed: source_stale or source_unavailable."""
    rows = changes.select("symbol_key").join(symbols.select("symbol_key", "file_id", "content_hash"), "symbol_key").join(live.select("file_id", "live_hash"), "file_id", "left")
    status = F.when(F.col("live_hash").isNull(), "source_unavailable").when(F.col("live_hash") != F.col("content_hash"), "source_stale")
    return rows.select("symbol_key", status.alias("status")).where("status IS NOT NULL")


def disruptive(change: Column) -> Column:
    return change.isin(*DISRUPTIVE)
