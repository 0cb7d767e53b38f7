"""Context compilation: seeds, scored packets, budgets with a work ledger, relationship frontiers, role sufficiency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import policy
from .graph import cut


def canonical_seeds(seeds: DataFrame) -> DataFrame:
    """request, seeds: sorted and without repeats, whatever order they came in."""
    return seeds.groupBy("request").agg(F.array_sort(F.collect_set("seed")).alias("seeds"))


def resolve_seeds(seeds: DataFrame, symbols: DataFrame, paths: DataFrame | None = None, words: DataFrame | None = None) -> DataFrame:
    """request, seed, stage, symbol_key, uncertain.

    Stages in order: canonical key, path (if `paths` are given), qualified name, display name; a seed takes the first
    that matches. An ambiguous display name gives nothing in the first form; where `words` (seed word, symbol_key) are
    given, it and phrase hits are kept as uncertain candidates.
    """
    asked = seeds.select("seed").distinct()
    stage = lambda df, key, rank, name: df.select(F.col(key).alias("seed"), "symbol_key").distinct().select("seed", "symbol_key", F.lit(rank).alias("rank"), F.lit(name).alias("stage"))
    found = stage(symbols.withColumn("own", F.col("symbol_key")), "own", 0, "canonical")
    if paths is not None:
        found = found.unionByName(stage(paths, "path", 1, "path"))
    found = found.unionByName(stage(symbols, "qualified_name", 2, "qualified")).unionByName(stage(symbols, "display_name", 3, "display"))
    if words is not None:
        found = found.unionByName(stage(words, "seed", 4, "phrase"))
    # a seed is settled once, however many requests have it; only what is left of it meets them
    found = cut(asked.join(found, "seed"), "stages")
    n = found.groupBy("seed", "rank").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("seed").agg(F.min(F.struct("rank", "n")).alias("best")).select("seed", "best.*")
    uncertain = (F.col("stage") == "phrase") | ((F.col("stage") == "display") & (F.col("n") > 1))
    kept = found.join(best, ["seed", "rank"]).withColumn("uncertain", uncertain)
    if words is None:
        kept = kept.where(~F.col("uncertain"))
    return seeds.select("request", "seed").distinct().join(kept, "seed").select("request", "seed", "stage", "symbol_key", "uncertain")


def tests_of(seeds: DataFrame, files: DataFrame) -> DataFrame:
    """seed, path of the files whose path holds `test` before or after the seed's base name. Seeds are a request's: few."""
    base = F.regexp_replace(F.element_at(F.split("seed", "/"), -1), r"\.[^.]*$", "")
    s = F.broadcast(seeds.select("seed", F.lower(base).alias("base")).distinct())
    low = F.lower("path")
    hit = F.like(low, F.concat(F.lit("%test%"), F.col("base"), F.lit("%"))) | F.like(low, F.concat(F.lit("%"), F.col("base"), F.lit("%test%")))
    return files.where(low.contains("test")).join(s, hit).select("seed", "path")


def rank_candidates(scores: DataFrame) -> DataFrame:
    """request, key, path, score, rank: contributions added up; by score, then distance, path and key."""
    total = scores.groupBy("request", "key", "path").agg(F.sum("points").cast("long").alias("score"), F.min("distance").alias("distance"))
    w = Window.partitionBy("request").orderBy(F.desc("score"), "distance", "path", "key")
    return total.withColumn("rank", F.row_number().over(w).cast("long"))


def one_hop_points(kind: Column) -> Column:
    """What a neighbour's edge adds to its score."""
    return F.when(kind == "calls", 50).when(kind == "imports", 40).otherwise(20)


def role_and_reason(kind: Column, inbound: Column, neighbour_is_symbol: Column, artifact_role: Column) -> Column:
    """struct<role, reason> of a neighbour: its artifact's role first, then the edge's type and direction."""
    pair = lambda role, reason: F.struct(F.lit(role).alias("role"), F.lit(reason).alias("reason"))
    tests, configs = pair("test_contract", "test_relation"), pair("configuration_input", "config_relation")
    toward = F.when((kind == "calls") & neighbour_is_symbol, pair("direct_dependent", "direct_caller")).when(kind == "tests", tests).when(kind == "configures", configs)
    toward = toward.otherwise(pair("direct_dependent", "task_recipe_requirement"))
    away = F.when(kind == "calls", pair("direct_dependency", "direct_callee")).when(kind == "tests", tests).when(kind == "configures", configs)
    away = away.when(kind.isin("implements", "extends"), pair("type_contract", "implementation_relation")).when(kind == "imports", pair("direct_dependency", "import_neighbor"))
    away = away.otherwise(pair("direct_dependency", "task_recipe_requirement"))
    return F.when(artifact_role == "test_contract", tests).when(artifact_role == "configuration_input", configs).when(inbound, toward).otherwise(away)


def artifact_role(artifact_class: Column, is_test: Column) -> Column:
    config = artifact_class.isin("configuration", "build_manifest", "infrastructure")
    return F.when(is_test | (artifact_class == "test"), "test_contract").when(config, "configuration_input")


def recipes(spark: SparkSession) -> DataFrame:
    """One row a task kind."""
    rows = [(k, *v) for k, v in policy.RECIPES.items()]
    return spark.createDataFrame(rows, "task_kind string, callers boolean, callees boolean, tests boolean, configs boolean, max_distance int")


def required_roles(spark: SparkSession) -> DataFrame:
    """Every kind with every role, and whether it must be filled."""
    rows = [(k, r, r in need) for k, need in policy.REQUIRED_ROLES.items() for r in policy.ROLES]
    return spark.createDataFrame(rows, "task_kind string, role string, required boolean")


def frontier(edges: DataFrame, seeds: DataFrame, kinds: list[str], max_depth: int, per_node: int) -> DataFrame:
    """request, depth, source, type, target, state: a breadth-first walk over symbol edges.

    A node gives its first `per_node` edges (resolved ones first, then by fact id); resolved targets are visited once a
    request, the others are `deferred` uncertainty. Each level is written and read again, so that plans stay short.
    """
    rows = edges.where(F.col("type").isin(*kinds))
    w = Window.partitionBy("source").orderBy(~F.col("status").startswith("resolved_"), "fact_id")
    few = rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_node).drop("place")
    if max_depth > 1:
        few = cut(few.select("source", "type", "target", "fact_id", "status"), "frontier-edges")  # else each level makes all edges again
    at = seeds.select("request", F.col("seed").alias("node")).distinct()
    seen, out = at, None
    for depth in range(1, max_depth + 1):
        # after one window the edges lie by their source already, so that nodes of any number needn't be broadcast
        step = (at if max_depth > 1 else at.hint("merge")).join(few, F.col("node") == F.col("source")).select("request", F.lit(depth).alias("depth"), "source", "type", "target", "fact_id", F.when(F.col("status").startswith("resolved_"), "followed").otherwise("deferred").alias("state"))
        step = cut(step, "frontier")
        out = step if out is None else out.unionByName(step)
        at = step.where("state = 'followed'").select("request", F.col("target").alias("node")).distinct().join(seen, ["request", "node"], "left_anti")
        if depth < max_depth:
            at = cut(at, "frontier-nodes")
            seen = seen.unionByName(at)
    return out


def ledger_rows(remaining: int, max_records: int) -> int:
    """Rows that one lookup of a closure may read of what is left of the work ledger."""
    return max(0, min((remaining - 2) // 5, max_records))


def relationship_closure(edges: DataFrame, seeds: DataFrame, kinds: list[str], max_depth: int, max_records: int, max_work: int) -> tuple[DataFrame, int]:
    """frontier() under one ledger of all levels: each level may read ledger_rows() of a node and is charged for what it
    found; the walk ends where nothing can be paid. Gives the edges and the work that is left."""
    left, out, depth = max_work, None, 0
    at, seen = seeds.select("request", F.col("seed").alias("seed")).distinct(), None
    while depth < max_depth:
        rows = ledger_rows(left, max_records)
        if rows == 0:
            break
        depth += 1
        step = cut(frontier(edges, at, kinds, 1, rows).withColumn("depth", F.lit(depth)), "closure")
        left -= min(left, step.count() + 2)
        out = step if out is None else out.unionByName(step)
        seen = at if seen is None else seen.unionByName(at)
        at = cut(step.where("state = 'followed'").select("request", F.col("target").alias("seed")).distinct().join(seen, ["request", "seed"], "left_anti"), "closure-nodes")
    if out is None:
        out = frontier(edges.limit(0), seeds, kinds, 1, 1)
    return out, left


def effect_closure(selected: DataFrame, effects: DataFrame, conflicts: DataFrame) -> DataFrame:
    """request, effect_id, subject, conflicted: effects of the selected symbols; conflicts that count are open, preferred or unresolved."""
    bad = conflicts.where(F.col("status").isin("open", "preferred_with_conflict", "unresolved")).select(F.col("subject_key").alias("subject")).distinct().withColumn("conflicted", F.lit(True))
    # keys as text are far larger than the key column by which Spark reckons them, so they are not broadcast at any size
    rows = selected.select("request", F.col("symbol_key").alias("subject")).distinct().hint("merge").join(effects, "subject")
    return rows.join(bad, "subject", "left").select("request", "effect_id", "subject", "effect_type", F.coalesce("conflicted", F.lit(False)).alias("conflicted"))


def role_sufficiency(matrix: DataFrame, items: DataFrame, deficits: DataFrame) -> DataFrame:
    """request, role, required, state, reason, items.

    matrix: request, role, required. items: request, role, item, reason (null where its evidence is good). deficits:
    request, role, reason, priority. A role is satisfied by items without a reason where none is recorded; else the
    reason with the least priority says the state; an empty role is missing if it is required, else unavailable.
    """
    own = items.groupBy("request", "role").agg(F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"), F.min("reason").alias("weak"))
    said = deficits.groupBy("request", "role").agg(F.min_by("reason", "priority").alias("recorded"))
    rows = matrix.join(own.hint("merge"), ["request", "role"], "left").join(said.hint("merge"), ["request", "role"], "left")
    reason = F.coalesce("weak", "recorded")
    state = F.when(F.col("items").isNotNull() & reason.isNull(), "satisfied").when(reason.isNotNull(), F.concat(F.lit("deficient_"), reason)).when(F.col("required"), "missing").otherwise("unavailable")
    why = F.when(F.col("items").isNotNull() & reason.isNull(), F.lit(None)).when(reason.isNotNull(), reason).when(F.col("required"), "missing_required_role").otherwise("unavailable_evidence")
    return rows.select("request", "role", "required", state.alias("state"), why.alias("reason"), F.coalesce("items", F.lit("")).alias("items"))


def coverage_claim(complete: Column, partial: Column, unsupported: Column, excluded: Column, failed: Column) -> Column:
    """none (nothing eligible), exhaustive_within_scope (no deficit) or bounded."""
    eligible = complete + partial + unsupported + excluded + failed
    return F.when(eligible == 0, "none").when((partial == 0) & (failed == 0) & (unsupported == 0), "exhaustive_within_scope").otherwise("bounded")


def seal_status(sources: DataFrame) -> DataFrame:
    """request, status: complete where every source verifies; else partial if a primary one does, else blocked, by the worst state."""
    bad = F.col("state") != "verified"
    primary = F.max((F.col("state") == "verified") & F.col("is_primary"))
    worst = F.max_by("state", F.when(F.col("state") == "stale", 2).when(bad, 1).otherwise(0))
    status = F.when(F.count_if(bad) == 0, "complete").when(primary, "partial").otherwise("blocked")
    return sources.groupBy("request").agg(status.alias("status"), F.when(F.count_if(bad) > 0, worst).alias("worst"))


def context_hash(items: DataFrame) -> DataFrame:
    """request, n, context_hash: a digest of a request's items in rank order."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"])
    return items.groupBy("request").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(listed, "\n"), 256).alias("context_hash"))
