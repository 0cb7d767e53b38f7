"""Resolution of semantic relations, evidence clusters, and their preference order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import expressions as X

#: Relation types that a provider asserts as aliases, and the candidates that are listed at most.
ALIASES = ("IMPLEMENTS", "TYPE_DEFINITION", "DEFINED_BY")
MAX_CANDIDATES = 16


def resolve(relations: DataFrame, symbols: DataFrame, files: DataFrame, same_execution: DataFrame | None = None) -> DataFrame:
    """The relations with status, resolved_kind, resolved_value, reason, confidence and candidates.

    relations: fact_id, type, ref_kind, target, reason_in, confidence_in, method (only `semantic` ones are resolved).
    symbols: symbol_key, display_name. files: path of files that own a symbol. Precedence: composed span, the same
    execution, a known key, an asserted alias that is not external, a known file, external, an ambiguous display name.
    """
    rows = relations.where("method = 'semantic'")
    known = symbols.select(F.col("symbol_key").alias("target")).distinct().withColumn("is_symbol", F.lit(True))
    owned = files.select(F.col("path").alias("target")).distinct().withColumn("is_file", F.lit(True))
    # of a name that any number of symbols share, the first keys only are gathered
    pairs = symbols.select("display_name", "symbol_key").distinct()
    place = F.row_number().over(Window.partitionBy("display_name").orderBy("symbol_key"))
    by_name = pairs.withColumn("place", place).where(F.col("place") <= MAX_CANDIDATES).groupBy(F.col("display_name").alias("shown")).agg(F.array_sort(F.collect_list("symbol_key")).alias("keys")).where(F.size("keys") > 1)
    rows = rows.join(known, "target", "left").join(owned, "target", "left")
    rows = rows.withColumn("shown", X.display_name(F.col("target"))).join(by_name, "shown", "left")
    if same_execution is not None:
        rows = rows.join(same_execution.select("target", F.lit(True).alias("same")).distinct(), "target", "left")
    else:
        rows = rows.withColumn("same", F.lit(None).cast("boolean"))
    external = F.col("ref_kind") == "external_symbol"
    cases = [
        ((F.col("reason_in") == "composed_span_match") & (F.col("is_symbol") | F.col("same")), "resolved_symbol", "symbol", "composed_span_match", F.col("confidence_in")),
        (F.col("same"), "resolved_symbol", "symbol", "exact_provider_symbol", F.lit(0.98)),
        (F.col("is_symbol"), "resolved_symbol", "symbol", "exact_canonical_symbol", F.lit(0.95)),
        (F.col("type").isin(*ALIASES) & ~external, "resolved_symbol", "symbol", "alias_or_reexport", F.lit(0.85)),
        (F.col("is_file"), "resolved_file", "file", "exact_relative_path", F.lit(0.9)),
        (external, "external", "external_symbol", "external_symbol", F.lit(0.7)),
        (F.col("keys").isNotNull(), "ambiguous", None, "multiple_valid_targets", F.lit(0.0)),
    ]
    out = F.struct(F.lit("unresolved").alias("status"), F.lit(None).cast("string").alias("resolved_kind"), F.lit("missing_document").alias("reason"), F.lit(0.0).alias("confidence"))
    for when, status, kind, reason, confidence in reversed(cases):
        own = F.struct(F.lit(status).alias("status"), F.lit(kind).cast("string").alias("resolved_kind"), F.lit(reason).alias("reason"), confidence.cast("double").alias("confidence"))
        out = F.when(F.coalesce(when, F.lit(False)), own).otherwise(out)
    rows = rows.withColumn("r", out)
    listed = F.when(F.col("r.status") == "ambiguous", F.col("keys")).otherwise(F.array().cast("array<string>"))
    value = F.when(F.col("r.resolved_kind").isNotNull(), F.col("target"))
    return rows.select("fact_id", "type", "target", "r.*", value.alias("resolved_value"), listed.alias("candidates"))


def cluster_key(kind: Column, source: Column, raw_target: Column) -> Column:
    """Type, source and the first word of the raw target, joined by the unit separator."""
    return F.concat_ws("\u001f", kind, source, F.get(F.split(F.trim(raw_target), r"\s+"), 0))


def preference(priority: Column, tier: Column, confidence: Column, deterministic: Column, provider: Column, fact: Column) -> Column:
    """The order in which evidence is preferred; the greatest wins."""
    millionths = F.round(confidence * 1_000_000).cast("long")
    return F.struct(
        F.coalesce(priority, F.lit(0)).cast("long").alias("priority"), X.tier_rank(tier).cast("long").alias("rank"), millionths.alias("millionths"), deterministic.alias("deterministic"), provider.alias("provider"), fact.alias("fact")
    )


def clusters(facts: DataFrame, listed: bool = False) -> DataFrame:
    """cluster, facts, targets, outcome, preferred of facts (cluster, fact_id, target, preference); null targets don't disagree.

    listed: for a caller that reads `fact_ids`. A cluster's facts are gathered for it anyway, and its targets with them, so one
    shuffle does; a distinct count is two."""
    targets = F.size(F.collect_set("target")).cast("long") if listed else F.count_distinct("target")
    return facts.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("facts"), targets.alias("targets"), F.when(targets <= 1, "corroborated").otherwise("conflict").alias("outcome"),
        F.max_by("fact_id", "preference").alias("preferred"), F.array_sort(F.collect_list("fact_id")).alias("fact_ids"),
    )


def conflict_records(found: DataFrame) -> DataFrame:
    """One record a cluster, single facts included, with a deterministic id: recording again adds nothing."""
    status = F.when(F.col("outcome") == "corroborated", "corroborated").when(F.col("preferred").isNotNull(), "preferred_with_conflict").otherwise("open")
    listed = F.array_join("fact_ids", ",")
    kind = F.when(F.col("outcome") == "conflict", "incompatible_target")
    return found.select(X.framed_id(F.col("cluster"), listed).alias("record_id"), "cluster", kind.alias("conflict_type"), status.alias("status"), "preferred", listed.alias("participating"))


def append_new(existing: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not there yet, one of each: insert-or-ignore."""
    return rows.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def compose_call_edges(calls: DataFrame, definitions: DataFrame) -> DataFrame:
    """Structural call spans joined with semantic occurrences on document, revision and span; confidence min(c * 0.98, 0.98).

    Spark reckons occurrences that an explode makes by the rows before it, and would broadcast them at any size: both sides
    are shuffled and sorted.
    """
    on = ["document", "revision_id", "start_line", "start_char", "end_line", "end_char"]
    confidence = F.least(F.round(F.col("confidence") * 0.98, 6), F.lit(0.98))
    return calls.join(definitions.hint("merge"), on).select(*on, "caller", "symbol", confidence.alias("confidence"), F.lit("composed_span_match").alias("reason"))


def split_by_resolution(edges: DataFrame) -> DataFrame:
    """path, verified, uncertain: a path may be in both parts."""
    good = F.col("status").startswith("resolved_")
    return edges.groupBy("path").agg(F.max(good).alias("verified"), F.max(~good).alias("uncertain"))
