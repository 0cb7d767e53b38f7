"""One function for each public command, over a model: each returns a DataFrame.

Defaults are fixed values of the surveyed interface: 50 rows a page, depth 3, 200 records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import context as _context
from .operators import diff as _diff
from .operators import find as _find
from .operators import graph as _graph
from .operators import lifecycle as _lifecycle
from .operators import serving as _serving
from .queries import bookkeeping, evidence, lookups, sessions, temporal
from .sources.model import Model

LIMIT, DEPTH, RECORDS = 50, 3, 200


def open_model(spark: SparkSession, folder: str) -> Model:
    return Model(spark, folder)


def status(m: Model) -> DataFrame:
    return lookups.k5_status(m)


def doctor(m: Model) -> DataFrame:
    return lookups.k6_doctor(m)


def reconcile(m: Model) -> DataFrame:
    """What a reconcile of the next listing does with each path."""
    return _diff.reconcile(m.generation(1), m.generation(2))


def find(m: Model, query: str | None = None, kind: str | None = None, path_prefix: str | None = None, min_confidence: float | None = None, limit: int = LIMIT, cursor: str | None = None) -> DataFrame:
    where = _find.matches(query, kind, path_prefix, min_confidence)
    digest = "|".join(map(str, (query, kind, path_prefix, min_confidence)))
    active = m.workspace().first()["active_id"]
    return _find.find_page(m.current_symbols(), where, limit, active, digest, cursor)


def envelope(m: Model) -> DataFrame:
    return lookups.a1_evidence_envelope(m)


def inspect(m: Model, path: str) -> DataFrame:
    s = m.current_symbols()
    return _find.inspect(s, m.current_edges(), m.resolved(), path, s.where(F.col("path") == path).select("symbol_key"))


def trace(m: Model, seed: str, outbound: bool = True, depth: int = DEPTH, records: int = RECORDS) -> DataFrame:
    seeds = m.spark.createDataFrame([(seed,)], "node string")
    steps = _graph.trace(m.current_edges().select("source", "type", "target").distinct(), seeds, depth, outbound)
    steps = steps.groupBy("source", "type", "target").agg(F.min("depth").alias("depth")).select("depth", "source", "type", "target")
    return _graph.trace_flags(steps, depth, records)


def impact(m: Model, *seeds: str) -> DataFrame:
    return _graph.impact(m.current_edges().select("source", "target", "type").distinct(), m.spark.createDataFrame([(s,) for s in seeds], "node string"))


def source(m: Model, live: DataFrame) -> DataFrame:
    """path, status of indexed sources against live ones (path, content)."""
    return _find.verify_source(m.current_files().where("revision_id is not null").select("path", "content_hash"), live)


def history(m: Model, limit: int = LIMIT) -> DataFrame:
    return _find.history(m.table("events").select("event_id", "ts", "event_type"), limit)


def providers(m: Model) -> DataFrame:
    return lookups.j5_provider_status(m)


def context_ir(m: Model, seeds: DataFrame, kinds: list[str], depth: int = DEPTH, per_node: int = 5) -> DataFrame:
    """The edges that a working set's frontier meets, of seeds (request, seed)."""
    return _context.frontier(m.current_edges(), seeds, kinds, depth, per_node)


def serving_build(m: Model) -> DataFrame:
    return _serving.cards(m.current_symbols(), evidence.counts(m), m.file_coverage())


def serving_status(m: Model) -> DataFrame:
    return evidence.b16_serving_status(m)


def generation_delta(m: Model) -> DataFrame:
    return temporal.all_changes(m)


def temporal_state(m: Model) -> DataFrame:
    return temporal.d10_explain(m)


def ancestry(m: Model) -> DataFrame:
    """How many ancestors each generation has."""
    return _lifecycle.Ancestry(m.generations()).depths()


def governor(m: Model) -> DataFrame:
    """Route decisions of the recorded requests."""
    return sessions.r1_route_decision(m)


def task(m: Model) -> DataFrame:
    return sessions.k14_classified_sessions(m)


def context_yield(m: Model) -> DataFrame:
    return sessions.m2_context_fractions(m)


def retention(m: Model) -> DataFrame:
    return temporal.d18_retention_manifest(m)


def capabilities(m: Model) -> DataFrame:
    return bookkeeping.r3_capabilities(m)
