"""Queries: differences between generations, their totals, risk, leases, reuse and retention."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import budget, diff, find, graph, merkle, temporal
from ..sources.model import Model, named
from .registry import register, sql


def snapshot_symbols(m: Model, number: int) -> DataFrame:
    """The symbols of generation 1 or 2; the second changes signatures, confidences and line numbers of some."""
    key = F.col("p_partkey")
    files = m.generation(number).select("file_id", "path")
    p = m.table("part").join(files, named("f", F.floor(key / 2)) == F.col("file_id"))
    later = F.lit(number == 2)
    signature = F.when(later & (key % 23 == 0), "v2").otherwise("v1")
    tenths = (F.col("p_size") % 10 + F.when(later & (key % 29 == 0), 1).otherwise(0)).cast("long")
    line = F.col("p_size") + F.when(later & (key % 31 == 0), 5).otherwise(0)
    return p.select(named("part", "p_partkey").alias("symbol_key"), "file_id", "path", F.col("p_type").alias("kind"), F.col("p_name").alias("display_name"), F.col("p_brand").alias("qualified_name"), signature.alias("signature"), F.lit("exact").alias("method"), tenths.alias("confidence"), line.alias("start_line"), "p_partkey")


def snapshot_relations(m: Model, number: int) -> DataFrame:
    """identity, target, state of every line; the second generation has other targets and states, lost some and gained some."""
    key, order = F.col("l_partkey"), F.col("l_orderkey")
    li = m.table("lineitem").where(order % (59 if number == 2 else 61) != 0)
    target = F.col("l_suppkey") + (F.when(key % 43 == 0, 1).otherwise(0) if number == 2 else F.lit(0))
    state = F.when(order % 53 == 0, "X").otherwise(F.col("l_returnflag")) if number == 2 else F.col("l_returnflag")
    source = named("part", "l_partkey")
    return li.select(F.concat_ws("|", source, F.col("l_linenumber").cast("string")).alias("identity"), named("part", target).alias("target"), state.alias("state"), source.alias("source"))


def _relations_sql(number: int) -> str:
    shift = "CASE WHEN l_partkey % 43 = 0 THEN 1 ELSE 0 END" if number == 2 else "0"
    state = "CASE WHEN l_orderkey % 53 = 0 THEN 'X' ELSE l_returnflag END" if number == 2 else "l_returnflag"
    return f"SELECT l_partkey, 'part:' || l_partkey || '|' || l_linenumber AS i, 'part:' || (l_suppkey + {shift}) AS t, {state} AS s FROM lineitem WHERE l_orderkey % {59 if number == 2 else 61} <> 0"


def _symbols_sql(number: int) -> str:
    later = "TRUE" if number == 2 else "FALSE"
    return f"""SELECT 'part:' || p_partkey AS symbol_key, path, file_id, sha256(concat_ws(chr(31), p_type, p_name, p_brand, CASE WHEN {later} AND p_partkey % 23 = 0 THEN 'v2' ELSE 'v1' END)) AS semantic,
sha256(concat_ws(chr(31), 'exact', (p_size % 10 + CASE WHEN {later} AND p_partkey % 29 = 0 THEN 1 ELSE 0 END)::VARCHAR)) AS evidence, coalesce(o.outbound, '') AS outbound
FROM part JOIN g{number} ON file_id = 'f:' || (p_partkey // 2) LEFT JOIN (SELECT l_partkey, string_agg(DISTINCT t, ',' ORDER BY t) AS outbound FROM ({_relations_sql(number)}) GROUP BY 1) o ON o.l_partkey = p_partkey"""


_D4 = f"""s1 AS ({_symbols_sql(1)}), s2 AS ({_symbols_sql(2)}),
d4 AS (SELECT * FROM (SELECT coalesce(a.symbol_key, b.symbol_key) AS symbol_key, CASE WHEN a.symbol_key IS NULL THEN 'added' WHEN b.symbol_key IS NULL THEN 'removed' WHEN a.path <> b.path THEN 'renamed'
WHEN a.file_id <> b.file_id OR a.semantic <> b.semantic OR a.evidence <> b.evidence OR a.outbound <> b.outbound THEN 'modified' END AS change,
CASE WHEN a.symbol_key IS NULL THEN 'symbol_added' WHEN b.symbol_key IS NULL THEN 'symbol_removed' WHEN a.path <> b.path THEN 'path_changed' WHEN a.file_id <> b.file_id THEN 'file_changed' WHEN a.semantic <> b.semantic THEN 'semantic_changed'
WHEN a.evidence <> b.evidence THEN 'evidence_changed' WHEN a.outbound <> b.outbound THEN 'outbound_changed' END AS reason FROM s1 a FULL JOIN s2 b ON a.symbol_key = b.symbol_key) WHERE change IS NOT NULL)"""


def symbol_diff(m: Model) -> DataFrame:
    states = [temporal.symbol_states(snapshot_symbols(m, n), snapshot_relations(m, n)) for n in (1, 2)]
    return temporal.symbol_changes(*states)


@register("d4_symbol_diff", sql("g1 g2", f", {_D4} SELECT symbol_key, change, reason FROM d4"))
def d4_symbol_diff(m: Model) -> DataFrame:
    return symbol_diff(m)


_FILE_DIFF = """fd AS (SELECT * FROM (SELECT coalesce(g1.file_id, g2.file_id) AS key, CASE WHEN g1.path IS NULL THEN 'added' WHEN g2.path IS NULL THEN 'removed' WHEN g1.path <> g2.path THEN 'renamed' WHEN g1.content_hash <> g2.content_hash THEN 'modified' END AS change
FROM g1 FULL JOIN g2 ON g1.file_id = g2.file_id) WHERE change IS NOT NULL)"""


@register("d2_file_diff_reasons", sql("g1 g2", f""", {_FILE_DIFF} SELECT key AS file_id, change, CASE change WHEN 'added' THEN 'file_added' WHEN 'removed' THEN 'file_removed' WHEN 'renamed' THEN 'path_changed' ELSE 'content_changed' END AS reason FROM fd"""))
def d2_file_diff_reasons(m: Model) -> DataFrame:
    reasons = F.create_map(*[F.lit(x) for pair in (("added", "file_added"), ("removed", "file_removed"), ("renamed", "path_changed"), ("modified", "content_changed")) for x in pair])
    return diff.file_changes(m.generation(1), m.generation(2)).select("file_id", "change", F.element_at(reasons, F.col("change")).alias("reason"))


def effects_of(m: Model, number: int) -> DataFrame:
    e = m.effects()
    if number == 1:
        return e.where("event_id % 5 != 0")
    return e.where("event_id % 4 != 0 or effect_type = 'view'").withColumn("phase", F.when(F.col("subject").isin("part:7", "part:21"), "runtime").otherwise(F.col("phase")))


_KEYED = """o AS (SELECT k, list(i ORDER BY i) AS items, list_sort(list_distinct(list(s))) AS states FROM a GROUP BY k), n AS (SELECT k, list(i ORDER BY i) AS items, list_sort(list_distinct(list(s))) AS states FROM b GROUP BY k),
d AS (SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' WHEN o.states <> n.states THEN 'state_changed' WHEN o.items <> n.items THEN 'modified' END AS change FROM o FULL JOIN n ON o.k = n.k)"""
_EFF1 = "SELECT subject || '|' || effect_type AS k, effect_id || phase AS i, phase AS s FROM eff WHERE event_id % 5 <> 0"
_EFF2 = "SELECT subject || '|' || effect_type, effect_id || p, p FROM (SELECT *, CASE WHEN subject IN ('part:7', 'part:21') THEN 'runtime' ELSE phase END AS p FROM eff WHERE event_id % 4 <> 0 OR effect_type = 'view')"


@register("d6_effect_diff", sql("eff", f", a AS ({_EFF1}), b(k, i, s) AS ({_EFF2}), {_KEYED} SELECT k AS key, change FROM d WHERE change IS NOT NULL"))
def d6_effect_diff(m: Model) -> DataFrame:
    return effect_diff(m)


@register("d6_conflict_diff", sql("conf", f", a AS (SELECT subject_key AS k, ok::VARCHAR || status AS i, status AS s FROM conf WHERE ok % 3 <> 0), b AS (SELECT subject_key AS k, ok::VARCHAR || status AS i, status AS s FROM conf WHERE ok % 5 <> 0), {_KEYED} SELECT k AS key, change FROM d WHERE change IS NOT NULL"))
def d6_conflict_diff(m: Model) -> DataFrame:
    c = m.conflicts().withColumnRenamed("subject_key", "key")
    return temporal.state_changes(c.where("ok % 3 != 0"), c.where("ok % 5 != 0"), "key", "status", ["ok", "status"])


_COV2 = "cov2 AS (SELECT file_id, CASE WHEN file_id LIKE '%3' THEN 'complete' ELSE status END AS status FROM cov WHERE file_id NOT LIKE '%44')"


def later_coverage(m: Model) -> DataFrame:
    return m.file_coverage().where("file_id not like '%44'").select("file_id", F.when(F.col("file_id").like("%3"), "complete").otherwise(F.col("status")).alias("status"))


@register("d6_coverage_diff", sql("cov", f", {_COV2}, a AS (SELECT file_id AS k, status AS i, status AS s FROM cov), b AS (SELECT file_id AS k, status AS i, status AS s FROM cov2), {_KEYED} SELECT k AS key, change FROM d WHERE change IS NOT NULL"))
def d6_coverage_diff(m: Model) -> DataFrame:
    key = lambda df: df.withColumnRenamed("file_id", "key")
    return temporal.state_changes(key(m.file_coverage()), key(later_coverage(m)), "key", "status", ["status"])


_D5_ROWS = """live AS (SELECT 'f:' || doc_id AS file_id, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE sha256(text) END AS h FROM documents WHERE doc_id % 9 <> 0),
d5 AS (SELECT s2.symbol_key, CASE WHEN p_partkey % 47 = 0 THEN 'provider_changed' WHEN coalesce(c1.status, '') <> 'complete' OR coalesce(c2.status, '') <> 'complete' THEN 'coverage_incomplete'
WHEN live.h IS NULL THEN 'source_unavailable' WHEN live.h <> g2.content_hash THEN 'source_stale' ELSE 'verified' END AS status
FROM s2 JOIN part ON symbol_key = 'part:' || p_partkey JOIN g2 ON g2.file_id = s2.file_id LEFT JOIN cov c1 ON c1.file_id = s2.file_id LEFT JOIN cov2 c2 ON c2.file_id = s2.file_id LEFT JOIN live ON live.file_id = s2.file_id
WHERE s2.symbol_key NOT IN (SELECT symbol_key FROM d4))"""
_D5 = f"{_D4}, {_COV2}, {_D5_ROWS}"


def live_files(m: Model) -> DataFrame:
    """file_id, live_hash of the files that are there now: some gone, some edited."""
    d = m.table("documents").where("doc_id % 9 != 0")
    return d.select(named("f", "doc_id").alias("file_id"), F.when(F.col("doc_id") % 5 == 0, "x").otherwise(F.sha2(F.col("text").cast("binary"), 256)).alias("live_hash"))


def contracts(m: Model) -> DataFrame:
    s = snapshot_symbols(m, 2).join(m.generation(2).select("file_id", "content_hash"), "file_id")
    s = s.select("symbol_key", "file_id", "content_hash", F.lit("a").alias("old_provider"), F.when(F.col("p_partkey") % 47 == 0, "b").otherwise("a").alias("new_provider"))
    return temporal.unchanged_contracts(s, symbol_diff(m), m.file_coverage(), later_coverage(m), live_files(m))


@register("d5_unchanged_contracts", sql("g1 g2 cov", f", {_D5} SELECT symbol_key, status FROM d5"))
def d5_unchanged_contracts(m: Model) -> DataFrame:
    return contracts(m)


_RELATIONS = f"""rb AS ({_relations_sql(1)}), ra AS ({_relations_sql(2)}),
rg AS (SELECT *, row_number() OVER (PARTITION BY i, t ORDER BY s) AS k FROM (SELECT i, t, s FROM rb EXCEPT ALL SELECT i, t, s FROM ra)), rn AS (SELECT *, row_number() OVER (PARTITION BY i, t ORDER BY s) AS k FROM (SELECT i, t, s FROM ra EXCEPT ALL SELECT i, t, s FROM rb)),
rj AS (SELECT coalesce(rg.i, rn.i) AS i, coalesce(rg.t, rn.t) AS t, rg.s AS s1, rn.s AS s2 FROM rg FULL JOIN rn ON rg.i = rn.i AND rg.t = rn.t AND rg.k = rn.k),
rr AS (SELECT *, count(s1) OVER (PARTITION BY i) AS c1, count(s2) OVER (PARTITION BY i) AS c2 FROM rj WHERE s1 IS NULL OR s2 IS NULL),
rel AS (SELECT i AS identity, 'evidence_changed' AS change, t AS old_target, t AS new_target FROM rj WHERE s1 IS NOT NULL AND s2 IS NOT NULL
UNION ALL SELECT i, 'retargeted', max(CASE WHEN s1 IS NOT NULL THEN t END), max(CASE WHEN s2 IS NOT NULL THEN t END) FROM rr WHERE c1 = 1 AND c2 = 1 GROUP BY i
UNION ALL SELECT i, CASE WHEN s1 IS NULL THEN 'added' ELSE 'removed' END, CASE WHEN s1 IS NOT NULL THEN t END, CASE WHEN s2 IS NOT NULL THEN t END FROM rr WHERE NOT (c1 = 1 AND c2 = 1)),
rel_ch AS (SELECT identity || '>' || coalesce(old_target, '') || '>' || coalesce(new_target, '') AS key, change FROM rel)"""


def _keyed_sql(name: str, before: str, after: str) -> str:
    """CTEs whose last is `name` (key, change): D6's rule over (k, i, s) rows of two snapshots."""
    listed = "list(i ORDER BY i) AS items, list_sort(list_distinct(list(s))) AS states"
    return f"""{name}_o AS (SELECT k, {listed} FROM ({before}) x(k, i, s) GROUP BY k), {name}_n AS (SELECT k, {listed} FROM ({after}) x(k, i, s) GROUP BY k),
{name} AS (SELECT * FROM (SELECT coalesce(o.k, n.k) AS key, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' WHEN o.states <> n.states THEN 'state_changed' WHEN o.items <> n.items THEN 'modified' END AS change FROM {name}_o o FULL JOIN {name}_n n ON o.k = n.k) WHERE change IS NOT NULL)"""


_PROVIDERS = "SELECT 'provider.' || (user_id % 4) AS provider, max(event_id // 1000) AS version FROM events {} GROUP BY 1"
_CONF = "SELECT subject_key, ok::VARCHAR || status, status FROM conf WHERE ok % {} <> 0"
_CHANGES = f"""{_FILE_DIFF}, {_D4}, {_COV2}, {_RELATIONS}, {_keyed_sql("eff_ch", _EFF1, _EFF2)}, {_keyed_sql("conf_ch", _CONF.format(3), _CONF.format(5))},
ca AS (SELECT coalesce(a.file_id, b.file_id) AS key, CASE WHEN b.file_id IS NULL THEN 'removed' ELSE 'state_changed' END AS change FROM cov a LEFT JOIN cov2 b ON a.file_id = b.file_id WHERE b.file_id IS NULL OR a.status <> b.status),
pv AS (SELECT 'provider-set' AS key, 'modified' AS change WHERE EXISTS (SELECT 1 FROM ({_PROVIDERS.format("WHERE event_id % 1000 < 500")}) a FULL JOIN ({_PROVIDERS.format("WHERE event_type <> 'view'")}) b USING (provider) WHERE a.version IS DISTINCT FROM b.version)),
ch AS (SELECT 'files' AS category, key, change FROM fd UNION ALL SELECT 'symbols', symbol_key, change FROM d4 UNION ALL SELECT 'relationships', key, change FROM rel_ch UNION ALL SELECT 'effects', key, change FROM eff_ch
UNION ALL SELECT 'coverage', key, change FROM ca UNION ALL SELECT 'coverage', key, change FROM pv UNION ALL SELECT 'conflicts', key, change FROM conf_ch)"""
_DELTA = "g1 g2 cov conf eff"


def relation_diff(m: Model) -> DataFrame:
    found = diff.relationship_changes(snapshot_relations(m, 1), snapshot_relations(m, 2))
    return found.select(F.concat_ws(">", "identity", F.coalesce("old_target", F.lit("")), F.coalesce("new_target", F.lit(""))).alias("key"), "change")


def effect_diff(m: Model) -> DataFrame:
    keyed = lambda n: effects_of(m, n).withColumn("key", F.concat_ws("|", "subject", "effect_type"))
    return temporal.state_changes(keyed(1), keyed(2), "key", "phase", ["effect_id", "phase"])


def providers(m: Model, number: int) -> DataFrame:
    """Each provider's version, from the events of its generation."""
    e = m.table("events").where("event_type != 'view'" if number == 2 else "event_id % 1000 < 500")
    return e.groupBy(F.concat(F.lit("provider."), (F.col("user_id") % 4).cast("string")).alias("provider")).agg(F.max(F.expr("event_id div 1000")).alias("version"))


def all_changes(m: Model) -> DataFrame:
    """All six categories; a coverage change says that the set of providers is another."""
    key = lambda df, name: df.withColumnRenamed(name, "key")
    coverage = temporal.state_changes(key(m.file_coverage(), "file_id"), key(later_coverage(m), "file_id"), "key", "status", ["status"])
    c = key(m.conflicts(), "subject_key")
    conflicts = temporal.state_changes(c.where("ok % 3 != 0"), c.where("ok % 5 != 0"), "key", "status", ["ok", "status"])
    return temporal.explain({
        "files": key(diff.file_changes(m.generation(1), m.generation(2)), "file_id"), "symbols": key(symbol_diff(m), "symbol_key"), "relationships": relation_diff(m), "effects": effect_diff(m),
        "coverage": coverage.unionByName(temporal.provider_set_change(providers(m, 1), providers(m, 2))), "conflicts": conflicts,
    })


@register("d7_all_changes", sql(_DELTA, f", {_CHANGES} SELECT * FROM ch"))
def d7_all_changes(m: Model) -> DataFrame:
    return all_changes(m)


@register("d8_sealed_delta", sql(_DELTA, f""", {_CHANGES} SELECT category, key, change, substr(sha256(concat_ws(chr(31), category, key, change)), 1, 32) AS change_id FROM ch"""))
def d8_sealed_delta(m: Model) -> DataFrame:
    return temporal.sealed(all_changes(m)).select("category", "key", "change", "change_id")


_LESS = "SELECT category || chr(31) || key AS key, change AS value FROM ch"


@register("d8_replays", sql(_DELTA, f""", {_CHANGES}, {merkle.root_sql(_LESS, "all_")}, {merkle.root_sql(_LESS + " WHERE category <> 'symbols'", "less_")}
SELECT 'first' AS attempt, 'sealed' AS outcome, n, digest FROM all_ UNION ALL SELECT 'again', 'replayed', n, digest FROM all_ UNION ALL SELECT 'other', 'conflict', n, digest FROM less_""", recursive=True))
def d8_replays(m: Model) -> DataFrame:
    """A delta is sealed once under its name: the same content again is a replay, other content a conflict."""
    c = graph.cut(all_changes(m), "delta")
    store = merkle.Sealed(m.spark, f"{graph.shared_folder(m.spark)}/deltas-{uuid.uuid4().hex}")
    key = F.concat_ws("\u001f", "category", "key")
    out = None
    for attempt, rows in (("first", c), ("again", c.orderBy("change", F.desc("key"))), ("other", c.where("category != 'symbols'"))):
        t = merkle.tree(rows, key, F.col("change"))
        row = t.root().select(F.lit(attempt).alias("attempt"), F.lit(store.seal("g1-g2", t)).alias("outcome"), "n", "digest")
        out = row if out is None else out.unionByName(row)
    return out


@register("d2_merkle_differences", sql("g1 g2", """, a AS (SELECT file_id AS key, path || '|' || content_hash AS v FROM g1), b AS (SELECT file_id AS key, path || '|' || content_hash AS v FROM g2)
SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' ELSE 'modified' END AS change, a.v AS before, b.v AS after FROM a FULL JOIN b USING (key) WHERE a.v IS DISTINCT FROM b.v"""))
def d2_merkle_differences(m: Model) -> DataFrame:
    """The files that differ between two snapshots, by descending both trees together."""
    value = F.concat_ws("|", "path", "content_hash")
    a = merkle.tree(m.generation(1), F.col("file_id"), value, keep_rows=True, leaf_rows=16)
    b = merkle.tree(m.generation(2), F.col("file_id"), value, keep_rows=True, depth=a.depth)
    return merkle.differences(a, b)


@register("d9_bounded_delta", sql(_DELTA, f", {_CHANGES} SELECT 100000000 AS budget, category, count(*) AS n FROM ch GROUP BY category"))
def d9_bounded_delta(m: Model) -> DataFrame:
    """All within the larger budget, nothing within the smaller one."""
    c = all_changes(m)
    given = lambda n: temporal.bounded(c, n).groupBy("category").agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("budget"), "category", "n")
    return given(100_000_000).unionByName(given(3))


_CATEGORIES = ["files", "symbols", "relationships", "effects", "coverage", "conflicts"]


@register("a12_category_totals", sql(_DELTA, f""", {_CHANGES}, k AS (SELECT unnest({_CATEGORIES}) AS category) SELECT k.category, count(ch.key) AS total, least(count(ch.key), 50) AS kept, greatest(count(ch.key) - 50, 0) AS omitted FROM k LEFT JOIN ch USING (category) GROUP BY 1"""))
def a12_category_totals(m: Model) -> DataFrame:
    return temporal.category_totals(all_changes(m), _CATEGORIES, 50)


@register("l7_first_details", sql(_DELTA, f""", {_CHANGES} SELECT category, key, change, total FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY key, change) AS k, count(*) OVER (PARTITION BY category) AS total FROM ch) WHERE k <= 50"""))
def l7_first_details(m: Model) -> DataFrame:
    return temporal.first_details(graph.cut(all_changes(m), "changes"), 50).select("category", "key", "change", "total")


_RISK = f"""{_CHANGES}, {_D5_ROWS}, core AS (SELECT change FROM ch WHERE category IN ('files', 'symbols', 'relationships', 'effects')),
own AS (SELECT CASE WHEN live.h IS NULL THEN 'source_unavailable' WHEN live.h <> g2.content_hash THEN 'source_stale' END AS status FROM d4 JOIN s2 USING (symbol_key) JOIN g2 ON g2.file_id = s2.file_id LEFT JOIN live ON live.file_id = s2.file_id), t AS (SELECT
(SELECT count(*) FROM d5 WHERE status = 'source_stale') + (SELECT count(*) FROM own WHERE status = 'source_stale') AS live_source_stale, (SELECT count(*) FROM d5 WHERE status = 'source_unavailable') + (SELECT count(*) FROM own WHERE status = 'source_unavailable') AS live_source_unavailable, (SELECT count(*) FROM d5 WHERE status IN ('provider_changed', 'coverage_incomplete')) AS delta_uncertainty,
(SELECT count(*) FROM conf WHERE status IN ('open', 'preferred_with_conflict')) AS open_evidence_conflicts, (SELECT count(*) FROM cov WHERE status IN ('failed', 'stale')) AS failed_or_stale_coverage,
(SELECT greatest(count(*) - 50, 0) FROM d5 WHERE status = 'verified') AS validity_evidence_omitted, (SELECT greatest(count(*) - 50, 0) FROM core) AS change_evidence_omitted,
(SELECT count(*) FROM core WHERE change IN ('removed', 'renamed', 'retargeted', 'state_changed', 'modified')) AS disruptive_changes, (SELECT count(*) FROM ce WHERE status IN ('unresolved', 'ambiguous', 'invalid', 'stale')) AS unresolved_relationships,
(SELECT count(*) FROM core WHERE change = 'added') AS additive_changes, CASE WHEN (SELECT count(*) FROM core) = 0 AND (SELECT count(*) FROM d5 WHERE status = 'verified') = 0 THEN 1 ELSE 0 END::BIGINT AS unchanged_contracts_unavailable),
l AS (SELECT * FROM (VALUES {", ".join(f"('{c}', '{v}', {temporal.LEVELS.index(v)})" for c, v in temporal.SIGNALS.items())}) AS v(code, level, rank)), u AS (UNPIVOT t ON COLUMNS(*) INTO NAME code VALUE count)
SELECT code, level, count, ({list(temporal.LEVELS)})[max(rank) OVER () + 1] AS overall FROM l JOIN u USING (code) WHERE count > 0"""


@register("a13_risk_signals", sql(_DELTA + " ce", f", {_RISK}"))
def a13_risk_signals(m: Model) -> DataFrame:
    """All eleven counters: changes of files, symbols, relationships and effects; sources of changed symbols count as stale or
    gone like those of unchanged contracts."""
    c = contracts(m).agg(*[F.count_if(F.col("status").isin(*s)).alias(n) for n, s in (("live_source_stale", ["source_stale"]), ("live_source_unavailable", ["source_unavailable"]), ("delta_uncertainty", ["provider_changed", "coverage_incomplete"]), ("verified", ["verified"]))])
    changed = symbol_diff(m).select("symbol_key", "change")
    core = diff.file_changes(m.generation(1), m.generation(2)).select("change").unionByName(changed.select("change")).unionByName(relation_diff(m).select("change")).unionByName(effect_diff(m).select("change"))
    core = core.agg(F.count(F.lit(1)).alias("core"), F.count_if(temporal.disruptive(F.col("change"))).alias("disruptive_changes"), F.count_if(F.col("change") == "added").alias("additive_changes"))
    some = lambda df, states, name: df.agg(F.count_if(F.col("status").isin(*states)).alias(name))
    own = temporal.changed_sources(changed, snapshot_symbols(m, 2).join(m.generation(2).select("file_id", "content_hash"), "file_id"), live_files(m))
    own = own.agg(F.count_if(F.col("status") == "source_stale").alias("own_stale"), F.count_if(F.col("status") == "source_unavailable").alias("own_gone"))
    row = c.crossJoin(own).crossJoin(core).crossJoin(some(m.conflicts(), find.OPEN_CONFLICT, "open_evidence_conflicts")).crossJoin(some(m.file_coverage(), ("failed", "stale"), "failed_or_stale_coverage"))
    row = row.crossJoin(some(m.current_edges(), find.UNRESOLVED, "unresolved_relationships"))  # single rows
    over = lambda x: F.greatest(F.col(x) - 50, F.lit(0))
    none = F.when((F.col("core") == 0) & (F.col("verified") == 0), 1).otherwise(0)
    row = row.withColumns({"live_source_stale": F.col("live_source_stale") + F.col("own_stale"), "live_source_unavailable": F.col("live_source_unavailable") + F.col("own_gone")})
    return temporal.risk_summary(row.withColumns({"validity_evidence_omitted": over("verified"), "change_evidence_omitted": over("core"), "unchanged_contracts_unavailable": none}))


@register("d10_explain", sql(_DELTA + " gen", f""", {_CHANGES}, h AS (SELECT count(*) AS events FROM events WHERE event_id > 100 AND event_id <= 5000)
SELECT category, change, count(*) AS n, max(events) AS events, 'g1' AS baseline, 'g2' AS active FROM ch, h GROUP BY 1, 2"""))
def d10_explain(m: Model) -> DataFrame:
    """The baseline is the active generation's parent; changes by category and kind, and the events in its sequence range."""
    active = m.generations().join(m.workspace(), F.col("generation_id") == F.col("active_id")).select(F.col("parent_id").alias("baseline"), F.col("generation_id").alias("active"))
    events = m.table("events").where("event_id > 100 and event_id <= 5000").agg(F.count(F.lit(1)).alias("events"))
    n = all_changes(m).groupBy("category", "change").agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(events)).crossJoin(F.broadcast(active))  # single rows


@register("j10_generation_events", sql("gen", """SELECT g.generation_id, count(e.event_id) AS events FROM gen g LEFT JOIN gen p ON p.generation_id = g.parent_id
LEFT JOIN events e ON (e.event_id % 6) > coalesce(p.sequence_no, 0) AND (e.event_id % 6) <= g.sequence_no GROUP BY 1"""))
def j10_generation_events(m: Model) -> DataFrame:
    """Events whose generation's sequence lies after the parent's, up to the generation's own."""
    g = m.generations()
    spans = g.alias("g").join(g.alias("p"), F.col("g.parent_id") == F.col("p.generation_id"), "left").select("g.generation_id", F.coalesce("p.sequence_no", F.lit(0)).alias("lo"), F.col("g.sequence_no").alias("hi"))
    per = m.table("events").groupBy((F.col("event_id") % 6).alias("s")).agg(F.count(F.lit(1)).alias("n"))  # counted before the range join
    return spans.join(per, (F.col("s") > F.col("lo")) & (F.col("s") <= F.col("hi")), "left").groupBy("generation_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("events"))


@register("j11_full_outer_diff", sql("g1 g2", "SELECT coalesce(g1.file_id, g2.file_id) AS file_id, coalesce(g1.byte_size, 0) AS before, coalesce(g2.byte_size, 0) AS after, coalesce(g2.byte_size, 0) - coalesce(g1.byte_size, 0) AS growth FROM g1 FULL JOIN g2 ON g1.file_id = g2.file_id"))
def j11_full_outer_diff(m: Model) -> DataFrame:
    side = lambda n, name: m.generation(n).select("file_id", F.col("byte_size").alias(name))
    return side(1, "before").join(side(2, "after"), "file_id", "full_outer").fillna(0, ["before", "after"]).withColumn("growth", F.col("after") - F.col("before"))


@register("d1_reconcile", sql("g1 g2", f""", {_FILE_DIFF}, gone AS (SELECT content_hash, min(path) AS p FROM g1 WHERE path NOT IN (SELECT path FROM g2) GROUP BY 1 HAVING count(*) = 1), new AS (SELECT content_hash, min(path) AS p FROM g2 WHERE path NOT IN (SELECT path FROM g1) GROUP BY 1 HAVING count(*) = 1),
rn AS (SELECT gone.p AS old_path, new.p AS path FROM gone JOIN new USING (content_hash))
SELECT g2.path, CASE WHEN rn.path IS NOT NULL THEN 'renamed' WHEN o.path IS NULL THEN 'created' WHEN o.content_hash <> g2.content_hash THEN 'modified' ELSE 'kept' END AS outcome, NOT EXISTS (SELECT 1 FROM g1 x WHERE x.content_hash = g2.content_hash) AS extract
FROM g2 LEFT JOIN rn ON rn.path = g2.path LEFT JOIN g1 o ON o.path = g2.path UNION ALL SELECT path, 'deleted', false FROM g1 WHERE path NOT IN (SELECT path FROM g2) AND path NOT IN (SELECT old_path FROM rn)"""))
def d1_reconcile(m: Model) -> DataFrame:
    """What one reconcile does with each path, and which contents have to be extracted; `diff.reconcile` is the operator."""
    return diff.reconcile(m.generation(1), m.generation(2))


@register("d12_tombstones", sql("g1 g2 sf", """, gone AS (SELECT file_id, path, content_hash FROM g1 WHERE file_id NOT IN (SELECT file_id FROM g2)), s AS (SELECT file_id, string_agg(DISTINCT symbol_key, ',' ORDER BY symbol_key) AS symbols FROM sf GROUP BY 1)
SELECT gone.file_id, path, content_hash, coalesce(symbols, '') AS symbols FROM gone LEFT JOIN s USING (file_id)"""))
def d12_tombstones(m: Model) -> DataFrame:
    """Deleted files with a summary of their symbols, never their text."""
    gone = m.generation(1).join(m.generation(2).select("file_id"), "file_id", "left_anti").select("file_id", "path", "content_hash")
    s = m.symbol_facts().groupBy("file_id").agg(F.array_join(F.array_sort(F.collect_set("symbol_key")), ",").alias("symbols"))
    return gone.join(s, "file_id", "left").withColumn("symbols", F.coalesce("symbols", F.lit("")))


@register("d16_leases", sql("g1 g2", """, l AS (SELECT lang || '|' || (doc_id % 50) AS lease_id, file_id AS dependency, content_hash AS digest FROM g1)
SELECT lease_id, count(*) FILTER (g2.file_id IS NULL OR g2.content_hash <> digest) = 0 AS valid, count(*) FILTER (g2.file_id IS NULL OR g2.content_hash <> digest) AS broken FROM l LEFT JOIN g2 ON g2.file_id = dependency GROUP BY 1"""))
def d16_leases(m: Model) -> DataFrame:
    lease = F.concat_ws("|", "lang", (F.col("doc_id") % 50).cast("string"))
    held = m.generation(1).select(lease.alias("lease_id"), F.col("file_id").alias("dependency"), F.col("content_hash").alias("digest"))
    return temporal.verify_leases(held, m.generation(2).select(F.col("file_id").alias("dependency"), F.col("content_hash").alias("digest")))


@register("d17_document_reuse", sql("g1 g2", """, x AS (SELECT content_hash AS fingerprint, file_id AS execution_id, CASE doc_id % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'partial' ELSE 'complete' END AS status, doc_id // 10 AS done_at FROM g1)
SELECT g2.file_id, (SELECT arg_max(execution_id, (done_at, execution_id)) FROM x WHERE x.fingerprint = g2.content_hash AND status IN ('complete', 'partial')) AS reused_from FROM g2"""))
def d17_document_reuse(m: Model) -> DataFrame:
    doc = F.col("doc_id")
    status = F.when(doc % 4 == 0, "failed").when(doc % 4 == 1, "partial").otherwise("complete")
    earlier = m.generation(1).select(F.col("content_hash").alias("fingerprint"), F.col("file_id").alias("execution_id"), status.alias("status"), F.floor(doc / 10).alias("done_at"))
    return temporal.reusable(m.generation(2).select("file_id", F.col("content_hash").alias("fingerprint")), earlier).select("file_id", "reused_from")


@register("k17_change_events", sql("g1 g2", f", {_FILE_DIFF} SELECT substr(sha256(concat_ws(chr(31), 'artifact_changed', key, change)), 1, 32) AS event_id, key AS entity, change FROM fd"))
def k17_change_events(m: Model) -> DataFrame:
    from ..functions import expressions as X

    d = diff.file_changes(m.generation(1), m.generation(2))
    return d.select(X.framed_id(F.lit("artifact_changed"), F.col("file_id"), F.col("change")).alias("event_id"), F.col("file_id").alias("entity"), "change")


@register("k18_invalid_changes", sql("g1 g2", f""", {_FILE_DIFF}, c AS (SELECT 'files' AS category, CASE WHEN key LIKE '%5' THEN '' ELSE key END AS key, CASE WHEN key LIKE '%7' THEN 'moved' ELSE change END AS change FROM fd)
SELECT category, key, change, CASE WHEN change = 'moved' THEN 'unknown_kind' ELSE 'empty_key' END AS why FROM c WHERE change = 'moved' OR key = ''"""))
def k18_invalid_changes(m: Model) -> DataFrame:
    d = diff.file_changes(m.generation(1), m.generation(2))
    rows = d.select(F.lit("files").alias("category"), F.when(F.col("file_id").like("%5"), "").otherwise(F.col("file_id")).alias("key"), F.when(F.col("file_id").like("%7"), "moved").otherwise(F.col("change")).alias("change"))
    return temporal.invalid_changes(rows, ["added", "removed", "renamed", "modified"])


def _greedy(m: Model) -> DataFrame:
    n = F.octet_length("text").cast("long")
    return m.table("documents").select(F.concat_ws("|", "source", "lang").alias("request"), F.col("doc_id").alias("rank"), F.col("doc_id").cast("string").alias("item"), n.alias("bytes"), F.floor(n / 4).cast("long").alias("tokens"))


@register("a11_omissions", """WITH RECURSIVE c AS (SELECT source || '|' || lang AS g, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS k, strlen(text)::BIGINT AS b FROM documents),
r AS (SELECT g, k, CASE WHEN b > 9000 THEN 'bytes' WHEN b // 4 > 2000 THEN 'tokens' ELSE 'selected' END AS d, CASE WHEN b <= 9000 AND b // 4 <= 2000 THEN 1 ELSE 0 END AS n, CASE WHEN b <= 9000 AND b // 4 <= 2000 THEN b ELSE 0 END AS sb, CASE WHEN b <= 9000 AND b // 4 <= 2000 THEN b // 4 ELSE 0 END AS st FROM c WHERE k = 1
UNION ALL SELECT c.g, c.k, CASE WHEN n >= 4 THEN 'records' WHEN sb + b > 9000 THEN 'bytes' WHEN st + b // 4 > 2000 THEN 'tokens' ELSE 'selected' END, n + CASE WHEN n < 4 AND sb + b <= 9000 AND st + b // 4 <= 2000 THEN 1 ELSE 0 END,
sb + CASE WHEN n < 4 AND sb + b <= 9000 AND st + b // 4 <= 2000 THEN b ELSE 0 END, st + CASE WHEN n < 4 AND sb + b <= 9000 AND st + b // 4 <= 2000 THEN b // 4 ELSE 0 END FROM r JOIN c ON c.g = r.g AND c.k = r.k + 1),
h AS (SELECT g, d, count(*) AS n FROM r WHERE d <> 'selected' GROUP BY 1, 2) SELECT g AS request, string_agg(d || '=' || n, ',' ORDER BY d) AS by_reason, sum(n)::BIGINT AS omitted FROM h GROUP BY 1""")
def a11_omissions(m: Model) -> DataFrame:
    found = temporal.omissions(budget.greedy_select(_greedy(m), "request", 4, 9_000, 2_000))
    shown = F.array_join(F.transform(F.map_entries("by_reason"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return found.select("request", shown.alias("by_reason"), "omitted")


@register("d18_retention_manifest", sql("ev", """, s AS (SELECT user_id, session_id, max(ts) AS last, bool_or(use_type = 'artifact_changed') AS derived FROM ev GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (ORDER BY last DESC, session_id) AS k, (SELECT max(ts) + INTERVAL 20 DAY FROM events) AS now FROM s),
a AS (SELECT session_id, CASE WHEN k > 1000 OR last < now - INTERVAL 45 DAY THEN 'delete_session' WHEN last < now - INTERVAL 30 DAY AND derived THEN 'delete_derived' WHEN last < now - INTERVAL 30 DAY THEN 'delete_metric' END AS action, last FROM r)
SELECT session_id, action FROM a WHERE action IS NOT NULL ORDER BY last, session_id LIMIT 100"""))
def d18_retention_manifest(m: Model) -> DataFrame:
    """At most 1000 sessions stay, and a run deletes at most 100, oldest first."""
    return diff.retention_manifest(m.use_events(), keep=1000, per_run=100, session_days=45, derived_days=30, now_after_days=20)


@register("d19_apply_retention", sql("ev", """, s AS (SELECT session_id, max(ts) AS last, row_number() OVER (ORDER BY max(ts) DESC, session_id) AS k FROM ev GROUP BY 1), gone AS (SELECT session_id FROM s WHERE k > 1000 ORDER BY last, session_id LIMIT 100)
SELECT session_id, count(*) AS events FROM ev WHERE session_id NOT IN (SELECT session_id FROM gone) GROUP BY 1"""))
def d19_apply_retention(m: Model) -> DataFrame:
    """The events that stay after the manifest's sessions are deleted."""
    e = m.use_events()
    manifest = diff.retention_manifest(e, keep=1000, per_run=100, session_days=10_000, derived_days=10_000, now_after_days=0).where("action = 'delete_session'")
    return e.join(manifest.select("session_id"), "session_id", "left_anti").groupBy("session_id").agg(F.count(F.lit(1)).alias("events"))
