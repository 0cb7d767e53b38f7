"""Queries: workspaces, providers, executions, policy tables, identities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions import policy
from ..operators import find, graph, merkle, resolution
from ..sources.model import Model, chosen
from .registry import register, sql

_ID = "substr(sha256('workspace' || chr(31) || {}), 1, 32)"


@register("k1_register_workspaces", f"""WITH a AS (SELECT DISTINCT source AS root FROM documents), old AS (SELECT root FROM a WHERE root LIKE '%1') SELECT {_ID.format('root')} AS workspace_id, root FROM a WHERE root NOT IN (SELECT root FROM old)""")
def k1_register_workspaces(m: Model) -> DataFrame:
    """Insert-or-ignore by a deterministic id."""
    rows = m.table("documents").select(X.framed_id(F.lit("workspace"), F.col("source")).alias("workspace_id"), F.col("source").alias("root"))
    return resolution.append_new(rows.where("root like '%1'").select("workspace_id").distinct(), rows, "workspace_id")


@register("k7_upsert_descriptors", "SELECT user_id AS provider, arg_max(event_type, (ts, event_id)) AS setting, max(event_id) >= 0 AS known FROM events GROUP BY user_id")
def k7_upsert_descriptors(m: Model) -> DataFrame:
    """The last write of each key stays."""
    e = m.table("events")
    rows = find.latest(e.withColumnRenamed("user_id", "provider"), "provider", ["ts", "event_id"], "event_type")
    return rows.select("provider", F.col("event_type").alias("setting"), F.lit(True).alias("known"))


@register("k8_record_coverage", sql("cov", "SELECT DISTINCT substr(sha256(concat_ws(chr(31), 'g2', 'file', file_id)), 1, 32) AS coverage_id, file_id, status FROM cov"))
def k8_record_coverage(m: Model) -> DataFrame:
    rows = m.file_coverage().select(X.framed_id(F.lit("g2"), F.lit("file"), F.col("file_id")).alias("coverage_id"), "file_id", "status")
    return rows.dropDuplicates(["coverage_id"])


@register("k9_execution_documents", sql("gf run", "SELECT run_id, file_id, CASE WHEN presence = 'present' THEN run_status ELSE 'skipped' END AS status, sha256(run_id || chr(31) || content_hash) AS digest FROM gf, run WHERE generation_id = 'g2' AND run_id IN ('run:1', 'run:3')"))
def k9_execution_documents(m: Model) -> DataFrame:
    """Two executions' documents with status and digest."""
    runs = m.runs().where(F.col("run_id").isin("run:1", "run:3"))
    rows = m.generation_files().where("generation_id = 'g2'").crossJoin(F.broadcast(runs))  # two rows
    return rows.select("run_id", "file_id", F.when(F.col("presence") == "present", F.col("run_status")).otherwise("skipped").alias("status"), F.sha2(F.concat_ws("\u001f", "run_id", "content_hash"), 256).alias("digest"))


@register("k10_checked_facts", sql("cs rev", "SELECT fact_id, symbol_key FROM cs JOIN rev USING (revision_id) WHERE start_byte >= 0 AND start_byte < end_byte AND end_byte <= byte_size"))
def k10_checked_facts(m: Model) -> DataFrame:
    """Facts whose span lies inside their revision; others are not recorded."""
    rows = m.current_symbols().join(m.revisions().select("revision_id", "byte_size"), "revision_id")
    return rows.where("start_byte >= 0 and start_byte < end_byte and end_byte <= byte_size").select("fact_id", "symbol_key")


@register("k10_edge_types", sql("ce", "SELECT upper(type) AS given, CASE WHEN upper(type) IN ('IMPORTS', 'REFERENCES', 'CALLS', 'IMPLEMENTS') THEN type ELSE 'other' END AS stored, CASE WHEN upper(type) IN ('IMPORTS', 'REFERENCES', 'CALLS', 'IMPLEMENTS') THEN NULL ELSE '{\"type\":\"' || upper(type) || '\"}' END AS attribute, count(*) AS n FROM ce GROUP BY 1, 2, 3"))
def k10_edge_types(m: Model) -> DataFrame:
    given = F.upper("type")
    known = given.isin("IMPORTS", "REFERENCES", "CALLS", "IMPLEMENTS")
    rows = m.current_edges().select(given.alias("given"), F.when(known, F.col("type")).otherwise("other").alias("stored"), F.when(~known, F.to_json(F.struct(given.alias("type")))).alias("attribute"))
    return rows.groupBy("given", "stored", "attribute").agg(F.count(F.lit(1)).alias("n"))


@register("k11_decide_support", """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'disabled' WHEN source NOT LIKE 'src1%' THEN 'out_of_scope' WHEN lang NOT IN ('en', 'de') THEN 'unsupported_language' ELSE 'supported' END AS decision FROM documents""")
def k11_decide_support(m: Model) -> DataFrame:
    """Enabled, then scope, then language."""
    decision = F.when(F.col("doc_id") % 7 == 0, "disabled").when(~F.col("source").like("src1%"), "out_of_scope").when(~F.col("lang").isin("en", "de"), "unsupported_language").otherwise("supported")
    return m.table("documents").select("doc_id", decision.alias("decision"))


@register("k12_provider_set_hash", f"""WITH RECURSIVE {merkle.root_sql("SELECT 'provider.' || user_id AS key, max(event_id // 1000)::VARCHAR AS value FROM events GROUP BY 1", "mp")} SELECT n AS members, digest AS set_hash FROM mp""")
def k12_provider_set_hash(m: Model) -> DataFrame:
    """The digest of a set of providers with their versions, whatever order they come in."""
    p = m.table("events").groupBy(F.concat(F.lit("provider."), F.col("user_id").cast("string")).alias("provider")).agg(F.max(F.expr("event_id div 1000")).alias("version"))
    return merkle.tree(p, F.col("provider"), F.col("version"), repeats=False).root().select(F.col("n").alias("members"), F.col("digest").alias("set_hash"))


_OUTCOMES = list(policy.COVERAGE_OF_OUTCOME)
_STATUS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in policy.COVERAGE_OF_OUTCOME.items())


@register("p21_outcomes", f"""WITH o AS (SELECT ({_OUTCOMES})[event_id % 13 + 1] AS outcome, user_id % 2 = 0 AS required FROM events) SELECT outcome, required, CASE outcome {_STATUS} END AS coverage, CASE WHEN required AND outcome IN ({', '.join(repr(b) for b in policy.BLOCKING)}) THEN 'block'
WHEN outcome = 'partial' OR outcome IN ({', '.join(repr(b) for b in policy.BLOCKING)}) THEN 'proceed_degraded' ELSE 'proceed' END AS decision, count(*) AS n FROM o GROUP BY 1, 2, 3, 4""")
def p21_outcomes(m: Model) -> DataFrame:
    outcome = F.get(F.array(*map(F.lit, _OUTCOMES)), (F.col("event_id") % 13).cast("int"))
    rows = m.table("events").select(outcome.alias("outcome"), (F.col("user_id") % 2 == 0).alias("required"))
    bad = F.col("outcome").isin(*policy.BLOCKING)
    decision = F.when(F.col("required") & bad, "block").when(bad | (F.col("outcome") == "partial"), "proceed_degraded").otherwise("proceed")
    return rows.groupBy("outcome", "required", chosen(F.col("outcome"), policy.COVERAGE_OF_OUTCOME, F.lit(None).cast("string")).alias("coverage"), decision.alias("decision")).agg(F.count(F.lit(1)).alias("n"))


@register("p22_canonical_digest", """SELECT c_custkey, sha256('{"balance":' || round(c_acctbal * 100)::BIGINT || ',"name":"' || c_name || '","segment":"' || c_mktsegment || '"}') AS digest FROM customer""")
def p22_canonical_digest(m: Model) -> DataFrame:
    """Fields in the order of their names, then sha256."""
    body = F.to_json(F.struct(F.round(F.col("c_acctbal") * 100).cast("long").alias("balance"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")))
    return m.table("customer").select("c_custkey", F.sha2(body, 256).alias("digest"))


@register("s19_ndjson", """SELECT '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS line FROM region""")
def s19_ndjson(m: Model) -> DataFrame:
    return m.table("region").select(F.to_json(F.struct("r_regionkey", "r_name")).alias("line"))


@register("p12_entity_ids", sql("ce", "SELECT CASE WHEN type = 'imports' THEN 'path:' WHEN status = 'external' THEN 'external:' ELSE 'symbol:' END || target AS entity, count(*) AS n FROM ce GROUP BY 1"))
def p12_entity_ids(m: Model) -> DataFrame:
    kind = F.when(F.col("type") == "imports", "path").when(F.col("status") == "external", "module").otherwise("symbol")
    return m.current_edges().groupBy(X.entity_id(kind, F.col("target")).alias("entity")).agg(F.count(F.lit(1)).alias("n"))


@register("p13_cost_estimates", sql("cs", "SELECT symbol_key, fact_id, greatest(end_byte - start_byte, 0) // 4 AS tokens, CASE WHEN method = 'exact' THEN 96 ELSE 64 END::BIGINT AS metadata FROM cs"))
def p13_cost_estimates(m: Model) -> DataFrame:
    """A seed's record counts 96 bytes of metadata, an edge's 64; seeds are the exact facts here."""
    return m.current_symbols().select("symbol_key", "fact_id", X.token_estimate(F.col("end_byte") - F.col("start_byte")).alias("tokens"), F.when(F.col("method") == "exact", 96).otherwise(64).cast("long").alias("metadata"))


@register("p10_trust_classes", sql("ce", "SELECT status, method, confidence, CASE WHEN status LIKE 'resolved%' AND method IN ('exact', 'semantic') THEN 'verified' WHEN status LIKE 'resolved%' THEN 'supported' WHEN confidence >= 0.5 THEN 'inferred' ELSE 'uncertain' END AS trust, count(*) AS n FROM ce GROUP BY 1, 2, 3, 4"))
def p10_trust_classes(m: Model) -> DataFrame:
    trust = X.trust_class(F.col("status"), F.col("method"), F.col("confidence"))
    return m.current_edges().groupBy("status", "method", "confidence", trust.alias("trust")).agg(F.count(F.lit(1)).alias("n"))


@register("p11_evidence_qualities", sql("cs", "SELECT method, confidence, CASE WHEN method IN ('semantic', 'exact') AND confidence >= 0.9 THEN 'verified' WHEN method = 'structural' THEN 'supported' WHEN confidence >= 0.5 THEN 'inferred' ELSE 'unsupported' END AS quality, count(*) AS n FROM cs GROUP BY 1, 2, 3"))
def p11_evidence_qualities(m: Model) -> DataFrame:
    return m.current_symbols().groupBy("method", "confidence", X.evidence_quality(F.col("method"), F.col("confidence")).alias("quality")).agg(F.count(F.lit(1)).alias("n"))


@register("u1_union_distinct", sql("cs run", "SELECT provider FROM cs JOIN run USING (run_id) UNION SELECT event_type FROM events ORDER BY 1"))
def u1_union_distinct(m: Model) -> DataFrame:
    used = m.current_symbols().select("run_id").distinct().join(F.broadcast(m.runs()), "run_id").select("provider")
    return used.union(m.table("events").select("event_type")).distinct().orderBy("provider")


@register("j6_suffix_impact", sql("ce", """, e AS (SELECT DISTINCT source, target FROM ce) SELECT DISTINCT source AS dependent, contains(lower(source), 'test') OR contains(lower(source), 'spec') AS is_test FROM e WHERE (target IN ('part:5', '7') OR lower(target) LIKE '%part:5' OR lower(target) LIKE '%7') AND source NOT IN ('part:5', '7')"""))
def j6_suffix_impact(m: Model) -> DataFrame:
    """G3 with suffix seeds: a seed may hit longer targets."""
    edges = m.current_edges().select("source", "target")
    return graph.impact(edges, m.spark.createDataFrame([("part:5",), ("7",)], "node string"))


_REF_KIND = "CASE WHEN type = 'imports' THEN 'path' WHEN status = 'external' THEN 'external' ELSE 'symbol' END"


@register("g3_impact_of_parts", sql("ce", f""", s AS (SELECT CASE p_partkey // 20 % 3 WHEN 0 THEN 'part:' WHEN 1 THEN './PART:' ELSE ':' END || p_partkey AS seed FROM part WHERE p_partkey % 20 = 0), e AS (SELECT path, target, status FROM ce WHERE {_REF_KIND} IN ('path', 'external')),
t AS (SELECT DISTINCT target FROM e JOIN s ON target = seed OR lower(target) LIKE '%' || regexp_replace(lower(seed), '^([.]/)+', ''))
SELECT path AS dependent, contains(lower(path), 'test') OR contains(lower(path), 'spec') AS is_test, bool_or(status LIKE 'resolved%') AS verified, bool_or(status NOT LIKE 'resolved%') AS uncertain FROM e WHERE target IN (SELECT target FROM t) AND path NOT IN (SELECT seed FROM s) GROUP BY path"""))
def g3_impact_of_parts(m: Model) -> DataFrame:
    """Files that depend on parts divisible by 20 through path and external references, verified and uncertain parts apart."""
    kind = F.when(F.col("type") == "imports", "path").when(F.col("status") == "external", "external").otherwise("symbol")
    edges = m.current_edges().select(F.col("path").alias("source"), "target", "status", kind.alias("ref_kind"))
    form = F.floor(F.col("p_partkey") / 20) % 3
    seed = F.concat(F.when(form == 0, "part:").when(form == 1, "./PART:").otherwise(":"), F.col("p_partkey").cast("string"))
    found = graph.impact(edges, m.table("part").where("p_partkey % 20 = 0").select(seed.alias("node")))
    return found.select("dependent", "is_test", "verified", "uncertain")


@register("a20_distinct_dependents", sql("ce", "SELECT target, count(DISTINCT source) AS dependents FROM ce GROUP BY target"))
def a20_distinct_dependents(m: Model) -> DataFrame:
    return m.current_edges().groupBy("target").agg(F.count_distinct("source").alias("dependents"))


_CAPABILITY_ROWS = ", ".join(f"('{c}', '{r}')" for c, r in policy.CAPABILITIES.items())


@register("r3_capabilities", f"WITH c(capability, least_route) AS (VALUES {_CAPABILITY_ROWS}), e AS (SELECT ({list(policy.CAPABILITIES)})[event_id % {len(policy.CAPABILITIES)} + 1] AS capability, user_id FROM events) SELECT capability, least_route, count(*) AS requests, count(DISTINCT user_id) AS users FROM e JOIN c USING (capability) GROUP BY 1, 2")
def r3_capabilities(m: Model) -> DataFrame:
    """Recorded requests by capability and the least route that serves it."""
    named_ = F.get(F.array(*map(F.lit, policy.CAPABILITIES)), (F.col("event_id") % len(policy.CAPABILITIES)).cast("int"))
    table = m.spark.createDataFrame(list(policy.CAPABILITIES.items()), "capability string, least_route string")
    asked = m.table("events").select(named_.alias("capability"), "user_id")
    return asked.join(F.broadcast(table), "capability").groupBy("capability", "least_route").agg(F.count(F.lit(1)).alias("requests"), F.count_distinct("user_id").alias("users"))


@register("l5_page_with_watermark", sql("cf", f""", {merkle.root_sql("SELECT file_id AS key, content_hash AS value FROM cf", "mf")}
SELECT 'same' AS request, 'page' AS outcome, path, file_id, digest FROM (SELECT path, file_id FROM cf WHERE (path, file_id) > ('src1/en/5.md', '') ORDER BY path, file_id LIMIT 200), mf
UNION ALL SELECT 'other', 'snapshot_changed', NULL, NULL, digest FROM mf""", recursive=True))
def l5_page_with_watermark(m: Model) -> DataFrame:
    """A keyset page under the digest of the snapshot that its cursor came from; a cursor of another digest gets no rows."""
    files = m.current_files()
    digest = lambda df: merkle.tree(df, F.col("file_id"), F.col("content_hash"), repeats=False).root().first().digest
    now, old = digest(files), digest(m.files_at(1))
    page = lambda name, seen: find.watermarked_page(files.select("path", "file_id"), ["path", "file_id"], 200, ("src1/en/5.md", ""), seen, now).select(F.lit(name).alias("request"), "outcome", "path", "file_id", "digest")
    return page("same", now).unionByName(page("other", old))


@register("s17_snapshot_tables", sql("gf", "SELECT generation_id, presence, count(*) AS n, count(DISTINCT path) AS paths FROM gf GROUP BY 1, 2"))
def s17_snapshot_tables(m: Model) -> DataFrame:
    return m.generation_files().groupBy("generation_id", "presence").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("path").alias("paths"))


@register("j4_effective_status", sql("se", "SELECT type, count(*) AS n, count(*) FILTER (x.status = 'unresolved') AS unresolved FROM (SELECT se.type, coalesce(r.status, 'unresolved') AS status FROM se LEFT JOIN (SELECT fact_id, 'resolved_symbol' AS status FROM se WHERE t % 3 = 0) r USING (fact_id)) x GROUP BY type"))
def j4_effective_status(m: Model) -> DataFrame:
    """Edges without a resolution are unresolved."""
    e = m.symbol_edges()
    r = e.where("t % 3 = 0").select("fact_id", F.lit("resolved_symbol").alias("status"))
    rows = e.join(r, "fact_id", "left").withColumn("status", F.coalesce("status", F.lit("unresolved")))
    return rows.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "unresolved").alias("unresolved"))


@register("p23_cursor_round_trip", sql("cf", "SELECT path, 'g2' AS generation_id, file_id FROM cf"))
def p23_cursor_round_trip(m: Model) -> DataFrame:
    """Cursors encoded and decoded again."""
    text = m.current_files().select(find.cursor_of(F.lit("g2"), F.col("file_id"), F.col("path")).alias("cursor"))
    parts = F.split(F.decode(F.unhex("cursor"), "UTF-8"), "\u001f")
    return text.select(F.get(parts, 2).alias("path"), F.get(parts, 0).alias("generation_id"), F.get(parts, 1).alias("file_id"))


@register("j9_latest_per_path", "SELECT 'f:' || json_extract_string(props, '$.k') AS file_id, arg_max(event_type, (ts, event_id)) AS last_type, max(ts) AS last_at FROM events WHERE ts <= TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1")
def j9_latest_per_path(m: Model) -> DataFrame:
    """The last event of each file up to a moment."""
    e = m.table("events").where(F.col("ts") <= F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).withColumn("file_id", F.concat(F.lit("f:"), F.get_json_object("props", "$.k")))
    return find.latest(e, "file_id", ["ts", "event_id"], "event_type", "ts").select("file_id", F.col("event_type").alias("last_type"), F.col("ts").alias("last_at"))


