"""Queries: snapshot joins, find, inspect, history, provider and source status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import find, lifecycle
from ..sources.model import Model, chosen
from .registry import register, sql


@register("j1_current_files", sql("cf", "SELECT workspace_id, generation_id, file_id, path, presence, revision_id, content_hash, coalesce(byte_size, -1) AS byte_size FROM cf"))
def j1_current_files(m: Model) -> DataFrame:
    return m.current_files().select("workspace_id", "generation_id", "file_id", "path", "presence", "revision_id", "content_hash", F.coalesce("byte_size", F.lit(-1)).alias("byte_size"))


@register("j2_current_symbols", sql("cs run", "SELECT cs.fact_id, symbol_key, path, provider, tier, confidence FROM cs JOIN run USING (run_id) WHERE run_status IN ('complete', 'partial')"))
def j2_current_symbols(m: Model) -> DataFrame:
    """The view's form: facts of failed runs are left out (find itself keeps them)."""
    good = m.runs().where(F.col("run_status").isin("complete", "partial"))
    return m.current_symbols().join(F.broadcast(good), "run_id").select("fact_id", "symbol_key", "path", "provider", "tier", "confidence")


@register("j3_edge_membership", sql("ce", "SELECT type, method, artifact_class, count(*) AS n, min(fact_id) AS first_fact FROM ce GROUP BY 1, 2, 3"))
def j3_edge_membership(m: Model) -> DataFrame:
    return m.current_edges().groupBy("type", "method", "artifact_class").agg(F.count(F.lit(1)).alias("n"), F.min("fact_id").alias("first_fact"))


_HISTORY = "WITH hg AS (SELECT 'w' || o_custkey AS workspace_id, 'g' || o_orderkey AS generation_id, o_orderkey AS sequence_no, CASE o_orderstatus WHEN 'F' THEN 'committed' WHEN 'O' THEN 'candidate' ELSE 'failed' END AS state FROM orders)"


def history_of_generations(m: Model) -> DataFrame:
    """A workspace for each customer, with a generation for each order."""
    o, status = m.table("orders"), F.col("o_orderstatus")
    return o.select(F.concat(F.lit("w"), F.col("o_custkey").cast("string")).alias("workspace_id"), F.concat(F.lit("g"), F.col("o_orderkey").cast("string")).alias("generation_id"), F.col("o_orderkey").alias("sequence_no"), chosen(status, {"F": "committed", "O": "candidate"}, "failed").alias("state"))


@register("w7_latest_generation", f"{_HISTORY} SELECT workspace_id, arg_max(generation_id, sequence_no) AS generation_id, max(sequence_no) AS sequence_no FROM hg WHERE state = 'committed' GROUP BY 1")
def w7_latest_generation(m: Model) -> DataFrame:
    """The latest committed generation of each workspace."""
    return lifecycle.latest_committed(history_of_generations(m))


@register("a19_next_sequence", f"{_HISTORY} SELECT 'w' || c_custkey AS workspace_id, coalesce(max(sequence_no), 0) + 1 AS next_no FROM customer LEFT JOIN hg ON workspace_id = 'w' || c_custkey GROUP BY 1")
def a19_next_sequence(m: Model) -> DataFrame:
    """The number that each workspace's next generation gets: 1 where there is none yet."""
    workspaces = m.table("customer").select(F.concat(F.lit("w"), F.col("c_custkey").cast("string")).alias("workspace_id"))
    last = history_of_generations(m).groupBy("workspace_id").agg(F.max("sequence_no").alias("last"))
    return workspaces.join(last, "workspace_id", "left").select("workspace_id", (F.coalesce("last", F.lit(0)) + 1).alias("next_no"))


@register("d13_generation_lifecycle", f"""{_HISTORY}, ac AS (SELECT workspace_id, arg_max(generation_id, sequence_no) AS active_id FROM hg WHERE state = 'committed' GROUP BY 1),
rq AS (SELECT 'w' || o_custkey AS workspace_id, CASE WHEN o_orderkey % 20 = 0 THEN 'g' ELSE 'x' END || o_orderkey AS generation_id, (['activate', 'fail', 'abandon'])[o_orderkey // 20 % 3 + 1] AS action FROM orders WHERE o_orderkey % 20 < 2)
SELECT workspace_id, generation_id, action, coalesce(state, 'absent') AS state, coalesce(state = 'candidate', false) AS accepted, coalesce(CASE WHEN state = 'candidate' AND action = 'activate' THEN generation_id ELSE active_id END, '') AS active_id FROM rq LEFT JOIN hg USING (workspace_id, generation_id) LEFT JOIN ac USING (workspace_id)""")
def d13_generation_lifecycle(m: Model) -> DataFrame:
    """What a request does to a workspace's generation: only a candidate can be activated, failed or abandoned."""
    key, g = F.col("o_orderkey"), history_of_generations(m)
    action = F.get(F.array(*map(F.lit, ("activate", "fail", "abandon"))), (F.floor(key / 20) % 3).cast("int"))
    asked = m.table("orders").where(key % 20 < 2).select(F.concat(F.lit("w"), F.col("o_custkey").cast("string")).alias("workspace_id"), F.concat(F.when(key % 20 == 0, "g").otherwise("x"), key.cast("string")).alias("generation_id"), action.alias("action"))
    active = lifecycle.latest_committed(g).select("workspace_id", F.col("generation_id").alias("active_id"))
    return lifecycle.judge_transitions(g, active, asked).withColumn("active_id", F.coalesce("active_id", F.lit("")))


@register("g7_ancestry", """WITH RECURSIVE p AS (SELECT doc_id AS id, CASE WHEN doc_id - 1 - doc_id % 7 >= 0 THEN doc_id - 1 - doc_id % 7 END AS parent FROM documents), q AS (SELECT doc_id AS newer, doc_id // 2 AS older FROM documents WHERE doc_id % 20 = 0),
w AS (SELECT newer, newer AS node, 0 AS d FROM q UNION ALL SELECT newer, parent, d + 1 FROM w JOIN p ON p.id = node WHERE parent IS NOT NULL)
SELECT q.older, q.newer, w.node IS NOT NULL AS is_ancestor, coalesce(w.d, -1)::BIGINT AS distance FROM q LEFT JOIN w ON w.newer = q.newer AND w.node = q.older""")
def g7_ancestry(m: Model) -> DataFrame:
    """Chains over all documents, a seventh of their number long; asked for every document divisible by 20."""
    d, up = m.table("documents").select("doc_id"), F.col("doc_id") - 1 - F.col("doc_id") % 7
    chains = lifecycle.Ancestry(d.select(F.col("doc_id").alias("generation_id"), F.when(up >= 0, up).alias("parent_id")))
    found = chains.judge(d.where("doc_id % 20 = 0").select(F.expr("doc_id div 2").alias("older"), F.col("doc_id").alias("newer")))
    return found.withColumn("distance", F.coalesce("distance", F.lit(-1)))


@register("a8_generation_counters", sql("gf rev", """SELECT generation_id, count(*) AS eligible, count(*) FILTER (presence = 'present') AS indexed, count(*) FILTER (presence = 'excluded') AS excluded,
count(*) FILTER (presence = 'secret_excluded') AS secret, count(*) FILTER (rev.artifact_class = 'source') AS parsed, sum(gf.byte_size)::BIGINT AS bytes
FROM gf LEFT JOIN rev USING (revision_id) GROUP BY generation_id"""))
def a8_generation_counters(m: Model) -> DataFrame:
    rows = m.generation_files().join(m.revisions().select("revision_id", "artifact_class"), "revision_id", "left")
    n = lambda c: F.count_if(c)
    return rows.groupBy("generation_id").agg(
        F.count(F.lit(1)).alias("eligible"), n(F.col("presence") == "present").alias("indexed"), n(F.col("presence") == "excluded").alias("excluded"),
        n(F.col("presence") == "secret_excluded").alias("secret"), n(F.col("artifact_class") == "source").alias("parsed"), F.sum("byte_size").alias("bytes"),
    )


@register("a1_evidence_envelope", sql("cs run cov conf sr", """SELECT (SELECT string_agg(p, ',' ORDER BY p) FROM (SELECT DISTINCT provider AS p FROM cs JOIN run USING (run_id))) AS providers,
(SELECT count(*) FROM cov) AS coverage_rows, (SELECT count(*) FROM cov WHERE status = 'complete') AS complete,
(SELECT count(*) FROM conf WHERE status IN ('open', 'preferred_with_conflict')) AS open_conflicts, (SELECT count(*) FROM sr WHERE status IN ('unresolved', 'ambiguous', 'invalid', 'stale')) AS unresolved"""))
def a1_evidence_envelope(m: Model) -> DataFrame:
    providers = m.current_symbols().select("run_id").distinct().join(F.broadcast(m.runs()), "run_id")
    return find.envelope(providers, m.file_coverage(), m.conflicts(), m.resolved())


_FIND = "SELECT symbol_key, display_name, kind, path, confidence, start_byte FROM cs WHERE lower(display_name) LIKE '%r%' AND confidence >= 0.3"
_CURSOR = "lower(hex(encode('g2' || chr(31) || 'q1' || chr(31) || last)))"


def _page_sql(after: str, limit: int) -> str:
    return sql("cs", f""", p AS ({_FIND} {after} ORDER BY path, start_byte, symbol_key LIMIT {limit + 1}), n AS (SELECT *, row_number() OVER (ORDER BY path, start_byte, symbol_key) AS place, count(*) OVER () AS n FROM p),
t AS (SELECT *, max(path) OVER () AS last FROM n WHERE place <= {limit})
SELECT symbol_key, display_name, kind, path, confidence, n > {limit} AS truncated, least(n, {limit}) AS total_matched, CASE WHEN n > {limit} THEN {_CURSOR} END AS next_cursor FROM t""")


def _found(m: Model, cursor: str | None) -> DataFrame:
    page = find.find_page(m.current_symbols(), find.matches("R", min_confidence=0.3), 50, "g2", "q1", cursor)
    return page.select("symbol_key", "display_name", "kind", "path", "confidence", "truncated", "total_matched", "next_cursor")


@register("b10_find_page", _page_sql("", 50))
def b10_find_page(m: Model) -> DataFrame:
    """The first page."""
    return _found(m, None)


@register("b10_find_resumed", _page_sql("AND path > 'src1/en/3.md'", 50))
def b10_find_resumed(m: Model) -> DataFrame:
    """The page after a cursor of this snapshot: by path only."""
    return _found(m, "\u001f".join(["g2", "q1", "src1/en/3.md"]).encode().hex())


@register("b10_find_stale_cursor", _page_sql("", 50))
def b10_find_stale_cursor(m: Model) -> DataFrame:
    """A cursor of another snapshot starts again."""
    return _found(m, "\u001f".join(["g1", "q1", "src1/en/3.md"]).encode().hex())


@register("l1_full_key_page", sql("cs", "SELECT path, start_byte, symbol_key FROM cs WHERE (path, start_byte, symbol_key) > ('src1/en/3.md', 10, 'part:2') ORDER BY 1, 2, 3 LIMIT 200"))
def l1_full_key_page(m: Model) -> DataFrame:
    """An extension: the cursor with the whole key, which drops nothing."""
    return find.keyset_page(m.current_symbols().select("path", "start_byte", "symbol_key"), ["path", "start_byte", "symbol_key"], 200, ("src1/en/3.md", 10, "part:2"))


@register("p25_negative_answer", sql("cs run", """, q AS (SELECT kind, run_id, confidence FROM cs), r AS (SELECT p_type AS kind, x AS least FROM (SELECT DISTINCT p_type FROM part UNION SELECT 'NONE') , (SELECT unnest([0.2, 0.9, 0.99]) AS x)),
n AS (SELECT r.kind, r.least, count(q.kind) AS matched FROM r LEFT JOIN q ON q.kind = r.kind AND q.confidence >= r.least GROUP BY 1, 2)
SELECT kind, least, matched, CASE WHEN matched = 0 THEN CASE WHEN least > 0.98 THEN 'provider_unavailable' WHEN kind = 'NONE' THEN 'not_found' ELSE 'coverage_partial' END END AS answer FROM n"""))
def p25_negative_answer(m: Model) -> DataFrame:
    kinds = m.table("part").select(F.col("p_type").alias("kind")).distinct().union(m.spark.createDataFrame([("NONE",)], "kind string"))
    asked = kinds.withColumn("least", F.explode(F.array(F.lit(0.2), F.lit(0.9), F.lit(0.99))))
    s = m.current_symbols().select(F.col("kind").alias("k"), "confidence")
    n = asked.join(s, (F.col("kind") == F.col("k")) & (F.col("confidence") >= F.col("least")), "left").groupBy("kind", "least").agg(F.count("k").alias("matched"))
    return n.withColumn("answer", find.negative_answer(F.col("matched"), F.lit(False), F.col("least") <= 0.98, F.col("kind") == "NONE"))


_ONE = "(SELECT min(path) FROM cs)"


@register("b11_inspect_path", sql("cs ce sr", f"""SELECT 'symbol' AS record, symbol_key AS a, kind AS b, '' AS c FROM cs WHERE path = {_ONE}
UNION ALL SELECT 'outbound', source, type, target FROM ce WHERE path = {_ONE}
UNION ALL SELECT 'inbound', source, type, target FROM sr WHERE target IN (SELECT symbol_key FROM cs WHERE path = {_ONE})"""))
def b11_inspect_path(m: Model) -> DataFrame:
    """Outbound edges are the revision's; inbound ones come from every revision, whatever the generation.

    The file is looked up first, so that edges are filtered by it before anything else.
    """
    s = m.current_symbols()
    one = s.agg(F.min(F.struct("path", "file_id")).alias("f")).first().f
    own = s.where(F.col("file_id") == one.file_id).select("symbol_key", "kind", "path")
    edges = m.resolved().where(F.col("file_id") == one.file_id).withColumn("path", F.lit(one.path))
    return find.inspect(own, edges, m.resolved(), one.path, own.select("symbol_key"))


@register("b11_inspect_symbol", sql("cs ce sr", """SELECT 'symbol' AS record, symbol_key AS a, path AS b, '' AS c FROM cs WHERE symbol_key = 'part:7'
UNION ALL SELECT 'outbound', source, type, target FROM ce WHERE source = 'part:7' UNION ALL SELECT 'inbound', source, type, target FROM sr WHERE target = 'part:7'"""))
def b11_inspect_symbol(m: Model) -> DataFrame:
    edge = lambda df, side, record: df.where(F.col(side) == "part:7").select(F.lit(record).alias("record"), F.col("source").alias("a"), F.col("type").alias("b"), F.col("target").alias("c"))
    own = m.current_symbols().where("symbol_key = 'part:7'").select(F.lit("symbol").alias("record"), F.col("symbol_key").alias("a"), F.col("path").alias("b"), F.lit("").alias("c"))
    return own.unionByName(edge(m.current_edges(), "source", "outbound")).unionByName(edge(m.resolved(), "target", "inbound"))


@register("b12_history", sql("g1 g2", """, h AS (SELECT event_id, ts, event_type, 'f:' || json_extract_string(props, '$.k') AS file_id FROM events WHERE event_type <> 'view'), gone AS (SELECT file_id FROM g1 WHERE file_id NOT IN (SELECT file_id FROM g2))
SELECT event_id, ts, event_type, file_id, file_id IN (SELECT file_id FROM gone) AS tombstone, (SELECT count(*) FROM h) AS total FROM h ORDER BY ts DESC, event_id DESC LIMIT 100"""))
def b12_history(m: Model) -> DataFrame:
    e = m.table("events").where("event_type != 'view'").select("event_id", "ts", "event_type", F.concat(F.lit("f:"), F.get_json_object("props", "$.k")).alias("file_id"))
    gone = m.generation(1).select("file_id").join(m.generation(2).select("file_id"), "file_id", "left_anti")
    return find.history(e, 100, gone)


@register("j5_provider_status", sql("run", """, p AS (SELECT provider, provider <> 'provider.d' AS enabled FROM run WHERE provider <> 'provider.e'),
x AS (SELECT 'provider.' || substr('abcd', (user_id % 4 + 1)::INTEGER, 1) AS provider, event_id AS execution_id, CASE WHEN value < 5 THEN 'partial' ELSE 'complete' END AS outcome, ts AS done_at FROM events WHERE event_type = 'click'),
i AS (SELECT 'provider.' || substr('abcd', (user_id % 4 + 1)::INTEGER, 1) AS provider, props AS reason, ts AS gone_at FROM events WHERE event_type = 'error'),
lx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY done_at DESC, execution_id DESC) AS k FROM x) WHERE k = 1), li AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY gone_at DESC, reason DESC) AS k FROM i) WHERE k = 1)
SELECT provider, tier, coalesce(enabled, true) AS enabled, execution_id::VARCHAR AS execution_id, outcome, reason, CASE WHEN NOT coalesce(enabled, true) THEN 'disabled' WHEN execution_id IS NULL THEN 'never_run' WHEN gone_at > done_at THEN 'stale' ELSE outcome END AS state
FROM run LEFT JOIN p USING (provider) LEFT JOIN lx USING (provider) LEFT JOIN li USING (provider)"""))
def j5_provider_status(m: Model) -> DataFrame:
    """Providers with policy, latest execution and latest invalidation."""
    e = m.table("events").withColumn("provider", F.concat(F.lit("provider."), F.substring(F.lit("abcd"), (F.col("user_id") % 4 + 1).cast("int"), F.lit(1))))
    runs = m.runs().select("provider", "tier")
    policy = runs.where("provider != 'provider.e'").select("provider", (F.col("provider") != "provider.d").alias("enabled"))
    done = e.where("event_type = 'click'").select("provider", F.col("event_id").alias("execution_id"), F.when(F.col("value") < 5, "partial").otherwise("complete").alias("outcome"), F.col("ts").alias("done_at"))
    gone = e.where("event_type = 'error'").select("provider", F.col("props").alias("reason"), F.col("ts").alias("at"))
    return find.provider_status(runs, policy, done, gone).select("provider", "tier", F.coalesce("enabled", F.lit(True)).alias("enabled"), F.col("execution_id").cast("string").alias("execution_id"), "outcome", "reason", "state")


@register("s18_verify_source", sql("g1", """, live AS (SELECT source || '/' || lang || '/' || doc_id || '.md' AS path, CASE WHEN doc_id % 41 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN text || '#' ELSE text END AS t FROM documents WHERE doc_id % 11 <> 0)
SELECT g1.path, CASE WHEN live.path IS NULL THEN 'not_found' WHEN t IS NULL THEN 'read_failed' WHEN sha256(t) = content_hash THEN 'verified' ELSE 'hash_mismatch' END AS status FROM g1 LEFT JOIN live ON live.path = g1.path"""))
def s18_verify_source(m: Model) -> DataFrame:
    """Indexed hashes against the bytes that are there now."""
    d = m.table("documents").where("doc_id % 11 != 0")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
    text = F.when(F.col("doc_id") % 41 == 0, F.lit(None)).when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("#"))).otherwise(F.col("text"))
    return find.verify_source(m.generation(1).select("path", "content_hash"), d.select(path.alias("path"), text.cast("binary").alias("content"))).select("path", "status")


@register("k23_symbol_coverage", sql("cs cov", "SELECT symbol_key, fact_id, coalesce(CASE WHEN c.status <> 'unsupported' THEN c.status END, 'complete') AS coverage FROM cs LEFT JOIN cov c ON c.file_id = cs.file_id"))
def k23_symbol_coverage(m: Model) -> DataFrame:
    known = m.file_coverage().where("status != 'unsupported'").select("file_id", "status")
    return m.current_symbols().join(known, "file_id", "left").select("symbol_key", "fact_id", F.coalesce("status", F.lit("complete")).alias("coverage"))


@register("k5_status", sql("gen ws cf", "SELECT workspace_id, generation_id, state, sequence_no, (SELECT count(*) FROM cf) AS files, (SELECT count(*) FROM gen WHERE state = 'candidate') AS stuck FROM ws JOIN gen ON generation_id = active_id"))
def k5_status(m: Model) -> DataFrame:
    one = m.workspace().join(m.generations(), F.col("active_id") == F.col("generation_id")).select("workspace_id", "generation_id", "state", "sequence_no")
    stuck = m.generations().agg(F.count_if(F.col("state") == "candidate").alias("stuck"))
    return one.crossJoin(m.current_files().agg(F.count(F.lit(1)).alias("files"))).crossJoin(stuck)  # single rows


@register("k6_doctor", f"{_HISTORY}, ac AS (SELECT workspace_id, max(sequence_no) AS last FROM hg WHERE state = 'committed' GROUP BY 1) SELECT workspace_id, generation_id, CASE WHEN state = 'candidate' AND sequence_no < last THEN 'abandoned' ELSE state END AS state FROM hg LEFT JOIN ac USING (workspace_id)")
def k6_doctor(m: Model) -> DataFrame:
    """Candidates that a later committed generation has left behind are abandoned."""
    return lifecycle.doctor(history_of_generations(m)).select("workspace_id", "generation_id", "state")
