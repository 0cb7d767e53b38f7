"""Registered queries of the catalogue operators over the tabular model, each with independent DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import expressions as X
from .functions import vocab
from .operators import budget, diff, graph, ranks
from .queries import QUERIES
from .sources.model import Model
from .sources.tables import Catalog

_QUERIES: dict[str, tuple[Callable[[Catalog], DataFrame], str]] = {}


def _register(name: str, sql: str):
    def add(f):
        _QUERIES[name] = (f, sql)
        return f

    return add


# SQL forms of the model tables
_FILES = "f AS (SELECT 'f:' || doc_id AS file_id, source || '/' || lang || '/' || doc_id || '.md' AS path, sha256(text) AS content_hash, strlen(text)::BIGINT AS byte_size, lang, source, doc_id FROM documents)"
_G1 = f"{_FILES}, g1 AS (SELECT * FROM f WHERE doc_id % 17 <> 0)"
_G2 = "g2 AS (SELECT 'f:' || doc_id AS file_id, CASE WHEN doc_id % 13 = 0 THEN 'moved/' ELSE '' END || source || '/' || lang || '/' || doc_id || '.md' AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '#' ELSE text END) AS content_hash, strlen(CASE WHEN doc_id % 7 = 0 THEN text || '#' ELSE text END)::BIGINT AS byte_size, lang, source, doc_id FROM documents WHERE doc_id % 11 <> 0)"
_SYM = "sym AS (SELECT 'part:' || p_partkey AS symbol_key, p_name AS display_name, p_type AS kind, p_brand AS path, round((p_size % 10) / 10.0 + 0.05, 2) AS confidence, p_size::BIGINT AS start_byte, p_partkey FROM part)"
_EDGE = """e AS (SELECT 'order:' || l_orderkey AS source, 'part:' || l_partkey AS target, 'calls' AS type FROM lineitem
UNION ALL SELECT 'order:' || l_orderkey, 'supplier:' || l_suppkey, 'reads' FROM lineitem
UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'references' FROM orders
UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'imports' FROM customer
UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'imports' FROM supplier
UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'imports' FROM nation)"""
_EV = "ev AS (SELECT event_id, ts, user_id, user_id || '|' || strftime(ts, '%Y-%m-%d') AS session_id, CASE event_type WHEN 'view' THEN 'context_supplied' WHEN 'click' THEN 'entity_queried' WHEN 'purchase' THEN 'exact_source_requested' WHEN 'signup' THEN 'reasoning_use_reported' ELSE 'artifact_changed' END AS use_type, json_extract_string(props, '$.k') AS entity, round(value)::BIGINT AS bytes FROM events)"
_COV = "cov AS (SELECT d.doc_id, d.lang, d.source, CASE WHEN toxic = 1 THEN 'failed' WHEN quality = 1 THEN 'complete' WHEN quality = 0 THEN 'partial' ELSE 'unsupported' END AS status FROM documents d LEFT JOIN labels l USING (doc_id))"
_RES = f"{_SYM}, {_EDGE}, res AS (SELECT e.*, CASE WHEN type <> 'calls' THEN 'unresolved' WHEN p_partkey IS NULL THEN 'unresolved' WHEN p_partkey % 9 = 0 THEN 'stale' WHEN p_partkey % 5 = 0 THEN 'external' ELSE 'resolved_symbol' END AS status, coalesce(confidence, 0.0) AS confidence FROM e LEFT JOIN sym ON e.target = sym.symbol_key)"


def resolved_edges(c: Catalog) -> DataFrame:
    """Edges with a resolution by precedence; targets without a symbol are unresolved."""
    sym = c.symbols().select("symbol_key", "confidence", "p_partkey")
    key = F.col("p_partkey")
    status = F.when((F.col("type") != "calls") | key.isNull(), "unresolved").when(key % 9 == 0, "stale").when(key % 5 == 0, "external").otherwise("resolved_symbol")
    return c.edges().join(sym, F.col("target") == F.col("symbol_key"), "left").select("source", "target", "type", status.alias("status"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


# --- sources and extractors -------------------------------------------------------------------------------------

@_register("s2_content_hash", f"WITH {_FILES} SELECT content_hash, count(*) AS n_files, min(path) AS first_path, sum(byte_size)::BIGINT AS total_bytes FROM f GROUP BY content_hash")
def s2_content_hash(c: Catalog) -> DataFrame:
    return c.files().groupBy("content_hash").agg(F.count(F.lit(1)).alias("n_files"), F.min("path").alias("first_path"), F.sum("byte_size").alias("total_bytes"))


@_register("s5_json_keys", """SELECT k AS key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY k""")
def s5_json_keys(c: Catalog) -> DataFrame:
    return c.table("events").select(F.explode(F.json_object_keys("props")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


# --- predicates and scalars -------------------------------------------------------------------------------------

def _task_sql() -> str:
    cases = " ".join(f"WHEN regexp_matches(text, '(?i)(^|[^A-Za-z0-9_]){k}([^A-Za-z0-9_]|$)') THEN '{kind}|{rule}'" for k, kind, rule in vocab.TASK_RULES)
    return f"WITH x AS (SELECT conv_id, turn, CASE {cases} ELSE '{'|'.join(vocab.DEFAULT_TASK_RULE)}' END AS r FROM conversations) SELECT conv_id, turn, split_part(r, '|', 1) AS kind, split_part(r, '|', 2) AS rule_id FROM x"


@_register("p9_classify_task", _task_sql())
def p9_classify_task(c: Catalog) -> DataFrame:
    return c.table("conversations").select("conv_id", "turn", X.task_rule(F.coalesce("text", F.lit(""))).alias("r")).select("conv_id", "turn", "r.kind", "r.rule_id")


@_register("p10_trust_class", f"WITH {_RES} SELECT status, CASE WHEN status = 'resolved_symbol' THEN 'supported' WHEN confidence >= 0.5 THEN 'inferred' ELSE 'uncertain' END AS trust, count(*) AS n FROM res GROUP BY 1, 2")
def p10_trust_class(c: Catalog) -> DataFrame:
    trust = X.trust_class(F.col("status"), F.lit("structural"), F.col("confidence"))
    return resolved_edges(c).groupBy("status", trust.alias("trust")).agg(F.count(F.lit(1)).alias("n"))


@_register("p11_evidence_quality", f"WITH {_SYM} SELECT kind, CASE WHEN p_partkey % 2 = 0 AND confidence >= 0.9 THEN 'verified' WHEN confidence >= 0.5 THEN 'inferred' ELSE 'unsupported' END AS quality, count(*) AS n FROM sym GROUP BY 1, 2")
def p11_evidence_quality(c: Catalog) -> DataFrame:
    state = F.when(F.col("p_partkey") % 2 == 0, "exact").otherwise("heuristic")
    return c.symbols().groupBy("kind", X.evidence_quality(state, F.col("confidence")).alias("quality")).agg(F.count(F.lit(1)).alias("n"))


@_register("p13_token_estimate", f"WITH {_FILES} SELECT lang, sum(byte_size // 4)::BIGINT AS tokens FROM f GROUP BY lang")
def p13_token_estimate(c: Catalog) -> DataFrame:
    return c.files().groupBy("lang").agg(F.sum(X.token_estimate(F.col("byte_size"))).alias("tokens"))


@_register("p15_display_name", r"SELECT p_partkey, list_last(regexp_split_to_array(regexp_replace('pkg/' || p_brand || '#' || p_type || '().', '[.#():!]+$', ''), '[/#. ]')) AS display FROM part")
def p15_display_name(c: Catalog) -> DataFrame:
    key = F.concat(F.lit("pkg/"), "p_brand", F.lit("#"), "p_type", F.lit("()."))
    return c.table("part").select("p_partkey", X.display_name(key).alias("display"))


@_register("p23_cursor", f"WITH {_FILES} SELECT path, lower(hex(encode(path || chr(31) || file_id))) AS cursor FROM f")
def p23_cursor(c: Catalog) -> DataFrame:
    return c.files().select("path", F.lower(F.hex(F.concat_ws("\u001f", "path", "file_id").cast("binary"))).alias("cursor"))


# --- joins ------------------------------------------------------------------------------------------------------

@_register("j4_edge_resolution", f"WITH {_RES} SELECT type, status, count(*) AS n FROM res GROUP BY type, status")
def j4_edge_resolution(c: Catalog) -> DataFrame:
    return resolved_edges(c).groupBy("type", "status").agg(F.count(F.lit(1)).alias("n"))


@_register("j7_semi_join", "SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def j7_semi_join(c: Catalog) -> DataFrame:
    return c.table("customer").join(c.table("orders").where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


@_register("j8_disappeared_paths", f"WITH {_G1}, {_G2} SELECT file_id, path FROM g1 WHERE path NOT IN (SELECT path FROM g2)")
def j8_disappeared_paths(c: Catalog) -> DataFrame:
    return c.generation(1).join(c.generation(2).select("path"), "path", "left_anti").select("file_id", "path")


@_register("j9_latest_event", "SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def j9_latest_event(c: Catalog) -> DataFrame:
    return c.table("events").groupBy("user_id").agg(F.max("ts").alias("ts"), F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@_register("j12_renames", f"WITH {_G1}, {_G2}, gone AS (SELECT content_hash, min(path) AS old_path FROM g1 WHERE path NOT IN (SELECT path FROM g2) GROUP BY 1 HAVING count(*) = 1), new AS (SELECT content_hash, min(path) AS new_path FROM g2 WHERE path NOT IN (SELECT path FROM g1) GROUP BY 1 HAVING count(*) = 1) SELECT content_hash, old_path, new_path FROM gone JOIN new USING (content_hash)")
def j12_renames(c: Catalog) -> DataFrame:
    before, after = c.generation(1), c.generation(2)
    return diff.renames(before.join(after.select("path"), "path", "left_anti"), after.join(before.select("path"), "path", "left_anti"))


# --- aggregates -------------------------------------------------------------------------------------------------

@_register("a2_coverage_summary", f"WITH {_COV} SELECT status, count(*) AS n, sum(count(*)) OVER ()::BIGINT AS total FROM cov GROUP BY status")
def a2_coverage_summary(c: Catalog) -> DataFrame:
    return c.coverage().groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy()))


@_register("a9_evidence_clusters", "SELECT l_orderkey, l_partkey, count(*) AS facts, count(DISTINCT l_suppkey) AS targets, CASE WHEN count(DISTINCT l_suppkey) <= 1 THEN 'corroborated' ELSE 'conflict' END AS outcome, arg_max(l_linenumber, (l_quantity, l_linenumber)) AS preferred FROM lineitem GROUP BY 1, 2")
def a9_evidence_clusters(c: Catalog) -> DataFrame:
    targets = F.count_distinct("l_suppkey")
    return c.table("lineitem").groupBy("l_orderkey", "l_partkey").agg(F.count(F.lit(1)).alias("facts"), targets.alias("targets"), F.when(targets <= 1, "corroborated").otherwise("conflict").alias("outcome"), F.max_by("l_linenumber", F.struct("l_quantity", "l_linenumber")).alias("preferred"))


@_register("a15_nearest_rank", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def a15_nearest_rank(c: Catalog) -> DataFrame:
    return ranks.nearest_ranks(c.table("events").select("event_type", "value"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


# --- windows, order, sets ---------------------------------------------------------------------------------------

@_register("w1_retention_rank", f"WITH {_EV} SELECT session_id, k::INTEGER AS k FROM (SELECT session_id, row_number() OVER (PARTITION BY user_id ORDER BY max(ts) DESC, session_id) AS k FROM ev GROUP BY user_id, session_id) WHERE k <= 3")
def w1_retention_rank(c: Catalog) -> DataFrame:
    s = c.use_events().groupBy("user_id", "session_id").agg(F.max("ts").alias("last"))
    return s.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("last"), "session_id"))).where("k <= 3").select("session_id", "k")


@_register("w6_retained_candidates", f"WITH {_SYM}, r AS (SELECT *, dense_rank() OVER (ORDER BY kind) AS d FROM sym) SELECT kind, count(*) AS n, max(d) = 6 AS sentinel FROM r WHERE d <= 6 GROUP BY kind")
def w6_retained_candidates(c: Catalog) -> DataFrame:
    """The first five keys and the sentinel after them; keys are ranked among distinct keys only."""
    kinds = c.symbols().groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy("kind").limit(6)
    return kinds.select("kind", "n", (F.row_number().over(Window.orderBy("kind")) == 6).alias("sentinel"))


@_register("l3_history", "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def l3_history(c: Catalog) -> DataFrame:
    return c.table("events").select("event_id", "ts", "event_type").orderBy(F.desc("ts"), F.desc("event_id")).limit(50)


@_register("u2_set_algebra", f"WITH {_EV}, s AS (SELECT session_id, coalesce(list(DISTINCT entity) FILTER (use_type = 'context_supplied'), []) AS a, coalesce(list(DISTINCT entity) FILTER (use_type = 'entity_queried'), []) AS b FROM ev GROUP BY session_id) SELECT session_id, len(a) AS supplied, len(b) AS observed, len(list_intersect(a, b)) AS used, len(b) - len(list_intersect(a, b)) AS expanded FROM s")
def u2_set_algebra(c: Catalog) -> DataFrame:
    s = c.use_events().groupBy("session_id").agg(*[F.collect_set(F.when(F.col("use_type") == t, F.col("entity"))).alias(n) for t, n in (("context_supplied", "a"), ("entity_queried", "b"))])
    n = lambda x: F.size(x).cast("long")
    return s.select("session_id", n("a").alias("supplied"), n("b").alias("observed"), n(F.array_intersect("a", "b")).alias("used"), n(F.array_except("b", "a")).alias("expanded"))


@_register("u3_multiset_difference", "SELECT l_returnflag AS k, l_linestatus AS v, count(*) AS n FROM (SELECT l_returnflag, l_linestatus FROM lineitem WHERE l_linenumber <= 4 EXCEPT ALL SELECT l_returnflag, l_linestatus FROM lineitem WHERE l_linenumber > 4) GROUP BY 1, 2")
def u3_multiset_difference(c: Catalog) -> DataFrame:
    li = c.table("lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_linestatus").alias("v"), "l_linenumber")
    return li.where("l_linenumber <= 4").drop("l_linenumber").exceptAll(li.where("l_linenumber > 4").drop("l_linenumber")).groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))


# --- graph ------------------------------------------------------------------------------------------------------

@_register("g1_trace", f"WITH RECURSIVE {_EDGE}, t AS (SELECT 1 AS depth, source, type, target FROM e WHERE source = 'order:1' UNION SELECT t.depth + 1, e.source, e.type, e.target FROM t JOIN e ON e.source = t.target WHERE t.depth < 4) SELECT min(depth)::INTEGER AS depth, source, type, target FROM t GROUP BY source, type, target")
def g1_trace(c: Catalog) -> DataFrame:
    seeds = c.spark.createDataFrame([("order:1",)], "node string")
    return graph.trace(c.edges(), seeds, 4).groupBy("source", "type", "target").agg(F.min("depth").alias("depth")).select("depth", "source", "type", "target")


@_register("g3_impact", f"WITH {_EDGE}, s AS (SELECT 'region:1' AS node UNION ALL SELECT 'nation:3') SELECT DISTINCT source AS dependent, contains(lower(source), 'test') OR contains(lower(source), 'spec') AS is_test FROM e JOIN s ON target = node OR lower(target) LIKE '%' || lower(node) WHERE source NOT IN (SELECT node FROM s)")
def g3_impact(c: Catalog) -> DataFrame:
    return graph.impact(c.edges(), c.spark.createDataFrame([("region:1",), ("nation:3",)], "node string"))


@_register("g8_adjacency", f"WITH {_RES} SELECT source, target, status FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY status <> 'resolved_symbol', target, status) AS k FROM (SELECT DISTINCT source, target, status FROM res WHERE type = 'calls')) WHERE k <= 2")
def g8_adjacency(c: Catalog) -> DataFrame:
    rows = resolved_edges(c).where("type = 'calls'").select("source", "target", "status").distinct()
    w = Window.partitionBy("source").orderBy(F.col("status") != "resolved_symbol", "target", "status")
    return rows.withColumn("k", F.row_number().over(w)).where("k <= 2").drop("k")


# --- versions ---------------------------------------------------------------------------------------------------

@_register("d2_file_diff", f"WITH {_G1}, {_G2}, j AS (SELECT coalesce(g1.file_id, g2.file_id) AS file_id, g1.path AS old_path, g2.path AS new_path, g1.content_hash AS h1, g2.content_hash AS h2 FROM g1 FULL JOIN g2 ON g1.file_id = g2.file_id), k AS (SELECT file_id, old_path, new_path, CASE WHEN old_path IS NULL THEN 'added' WHEN new_path IS NULL THEN 'removed' WHEN old_path <> new_path THEN 'renamed' WHEN h1 <> h2 THEN 'modified' END AS change FROM j) SELECT file_id, old_path, new_path, change FROM k WHERE change IS NOT NULL")
def d2_file_diff(c: Catalog) -> DataFrame:
    return diff.file_changes(c.generation(1), c.generation(2)).select("file_id", "old_path", "new_path", "change")


@_register("d3_relationship_diff", """WITH b AS (SELECT 'order:' || l_orderkey AS i, 'part:' || l_partkey AS t, l_returnflag AS s FROM lineitem),
a AS (SELECT 'order:' || l_orderkey AS i, 'part:' || CASE WHEN l_linenumber = 1 THEN l_partkey + 1 ELSE l_partkey END AS t, CASE WHEN l_linenumber = 2 THEN 'X' ELSE l_returnflag END AS s FROM lineitem),
g AS (SELECT *, row_number() OVER (PARTITION BY i, t ORDER BY s) AS k FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)), n AS (SELECT *, row_number() OVER (PARTITION BY i, t ORDER BY s) AS k FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)),
j AS (SELECT coalesce(g.i, n.i) AS i, coalesce(g.t, n.t) AS t, g.s AS s1, n.s AS s2 FROM g FULL JOIN n ON g.i = n.i AND g.t = n.t AND g.k = n.k),
r AS (SELECT *, count(s1) OVER (PARTITION BY i) AS c1, count(s2) OVER (PARTITION BY i) AS c2 FROM j WHERE s1 IS NULL OR s2 IS NULL)
SELECT i AS identity, 'evidence_changed' AS change, t AS old_target, t AS new_target FROM j WHERE s1 IS NOT NULL AND s2 IS NOT NULL
UNION ALL SELECT i, 'retargeted', max(CASE WHEN s1 IS NOT NULL THEN t END), max(CASE WHEN s2 IS NOT NULL THEN t END) FROM r WHERE c1 = 1 AND c2 = 1 GROUP BY i
UNION ALL SELECT i, CASE WHEN s1 IS NULL THEN 'added' ELSE 'removed' END, CASE WHEN s1 IS NOT NULL THEN t END, CASE WHEN s2 IS NOT NULL THEN t END FROM r WHERE NOT (c1 = 1 AND c2 = 1)""")
def d3_relationship_diff(c: Catalog) -> DataFrame:
    return _lineitem_diff(c.table("lineitem"))


def _lineitem_diff(li: DataFrame) -> DataFrame:
    name = lambda kind, x: F.concat(F.lit(kind), x.cast("string"))
    before = li.select(name("order:", F.col("l_orderkey")).alias("identity"), name("part:", F.col("l_partkey")).alias("target"), F.col("l_returnflag").alias("state"))
    after = li.select(name("order:", F.col("l_orderkey")).alias("identity"), name("part:", F.when(F.col("l_linenumber") == 1, F.col("l_partkey") + 1).otherwise(F.col("l_partkey"))).alias("target"), F.when(F.col("l_linenumber") == 2, "X").otherwise(F.col("l_returnflag")).alias("state"))
    return diff.relationship_changes(before, after)


# --- selection --------------------------------------------------------------------------------------------------

@_register("b1_greedy_budget", """WITH RECURSIVE c AS (SELECT source AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS rank, doc_id::VARCHAR AS item, strlen(text)::BIGINT AS b FROM documents),
r AS (SELECT g, rank, item, CASE WHEN b > 20000 THEN 'bytes' WHEN b // 4 > 4000 THEN 'tokens' ELSE 'selected' END AS d, CASE WHEN b <= 20000 AND b // 4 <= 4000 THEN 1 ELSE 0 END AS n, CASE WHEN b <= 20000 AND b // 4 <= 4000 THEN b ELSE 0 END AS sb, CASE WHEN b <= 20000 AND b // 4 <= 4000 THEN b // 4 ELSE 0 END AS st FROM c WHERE rank = 1
UNION ALL SELECT c.g, c.rank, c.item, CASE WHEN n >= 10 THEN 'records' WHEN sb + b > 20000 THEN 'bytes' WHEN st + b // 4 > 4000 THEN 'tokens' ELSE 'selected' END, n + CASE WHEN n < 10 AND sb + b <= 20000 AND st + b // 4 <= 4000 THEN 1 ELSE 0 END, sb + CASE WHEN n < 10 AND sb + b <= 20000 AND st + b // 4 <= 4000 THEN b ELSE 0 END, st + CASE WHEN n < 10 AND sb + b <= 20000 AND st + b // 4 <= 4000 THEN b // 4 ELSE 0 END FROM r JOIN c ON c.g = r.g AND c.rank = r.rank + 1)
SELECT g AS request, rank, item, d AS decision FROM r""")
def b1_greedy_budget(c: Catalog) -> DataFrame:
    n = F.octet_length("text").cast("long")
    rank = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("long")
    rows = c.table("documents").select(F.col("source").alias("request"), rank.alias("rank"), F.col("doc_id").cast("string").alias("item"), n.alias("bytes"), X.token_estimate(n).alias("tokens"))
    return budget.greedy_select(rows, "request", 10, 20_000, 4_000)


# --- metrics ----------------------------------------------------------------------------------------------------


@_register("k4_integrity", "SELECT 'orders.o_custkey' AS rule, count(*) AS violations FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'lineitem.l_orderkey', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'documents.doc_id unique', (SELECT count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1))")
def k4_integrity(c: Catalog) -> DataFrame:
    count = lambda df, rule: df.agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("violations"))
    o, li = c.table("orders"), c.table("lineitem")
    out = count(o.join(c.table("customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti"), "orders.o_custkey")
    out = out.unionByName(count(li.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti"), "lineitem.l_orderkey"))
    return out.unionByName(count(c.table("documents").groupBy("doc_id").count().where("count > 1"), "documents.doc_id unique"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    first = {name: (lambda spark, sf_dir, f=f: f(Catalog(spark, sf_dir))) for name, (f, _) in _QUERIES.items()}
    return first | {name: (lambda spark, sf_dir, f=f: f(Model(spark, sf_dir))) for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in (_QUERIES | QUERIES).items() if sql is not None}
