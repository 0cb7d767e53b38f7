"""Queries: traces, seeds, packets, budgets, frontiers and compiled contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import expressions as X
from ..functions import policy, vocab
from ..operators import budget, context, graph
from ..operators import compiled as compiled_context
from ..sources.model import Model, named
from .registry import register, sql

_WALK = """t AS (SELECT 1 AS depth, {a} AS here, {b} AS there, source, type, target FROM e WHERE {a} IN ('part:40', 'part:77') UNION SELECT t.depth + 1, e.{a}, e.{b}, e.source, e.type, e.target FROM t JOIN e ON e.{a} = t.there WHERE t.depth < {n}),
w AS (SELECT min(depth)::INTEGER AS depth, source, type, target FROM t GROUP BY 2, 3, 4)"""


def _seeds(m: Model, *nodes: str) -> DataFrame:
    return m.spark.createDataFrame([(n,) for n in nodes], "node string")


_RESOLVED_TARGET = "CASE WHEN t % 4 = 0 THEN 'part:' || (t + 3) ELSE target END"


def _with_value(edges: DataFrame) -> DataFrame:
    return edges.withColumn("resolved_value", F.when(F.col("t") % 4 == 0, named("part", F.col("t") + 3)))


@register("g2_trace_resolved_outbound", sql("ce", ", e AS (SELECT DISTINCT source, type, " + _RESOLVED_TARGET + " AS target FROM ce WHERE status = 'resolved_symbol'), " + _WALK.format(a="source", b="target", n=3) + " SELECT * FROM w", recursive=True))
def g2_trace_resolved_outbound(m: Model) -> DataFrame:
    found = graph.trace_resolved(_with_value(m.resolved()), m.current_files().where("revision_id is not null"), _seeds(m, "part:40", "part:77"), 3, True)
    return found.groupBy("source", "type", "target").agg(F.min("depth").alias("depth"))


@register("g2_trace_resolved_inbound", sql("sr", ", e AS (SELECT DISTINCT source, type, " + _RESOLVED_TARGET + " AS target FROM sr WHERE status = 'resolved_symbol'), " + _WALK.format(a="target", b="source", n=2) + " SELECT * FROM w", recursive=True))
def g2_trace_resolved_inbound(m: Model) -> DataFrame:
    """No membership of the edge's file is asked for."""
    found = graph.trace_resolved(_with_value(m.resolved()), m.current_files(), _seeds(m, "part:40", "part:77"), 2, False)
    return found.groupBy("source", "type", "target").agg(F.min("depth").alias("depth"))


@register("g1_trace_bounded", sql("ce", ", e AS (SELECT DISTINCT source, type, target FROM ce), " + _WALK.format(a="source", b="target", n=2) + """, f AS (SELECT target, min(depth) AS first FROM w GROUP BY 1)
SELECT depth, source, type, target, (SELECT coalesce(bool_or(first = 2), false) FROM f) AS truncated_by_depth, (SELECT count(*) FROM w) > 25 AS truncated_by_records FROM w ORDER BY depth, source, type, target LIMIT 25""", recursive=True))
def g1_trace_bounded(m: Model) -> DataFrame:
    """G1 with its record cap and both flags; the order that decides is (depth, source, type, target)."""
    steps = graph.trace(m.current_edges().select("source", "type", "target"), _seeds(m, "part:40", "part:77"), 2)
    return graph.trace_flags(steps.groupBy("source", "type", "target").agg(F.min("depth").alias("depth")).select("depth", "source", "type", "target"), 2, 25)


@register("u4_canonical_seeds", "SELECT conv_id::VARCHAR AS request, array_to_string(list_sort(list_distinct(list(role))), ',') AS seeds FROM conversations GROUP BY 1")
def u4_canonical_seeds(m: Model) -> DataFrame:
    found = context.canonical_seeds(m.table("conversations").select(F.col("conv_id").cast("string").alias("request"), F.col("role").alias("seed")))
    return found.select("request", F.array_join("seeds", ",").alias("seeds"))


@register("j16_tests_for_seed", """WITH f AS (SELECT 'src/' || CASE WHEN doc_id % 3 = 0 THEN 'test_' ELSE '' END || source || '_' || lang || '.rs' AS path FROM documents), s(seed, base) AS (VALUES ('a/src1_en.rs', 'src1_en'), ('src7_de', 'src7_de'))
SELECT seed, path FROM f JOIN s ON lower(path) LIKE '%test%' || base || '%' OR lower(path) LIKE '%' || base || '%test%'""")
def j16_tests_for_seed(m: Model) -> DataFrame:
    path = F.concat(F.lit("src/"), F.when(F.col("doc_id") % 3 == 0, "test_").otherwise(""), F.col("source"), F.lit("_"), F.col("lang"), F.lit(".rs"))
    return context.tests_of(m.spark.createDataFrame([("a/src1_en.rs",), ("src7_de",)], "seed string"), m.table("documents").select(path.alias("path")))


_DEEP = """c AS (SELECT source || '|' || lang AS g, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS k, doc_id::VARCHAR AS item, 1 + doc_id % 3 AS work, doc_id % 4 AS depth, doc_id % 5 = 0 AS u, strlen(text)::BIGINT AS b FROM documents),
x AS (SELECT *, 0 AS z FROM c WHERE k = 1),
r AS (SELECT g, k, item, CASE WHEN work > 40 THEN 'work_units' WHEN depth > 2 THEN 'depth' WHEN u AND 0 >= 2 THEN 'uncertainty_reserve' WHEN b > 20000 THEN 'bytes' WHEN b // 4 > 4000 THEN 'tokens' ELSE 'selected' END AS d, CASE WHEN work > 40 THEN 0 ELSE work END AS spent,
CASE WHEN depth <= 2 AND b <= 20000 AND b // 4 <= 4000 AND NOT u THEN 1 ELSE 0 END AS n, CASE WHEN depth <= 2 AND b <= 20000 AND b // 4 <= 4000 AND u THEN 1 ELSE 0 END AS un, CASE WHEN depth <= 2 AND b <= 20000 AND b // 4 <= 4000 THEN b ELSE 0 END AS sb, CASE WHEN depth <= 2 AND b <= 20000 AND b // 4 <= 4000 THEN b // 4 ELSE 0 END AS st FROM x
UNION ALL SELECT g, k, item, d, CASE WHEN d = 'work_units' THEN spent ELSE spent + work END, n + CASE WHEN d = 'selected' AND NOT u THEN 1 ELSE 0 END, un + CASE WHEN d = 'selected' AND u THEN 1 ELSE 0 END, sb + CASE WHEN d = 'selected' THEN b ELSE 0 END, st + CASE WHEN d = 'selected' THEN b // 4 ELSE 0 END
FROM (SELECT c.*, r.spent, r.n, r.un, r.sb, r.st, CASE WHEN r.spent + c.work > 40 THEN 'work_units' WHEN c.depth > 2 THEN 'depth' WHEN c.u AND r.un >= 2 THEN 'uncertainty_reserve' WHEN NOT c.u AND r.n >= 8 THEN 'records' WHEN r.sb + c.b > 20000 THEN 'bytes' WHEN r.st + c.b // 4 > 4000 THEN 'tokens' ELSE 'selected' END AS d
FROM r JOIN c ON c.g = r.g AND c.k = r.k + 1))"""


def deep_candidates(m: Model) -> DataFrame:
    d, n = F.col("doc_id"), F.octet_length("text").cast("long")
    rank = F.row_number().over(Window.partitionBy("source", "lang").orderBy("doc_id"))
    return m.table("documents").select(F.concat_ws("|", "source", "lang").alias("request"), rank.alias("rank"), d.cast("string").alias("item"), (1 + d % 3).alias("work"), (d % 4).alias("depth"), (d % 5 == 0).alias("uncertain"), n.alias("bytes"), X.token_estimate(n).alias("tokens"))


@register("b2_deep_budget", f"WITH RECURSIVE {_DEEP} SELECT g AS request, k AS rank, item, d AS decision, spent::BIGINT AS ledger FROM r")
def b2_deep_budget(m: Model) -> DataFrame:
    """Ten records of which a fifth are kept for uncertainty."""
    return budget.deep_budget(deep_candidates(m), 10, 20_000, 4_000, 2, 40, 20)


@register("p19_role_and_reason", sql("ce", """, x AS (SELECT type, unnest([true, false]) AS inbound, CASE WHEN is_test OR artifact_class = 'test' THEN 'test_contract' WHEN artifact_class IN ('configuration', 'build_manifest', 'infrastructure') THEN 'configuration_input' END AS ar FROM ce),
y AS (SELECT type, inbound, CASE WHEN ar = 'test_contract' THEN 'test_contract|test_relation' WHEN ar = 'configuration_input' THEN 'configuration_input|config_relation' WHEN inbound AND type = 'calls' THEN 'direct_dependent|direct_caller' WHEN type = 'tests' THEN 'test_contract|test_relation'
WHEN type = 'configures' THEN 'configuration_input|config_relation' WHEN inbound THEN 'direct_dependent|task_recipe_requirement' WHEN type = 'calls' THEN 'direct_dependency|direct_callee' WHEN type IN ('implements', 'extends') THEN 'type_contract|implementation_relation'
WHEN type = 'imports' THEN 'direct_dependency|import_neighbor' ELSE 'direct_dependency|task_recipe_requirement' END AS rr FROM x) SELECT type, inbound, split_part(rr, '|', 1) AS role, split_part(rr, '|', 2) AS reason, count(*) AS n FROM y GROUP BY 1, 2, 3, 4"""))
def p19_role_and_reason(m: Model) -> DataFrame:
    rows = m.current_edges().withColumn("inbound", F.explode(F.array(F.lit(True), F.lit(False))))
    role = context.role_and_reason(F.col("type"), F.col("inbound"), F.lit(True), context.artifact_role(F.col("artifact_class"), F.col("is_test")))
    return rows.select("type", "inbound", role.alias("r")).groupBy("type", "inbound", "r.role", "r.reason").agg(F.count(F.lit(1)).alias("n"))


def _task_kind_sql() -> str:
    cases = " ".join(f"WHEN regexp_matches(text, '(?i)(^|[^A-Za-z0-9_]){k}([^A-Za-z0-9_]|$)') THEN '{kind}'" for k, kind, _ in vocab.TASK_RULES)
    return f"tk AS (SELECT conv_id, turn, CASE {cases} ELSE 'unknown' END AS task_kind FROM (SELECT conv_id, turn, text || CASE conv_id % 6 WHEN 0 THEN ' fix' WHEN 1 THEN ' API' WHEN 2 THEN ' Audit' WHEN 3 THEN ' config' WHEN 4 THEN ' tests' ELSE '' END AS text FROM conversations))"


def task_kinds(m: Model) -> DataFrame:
    """Tasks whose texts carry a keyword of some rules."""
    word = F.get(F.array(*map(F.lit, (" fix", " API", " Audit", " config", " tests", ""))), (F.col("conv_id") % 6).cast("int"))
    return m.table("conversations").select("conv_id", "turn", X.task_rule(F.concat("text", word))["kind"].alias("task_kind"))


_RECIPE_ROWS = ", ".join(f"('{k}', {str(a).lower()}, {str(b).lower()}, {str(c).lower()}, {str(d).lower()}, {n})" for k, (a, b, c, d, n) in policy.RECIPES.items())


@register("p20_recipes", f"WITH {_task_kind_sql()}, rc(task_kind, callers, callees, tests, configs, max_distance) AS (VALUES {_RECIPE_ROWS}) SELECT conv_id, turn, task_kind, callers, callees, tests, configs, max_distance FROM tk JOIN rc USING (task_kind)")
def p20_recipes(m: Model) -> DataFrame:
    return task_kinds(m).join(F.broadcast(context.recipes(m.spark)), "task_kind").select("conv_id", "turn", "task_kind", "callers", "callees", "tests", "configs", "max_distance")


_ROLE_ROWS = ", ".join(f"('{k}', '{r}', {str(r in need).lower()})" for k, need in policy.REQUIRED_ROLES.items() for r in policy.ROLES)


@register("b8_role_sufficiency", f"""WITH {_task_kind_sql()}, rr(task_kind, role, required) AS (VALUES {_ROLE_ROWS}), mx AS (SELECT conv_id::VARCHAR || ':' || turn AS request, role, required FROM tk JOIN rr USING (task_kind)),
it AS (SELECT conv_id::VARCHAR || ':' || turn AS request, ({list(policy.ROLES)})[conv_id % 4 + 1] AS role, 'i' || conv_id AS item, CASE WHEN turn % 3 = 0 THEN 'stale_evidence' END AS reason FROM conversations
UNION ALL SELECT conv_id::VARCHAR || ':' || turn, 'validation_target', 'v' || turn, NULL FROM conversations WHERE turn % 2 = 0),
df AS (SELECT conv_id::VARCHAR || ':' || turn AS request, 'test_contract' AS role, 'unsupported_evidence' AS reason FROM conversations WHERE conv_id % 5 = 0),
o AS (SELECT request, role, string_agg(item, ',' ORDER BY item) AS items, min(reason) AS weak FROM it GROUP BY 1, 2), j AS (SELECT mx.*, o.items, coalesce(weak, df.reason) AS reason FROM mx LEFT JOIN o USING (request, role) LEFT JOIN df USING (request, role))
SELECT request, role, required, CASE WHEN items IS NOT NULL AND reason IS NULL THEN 'satisfied' WHEN reason IS NOT NULL THEN 'deficient_' || reason WHEN required THEN 'missing' ELSE 'unavailable' END AS state,
CASE WHEN items IS NOT NULL AND reason IS NULL THEN NULL WHEN reason IS NOT NULL THEN reason WHEN required THEN 'missing_required_role' ELSE 'unavailable_evidence' END AS reason, coalesce(items, '') AS items FROM j""")
def b8_role_sufficiency(m: Model) -> DataFrame:
    request = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("request")
    matrix = task_kinds(m).join(F.broadcast(context.required_roles(m.spark)), "task_kind").select(request, "role", "required")
    c = m.table("conversations")
    role = F.get(F.array(*map(F.lit, policy.ROLES)), (F.col("conv_id") % 4).cast("int"))
    items = c.select(request, role.alias("role"), F.concat(F.lit("i"), F.col("conv_id").cast("string")).alias("item"), F.when(F.col("turn") % 3 == 0, "stale_evidence").alias("reason"))
    targets = c.where("turn % 2 = 0").select(request, F.lit("validation_target").alias("role"), F.concat(F.lit("v"), F.col("turn").cast("string")).alias("item"), F.lit(None).cast("string").alias("reason"))
    deficits = c.where("conv_id % 5 = 0").select(request, F.lit("test_contract").alias("role"), F.lit("unsupported_evidence").alias("reason"), F.lit(1).alias("priority"))
    return context.role_sufficiency(matrix, items.unionByName(targets), deficits)


@register("b9_coverage_claim", sql("cov", """, n AS (SELECT lang, count(*) FILTER (status = 'complete') AS c, count(*) FILTER (status = 'partial') AS p, count(*) FILTER (status = 'unsupported') AS u, count(*) FILTER (status = 'excluded') AS e, count(*) FILTER (status IN ('failed', 'stale')) AS f FROM cov GROUP BY 1
UNION ALL SELECT 'only-complete', count(*) FILTER (status = 'complete'), 0, 0, 0, 0 FROM cov UNION ALL SELECT 'nothing', 0, 0, 0, 0, 0) SELECT lang AS scope, CASE WHEN c + p + u + e + f = 0 THEN 'none' WHEN p = 0 AND f = 0 AND u = 0 THEN 'exhaustive_within_scope' ELSE 'bounded' END AS claim FROM n"""))
def b9_coverage_claim(m: Model) -> DataFrame:
    cov = m.file_coverage()
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    rows = cov.groupBy(F.col("lang").alias("scope")).agg(n("complete").alias("c"), n("partial").alias("p"), n("unsupported").alias("u"), n("excluded").alias("e"), n("failed", "stale").alias("f"))
    zero = [F.lit(0).cast("long").alias(x) for x in "pue"] + [F.lit(0).cast("long").alias("f")]
    rows = rows.unionByName(cov.agg(n("complete").alias("c")).select(F.lit("only-complete").alias("scope"), "c", *zero))
    rows = rows.unionByName(m.spark.createDataFrame([("nothing", 0, 0, 0, 0, 0)], rows.schema))
    return rows.select("scope", context.coverage_claim(*map(F.col, "cpuef")).alias("claim"))


_FEW = "few AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY status LIKE 'resolved%' DESC, fact_id) AS k FROM ce WHERE type IN ('calls', 'imports', 'tests')) WHERE k <= 3)"
_SD = "sd0 AS (SELECT 'q' || (p_partkey % 7) AS request, 'part:' || p_partkey AS node FROM part WHERE p_partkey % 20 = 0)"
_FRONT = f"""{_FEW}, {_SD}, fr AS (SELECT request, 1 AS depth, source, type, target, fact_id, status LIKE 'resolved%' AS ok FROM sd0 JOIN few ON source = node
UNION SELECT fr.request, fr.depth + 1, few.source, few.type, few.target, few.fact_id, few.status LIKE 'resolved%' FROM fr JOIN few ON few.source = fr.target WHERE fr.ok AND fr.depth < 2),
f2 AS (SELECT request, min(depth)::INTEGER AS depth, source, type, target, fact_id, CASE WHEN ok THEN 'followed' ELSE 'deferred' END AS state FROM fr GROUP BY request, source, type, target, fact_id, ok)"""


def walk_seeds(m: Model) -> DataFrame:
    return m.table("part").where("p_partkey % 20 = 0").select(F.concat(F.lit("q"), (F.col("p_partkey") % 7).cast("string")).alias("request"), named("part", "p_partkey").alias("seed"))


@register("g4_frontier", sql("ce", f", {_FRONT} SELECT request, depth, source, type, target, state FROM f2", recursive=True))
def g4_frontier(m: Model) -> DataFrame:
    return context.frontier(m.current_edges(), walk_seeds(m), ["calls", "imports", "tests"], 2, 3).select("request", "depth", "source", "type", "target", "state")


_CLOSURE = f"""{_FEW}, {_SD}, c1 AS (SELECT DISTINCT request, source, type, target, fact_id, status LIKE 'resolved%' AS ok FROM sd0 JOIN few ON source = node), lft AS (SELECT least((9 - 2) // 5, 3) AS rows FROM (SELECT count(*) FROM c1)),
c2 AS (SELECT DISTINCT n.request, f.source, f.type, f.target, f.fact_id, f.status LIKE 'resolved%' AS ok FROM (SELECT DISTINCT request, target AS node FROM c1 WHERE ok EXCEPT SELECT request, node FROM sd0) n JOIN few f ON f.source = n.node, lft WHERE f.k <= lft.rows)"""


@register("g5_relationship_closure", sql("ce", f", {_CLOSURE} SELECT request, 1 AS depth, source, type, target, CASE WHEN ok THEN 'followed' ELSE 'deferred' END AS state FROM c1 UNION ALL SELECT request, 2, source, type, target, CASE WHEN ok THEN 'followed' ELSE 'deferred' END FROM c2"))
def g5_relationship_closure(m: Model) -> DataFrame:
    """One ledger of all levels that binds: it pays the first level at three rows a node, and then one row a node."""
    edges, seeds = graph.cut(m.current_edges(), "edges"), walk_seeds(m)
    first = context.frontier(edges, seeds, ["calls", "imports", "tests"], 1, 3).count()
    found, left = context.relationship_closure(edges, seeds, ["calls", "imports", "tests"], 3, 3, first + 2 + 9)
    return found.select("request", "depth", "source", "type", "target", "state")


@register("g6_effect_closure", sql("eff conf", """, s AS (SELECT DISTINCT 'q' || (p_partkey % 7) AS request, 'part:' || p_partkey AS subject FROM part), b AS (SELECT DISTINCT subject_key FROM conf WHERE status IN ('open', 'preferred_with_conflict', 'unresolved'))
SELECT request, effect_id, subject, effect_type, subject IN (SELECT subject_key FROM b) AS conflicted FROM s JOIN eff USING (subject)"""))
def g6_effect_closure(m: Model) -> DataFrame:
    chosen = m.table("part").select(F.concat(F.lit("q"), (F.col("p_partkey") % 7).cast("string")).alias("request"), named("part", "p_partkey").alias("symbol_key"))
    return context.effect_closure(chosen, m.effects(), m.conflicts())


_COMPILED = f"""{_FRONT}, ci AS (SELECT request, node AS item, 0 AS depth FROM sd0 UNION SELECT request, target, depth FROM f2 WHERE state = 'followed'), cr AS (SELECT request, item, min(depth) AS depth FROM ci GROUP BY 1, 2),
ck AS (SELECT request, item, depth, row_number() OVER (PARTITION BY request ORDER BY depth, item) AS rank FROM cr)"""


def walked(m: Model) -> DataFrame:
    return context.frontier(m.current_edges(), walk_seeds(m), ["calls", "imports", "tests"], 2, 3)


def compiled(m: Model, front: DataFrame | None = None) -> DataFrame:
    """Seeds and what a frontier followed, ranked by depth and key: request, item, depth, rank."""
    s = walk_seeds(m)
    front = walked(m) if front is None else front
    items = s.select("request", F.col("seed").alias("item"), F.lit(0).alias("depth")).unionByName(front.where("state = 'followed'").select("request", F.col("target").alias("item"), "depth"))
    best = items.groupBy("request", "item").agg(F.min("depth").alias("depth"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("request").orderBy("depth", "item")))


@register("b4_compiled_context", sql("ce", f", {_COMPILED} SELECT request, count(*) AS n, sha256(string_agg(item, chr(10) ORDER BY rank)) AS context_hash FROM ck WHERE rank <= 30 GROUP BY 1", recursive=True))
def b4_compiled_context(m: Model) -> DataFrame:
    """Up to 30 items a request under a sealed hash; the seeds' order has no part in it."""
    return context.context_hash(compiled(m).where("rank <= 30"))


@register("b7_deep_context", sql("ce", f""", {_COMPILED}, n AS (SELECT request, count(*) AS considered, count(*) FILTER (depth <= 1 AND rank <= 24) AS selected FROM ck GROUP BY 1), d AS (SELECT request, count(*) AS deferred FROM f2 WHERE state = 'deferred' GROUP BY 1)
SELECT request, considered, (SELECT count(*) FROM (SELECT row_number() OVER (ORDER BY rank) AS k FROM ck c WHERE c.request = n.request AND depth <= 1) WHERE k <= 24) AS selected, coalesce(deferred, 0) AS deferred FROM n LEFT JOIN d USING (request)""", recursive=True))
def b7_deep_context(m: Model) -> DataFrame:
    """Candidates of the closure through the deep budget: depth 1 at most, 24 usual records, ample bytes, tokens and work."""
    front = walked(m)
    items = compiled(m, front).select("request", "item", "rank", "depth", F.lit(1).alias("work"), F.lit(False).alias("uncertain"), F.lit(1).alias("bytes"), F.lit(1).alias("tokens"))
    chosen = budget.deep_budget(items, 30, 10**9, 10**9, 1, 10**9, 20).groupBy("request").agg(F.count(F.lit(1)).alias("considered"), F.count_if(F.col("decision") == "selected").alias("selected"))
    lost = front.where("state = 'deferred'").select("request", "source", "type", "target", "fact_id").distinct().groupBy("request").agg(F.count(F.lit(1)).alias("deferred"))
    return chosen.join(lost, "request", "left").select("request", "considered", "selected", F.coalesce("deferred", F.lit(0)).alias("deferred"))


@register("b7a_seal_status", sql("g1 g2", """, s AS (SELECT g1.lang || '|' || (g1.doc_id % 40) AS request, g1.doc_id % 3 = 0 AS is_primary, CASE WHEN g2.file_id IS NULL THEN 'unavailable' WHEN g1.content_hash = g2.content_hash THEN 'verified' ELSE 'stale' END AS state FROM g1 LEFT JOIN g2 USING (file_id))
SELECT request, CASE WHEN count(*) FILTER (state <> 'verified') = 0 THEN 'complete' WHEN bool_or(state = 'verified' AND is_primary) THEN 'partial' ELSE 'blocked' END AS status, CASE WHEN bool_or(state = 'stale') THEN 'stale' WHEN bool_or(state = 'unavailable') THEN 'unavailable' END AS worst FROM s GROUP BY 1"""))
def b7a_seal_status(m: Model) -> DataFrame:
    old = m.generation(1).select("file_id", "content_hash", F.concat_ws("|", "lang", (F.col("doc_id") % 40).cast("string")).alias("request"), (F.col("doc_id") % 3 == 0).alias("is_primary"))
    rows = old.join(m.generation(2).select("file_id", F.col("content_hash").alias("live")), "file_id", "left")
    state = F.when(F.col("live").isNull(), "unavailable").when(F.col("live") == F.col("content_hash"), "verified").otherwise("stale")
    return context.seal_status(rows.select("request", "is_primary", state.alias("state")))


@register("k15_compiled_use", sql("ce", f""", {_COMPILED} SELECT request, 'context_supplied' AS use_type, item AS entity, rank AS ordinal FROM ck WHERE rank <= 30
UNION ALL SELECT request, 'relationship_traversed', source || '>' || target, row_number() OVER (PARTITION BY request ORDER BY source, type, target, fact_id) FROM f2""", recursive=True))
def k15_compiled_use(m: Model) -> DataFrame:
    """One event an item and one an edge, in order of delivery."""
    found = walked(m)
    items = compiled(m, found).where("rank <= 30").select("request", F.lit("context_supplied").alias("use_type"), F.col("item").alias("entity"), F.col("rank").cast("long").alias("ordinal"))
    front = found.select("request", "source", "type", "target", "fact_id").distinct()
    place = F.row_number().over(Window.partitionBy("request").orderBy("source", "type", "target", "fact_id")).cast("long")
    return items.unionByName(front.select("request", F.lit("relationship_traversed").alias("use_type"), F.concat_ws(">", "source", "target").alias("entity"), place.alias("ordinal")))


@register("k16_context_items", sql("ce", f", {_COMPILED} SELECT request, (rank - 1)::BIGINT AS position, item FROM ck WHERE rank <= 30", recursive=True))
def k16_context_items(m: Model) -> DataFrame:
    """The header's nested items as ordered rows."""
    nested = compiled(m).where("rank <= 30").groupBy("request").agg(F.array_sort(F.collect_list(F.struct("rank", "item"))).alias("items"))
    return nested.select("request", F.posexplode("items").alias("position", "i")).select("request", F.col("position").cast("long").alias("position"), "i.item")


@register("k24_temporal_candidates", """WITH t AS (SELECT user_id::VARCHAR AS request, event_id::VARCHAR AS item, CASE event_type WHEN 'error' THEN 'historical_constraint' WHEN 'purchase' THEN 'validation_target' ELSE 'temporal_evidence' END AS role, ts FROM events)
SELECT request, item, role, row_number() OVER (PARTITION BY request ORDER BY role, ts DESC, item) AS rank FROM t QUALIFY row_number() OVER (PARTITION BY request ORDER BY role, ts DESC, item) <= 50""")
def k24_temporal_candidates(m: Model) -> DataFrame:
    role = F.when(F.col("event_type") == "error", "historical_constraint").when(F.col("event_type") == "purchase", "validation_target").otherwise("temporal_evidence")
    rows = m.table("events").select(F.col("user_id").cast("string").alias("request"), F.col("event_id").cast("string").alias("item"), role.alias("role"), "ts")
    place = F.row_number().over(Window.partitionBy("request").orderBy("role", F.desc("ts"), "item"))
    return rows.withColumn("rank", place.cast("long")).where("rank <= 50").drop("ts")


@register("k25_validation_plan", sql("ce", f", {_COMPILED} SELECT DISTINCT ck.request, e.path FROM ck JOIN ce e ON e.source = ck.item WHERE e.is_test AND ck.rank <= 30", recursive=True))
def k25_validation_plan(m: Model) -> DataFrame:
    """Test files that a working set's items stand in."""
    tests = m.current_edges().where("is_test").select(F.col("source").alias("item"), "path").distinct()
    return compiled(m).where("rank <= 30").join(tests, "item").select("request", "path").distinct()


_KINDS = "('calls', 'imports', 'tests', 'configures', 'implements')"
_LIMITS = budget.Limits(12, 2500, 400, reserve=3, depth=1, work=30)
_TASK_KINDS = list(policy.RECIPES)


def _fold_sql(name: str, candidates: str, start: str) -> str:
    """CTEs: {name}_c, ranked candidates; {name}, their fold from the totals in {start}; {name}_s, the totals after it."""
    x = _LIMITS
    why = f"CASE WHEN f.spent + 1 > {x.work} THEN 'work_units' WHEN c.depth > {x.depth} THEN 'depth' WHEN c.u AND f.doubtful >= {x.reserve} THEN 'uncertainty_reserve' WHEN NOT c.u AND f.n >= {x.records} THEN 'records' WHEN f.size + c.b > {x.bytes} THEN 'bytes' WHEN f.used + c.t > {x.tokens} THEN 'tokens' ELSE 'selected' END"
    return f"""{name}_c AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY depth, item) AS rank FROM ({candidates})),
{name} AS (SELECT request, 0::BIGINT AS rank, NULL::VARCHAR AS item, NULL::VARCHAR AS role, NULL::VARCHAR AS reason, NULL::VARCHAR AS file_id, NULL::VARCHAR AS d, spent, n, doubtful, size, used FROM {start}
UNION ALL SELECT request, rank, item, role, reason, file_id, d, spent + CASE WHEN d = 'work_units' THEN 0 ELSE 1 END, n + CASE WHEN d = 'selected' AND NOT u THEN 1 ELSE 0 END, doubtful + CASE WHEN d = 'selected' AND u THEN 1 ELSE 0 END, size + CASE WHEN d = 'selected' THEN b ELSE 0 END, used + CASE WHEN d = 'selected' THEN t ELSE 0 END
FROM (SELECT c.request, c.rank, c.item, c.role, c.reason, c.file_id, c.u, c.b, c.t, f.spent, f.n, f.doubtful, f.size, f.used, {why} AS d FROM {name} f JOIN {name}_c c ON c.request = f.request AND c.rank = f.rank + 1)),
{name}_s AS (SELECT request, arg_max(spent, rank) AS spent, arg_max(n, rank) AS n, arg_max(doubtful, rank) AS doubtful, arg_max(size, rank) AS size, arg_max(used, rank) AS used FROM {name} GROUP BY 1)"""


_AR = "CASE WHEN is_test OR artifact_class = 'test' THEN 'test_contract' WHEN artifact_class IN ('configuration', 'build_manifest', 'infrastructure') THEN 'configuration_input' END"
_ROLE_OF = f"""CASE WHEN u THEN 'uncertainty|unresolved_relation' WHEN {_AR} = 'test_contract' THEN 'test_contract|test_relation' WHEN {_AR} = 'configuration_input' THEN 'configuration_input|config_relation' WHEN inbound AND type = 'calls' THEN 'direct_dependent|direct_caller'
WHEN type = 'tests' THEN 'test_contract|test_relation' WHEN type = 'configures' THEN 'configuration_input|config_relation' WHEN inbound THEN 'direct_dependent|task_recipe_requirement' WHEN type = 'calls' THEN 'direct_dependency|direct_callee'
WHEN type IN ('implements', 'extends') THEN 'type_contract|implementation_relation' WHEN type = 'imports' THEN 'direct_dependency|import_neighbor' ELSE 'direct_dependency|task_recipe_requirement' END"""
_SMALL = "{} AS role, {} AS reason, 0 AS depth, {} AS u, 64::BIGINT AS b, 16::BIGINT AS t, NULL AS file_id"
_DOCUMENT = f"""rq AS (SELECT 'q' || p_partkey AS request, ({_TASK_KINDS})[p_partkey // 20 % {len(_TASK_KINDS)} + 1] AS task_kind FROM part WHERE p_partkey % 20 = 0), s0 AS (SELECT request, 0::BIGINT AS spent, 0::BIGINT AS n, 0::BIGINT AS doubtful, 0::BIGINT AS size, 0::BIGINT AS used FROM rq),
sdx AS (SELECT 'q' || (p_partkey - p_partkey % 20) AS request, 'part:' || p_partkey AS k FROM part WHERE p_partkey % 20 < 2),
{_fold_sql("x1", f"SELECT request, symbol_key AS item, coalesce({_AR}, 'primary_implementation') AS role, 'explicit_seed' AS reason, 0 AS depth, false AS u, greatest(end_byte - start_byte, 0) + 96 AS b, greatest(end_byte - start_byte, 0) // 4 AS t, file_id FROM sdx JOIN cs ON symbol_key = k", "s0")},
g1x AS (SELECT request, item FROM x1 WHERE d = 'selected'),
fo AS (SELECT source AS a, target AS z, type, status LIKE 'resolved%' AS ok, false AS inbound FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY status LIKE 'resolved%' DESC, fact_id) AS k FROM ce WHERE type IN {_KINDS}) WHERE k <= 3
UNION ALL SELECT target, source, type, true, true FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY fact_id) AS k FROM ce WHERE type IN {_KINDS} AND status = 'resolved_symbol') WHERE k <= 3),
nb AS (SELECT request, z AS item, min((NOT ok, inbound, type)) AS m FROM g1x JOIN fo ON a = item GROUP BY 1, 2),
n2 AS (SELECT nb.request, nb.item, m[1] AS u, m[2] AS inbound, m[3] AS type FROM nb ANTI JOIN g1x ON g1x.request = nb.request AND g1x.item = nb.item),
{_fold_sql("x2", f"SELECT request, item, split_part(rr, '|', 1) AS role, split_part(rr, '|', 2) AS reason, 1 AS depth, u, coalesce(greatest(end_byte - start_byte, 0), 0) + 64 AS b, coalesce(greatest(end_byte - start_byte, 0), 0) // 4 AS t, file_id FROM (SELECT n2.*, end_byte, start_byte, file_id, {_ROLE_OF} AS rr FROM n2 LEFT JOIN cs ON symbol_key = item)", "x1_s")},
g2x AS (SELECT request, item FROM g1x UNION ALL SELECT request, item FROM x2 WHERE d = 'selected'), bad AS (SELECT DISTINCT subject_key FROM conf WHERE status IN ('open', 'preferred_with_conflict', 'unresolved')),
{_fold_sql("x3", "SELECT request, effect_id AS item, " + _SMALL.format("'effect'", "'effect_of_' || min(effect_type)", "bool_or(subject IN (SELECT subject_key FROM bad))") + " FROM g2x JOIN eff ON subject = item GROUP BY 1, 2", "x2_s")},
{_fold_sql("x4", "SELECT request, concat_ws('@', subject, kind, event_id) AS item, " + _SMALL.format("CASE WHEN kind = 'error' THEN 'historical_constraint' ELSE 'temporal_evidence' END", "'last_' || kind", "false") + " FROM (SELECT request, subject, effect_type AS kind, max(event_id) AS event_id FROM g2x JOIN eff ON subject = item GROUP BY 1, 2, 3)", "x3_s")},
{_fold_sql("x5", "SELECT request, item, " + _SMALL.format("'validation_target'", "'covers_selected'", "false") + " FROM (SELECT DISTINCT request, 'test:' || cs.path AS item FROM g2x JOIN ce ON ce.target = g2x.item JOIN cs ON cs.symbol_key = ce.source AND cs.is_test)", "x4_s")},
dx AS (SELECT *, 'seeds' AS section, 0 AS place FROM x1 WHERE rank > 0 UNION ALL SELECT *, 'closure', 1 FROM x2 WHERE rank > 0 UNION ALL SELECT *, 'effects', 2 FROM x3 WHERE rank > 0 UNION ALL SELECT *, 'temporal', 3 FROM x4 WHERE rank > 0 UNION ALL SELECT *, 'validation', 4 FROM x5 WHERE rank > 0),
om AS (SELECT request, string_agg(why || ':' || n, ',' ORDER BY why) AS omissions FROM (SELECT request, section || '_' || d AS why, count(*) AS n FROM dx WHERE d <> 'selected' GROUP BY 1, 2) GROUP BY 1),
rrx(task_kind, role, required) AS (VALUES {_ROLE_ROWS}), sel AS (SELECT DISTINCT request, role FROM dx WHERE d = 'selected'), dfx AS (SELECT request, role, min((place, 'omitted_' || d)) AS m FROM dx WHERE d <> 'selected' GROUP BY 1, 2),
ro AS (SELECT request, string_agg(rrx.role || ':' || CASE WHEN sel.role IS NOT NULL THEN 'satisfied' WHEN dfx.role IS NOT NULL THEN 'deficient_' || dfx.m[2] WHEN required THEN 'missing' ELSE 'unavailable' END, ',' ORDER BY rrx.role) AS roles
FROM rq JOIN rrx USING (task_kind) LEFT JOIN sel USING (request, role) LEFT JOIN dfx USING (request, role) GROUP BY 1),
lv AS (SELECT 'f:' || doc_id AS file_id, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE sha256(text) END AS h FROM documents WHERE doc_id % 9 <> 0),
st AS (SELECT request, file_id, bool_or(place = 0) AS prim, any_value(CASE WHEN h IS NULL THEN 'unavailable' WHEN h = content_hash THEN 'verified' ELSE 'stale' END) AS state FROM dx JOIN g2 USING (file_id) LEFT JOIN lv USING (file_id) WHERE d = 'selected' GROUP BY 1, 2),
sl AS (SELECT request, count(*) AS leases, CASE WHEN count(*) FILTER (state <> 'verified') = 0 THEN 'complete' WHEN bool_or(state = 'verified' AND prim) THEN 'partial' ELSE 'blocked' END AS seal FROM st GROUP BY 1)"""


@register("b7_compiled_document", sql("cs ce eff conf g2", f""", {_DOCUMENT} SELECT rq.request, task_kind, coalesce(string_agg(section || '|' || item || '|' || role || '|' || reason, ',' ORDER BY place, rank) FILTER (d = 'selected'), '') AS items, any_value(roles) AS roles, coalesce(any_value(omissions), '') AS omissions,
coalesce(any_value(leases), 0) AS leases, coalesce(any_value(seal), 'blocked') AS seal, any_value(x5_s.spent) AS work, any_value(x5_s.n + x5_s.doubtful) AS records, any_value(x5_s.size)::BIGINT AS bytes, any_value(x5_s.used)::BIGINT AS tokens
FROM rq LEFT JOIN dx USING (request) LEFT JOIN om USING (request) LEFT JOIN ro USING (request) LEFT JOIN sl USING (request) LEFT JOIN x5_s USING (request) GROUP BY 1, 2""", recursive=True))
def b7_compiled_document(m: Model) -> DataFrame:
    """The compiled context of parts divisible by 20 in five sections under one ledger, its lists as text."""
    key = F.col("p_partkey")
    request = lambda k: F.concat(F.lit("q"), k.cast("string")).alias("request")
    p = m.table("part")
    kind = F.get(F.array(*map(F.lit, _TASK_KINDS)), (F.floor(key / 20) % len(_TASK_KINDS)).cast("int")).alias("task_kind")
    requests, seeds = p.where(key % 20 == 0).select(request(key), kind), p.where(key % 20 < 2).select(request(key - key % 20), named("part", "p_partkey").alias("seed"))
    from .temporal import live_files

    files = m.generation(2).select("file_id", "path", "content_hash").join(live_files(m), "file_id", "left")
    effects = graph.cut(m.effects().select("effect_id", "subject", "effect_type", "event_id"), "effects")  # so that properties are parsed once
    e = compiled_context.Evidence(
        graph.cut(m.current_symbols().select("symbol_key", "file_id", "path", "start_byte", "end_byte", "artifact_class", "is_test"), "symbols"), graph.cut(m.current_edges().select("source", "target", "type", "status", "fact_id"), "edges"),
        effects.drop("event_id"), m.conflicts(), effects.select("event_id", "subject", F.col("effect_type").alias("kind")), files,
    )
    found = compiled_context.compile_context(requests, seeds, context.required_roles(m.spark), e, _LIMITS, ["calls", "imports", "tests", "configures", "implements"], 1)
    lines = lambda c, sep, *f: F.coalesce(F.array_join(F.transform(c, lambda x: F.concat_ws(sep, *[x[k] for k in f])), ","), F.lit(""))
    return found.select(
        "request", "task_kind", lines("items", "|", "section", "item", "role", "reason").alias("items"), lines("roles", ":", "role", "state").alias("roles"), lines("omissions", ":", "why", "n").alias("omissions"),
        F.coalesce(F.size("leases").cast("long"), F.lit(0)).alias("leases"), "seal", "cost.work", "cost.records", "cost.bytes", "cost.tokens",
    )
