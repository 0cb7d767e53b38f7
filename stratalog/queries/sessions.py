"""Queries: routing, session states, metrics, yield reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions import policy
from ..operators import find, graph, ranks, resolution, sessions
from ..sources.model import Model, chosen
from .context import _task_kind_sql, task_kinds
from .registry import register, sql

_CAPS = list(policy.CAPABILITIES)
_LIGHT = [c for c, r in policy.CAPABILITIES.items() if r == "light"]
_DEEP = [c for c, r in policy.CAPABILITIES.items() if r == "deep"]


@register("r1_route_decision", f"""WITH q AS (SELECT event_id, (['none', 'allow', 'require'])[event_id % 3 + 1] AS intent, (['direct', 'light', 'deep'])[user_id % 3 + 1] AS floor0, 'deep' AS ceiling0, ({_CAPS})[event_id % 8 + 1] AS c1, ({_CAPS})[user_id % 8 + 1] AS c2,
(['satisfied', 'unsatisfied', 'unknown'])[event_id % 7 % 3 + 1] AS s1, (['satisfied', 'unsatisfied', 'unknown'])[user_id % 5 % 3 + 1] AS s2, event_id % 4 AS n_seeds, event_id % 6 <> 0 AS seen FROM events),
k AS (SELECT *, CASE WHEN c1 = c2 THEN [c1] ELSE [c1, c2] END AS names, CASE WHEN c1 = c2 THEN [s2] ELSE [s1, s2] END AS states,
list_filter([CASE WHEN c1 <> c2 AND s1 <> 'satisfied' THEN c1 END, CASE WHEN s2 <> 'satisfied' THEN c2 END], lambda x: x IS NOT NULL) AS open,
CASE intent WHEN 'none' THEN 'direct' WHEN 'allow' THEN floor0 ELSE CASE floor0 WHEN 'direct' THEN 'light' ELSE floor0 END END AS floor, CASE intent WHEN 'none' THEN 'direct' ELSE ceiling0 END AS ceiling FROM q),
r AS (SELECT event_id, floor, ceiling, floor AS initial,
array_to_string(list_sort(list_filter(list_transform(list_distinct(states), lambda s: 'caller_capabilities_' || s) || ['intent_' || intent, 'route_floor_' || floor, 'route_ceiling_' || ceiling, CASE WHEN n_seeds > 0 THEN 'explicit_seeds_present' END,
CASE WHEN list_has_any(names, ['identity_lookup', 'exact_source']) THEN 'identity_or_source_requested' END, CASE WHEN list_has_any(names, ['bounded_relationships', 'impact_frontier']) THEN 'relationships_or_impact_requested' END,
CASE WHEN list_contains(names, 'basic_coverage_conflicts') THEN 'basic_coverage_conflicts_requested' END, CASE WHEN list_has_any(names, {_DEEP}) THEN 'deep_synthesis_requested' END,
CASE WHEN seen THEN 'starting_generation_observed' ELSE 'starting_generation_unavailable' END], lambda x: x IS NOT NULL)), ',') AS signals,
array_to_string(list_sort(list_filter([CASE WHEN len(open) = 0 THEN 'caller_context_sufficient' ELSE 'caller_context_incomplete' END, CASE WHEN intent = 'none' THEN 'context_not_requested' END, CASE WHEN intent = 'require' THEN 'explicit_context_request' END,
CASE WHEN list_has_any(open, {_LIGHT}) THEN 'light_capability_required' END, CASE WHEN list_has_any(open, {_DEEP}) THEN 'deep_capability_required' END, CASE WHEN floor <> 'direct' THEN 'route_floor_applied' END,
CASE WHEN NOT seen THEN 'starting_generation_unavailable' END], lambda x: x IS NOT NULL)), ',') AS reasons FROM k)
SELECT event_id::VARCHAR AS request, floor, ceiling, initial, signals, reasons, sha256(concat_ws(chr(31), event_id::VARCHAR, floor, ceiling, initial, signals, reasons)) AS decision_hash FROM r""")
def r1_route_decision(m: Model) -> DataFrame:
    pick = lambda values, by: F.get(F.array(*map(F.lit, values)), by.cast("int"))
    e, u = F.col("event_id"), F.col("user_id")
    states = ["satisfied", "unsatisfied", "unknown"]
    c1, c2, s1, s2 = pick(_CAPS, e % 8), pick(_CAPS, u % 8), pick(states, e % 7 % 3), pick(states, u % 5 % 3)
    both = F.when(c1 == c2, F.create_map(c2, s2)).otherwise(F.map_from_arrays(F.array(c1, F.when(c1 == c2, F.lit("-")).otherwise(c2)), F.array(s1, s2)))
    return sessions.decide_route(m.table("events").select(
        e.cast("string").alias("request"), pick(["none", "allow", "require"], e % 3).alias("intent"), pick(["direct", "light", "deep"], u % 3).alias("floor"), F.lit("deep").alias("ceiling"),
        both.alias("capabilities"), (e % 4).alias("n_seeds"), F.when(e % 6 != 0, "g2").alias("generation"),
    ))


_STATES = ["created", "context_compiled", "active", "reconciled", "completed", "abandoned", "failed"]
_ALLOWED = [f"{a}>{b}" for a, b in policy.TRANSITIONS]


@register("r4_transitions", f"""WITH s AS (SELECT unnest({_STATES}) AS a), t AS (SELECT unnest({_STATES}) AS b), e AS (SELECT event_id, ({_STATES})[event_id % 7 + 1] AS a, ({_STATES})[user_id % 7 + 1] AS b FROM events)
SELECT a AS state, b AS target, a NOT IN ('completed', 'abandoned', 'failed') AND (b = 'failed' OR a || '>' || b IN (SELECT unnest({_ALLOWED}))) AS allowed, count(*) AS n FROM e GROUP BY 1, 2, 3""")
def r4_transitions(m: Model) -> DataFrame:
    states = F.array(*map(F.lit, _STATES))
    rows = m.table("events").select(F.get(states, (F.col("event_id") % 7).cast("int")).alias("state"), F.get(states, (F.col("user_id") % 7).cast("int")).alias("target"))
    return rows.groupBy("state", "target", sessions.judge_transition(F.col("state"), F.col("target")).alias("allowed")).agg(F.count(F.lit(1)).alias("n"))


_SESSIONS = f"""ss AS (SELECT session_id, 'g' || (min(event_id) % 4) AS start_generation, ({_STATES})[(min(event_id) % 7 + 1)::BIGINT] AS state, (min(event_id) % 5)::VARCHAR AS had_outcome, (min(event_id) % 3)::VARCHAR AS tree_hash FROM ev GROUP BY 1)"""


def task_sessions(m: Model) -> DataFrame:
    first = F.min("event_id")
    s = m.use_events().groupBy("session_id").agg(first.alias("e"))
    e = F.col("e")
    return s.select("session_id", F.concat(F.lit("g"), (e % 4).cast("string")).alias("start_generation"), F.get(F.array(*map(F.lit, _STATES)), (e % 7).cast("int")).alias("state"), (e % 5).cast("string").alias("had_outcome"), (e % 3).cast("string").alias("tree_hash"))


@register("r5_reconcile_sessions", sql("ev gen", f", {_SESSIONS} SELECT session_id, start_generation, CASE WHEN ss.state = 'active' AND sequence_no < 3 THEN 'reconciled' ELSE ss.state END AS state FROM ss LEFT JOIN gen ON generation_id = start_generation"))
def r5_reconcile_sessions(m: Model) -> DataFrame:
    return sessions.reconcile_sessions(task_sessions(m), m.generations(), 3)


@register("r6_complete_sessions", sql("ev gen", f""", {_SESSIONS}, rq AS (SELECT session_id, 'g' || (max(event_id) % 4) AS end_generation, (max(event_id) % 5)::VARCHAR AS outcome, (max(event_id) % 3)::VARCHAR AS seen_hash FROM ev GROUP BY 1 UNION ALL SELECT 'none', 'g2', '1', '1')
SELECT rq.session_id, CASE WHEN ss.state IS NULL THEN 'not_found' WHEN ss.state = 'completed' AND outcome = had_outcome THEN 'replayed' WHEN ss.state = 'completed' THEN 'conflicting_replay' WHEN ss.state <> 'reconciled' THEN 'illegal_transition'
WHEN end_generation <> 'g2' OR gen.state IS NULL OR gen.state <> 'committed' THEN 'generation_not_active' WHEN tree_hash <> seen_hash THEN 'tree_mismatch' ELSE 'completed' END AS verdict FROM rq LEFT JOIN ss USING (session_id) LEFT JOIN gen ON generation_id = end_generation"""))
def r6_complete_sessions(m: Model) -> DataFrame:
    last = m.use_events().groupBy("session_id").agg(F.max("event_id").alias("e"))
    e = F.col("e")
    asked = last.select("session_id", F.concat(F.lit("g"), (e % 4).cast("string")).alias("end_generation"), (e % 5).cast("string").alias("outcome"), (e % 3).cast("string").alias("seen_hash"))
    asked = asked.unionByName(m.spark.createDataFrame([("none", "g2", "1", "1")], asked.schema))
    return sessions.complete_sessions(asked, task_sessions(m), m.generations(), "g2")


_EVIDENCE = """p AS (SELECT session_id, entity, bool_or(use_type = 'context_supplied') AS su, min(bytes) FILTER (use_type = 'context_supplied') AS lo, max(bytes) FILTER (use_type = 'context_supplied') AS hi,
count(*) FILTER (use_type = 'exact_source_requested' AND bytes > 0) AS rd, bool_or(use_type = 'reasoning_use_reported') AS rp, bool_or(use_type = 'artifact_changed') AS cg FROM ev WHERE entity IS NOT NULL GROUP BY 1, 2),
m1 AS (SELECT session_id, count(*) FILTER (su) AS supplied, count(*) FILTER (rd > 0) AS observed, count(*) FILTER (rp) AS reported, count(*) FILTER (cg) AS changed, count(*) FILTER (rd > 0 AND su) AS observed_supplied, count(*) FILTER (rp AND su) AS reported_supplied,
count(*) FILTER ((rd > 0 OR rp) AND NOT su) AS expanded, sum(rd)::BIGINT AS reads, sum(CASE WHEN su THEN rd ELSE 0 END)::BIGINT AS rediscoveries, sum(CASE WHEN su THEN lo ELSE 0 END)::BIGINT AS supplied_bytes, sum(CASE WHEN su AND rd > 0 THEN lo ELSE 0 END)::BIGINT AS used_bytes, coalesce(bool_or(su AND lo <> hi), false) AS conflicting FROM p GROUP BY 1)"""


@register("m1_session_evidence", sql("ev", f", {_EVIDENCE} SELECT * FROM m1"))
def m1_session_evidence(m: Model) -> DataFrame:
    return sessions.evidence(m.use_events())


_FRACTIONS = " UNION ALL ".join(f"SELECT session_id, '{k}' AS metric, {a} AS numerator, {b or '1::BIGINT'} AS denominator, supplied + reads + reported + changed AS total, conflicting FROM m1" for k, (a, b) in sessions.METRICS.items())


@register("m2_context_fractions", sql("ev", f", {_EVIDENCE}, fr AS ({_FRACTIONS}) SELECT session_id, metric, numerator, denominator, CASE WHEN total > 4096 THEN 'capacity_exceeded' WHEN conflicting THEN 'conflicting_supplied_bytes' WHEN denominator = 0 THEN 'zero_denominator' ELSE 'valid' END AS validity FROM fr"))
def m2_context_fractions(m: Model) -> DataFrame:
    """Five unreduced fractions a session."""
    return sessions.context_metrics(sessions.evidence(m.use_events()))


@register("a14_metric_totals", sql("ev", f", {_EVIDENCE}, fr AS ({_FRACTIONS}) SELECT metric, sum(numerator)::BIGINT AS numerator, sum(denominator)::BIGINT AS denominator, count(*) FILTER (denominator = 0) AS invalid FROM fr WHERE NOT conflicting GROUP BY 1"))
def a14_metric_totals(m: Model) -> DataFrame:
    found = sessions.context_metrics(sessions.evidence(m.use_events()).where("not conflicting"))
    return found.groupBy("metric").agg(F.sum("numerator").alias("numerator"), F.sum("denominator").alias("denominator"), F.count_if(F.col("denominator") == 0).alias("invalid"))


_FIELDS = [f for _, f in policy.YIELD_GATES]


def _reports_sql(shift: int) -> str:
    fields = ", ".join(f"CASE WHEN (event_id + {shift * (i + 1)}) % {17 + i} = 0 THEN 'y' ELSE 'x' END AS {f}" for i, f in enumerate(_FIELDS) if f != "sample_size")
    return f"""SELECT event_id AS pair, {fields}, CASE WHEN (event_id + {shift}) % 23 = 0 THEN 'v1.0' ELSE 'v1.5' END AS schema_version, (event_id + {shift}) % 19 <> 0 AS accepted, 3 + (event_id + {shift}) % 29 // 28 AS sample_size,
3 + CASE WHEN (event_id + {shift}) % 31 = 0 THEN 1 ELSE (event_id + {shift}) % 29 // 28 END AS samples, (event_id + {shift}) % 2 AS context_hash, round(value)::BIGINT + {shift} AS size, user_id * {shift + 1} AS source_bytes FROM events"""


_GATES = " ".join(f"WHEN a.{f} <> b.{f} THEN '{why}'" for why, f in policy.YIELD_GATES)


@register("m3_compare_reports", f"""WITH a AS ({_reports_sql(0)}), b AS ({_reports_sql(1)}), c AS (SELECT a.pair, CASE WHEN a.schema_version <> 'v1.5' THEN 'unsupported_report_version' WHEN NOT a.accepted THEN 'outcome_not_accepted' WHEN b.schema_version <> 'v1.5' THEN 'unsupported_report_version' WHEN NOT b.accepted THEN 'outcome_not_accepted'
WHEN a.samples <> a.sample_size OR b.samples <> b.sample_size THEN 'invalid_report' {_GATES} ELSE 'comparable' END AS verdict, a.context_hash = b.context_hash AS h, b.size - a.size AS s, b.source_bytes - a.source_bytes AS sb FROM a JOIN b USING (pair))
SELECT pair, verdict, CASE WHEN verdict = 'comparable' THEN h::VARCHAR END AS hashes_match, CASE WHEN verdict = 'comparable' THEN s::VARCHAR END AS size_delta, CASE WHEN verdict = 'comparable' THEN sb::VARCHAR END AS bytes_delta FROM c""")
def m3_compare_reports(m: Model) -> DataFrame:
    e = F.col("event_id")

    def report(shift: int) -> F.Column:
        at = e + shift
        fields = [F.when((e + shift * (i + 1)) % (17 + i) == 0, "y").otherwise("x").alias(f) for i, f in enumerate(_FIELDS) if f != "sample_size"]
        extra = F.floor(at % 29 / 28)
        return F.struct(
            *fields, F.when(at % 23 == 0, "v1.0").otherwise("v1.5").alias("schema_version"), (at % 19 != 0).alias("accepted"), (3 + extra).alias("sample_size"), (3 + F.when(at % 31 == 0, 1).otherwise(extra)).alias("samples"),
            (at % 2).alias("context_hash"), (F.round("value").cast("long") + shift).alias("size"), (F.col("user_id") * (shift + 1)).alias("source_bytes"),
        )

    found = sessions.compare_reports(m.table("events").select(e.alias("pair"), report(0).alias("a"), report(1).alias("b")))
    return found.withColumns({c: F.col(c).cast("string") for c in ("hashes_match", "size_delta", "bytes_delta")})


@register("a16_arm_summary", """WITH s AS (SELECT event_type AS arm, round(value * 1000)::BIGINT AS micros, CASE WHEN event_type = 'view' THEN 'same' ELSE (event_id % 2)::VARCHAR END AS hash FROM events), b AS (SELECT arm, count(*) AS n, min(micros) AS minimum, max(micros) AS maximum, (sum(micros) // count(*))::BIGINT AS mean,
quantile_disc(micros, 0.5) AS p50, quantile_disc(micros, 0.95) AS p95, count(DISTINCT hash) <= 1 AS deterministic FROM s GROUP BY 1), d AS (SELECT s.arm, quantile_disc(abs(micros - p50), 0.5) AS mad FROM s JOIN b USING (arm) GROUP BY 1) SELECT b.*, d.mad FROM b JOIN d USING (arm)""")
def a16_arm_summary(m: Model) -> DataFrame:
    e = m.table("events")
    hash_ = F.when(F.col("event_type") == "view", "same").otherwise((F.col("event_id") % 2).cast("string"))
    return sessions.arm_summary(e.select(F.col("event_type").alias("arm"), F.round(F.col("value") * 1000).cast("long").alias("micros"), hash_.alias("hash")))


_ARMS = "SELECT event_type || ':' || v AS arm, round(value * 1000)::BIGINT AS micros, (event_id % 2)::VARCHAR AS hash, user_id FROM events, (SELECT unnest(range(4)) AS v)"


@register("k22_validate_arm", f"""WITH s AS ({_ARMS}), f AS (SELECT arm, count(*) AS n, quantile_disc(micros, 0.95) AS p95, count(DISTINCT hash) <= 1 AS same FROM s GROUP BY 1),
d AS (SELECT arm, count(*) + CASE WHEN arm LIKE '%:2' THEN (SELECT count(*) FROM s x WHERE x.arm = s.arm) - count(*) ELSE 0 END AS n, quantile_disc(micros, 0.95) AS p95, arm LIKE '%:3' AS same FROM s WHERE CASE WHEN arm LIKE '%:1' THEN user_id % 20 <> 0 WHEN arm LIKE '%:2' THEN micros < 9000 ELSE true END GROUP BY 1)
SELECT d.arm, f.n, f.p95, CASE WHEN d.n <> f.n THEN 'sample_count' WHEN d.p95 <> f.p95 THEN 'p95' WHEN d.same <> f.same THEN 'determinism' ELSE 'valid' END AS verdict FROM d JOIN f USING (arm)""")
def k22_validate_arm(m: Model) -> DataFrame:
    """Declared figures against figures taken again: declared of all samples, of a part of them, of the small ones under the
    whole count, and with a wrong claim of determinism."""
    v = F.explode(F.array(*[F.lit(str(i)) for i in range(4)]))
    e = m.table("events").withColumn("v", v)
    s = e.select(F.concat_ws(":", "event_type", "v").alias("arm"), "v", F.round(F.col("value") * 1000).cast("long").alias("micros"), (F.col("event_id") % 2).cast("string").alias("hash"), "user_id")
    found = graph.cut(sessions.arm_summary(s.select("arm", "micros", "hash")), "arms")
    part = s.where(F.when(F.col("v") == "1", F.col("user_id") % 20 != 0).when(F.col("v") == "2", F.col("micros") < 9000).otherwise(True))
    said = sessions.arm_summary(part.select("arm", "micros", "hash")).select("arm", F.col("n").alias("part_n"), "p95")
    whole = F.col("arm").endswith(":2")
    said = said.join(found.select("arm", "n"), "arm").select("arm", F.when(whole, F.col("n")).otherwise(F.col("part_n")).alias("n"), "p95", F.col("arm").endswith(":3").alias("deterministic"))
    return sessions.validate_arms(said, found).join(found.select("arm", "n", "p95"), "arm").select("arm", "n", "p95", "verdict")


@register("a17_regression_gate", """WITH s AS (SELECT event_type AS profile, event_id % 3 AS repetition, user_id % 2 AS arm, value FROM events), q AS (SELECT profile, repetition, arm, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM s GROUP BY 1, 2, 3),
d AS (SELECT s.profile, s.repetition, s.arm, quantile_disc(abs(value - p50), 0.5) AS mad FROM s JOIN q ON q.profile = s.profile AND q.repetition = s.repetition AND q.arm = s.arm GROUP BY 1, 2, 3),
j AS (SELECT b.profile, c.p95 - b.p95 > greatest(b.p95 * 0.15, d.mad * 2.0) AS worse FROM q b JOIN q c ON c.profile = b.profile AND c.repetition = b.repetition AND c.arm = 1 JOIN d ON d.profile = b.profile AND d.repetition = b.repetition AND d.arm = 0 WHERE b.arm = 0)
SELECT profile, count(*) FILTER (worse) >= 2 AS regressed, count(*) FILTER (worse) AS worse FROM j GROUP BY 1""")
def a17_regression_gate(m: Model) -> DataFrame:
    e = m.table("events").select(F.col("event_type").alias("profile"), (F.col("event_id") % 3).alias("repetition"), (F.col("user_id") % 2).alias("side"), "value")
    keys = ["profile", "repetition", "side"]
    s = ranks.nearest_ranks(e, keys, "value", {"p50": 0.5, "p95": 0.95})
    mad = sessions.deviations(e, s, keys, "value")
    both = s.join(mad, keys)
    return sessions.regression_gate(both.where("side = 0"), both.where("side = 1"))


@register("a7_event_counts_by_source", sql("ev", "SELECT use_type, CASE WHEN user_id % 3 = 0 THEN 'observed' ELSE 'reported' END AS source, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM ev GROUP BY 1, 2"))
def a7_event_counts_by_source(m: Model) -> DataFrame:
    source = F.when(F.col("user_id") % 3 == 0, "observed").otherwise("reported")
    return m.use_events().groupBy("use_type", source.alias("source")).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))


@register("k14_classified_sessions", f"WITH {_task_kind_sql()} SELECT conv_id, min(turn) AS first_turn, arg_min(task_kind, turn) AS task_kind, substr(sha256('session' || chr(31) || conv_id), 1, 32) AS session_id, 'created' AS state FROM tk GROUP BY conv_id")
def k14_classified_sessions(m: Model) -> DataFrame:
    """A session row for each conversation, classified by its first turn."""
    t = task_kinds(m).groupBy("conv_id").agg(F.min("turn").alias("first_turn"), F.min_by("task_kind", "turn").alias("task_kind"))
    return t.select("*", X.framed_id(F.lit("session"), F.col("conv_id").cast("string")).alias("session_id"), F.lit("created").alias("state"))


@register("k19_session_page", sql("ev", "SELECT event_id, use_type, entity FROM ev WHERE user_id = 3 AND event_id > 1000 AND event_id <= 8000 ORDER BY event_id LIMIT 50"))
def k19_session_page(m: Model) -> DataFrame:
    """A keyset page of events up to the captured last id."""
    rows = m.use_events().where("user_id = 3 and event_id <= 8000").select("event_id", "use_type", "entity")
    return find.keyset_page(rows, ["event_id"], 50, (1000,))


@register("k21_query_observations", sql("ev", "SELECT DISTINCT substr(sha256(concat_ws(chr(31), session_id, use_type, sha256(entity))), 1, 32) AS event_id, session_id, sha256(entity) AS input_hash FROM ev WHERE use_type = 'entity_queried' AND entity IS NOT NULL"))
def k21_query_observations(m: Model) -> DataFrame:
    """Successful queries as events; the input is kept as its hash only."""
    e = m.use_events().where("use_type = 'entity_queried' and entity is not null").withColumn("input_hash", F.sha2(F.col("entity").cast("binary"), 256))
    rows = e.select(X.framed_id(F.col("session_id"), F.col("use_type"), F.col("input_hash")).alias("event_id"), "session_id", "input_hash")
    return resolution.append_new(rows.limit(0), rows, "event_id")


@register("r7_append_events", sql("ev", """, k AS (SELECT substr(sha256(concat_ws(chr(31), session_id, use_type, entity)), 1, 32) AS key, user_id FROM ev WHERE entity IS NOT NULL), old AS (SELECT DISTINCT key FROM k WHERE user_id % 2 = 0) SELECT DISTINCT key FROM k WHERE key NOT IN (SELECT key FROM old)"""))
def r7_append_events(m: Model) -> DataFrame:
    e = m.use_events().where("entity is not null").select(X.framed_id(F.col("session_id"), F.col("use_type"), F.col("entity")).alias("key"), "user_id")
    return resolution.append_new(e.where("user_id % 2 = 0").select("key").distinct(), e.select("key"), "key")


@register("m4_stage_totals", """WITH s AS (SELECT (['parse', 'plan', 'seed', 'expand', 'budget', 'verify', 'seal'])[event_id % 7 + 1] AS stage, round(value)::BIGINT AS rows_read, event_type = 'error' AS prohibited FROM events)
SELECT stage, count(*) AS n, sum(rows_read)::BIGINT AS rows_read, count(*) FILTER (prohibited) AS prohibited FROM s GROUP BY 1""")
def m4_stage_totals(m: Model) -> DataFrame:
    """Counts of the seven stages of recorded queries."""
    stage = chosen(F.col("event_id") % 7, dict(enumerate(["parse", "plan", "seed", "expand", "budget", "verify"])), "seal")
    rows = m.table("events").select(stage.alias("stage"), F.round("value").cast("long").alias("rows_read"), (F.col("event_type") == "error").alias("prohibited"))
    return rows.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.sum("rows_read").alias("rows_read"), F.count_if("prohibited").alias("prohibited"))
