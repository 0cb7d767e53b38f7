"""Sessions, routing and their measures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import policy
from . import ranks

#: Evidence of one session that is measured at most; more is a typed invalidity.
MAX_EVIDENCE = 4096


def _rank(route: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, policy.ROUTES)), route)


def decide_route(requests: DataFrame) -> DataFrame:
    """request, floor, ceiling, initial, signals, reasons, decision_hash.

    requests: request, intent (none, allow, require), floor, ceiling, capabilities (map<name, state>), n_seeds,
    generation (null: not observed). Signals and reasons are sorted sets joined by commas.
    """
    light_floor = F.when(_rank(F.col("floor")) < 2, F.lit("light")).otherwise(F.col("floor"))
    floor = F.when(F.col("intent") == "none", "direct").when(F.col("intent") == "allow", F.col("floor")).otherwise(light_floor)
    ceiling = F.when(F.col("intent") == "none", "direct").otherwise(F.col("ceiling"))
    names, states = F.map_keys("capabilities"), F.map_values("capabilities")
    needs = lambda level, keys: F.exists(keys, lambda k: k.isin(*[c for c, r in policy.CAPABILITIES.items() if r == level]))
    open_ = F.map_keys(F.map_filter("capabilities", lambda k, v: v != "satisfied"))
    asks = lambda *c: F.exists(names, lambda k: k.isin(*c))
    seen = F.col("generation").isNotNull()
    rows = requests.withColumns({"f": floor, "c": ceiling})
    signals = F.array_compact(F.flatten(F.array(
        F.transform(F.array_distinct(states), lambda s: F.concat(F.lit("caller_capabilities_"), s)),
        F.array(
            F.concat(F.lit("intent_"), F.col("intent")), F.concat(F.lit("route_floor_"), F.col("f")), F.concat(F.lit("route_ceiling_"), F.col("c")),
            F.when(F.col("n_seeds") > 0, "explicit_seeds_present"), F.when(asks("identity_lookup", "exact_source"), "identity_or_source_requested"),
            F.when(asks("bounded_relationships", "impact_frontier"), "relationships_or_impact_requested"), F.when(asks("basic_coverage_conflicts"), "basic_coverage_conflicts_requested"),
            F.when(needs("deep", names), "deep_synthesis_requested"), F.when(seen, "starting_generation_observed").otherwise("starting_generation_unavailable"),
        ),
    )))
    reasons = F.array_compact(F.array(
        F.when(F.forall(states, lambda s: s == "satisfied"), "caller_context_sufficient").otherwise("caller_context_incomplete"),
        F.when(F.col("intent") == "none", "context_not_requested"), F.when(F.col("intent") == "require", "explicit_context_request"), F.when(needs("light", open_), "light_capability_required"),
        F.when(needs("deep", open_), "deep_capability_required"), F.when(F.col("f") != "direct", "route_floor_applied"), F.when(~seen, "starting_generation_unavailable"),
    ))
    joined = lambda a: F.array_join(F.array_sort(a), ",")
    out = rows.select("request", F.col("f").alias("floor"), F.col("c").alias("ceiling"), F.col("f").alias("initial"), joined(signals).alias("signals"), joined(reasons).alias("reasons"))
    return out.withColumn("decision_hash", F.sha2(F.concat_ws("\u001f", *out.columns), 256))


def execute_route(initial: str, ceiling: str, attempt: Callable[[str], set[str]], observe: Callable[[], str | None]) -> list[tuple[str, str]]:
    """[(route, outcome)]: from the initial route up to the ceiling while what is missing can be had further up.

    attempt(route) gives the capabilities still missing, observe() the generation. Ends `sufficient`, `ceiling_reached`,
    `not_escalatable`, or `generation_changed` where another generation is active before an attempt.
    """
    done, began = [], observe()
    for route in policy.ROUTES[policy.ROUTES.index(initial) :]:
        if observe() != began:
            return [*done, (route, "generation_changed")]
        missing = attempt(route)
        if not missing:
            return [*done, (route, "sufficient")]
        if route == ceiling:
            return [*done, (route, "ceiling_reached")]
        if not all(c in policy.CAPABILITIES for c in missing):
            return [*done, (route, "not_escalatable")]
        done.append((route, "escalated"))
    return done


def judge_transition(current: Column, to: Column) -> Column:
    """Whether a session may go from one state to another."""
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, b in policy.TRANSITIONS])
    ended = current.isin(*policy.TERMINAL)
    return ~ended & ((to == "failed") | F.array_contains(allowed, F.concat_ws(">", current, to)))


def reconcile_sessions(sessions: DataFrame, generations: DataFrame, candidate_no: int) -> DataFrame:
    """Active sessions that began under an earlier generation than the candidate become reconciled."""
    rows = sessions.join(F.broadcast(generations.select("generation_id", "sequence_no")), sessions["start_generation"] == F.col("generation_id"), "left")
    state = F.when((F.col("state") == "active") & (F.col("sequence_no") < candidate_no), "reconciled").otherwise(F.col("state"))
    return rows.select("session_id", "start_generation", state.alias("state"))


def complete_sessions(requests: DataFrame, sessions: DataFrame, generations: DataFrame, active: str) -> DataFrame:
    """session_id, verdict: completed, replayed (the same again), conflicting_replay, or why not."""
    rows = requests.join(sessions, "session_id", "left").join(F.broadcast(generations.select(F.col("generation_id").alias("end_generation"), F.col("state").alias("g_state"))), "end_generation", "left")
    verdict = F.when(F.col("state").isNull(), "not_found").when((F.col("state") == "completed") & (F.col("outcome") == F.col("had_outcome")), "replayed").when(F.col("state") == "completed", "conflicting_replay")
    verdict = verdict.when(F.col("state") != "reconciled", "illegal_transition").when((F.col("end_generation") != active) | F.col("g_state").isNull() | (F.col("g_state") != "committed"), "generation_not_active")
    return rows.select("session_id", verdict.when(F.col("tree_hash") != F.col("seen_hash"), "tree_mismatch").otherwise("completed").alias("verdict"))


def evidence(events: DataFrame) -> DataFrame:
    """session_id with sets of supplied, observed, reported and changed entities, reads, and supplied bytes.

    Of an entity that is supplied with different byte counts the session is marked `conflicting`. Reads count only where
    they succeeded (positive bytes).
    """
    kind = F.col("use_type")
    per = events.where("entity is not null").groupBy("session_id", "entity").agg(
        F.max(kind == "context_supplied").alias("supplied"), F.min(F.when(kind == "context_supplied", F.col("bytes"))).alias("lo"), F.max(F.when(kind == "context_supplied", F.col("bytes"))).alias("hi"),
        F.count_if((kind == "exact_source_requested") & (F.col("bytes") > 0)).alias("reads"), F.max(kind == "reasoning_use_reported").alias("reported"), F.max(kind == "artifact_changed").alias("changed"),
    )
    on, read = F.col("supplied"), F.col("reads") > 0
    n = lambda c: F.count_if(c)
    return per.groupBy("session_id").agg(
        n(on).alias("supplied"), n(read).alias("observed"), n("reported").alias("reported"), n("changed").alias("changed"), n(read & on).alias("observed_supplied"), n(F.col("reported") & on).alias("reported_supplied"),
        n((read | F.col("reported")) & ~on).alias("expanded"), F.sum("reads").alias("reads"), F.sum(F.when(on, F.col("reads")).otherwise(0)).alias("rediscoveries"),
        F.sum(F.when(on, F.col("lo")).otherwise(0)).alias("supplied_bytes"), F.sum(F.when(on & read, F.col("lo")).otherwise(0)).alias("used_bytes"),
        F.coalesce(F.max(on & (F.col("lo") != F.col("hi"))), F.lit(False)).alias("conflicting"),
    )


METRICS = {
    "precision_observed": ("observed_supplied", "supplied"), "precision_reported": ("reported_supplied", "supplied"), "expansion_count": ("expanded", None),
    "rediscovery_rate": ("rediscoveries", "reads"), "source_efficiency": ("used_bytes", "supplied_bytes"),
}


def context_metrics(found: DataFrame) -> DataFrame:
    """session_id, metric, numerator, denominator, validity: fractions stay unreduced, and a zero denominator is a typed invalidity."""
    total = F.col("supplied") + F.col("reads") + F.col("reported") + F.col("changed")
    whole = F.when(total > MAX_EVIDENCE, "capacity_exceeded").when(F.col("conflicting"), "conflicting_supplied_bytes")
    rows = []
    for name, (top, bottom) in METRICS.items():
        under = F.lit(1).cast("long") if bottom is None else F.col(bottom).cast("long")
        why = F.coalesce(whole, F.when(under == 0, "zero_denominator").otherwise("valid"))
        rows.append(F.struct(F.lit(name).alias("metric"), F.col(top).cast("long").alias("numerator"), under.alias("denominator"), why.alias("validity")))
    return found.select("session_id", F.explode(F.array(*rows)).alias("m")).select("session_id", "m.*")


def compare_reports(pairs: DataFrame) -> DataFrame:
    """pair, verdict, hashes_match, size_delta, bytes_delta of structs a and b: the first gate that differs is the verdict."""
    reason = F.lit(None).cast("string")
    gates = [(F.col(f"{side}.schema_version") != "v1.5", "unsupported_report_version") for side in ("a", "b")] + [(~F.col(f"{side}.accepted"), "outcome_not_accepted") for side in ("a", "b")]
    gates = [g for pair in zip(gates[:1], gates[2:3], strict=True) for g in pair] + [g for pair in zip(gates[1:2], gates[3:], strict=True) for g in pair]
    gates += [((F.col("a.samples") != F.col("a.sample_size")) | (F.col("b.samples") != F.col("b.sample_size")), "invalid_report")]
    gates += [(~F.col(f"a.{field}").eqNullSafe(F.col(f"b.{field}")), why) for why, field in policy.YIELD_GATES]
    for when, why in reversed(gates):
        reason = F.when(when, F.lit(why)).otherwise(reason)
    same = F.col("verdict") == "comparable"
    delta = lambda f: F.when(same, F.col(f"b.{f}") - F.col(f"a.{f}"))
    rows = pairs.withColumn("verdict", F.coalesce(reason, F.lit("comparable")))
    return rows.select("pair", "verdict", F.when(same, F.col("a.context_hash") == F.col("b.context_hash")).alias("hashes_match"), delta("size").alias("size_delta"), delta("source_bytes").alias("bytes_delta"))


def arm_summary(samples: DataFrame) -> DataFrame:
    """arm, n, minimum, maximum, mean (whole), mad, p50, p95, deterministic (all hashes equal), of samples (arm, micros, hash);
    quantiles are exact nearest ranks, and no arm goes through one task."""
    n = F.count(F.lit(1))
    s = samples.groupBy("arm").agg(n.alias("n"), F.min("micros").alias("minimum"), F.max("micros").alias("maximum"), F.floor(F.sum("micros") / n).alias("mean"), F.min("hash").eqNullSafe(F.max("hash")).alias("deterministic"))
    middle = ranks.nearest_ranks(samples, ["arm"], "micros", {"p50": 0.5, "p95": 0.95})
    return s.join(middle, "arm").join(deviations(samples, middle, ["arm"], "micros"), "arm")


def deviations(samples: DataFrame, middle: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, mad: the nearest rank at one half of the distances from each group's p50."""
    off = samples.select(*keys, value).join(middle.select(*keys, "p50"), keys).select(*keys, F.abs(F.col(value) - F.col("p50")).alias("off"))
    return ranks.nearest_ranks(off, keys, "off", {"mad": 0.5})


def validate_arms(declared: DataFrame, found: DataFrame) -> DataFrame:
    """arm, verdict of declared figures (arm, n, p95, deterministic) against those taken again from the samples: the first that
    differs, missing_samples where there are none, else valid."""
    said = declared.select("arm", *[F.col(c).alias(f"said_{c}") for c in ("n", "p95", "deterministic")])
    verdict = F.when(F.col("n").isNull(), "missing_samples")
    for column, why in (("n", "sample_count"), ("p95", "p95"), ("deterministic", "determinism")):
        verdict = verdict.when(~F.col(column).eqNullSafe(F.col(f"said_{column}")), why)
    return said.join(found.select("arm", "n", "p95", "deterministic"), "arm", "left").select("arm", verdict.otherwise("valid").alias("verdict"))


def regression_gate(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """profile, regressed: in 2 of 3 repetitions at least, candidate p95 exceeds base p95 by more than max(15 %, 2 MAD)."""
    b = base.select("profile", "repetition", F.col("p95").alias("b95"), "mad")
    worse = (F.col("p95") - F.col("b95")) > F.greatest(F.col("b95") * 0.15, F.col("mad") * 2.0)
    return candidate.select("profile", "repetition", "p95").join(b, ["profile", "repetition"]).groupBy("profile").agg((F.count_if(worse) >= 2).alias("regressed"), F.count_if(worse).alias("worse"))
