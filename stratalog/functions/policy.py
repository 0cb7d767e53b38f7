"""Fixed policy tables: evidence recipes, roles, routes, session states, provider outcomes. All values are fixed."""

#: Task kind: (callers, callees, tests, configs, greatest distance).
RECIPES = {
    "bug_fix": (True, True, True, False, 2), "behavior_change": (True, True, True, False, 2), "api_change": (True, False, True, False, 3), "refactor": (True, True, True, False, 2),
    "configuration_change": (False, False, True, True, 1), "test_change": (True, False, True, False, 1), "review": (True, True, True, True, 1), "audit": (True, True, True, True, 3),
    "explore": (True, True, False, False, 1), "unknown": (True, True, True, False, 1),
}

#: Task kind: roles that must be filled.
REQUIRED_ROLES = {
    "explore": ("primary_implementation",),
    "bug_fix": ("primary_implementation", "test_contract", "historical_constraint", "validation_target"),
    "behavior_change": ("primary_implementation", "direct_dependent", "test_contract", "effect", "validation_target"),
    "api_change": ("primary_implementation", "type_contract", "direct_dependent", "test_contract", "effect", "validation_target"),
    "refactor": ("primary_implementation", "direct_dependent", "test_contract", "validation_target"),
    "configuration_change": ("primary_implementation", "configuration_input", "test_contract", "validation_target"),
    "test_change": ("primary_implementation", "test_contract", "validation_target"),
    "review": ("primary_implementation", "test_contract", "effect", "historical_constraint", "validation_target"),
    "audit": ("primary_implementation", "test_contract", "configuration_input", "historical_constraint", "validation_target"),
    "unknown": ("primary_implementation", "validation_target"),
}
ROLES = (
    "primary_implementation", "direct_dependent", "direct_dependency", "type_contract", "test_contract", "configuration_input", "effect", "historical_constraint", "validation_target", "uncertainty", "temporal_evidence",
)

#: Capability: least route that serves it.
CAPABILITIES = {
    "identity_lookup": "light", "exact_source": "light", "bounded_relationships": "light", "impact_frontier": "light", "basic_coverage_conflicts": "light",
    "role_complete_context": "deep", "temporal_evidence": "deep", "validation_plan": "deep",
}
ROUTES = ("direct", "light", "deep")

#: Allowed steps of a session's state; any state that is not terminal may also fail.
TRANSITIONS = (
    ("created", "context_compiled"), ("context_compiled", "active"), ("active", "reconciled"), ("reconciled", "completed"), ("reconciled", "abandoned"), ("active", "abandoned"),
)
TERMINAL = ("completed", "abandoned", "failed")

#: Provider outcome: coverage status.
COVERAGE_OF_OUTCOME = {
    "complete": "complete", "partial": "partial", "unsupported": "excluded", "unavailable": "excluded", "stale": "stale", "failed": "failed", "cancelled": "failed", "timed_out": "failed",
    "output_rejected": "failed", "decode_failed": "failed", "mapping_failed": "failed", "planned": "partial", "running": "partial",
}
#: Outcomes that block activation where the provider is required.
BLOCKING = ("failed", "unavailable", "timed_out", "cancelled", "output_rejected", "decode_failed", "mapping_failed", "unsupported")

#: Comparability gates of two yield reports, in order: (reason, field).
YIELD_GATES = (
    ("different_workspace", "workspace_id"), ("different_generation", "generation_id"), ("different_task", "task_hash"), ("different_task_kind", "task_kind"),
    ("different_planner_policy", "planner_policy"), ("different_projection_policy", "projection_policy"), ("different_estimator_policy", "estimator_policy"),
    ("different_metric_policy", "metric_policy"), ("different_sample_size", "sample_size"), ("different_accepted_outcome", "outcome_hash"), ("different_experimental_profile_contract", "profile_version"),
)
