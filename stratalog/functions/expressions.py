"""Column expressions of the catalogue: classification, ranks, estimates, identities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab


def _chain(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    return reduce(lambda rest, case: F.when(case[0], case[1]).otherwise(rest), reversed(cases), otherwise)


def has_keyword(text: Column, keyword: str) -> Column:
    """Whole-word, ASCII case-insensitive."""
    return text.rlike(f"(?i)(^|[^A-Za-z0-9_]){keyword}([^A-Za-z0-9_]|$)")


def task_rule(text: Column) -> Column:
    """struct<kind, rule_id> of the first rule that matches."""
    pair = lambda kind, rule: F.struct(F.lit(kind).alias("kind"), F.lit(rule).alias("rule_id"))
    return _chain([(has_keyword(text, k), pair(kind, rule)) for k, kind, rule in vocab.TASK_RULES], pair(*vocab.DEFAULT_TASK_RULE))


def classify_path(path: Column) -> Column:
    """struct<state, code, detail>: the first class with a matching pattern, and that pattern; else `present`."""
    fixed = F.replace(path, F.lit("\\"), F.lit("/"))
    out = lambda state, code, detail: F.struct(F.lit(state).alias("state"), F.lit(code).cast("string").alias("code"), F.lit(detail).cast("string").alias("detail"))
    return _chain([(fixed.rlike(p), out(state, code, p)) for code, state, patterns in vocab.PATH_RULES for p in patterns], out("present", None, None))


def artifact_class(path: Column) -> Column:
    """`test` where is_test() holds, else by the extension: what stands after the path's last dot."""
    name = F.lower(path)
    ext = F.when(name.contains("."), F.element_at(F.split(name, r"\."), -1)).otherwise("")
    by_extension = _chain([(ext.isin(*exts), F.lit(kind)) for kind, exts in vocab.ARTIFACT_CLASSES.items()], F.lit("other"))
    return F.when(is_test(path), "test").otherwise(by_extension)


def is_test(path: Column) -> Column:
    """Rust files under a directory segment that is exactly `tests`."""
    parts = F.split(path, "/")
    return F.lower(F.element_at(parts, -1)).rlike(r"\.rs$") & F.array_contains(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), "tests")


def tier_rank(tier: Column) -> Column:
    return _chain([(tier == k, F.lit(v)) for k, v in vocab.TIER_RANK.items()], F.lit(0))


def trust_class(resolution: Column, method: Column, confidence: Column) -> Column:
    resolved = resolution.isin("resolved_symbol", "resolved_file")
    return F.when(resolved & method.isin("exact", "semantic"), "verified").when(resolved, "supported").when(confidence >= 0.5, "inferred").otherwise("uncertain")


def evidence_quality(state: Column, confidence: Column) -> Column:
    return F.when(state.isin("semantic", "exact") & (confidence >= 0.9), "verified").when(state.isin("structural", "declared", "observed"), "supported").when(confidence >= 0.5, "inferred").otherwise("unsupported")


def entity_id(kind: Column, value: Column) -> Column:
    return F.concat(F.when(kind.isin("symbol", "path"), kind).otherwise("external"), F.lit(":"), value)


def token_estimate(n_bytes: Column) -> Column:
    return F.floor(F.greatest(n_bytes, F.lit(0)) / 4).cast("long")


def display_name(key: Column) -> Column:
    """Last segment of a symbol key without its closing marks."""
    return F.element_at(F.split(F.regexp_replace(key, r"[.#():!]+$", ""), r"[/#. ]"), -1)


def framed_id(*parts: Column) -> Column:
    """Deterministic 32-digit id of parts joined by the unit separator."""
    return F.substring(F.sha2(F.concat_ws("\u001f", *parts), 256), 1, 32)
