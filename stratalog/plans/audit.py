"""A physical plan in numbers, for tests and for reviewing a query before it runs on large tables."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

#: Operators that hand rows to Python workers.
_PYTHON = ("MapInArrow", "MapInPandas", "ArrowEvalPython", "BatchEvalPython", "FlatMapGroupsInPandas", "PythonMapInArrow")


@dataclass(frozen=True)
class Audit:
    """Counts of a plan's operators, the columns of each scan, and the filters that reach one."""

    shuffles: int
    broadcasts: int
    cartesian: int
    sorts: int
    python: int
    scanned: tuple[tuple[str, ...], ...]
    pushed: tuple[str, ...]


def audit(df: DataFrame) -> Audit:
    plan = df._jdf.queryExecution().executedPlan().toString()
    lines = [re.sub(r"^[\s:+\-*()0-9]*", "", line) for line in plan.splitlines()]
    count = lambda *names: sum(line.startswith(names) for line in lines)
    scans = re.findall(r"ReadSchema: struct<([^>]*)", plan)
    columns = tuple(tuple(f.split(":")[0] for f in s.split(",") if f) for s in scans)
    return Audit(
        count("Exchange "), count("BroadcastExchange"), count("CartesianProduct", "BroadcastNestedLoopJoin"), count("Sort "), count(*_PYTHON), columns,
        tuple(f for s in re.findall(r"PushedFilters: \[([^\]]*)\]", plan) for f in s.split(", ") if f),
    )
