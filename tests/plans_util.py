from __future__ import annotations


def physical_plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def count_node(df, node: str) -> int:
    return sum(1 for line in physical_plan(df).splitlines() if line.lstrip(" :+-*()0123456789").startswith(node))


def optimized_sizes(build, few: int = 8, many: int = 500) -> tuple[int, int]:
    """Characters of the plan for few and for many slices, the latter optimised only where the plan as written has not grown."""
    plans = [build(n)._jdf.queryExecution() for n in (few, many)]
    written = [p.analyzed().toString() for p in plans]
    assert len(written[1]) < 2 * len(written[0])
    return tuple(len(p.optimizedPlan().toString()) for p in plans)
