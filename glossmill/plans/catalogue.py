"""All queries and their SQL counterparts, gathered from the plan modules."""

from __future__ import annotations

from glossmill.plans import core_problems, eval_plans, graph_plans, inventory_plans, more_plans, rule_plans, text_plans

_MODULES = (core_problems, rule_plans, eval_plans, graph_plans, text_plans, more_plans, inventory_plans)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
FLAGSHIP = "rule_eval_by_family"
