"""All core queries and their SQL, gathered from the modules of this folder."""

from __future__ import annotations

from textlathe.plans import more_plans, nested_plans, record_plans, search_plans, source_plans, stats_plans, text_plans

MODULES = [record_plans, search_plans, stats_plans, text_plans, nested_plans, more_plans, source_plans]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
