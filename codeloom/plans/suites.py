"""Imports every module that registers queries."""

from __future__ import annotations

import importlib

MODULES = ("q_basics", "q_code", "q_docs", "q_joins", "q_aggs", "q_ranking", "q_sets", "q_graph", "q_rewrite", "q_gate", "q_reports")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"codeloom.plans.{name}")
