"""All registered queries of the splicing operators with their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("annotation_cases", "cluster_cases", "quant_cases", "cohort_cases", "stats_cases", "represent_cases", "scan_cases")


def _cases() -> dict:
    found = {}
    for name in MODULES:
        found |= import_module(f"introngrid.plans.{name}").CASES
    return found


def queries() -> dict:
    return {name: case[0] for name, case in _cases().items()}


def oracle_sql() -> dict[str, str]:
    from introngrid.plans.adapters import sql

    return {name: sql(case[1]) for name, case in _cases().items() if case[1]}
