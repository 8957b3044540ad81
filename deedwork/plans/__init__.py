"""Registered queries. Importing this package registers all of them."""

import importlib

from deedwork.plans.registry import all_oracles, all_queries

for _group in (
    "workloads",
    "expressions",
    "relational",
    "quality",
    "governance",
    "profiling",
    "disclosure",
    "privacy",
    "ingest",
    "streams",
    "modelling",
):
    importlib.import_module(f"deedwork.plans.{_group}")

__all__ = ["all_oracles", "all_queries"]
