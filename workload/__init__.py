"""Queries over the given tables, one per operator."""

from importlib import import_module

MODULES = [
    "pricing_queries", "review_queries", "rule_queries", "parsing_queries", "search_queries", "function_queries",
    "ingest_queries", "review_job_queries",
]


def load_all() -> None:
    for module in MODULES:
        import_module(f"workload.{module}")
