"""Composed flows and the query registry."""


def load_all() -> None:
    """Import every module that registers queries."""
    from liftlake.plans import (  # noqa: F401
        coach_queries, dashboard_queries, gold_queries, landing_queries, legacy_plan_queries, normalized_queries, silver_queries, streaming_queries,
    )
