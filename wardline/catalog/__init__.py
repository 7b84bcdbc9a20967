"""Every registered query with its inventory ids and, where SQL can say it, the equivalent SQL."""

from wardline.catalog.base import REGISTRY, Query, query

__all__ = ["REGISTRY", "Query", "query", "load_all"]


def load_all() -> dict[str, Query]:
    from wardline.catalog import (  # noqa: F401
        cohort, episodes, governance, intake, joins, kidney, records, lasting, rule_files, ruled, scoring, stewardship, streams, study,
    )
    return REGISTRY
