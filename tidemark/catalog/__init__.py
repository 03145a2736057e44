"""Every operator wired to the test tables, each with the SQL it must agree with."""

from tidemark.catalog.base import REGISTRY
from tidemark.catalog import (  # noqa: F401  (importing registers)
    aggregates,
    history,
    joins,
    marts,
    metrics,
    quality,
    scalars,
    sets,
    sources,
    streams,
    windows,
)

__all__ = ["REGISTRY"]
