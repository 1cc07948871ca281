"""Named queries over the driver tables, each with the SQL that gives the same rows."""

from evenkeel.catalog.registry import INVENTORY, ORACLES, QUERIES
from evenkeel.catalog import (  # noqa: F401  (importing registers the queries)
    columns,
    evaluation,
    generation,
    logistic,
    neighborhood,
    profiles,
    resampling,
    scalars,
    scores,
    sources,
    splitting,
)

__all__ = ["INVENTORY", "ORACLES", "QUERIES"]
