"""Registered queries: each shows one or more operators on the given tables.

``REGISTRY`` maps a name to its Spark function, its SQL statement (if SQL can state it) and the
inventory items it covers. Importing this package fills it.
"""

from pairwell.catalog.base import REGISTRY
from pairwell.catalog import (  # noqa: F401
    aggregates,
    cleaning,
    filters,
    joining,
    learning,
    match,
    measures,
    samples,
    storage,
    testing,
    weighting,
)

__all__ = ["REGISTRY"]
