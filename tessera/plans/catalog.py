"""Every registered query and its SQL."""

from . import aggregates, associations, complex_types, filters, joins, modifications, naming, ordering, recursion, scalars, shaping, streams, windows  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
