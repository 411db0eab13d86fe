"""Every registered query of the engine's own operators, with the SQL that checks it."""

from quire.catalog import ORACLES, QUERIES
from quire.plans import analytics, assembly, documents, grid, matching, placement, rules, scalars, sources, spatial, streams, validation, windows  # noqa: F401  each registers its queries
from quire.plans.documents import review_queue

__all__ = ["ORACLES", "QUERIES", "review_queue"]
