"""The registered queries of the corpus operators and the SQL that states their results."""

from __future__ import annotations

from strataloom.plans import quality, training, web  # noqa: F401  register their queries
from strataloom.plans.corpus import ORACLES, QUERIES, flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
