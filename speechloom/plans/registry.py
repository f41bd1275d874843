"""All queries of the core library and their SQL."""

from __future__ import annotations

from speechloom.plans import extended, problems, reference  # noqa: F401  extended registers its queries with reference

QUERIES = problems.QUERIES | reference.QUERIES
ORACLES = problems.ORACLES | reference.ORACLES
