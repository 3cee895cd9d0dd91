"""All queries of the core by name."""

from orelith.plans import core, general

QUERIES = general.QUERIES | core.QUERIES
