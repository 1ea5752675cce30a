"""Registry of the core queries: QUERIES by name, and the equivalent SQL where there is one."""

from corpusloom.catalog import corpus, joins, quality, rollups, samples, vectors
from corpusloom.catalog.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "corpus", "joins", "quality", "rollups", "samples", "vectors"]
