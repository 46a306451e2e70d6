"""The registered queries and their SQL."""

from helixlake.jobs.oracle import ORACLE_SQL
from helixlake.jobs.variants import QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
