"""All registered queries of the library's own operators and their SQL."""

from tablesmith.plans import assignment, discovery, keys, loading, references, schema36, structure  # noqa: F401  (they register their queries)
from tablesmith.plans.queries import ORACLE_SQL, QUERIES, flagship

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
