"""All named queries and their SQL."""

from marketframe.plans import stored  # noqa: F401  registers its queries
from marketframe.plans.queries import QUERIES, SQL, flagship

__all__ = ["QUERIES", "SQL", "flagship"]
