"""All queries of the library, with SQL where there is one."""

from labelmill.plans import labels, relational, scoring, steps, texts  # noqa: F401
from labelmill.plans.registry import GOLDEN_SQL, GOLDENS, QUERIES, SQL  # noqa: F401
