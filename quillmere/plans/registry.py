"""All queries of the library by name, and the SQL each is checked against."""

from __future__ import annotations

from quillmere.plans import daily, days, modelling, more, tracks, windows  # noqa: F401  (they register their queries)
from quillmere.plans.base import ORACLE_SQL, QUERIES

FLAGSHIP = "paired_skill"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
