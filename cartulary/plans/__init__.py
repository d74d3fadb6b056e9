"""Registered queries: every operator bound to the test tables, next to the SQL that must agree."""

from . import changes, documents, feed, listings, names, predicates, relations, search, sources, tags  # noqa: F401
from .registry import QUERIES, Query  # noqa: F401
