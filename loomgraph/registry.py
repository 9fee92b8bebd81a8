"""Every registered query and its SQL."""

from __future__ import annotations

from .plans import catalog, catalog_listings, catalog_more, catalog_rest, catalog_results, catalog_walks  # noqa: F401 (the other parts register in the first)

QUERIES: dict = dict(catalog.QUERIES)
SQL: dict[str, str] = dict(catalog.SQL)
