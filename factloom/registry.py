"""Every registered query and its SQL twin, by key."""

from __future__ import annotations

from .plans import QUERIES, SQL, filings, language, money, records, texts  # noqa: F401
