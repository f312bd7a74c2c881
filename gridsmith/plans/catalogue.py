"""All queries of the library, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from gridsmith.plans import library, pages, parsing, reviewing

QUERIES = parsing.QUERIES | reviewing.QUERIES | pages.QUERIES | library.QUERIES
ORACLES = parsing.ORACLES | reviewing.ORACLES | pages.ORACLES | library.ORACLES
FLAGSHIP = "locale_parse_totals"
