"""All registered queries and the SQL that says the same."""

from __future__ import annotations

from . import markup, queries, strings

QUERIES = {**queries.QUERIES, **strings.QUERIES, **markup.QUERIES}
ORACLES = {**queries.ORACLES, **strings.ORACLES, **markup.ORACLES}
