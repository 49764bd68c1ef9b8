"""The queries by name, and the SQL they are compared with."""

from __future__ import annotations

from . import activity, audit, coverage, ingest, media, reports, state

ENTRIES = {**ingest.ENTRIES, **state.ENTRIES, **coverage.ENTRIES, **media.ENTRIES, **activity.ENTRIES, **audit.ENTRIES, **reports.ENTRIES}
QUERIES = {name: entry[0] for name, entry in ENTRIES.items()}
SQL = {name: entry[1] for name, entry in ENTRIES.items() if entry[1]}
