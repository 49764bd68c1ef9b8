"""Audited tables from append-only evidence: ingest, timeline, coverage, state, reconciliation and gates on Spark."""
