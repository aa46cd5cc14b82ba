"""Registered queries of the history engine and the SQL that states what they compute."""

from __future__ import annotations

from tidemark.plans import catalogs, history, schedule, streams, verdicts, visits, walks

_PARTS = (history, schedule, catalogs, streams, verdicts, visits, walks)


def queries():
    return {k: f for part in _PARTS for k, f in part.QUERIES.items()}


def oracle_sql():
    return {k: s for part in _PARTS for k, s in part.ORACLES.items()}
