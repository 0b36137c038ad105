"""Registered queries and their SQL. Importing a module of queries registers them."""

from __future__ import annotations

from nearby.plans import queries_answers, queries_drive, queries_feeds, queries_places, queries_rules, queries_search

MODULES = (queries_search, queries_places, queries_feeds, queries_rules, queries_drive, queries_answers)
QUERIES = queries_search.Q
ORACLES = queries_search.SQL
