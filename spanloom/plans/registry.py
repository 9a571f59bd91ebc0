"""Registered queries of the interval, sequence and statistics operators, with their oracle SQL."""

from __future__ import annotations

from spanloom.plans import overlaps, records, sequences, statistics

QUERIES = overlaps.QUERIES | statistics.QUERIES | sequences.QUERIES | records.QUERIES
ORACLE = overlaps.ORACLE | statistics.ORACLE | sequences.ORACLE | records.ORACLE
