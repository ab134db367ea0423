"""The named queries and their SQL equivalents."""

from __future__ import annotations

from . import catalogue, evaluation, feeds, kept, library, more, system


def queries():
    return library.QUERIES | catalogue.QUERIES | evaluation.QUERIES | more.QUERIES | system.QUERIES | kept.QUERIES | feeds.QUERIES


def oracle_sql():
    return library.ORACLES | catalogue.ORACLES | evaluation.ORACLES | more.ORACLES | system.ORACLES | kept.ORACLES | feeds.ORACLES
