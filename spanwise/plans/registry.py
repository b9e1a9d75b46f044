"""Every query of the engine by name, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audits, decisions, fields, further, language, modelling, statistics, suites, surfaces, temporal

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for part in (temporal, statistics, decisions, language, modelling, further, audits, suites, surfaces, fields):
    QUERIES |= part.book.queries
    ORACLES |= part.book.oracles
