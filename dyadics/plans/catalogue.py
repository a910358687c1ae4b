"""All queries on the driver tables, each with the SQL that defines its result."""

from __future__ import annotations

from . import answers, choices, estimators, series, sets, storage, surveys

QUERIES: dict = {}
ORACLES: dict = {}
for _part in (choices, sets, series, answers, estimators, surveys, storage):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
