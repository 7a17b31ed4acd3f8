"""All core queries and their SQL."""

from __future__ import annotations

from callframe.plans import data, evaluation, programs, training

QUERIES = {**training.QUERIES, **evaluation.QUERIES, **data.QUERIES, **programs.QUERIES}
ORACLES = {**training.ORACLES, **evaluation.ORACLES, **data.ORACLES, **programs.ORACLES}
