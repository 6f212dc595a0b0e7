"""All queries over the trajectory operators, keyed by inventory id, and their SQL."""

from __future__ import annotations

from . import bends, corridors, curves, evaluation, evidence, files, live, matching, motion, network, places, scalars, signals, temporal, whole

PARTS = (scalars, temporal, network, evidence, motion, files, places, live, signals, matching, curves, corridors, bends, evaluation, whole)


def entry(spark, sf_dir):
    """Trips cut into sessions, with their moving time, way and jumps."""
    return temporal.session_summary(spark, sf_dir)


def queries() -> dict:
    return {name: run for part in PARTS for name, (run, _) in part.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for part in PARTS for name, (_, sql) in part.QUERIES.items() if sql}
