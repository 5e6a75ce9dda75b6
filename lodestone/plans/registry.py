"""Every query of the library by name, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans import activity, archives, conversations, corpus_build, evidence, feeds, live, retrieval, routing, snapshots, tiers

JOBS = (activity, corpus_build, retrieval, conversations, snapshots, live, evidence, archives, tiers, routing, feeds)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: q for job in JOBS for name, q in job.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for job in JOBS for name, sql in job.ORACLE_SQL.items()}
