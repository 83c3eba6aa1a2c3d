"""Every query of the reference's own operators, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dialogscope.plans import audits, batteries, checks, dialogues, outcomes, stores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**outcomes.QUERIES, **dialogues.QUERIES, **batteries.QUERIES, **checks.QUERIES, **audits.QUERIES, **stores.QUERIES}
ORACLE_SQL: dict[str, str] = {**outcomes.ORACLE_SQL, **dialogues.ORACLE_SQL, **batteries.ORACLE_SQL, **checks.ORACLE_SQL, **audits.ORACLE_SQL, **stores.ORACLE_SQL}
FLAGSHIP = "primary_contrast"
