"""The registered queries over the given tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomlake.jobs import audit_jobs, catalog_jobs, formats, native_jobs, oracle_formats, oracle_losses, oracle_timeline, store_jobs, timeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**timeline.QUERIES, **formats.QUERIES, **catalog_jobs.QUERIES, **audit_jobs.QUERIES, **store_jobs.QUERIES, **native_jobs.QUERIES}
ORACLE_SQL: dict[str, str] = {**oracle_timeline.ORACLE, **oracle_losses.ORACLE, **oracle_formats.ORACLE, **catalog_jobs.ORACLE, **audit_jobs.ORACLE, **store_jobs.ORACLE, **native_jobs.ORACLE}
