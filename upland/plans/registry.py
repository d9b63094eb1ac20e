"""Every registered query with its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from upland.plans import features, fullrun, intake, machine, raster, serving, spatial_queries, validation_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (features, spatial_queries, validation_queries, raster, serving, machine, intake, fullrun):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
