"""All core queries by name, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.plans import documents, operations, search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**documents.QUERIES, **search.QUERIES, **operations.QUERIES}
SQL: dict[str, str] = {**documents.SQL, **search.SQL, **operations.SQL}
