"""Collects the registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module
from importlib.util import find_spec

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

PLAN_MODULES = (
    "quality_plans",
    "profile_plans",
    "gate_plans",
    "curation_plans",
    "search_plans",
    "discovery_plans",
    "access_plans",
    "call_log_plans",
    "trace_plans",
    "report_plans",
    "response_plans",
    "export_plans",
    "stream_plans",
    "json_plans",
    "assembly_plans",
)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_all() -> tuple[dict[str, Query], dict[str, str]]:
    for module in [m for m in PLAN_MODULES if find_spec(f"gristmill.plans.{m}")]:
        import_module(f"gristmill.plans.{module}")
    return dict(QUERIES), dict(ORACLES)
