"""Registry of named queries (Spark callables) and their DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import with_fixtures

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, fixtures: tuple[str, ...] = ()):
    """Register ``fn`` as query ``name``; ``sql`` (with stand-in views ``fixtures``) is its oracle."""

    def wrap(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_fixtures(sql, *fixtures)
        return fn

    return wrap


def load_all() -> tuple[dict[str, QueryFn], dict[str, str]]:
    from . import (  # noqa: F401
        q_geo,
        q_io,
        q_joined,
        q_metrics,
        q_models,
        q_panel,
        q_pipeline,
        q_scalars,
        q_streaming,
        q_weather,
    )

    from .rounding import load_manifest, round_doubles, round_sql

    manifest = load_manifest()

    def rounded(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        return run

    qs = {k: rounded(v) for k, v in QUERIES.items()}
    ors = {k: round_sql(v, manifest.get(k, [])) for k, v in ORACLES.items()}
    return qs, ors


def load_raw() -> tuple[dict[str, QueryFn], dict[str, str]]:
    """Queries and oracles without the output rounding (used to build the manifest)."""
    load_all()
    return dict(QUERIES), dict(ORACLES)
