"""Query registry: name -> (Spark builder, DuckDB oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from cartwalk.sources.roles import Roles
from cartwalk.sources.tables import Tables


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}

# Stands for the stop-word rows in oracle SQL until the text is rendered, so
# that importing the plans needs no JVM and no file of the Spark install.
STOP_WORDS = "%STOP_WORDS%"


def oracle_text(q: Query) -> str:
    """The oracle SQL of ``q`` with the stop-word list filled in.  The list is
    the one the operators use, asked from Spark itself."""
    if STOP_WORDS not in q.sql:
        return q.sql
    from cartwalk.operators.text import spanish_stop_words
    from cartwalk.session import get_spark
    rows = ", ".join("('" + w.replace("'", "''") + "')" for w in spanish_stop_words(get_spark()))
    return q.sql.replace(STOP_WORDS, rows)


def query(name: str, sql: str | None = None):
    """Register ``fn(ctx) -> DataFrame`` under ``name``."""
    def deco(fn):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Ctx(spark, sf_dir))
        build.__name__ = name
        build.__doc__ = fn.__doc__
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, build, sql)
        return fn
    return deco


class Ctx:
    """Everything a query needs: the session, tables and role builders."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        from cartwalk.session import _apply, ship_package
        _apply(spark)
        ship_package(spark)
        self.spark = spark
        self.sf_dir = sf_dir
        self.t = Tables(spark, sf_dir)
        self.r = Roles(self.t)
        self.memo: dict = {}


def load_all() -> dict[str, Query]:
    # Importing the modules registers their queries.
    from cartwalk.plans import (  # noqa: F401
        queries_rec, queries_eval, queries_profile, queries_enrich,
        queries_text, queries_session, queries_io, queries_stream,
    )
    return REGISTRY
