"""Registration of checked queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.text import SPACE
from .base import JOBS_AS_OF, RUNS_AS_OF, Tables, oracle


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    build: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register a function of the tables; ``covers`` lists operator ids, ``sql`` is the DuckDB check."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(name, tuple(covers.split()), fn, sql)
        return fn

    return register


def comparable(df: DataFrame) -> DataFrame:
    """Instants and arrays as text, so that both engines print them alike."""
    columns = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), "|")
        columns.append(c.alias(f.name))
    return df.select(*columns)


def run(name: str, spark, sf_dir: str) -> DataFrame:
    return comparable(QUERIES[name].build(Tables(spark, sf_dir)))


def check_sql(name: str) -> str | None:
    text = QUERIES[name].sql
    return None if text is None else oracle(text)


# --- helpers for the DuckDB texts ---------------------------------------------------------------

JOBS_NOW = f"TIMESTAMP '{JOBS_AS_OF}'"
RUNS_NOW = f"TIMESTAMP '{RUNS_AS_OF}'"


def ts(c: str, name: str | None = None) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {name or c.split('.')[-1]}"


def arr(c: str, name: str | None = None) -> str:
    return f"array_to_string({c}, '|') AS {name or c.split('.')[-1]}"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def sql_collapse(x: str) -> str:
    return f"regexp_replace({x}, '{SPACE}+', ' ', 'g')"


def sql_title(x: str) -> str:
    return sql_strip(sql_collapse(f"lower({x})"))


def sql_key(title: str, company: str) -> str:
    stripped = sql_strip(f"lower(coalesce({company}, ''))")
    return f"({sql_title(title)} || '|' || {stripped})"
