"""Registration of a query together with its checking SQL."""

from __future__ import annotations

import re
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import apply_settings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
CTES: dict[str, str] = {}


def present(df: DataFrame) -> DataFrame:
    """Comparable output: dates, times, lists and maps as text, numbers with six places."""
    out = []
    for field in df.schema.fields:
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, T.DateType):
            c = c.cast("string")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(kind, T.ArrayType):
            c = F.array_join(c, ",")
        elif isinstance(kind, T.MapType):
            entries = F.array_sort(F.map_entries(c))
            c = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
        out.append(c.alias(field.name))
    return df.select(*out)


def D(expr: str, name: str | None = None) -> str:
    return f"strftime({expr}, '%Y-%m-%d') AS {name or expr.split('.')[-1]}"


def TS(expr: str, name: str | None = None) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f') AS {name or expr.split('.')[-1]}"


def R(expr: str, name: str | None = None) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) + 0.0 AS {name or expr.split('.')[-1]}"


def L(expr: str, name: str | None = None) -> str:
    return f"array_to_string({expr}, ',') AS {name or expr.split('.')[-1]}"


def cents(expr: str) -> str:
    """Half-even rounding to two places of the decimal that a double is shown as, which is how Spark rounds it."""
    shown = f"(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38, 18)) * 100)"
    return (f"(CASE WHEN abs({shown} - trunc({shown})) = 0.5 AND CAST(trunc({shown}) AS BIGINT) % 2 = 0 THEN trunc({shown}) ELSE round({shown}) END / 100)")


def cte(name: str, body: str) -> None:
    CTES[name] = body.strip()


def _needs(text: str, done: list[str], open_: frozenset = frozenset()) -> None:
    for name, body in CTES.items():
        if name not in done and name not in open_ and re.search(rf"\b{name}\b", text):
            _needs(body, done, open_ | {name})
            if name not in done:
                done.append(name)


def with_ctes(text: str) -> str:
    """The statement with the table expressions it uses, in order."""
    done: list[str] = []
    _needs(text, done)
    if not done:
        return text.strip()
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in done) + "\n" + text.strip()


def query(name: str, sql: str | None = None):
    """Register a query; without SQL only its rows are checked."""
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: present(fn(apply_settings(spark), sf_dir))
        if sql is not None:
            ORACLE[name] = with_ctes(sql)
        return fn

    return register
