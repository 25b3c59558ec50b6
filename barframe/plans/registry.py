"""Registration of queries together with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barframe.functions.numbers import round_half_up
from barframe.plans.sql_twins import CTES, r, statement
from barframe.plans.tables import Tables

DIGITS = 4


@dataclass
class Query:
    name: str
    covers: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles at a fixed number of decimals, so that two engines can be compared by value."""
    return df.select(*[
        round_half_up(F.col(f"`{f.name}`"), digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f"`{f.name}`")
        for f in df.schema
    ])


def query(name: str, covers: str, sql: str | None = None, doubles: str = "", digits: int = DIGITS):
    """Register ``fn(tables) -> DataFrame``. ``doubles`` names the columns rounded on the SQL side."""

    def wrap(fn):
        text = None
        if sql is not None:
            names = doubles.split()
            replaced = f" REPLACE ({', '.join(f'{r(n, digits)} AS {n}' for n in names)})" if names else ""
            text = statement(f"SELECT *{replaced} FROM ({sql}) AS answer")
        REGISTRY[name] = Query(name, covers, lambda spark, d: rounded(fn(Tables(spark, d)), digits), text)
        return fn

    return wrap


def define(name: str, sql: str) -> None:
    """Add a common table expression for the SQL side."""
    CTES[name] = sql
