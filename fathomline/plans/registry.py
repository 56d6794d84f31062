"""Queries by name, with the SQL an independent engine can check them by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of one directory, and the adapters built on them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        from ..sources import testdata

        build = getattr(testdata, name, None)
        return build(self) if build else self.table(name)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def query(name: str, sql: str | None = None, uses: str = ""):
    """Registers a function of Tables; uses: adapters whose SQL stands before the oracle's."""

    def put(fn: Callable[[Tables], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            from ..sources.testdata import SQL

            need: list[str] = []

            def add(x: str) -> None:
                for y in SQL[x][0].split():
                    add(y)
                if x not in need:
                    need.append(x)

            for x in uses.split():
                add(x)
            ctes = [f"{x} AS ({SQL[x][1]})" for x in need]
            body = sql.strip()
            if body[:5].upper() == "WITH ":
                recursive = body[5:].lstrip()[:10].upper() == "RECURSIVE "
                body = body[5:].lstrip()[10 * recursive :]
                head = "WITH RECURSIVE " if recursive else "WITH "
                ORACLES[name] = head + ", ".join([*ctes, body])
            else:
                ORACLES[name] = (f"WITH {', '.join(ctes)} " if ctes else "") + body
        return fn

    return put
