"""Registry of named queries over the test tables and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillgraph.sources.testtables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of :class:`Tables` under its own name."""
    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Tables(spark, folder))

        run.__name__ = build.__name__
        run.__doc__ = build.__doc__
        QUERIES[build.__name__] = run
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return register


# Shared beginnings of oracle statements.
MENTIONS = "m AS (SELECT l_orderkey AS work, l_partkey AS author FROM lineitem)"
EDGES = MENTIONS + """,
small AS (SELECT work FROM m GROUP BY work HAVING count(*) BETWEEN 2 AND 10),
kept AS (SELECT author, work FROM m WHERE work IN (SELECT work FROM small)),
active AS (SELECT author FROM kept GROUP BY author HAVING count(*) BETWEEN 2 AND 20),
edges AS (SELECT author, work FROM kept WHERE author IN (SELECT author FROM active))"""
PAIRS = MENTIONS + """,
small AS (SELECT work FROM m GROUP BY work HAVING count(*) <= 10),
sm AS (SELECT work, author FROM m WHERE work IN (SELECT work FROM small)),
pairs AS (SELECT a.work, a.author AS src, b.author AS dst
          FROM sm a JOIN sm b ON a.work = b.work WHERE a.author <> b.author),
und AS MATERIALIZED (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, count(*) AS weight
        FROM pairs GROUP BY 1, 2)"""
SELECTED = MENTIONS + """,
big AS (SELECT work FROM m GROUP BY work HAVING count(*) > 1),
p AS (SELECT DISTINCT work, author FROM m WHERE work IN (SELECT work FROM big)),
rep AS (SELECT author FROM p GROUP BY author HAVING count(*) > 1),
sel AS (SELECT work, author FROM p WHERE author IN (SELECT author FROM rep))"""
AUTHOR_IX = """
firsts AS (SELECT l_partkey AS author, l_orderkey AS work, l_linenumber AS pos FROM lineitem
           QUALIFY row_number() OVER (PARTITION BY l_partkey
                                      ORDER BY l_orderkey, l_linenumber) = 1),
ix AS (SELECT author, row_number() OVER (ORDER BY work, pos, author) - 1 AS author_ix
       FROM firsts)"""


def hash60(text: str, part: int = 0) -> str:
    """SQL for 60 bits of the md5 of a text expression: one run of fifteen digits."""
    return f"('0x' || substr(md5({text}), {15 * part + 1}, 15))::BIGINT"


def hash32(text: str, part: int = 0) -> str:
    """SQL for 32 bits of the md5 of a text expression: one run of eight digits."""
    return f"('0x' || substr(md5({text}), {8 * part + 1}, 8))::BIGINT"
