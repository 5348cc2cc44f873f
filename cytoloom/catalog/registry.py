"""Registered queries, each with the SQL it is checked against where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(views)`` under ``name``; ``views`` gives the bound tables of one data folder."""

    def wrap(fn):
        from cytoloom.sources.views import Views

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return wrap


def greedy_sql(items: str, conflicts: str) -> str:
    """CTE ``settled(id, s)``: s = 1 where an item is taken, walking items best first.

    ``items(id)`` and ``conflicts(win, lose)``: an item is taken when every better rival is out, and out when a
    better rival is taken; rounds repeat until nothing changes.
    """
    return f""", settled (id, s) using key (id) as (select id, 0 from {items} union
  (select r.id, case when bool_or(coalesce(b.s, 0) = 1) then 2 else 1 end
   from recurring.settled r left join {conflicts} c on c.lose = r.id left join recurring.settled b on b.id = c.win
   where r.s = 0 group by r.id
   having bool_or(coalesce(b.s, 0) = 1) or bool_and(c.win is null or b.s = 2)))\n"""
