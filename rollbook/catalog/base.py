"""Registry of queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import bindings
from ..session import small_tasks, tune
from ..sources import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """Tables and bindings of one data folder, as attributes: ``t.orders``, ``t.b_user``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def __getattr__(self, name: str) -> DataFrame:
        if name == "b_contract_items":
            return bindings.contract_items(self.spark, self.root)
        if name.startswith("b_"):
            return bindings.frame(self.spark, self.root, name)
        return load(self.spark, self.root, name)


def _words(text: str) -> list[str]:
    return text.split()


def register(name: str, sql: str | None = None, uses: str = "", dates: str = "", money: str = "", extra: str = ""):
    """Register a query.

    ``uses`` lists bindings for the oracle and ``extra`` adds CTEs. Columns in ``dates`` are compared as
    text and columns in ``money`` as double, so that both engines return the same client types.
    """

    def wrap(fn: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, root: str) -> DataFrame:
            out = fn(Inputs(small_tasks(tune(spark)), root))
            casts = {c: F.col(c).cast("string") for c in _words(dates)}
            casts |= {c: F.col(c).cast("double") for c in _words(money)}
            return out.withColumns(casts) if casts else out

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ctes = ", ".join(x for x in [bindings.cte(*_words(uses)) if uses else "", extra] if x)
            ctes = f"{ctes}, " if ctes else ""
            replaced = [f"CAST({c} AS VARCHAR) AS {c}" for c in _words(dates)]
            replaced += [f"CAST({c} AS DOUBLE) AS {c}" for c in _words(money)]
            pick = f"SELECT * REPLACE ({', '.join(replaced)})" if replaced else "SELECT *"
            ORACLES[name] = f"WITH {ctes}result AS ({sql}) {pick} FROM result"
        return fn

    return wrap
