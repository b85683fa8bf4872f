"""The registered queries of the library and their SQL, gathered from the operator modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its operator's name, with the SQL that must give the same rows."""

    def keep(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = f
        if oracle:
            _ORACLES[name] = oracle
        return f

    return keep


def queries() -> dict[str, Query]:
    from . import registry  # noqa: F401  importing it registers everything

    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    from . import registry  # noqa: F401

    return dict(_ORACLES)
