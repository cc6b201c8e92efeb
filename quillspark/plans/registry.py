"""The registry of queries and their SQL, and SQL fragments that mirror the text functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import text as X

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with SQL for the same rows if there is any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def words(x: str) -> str:
    return f"regexp_extract_all(coalesce({x}, ''), '{X.WORD_PATTERN}')"


def folded(x: str) -> str:
    return f"lower(translate(coalesce({x}, ''), {quoted(X.FOLD_FROM + X.FOLD_DELETE)}, {quoted(X.FOLD_TO)}))"


def tokens(x: str) -> str:
    return f"list_filter({words(folded(x))}, lambda t: length(t) > 1)"


def terms(x: str) -> str:
    return f"regexp_extract_all({folded(x)}, '{X.TERM_PATTERN}')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{X.SPACE}]+|[{X.SPACE}]+$', '', 'g')"


def listed(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def packed(items: str, key: str, longest: int) -> str:
    """Recursive CTEs that join the texts of `items` (key, rn, p) to pages of at most `longest` characters: (key, page_no, page)."""
    grown = f"length(f.page) + 2 + length(i.p) <= {longest}"
    return f"""fold AS (SELECT {key}, rn, 0::BIGINT AS page_no, p AS page FROM {items} WHERE rn = 1
 UNION ALL SELECT i.{key}, i.rn, CASE WHEN {grown} THEN f.page_no ELSE f.page_no + 1 END, CASE WHEN {grown} THEN f.page || chr(10) || chr(10) || i.p ELSE i.p END FROM fold AS f JOIN {items} AS i ON i.{key} = f.{key} AND i.rn = f.rn + 1),
pages_of AS (SELECT {key}, page_no, arg_max(page, rn) AS page FROM fold GROUP BY {key}, page_no)"""
