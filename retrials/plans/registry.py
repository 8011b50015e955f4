"""Registered queries and their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from retrials.functions.numeric import tidy
from retrials.plans.duck_views import VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Shorthand of the SQL twins: H(x) keyed hash, R(x) rounded double, I(x) bigint.
_SHORT = {
    "H": "cast('0x'||substr(md5({0}),1,15) as bigint)",
    "R": "(round(cast({0} as double) + 3e-11, 8) + 0.0)",
    "I": "cast({0} as bigint)",
}


def expand(sql: str) -> str:
    """Replace the shorthand calls, innermost first."""
    while True:
        hits = list(re.finditer(r"(?<![A-Za-z0-9_.])([HRI])\(", sql))
        if not hits:
            return sql
        start = hits[-1]
        depth, end = 1, start.end()
        quoted = False
        while depth:
            ch = sql[end]
            if ch == "'":
                quoted = not quoted
            elif not quoted:
                depth += (ch == "(") - (ch == ")")
            end += 1
        inner = sql[start.end(): end - 1]
        sql = sql[: start.start()] + _SHORT[start.group(1)].format(inner) + sql[end:]


def _needed(sql: str) -> list[str]:
    """Names of the fixture views a text uses, in definition order."""
    wanted: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name, body in VIEWS.items():
            if name not in wanted and re.search(rf"\b{name}\b", text):
                wanted.add(name)
                todo.append(body)
    return [name for name in VIEWS if name in wanted]


def with_views(sql: str) -> str:
    views = [f"{name} AS ({VIEWS[name]})" for name in _needed(sql)]
    body = sql.strip()
    if body.lower().startswith("with "):
        views.append(body[5:])
        text = "WITH " + ",\n".join(views)
    else:
        text = ("WITH " + ",\n".join(views) + "\n" if views else "") + body
    return expand(text)


def query(name: str, sql: str | None = None, digits: int = 8):
    """Register ``fn(spark, sf_dir)`` under ``name``, with its SQL twin if there is one."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(fn(spark, sf_dir), digits)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return wrap
