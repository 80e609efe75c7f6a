"""Named queries and the SQL that checks them."""

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stintwise.plans.oracle_ctes import CTES
from stintwise.plans.columns import TIE_SHIFT
from stintwise.plans.marts import Marts

Query = Callable[[Marts], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def with_ctes(sql: str) -> str:
    """Prefix the shared CTEs that `sql` names, in dependency order."""
    needed: list[str] = []

    opened: set[str] = set()

    def visit(text: str) -> None:
        for name, body in CTES.items():
            if name not in opened and re.search(rf"\b{name}\b", text):
                opened.add(name)
                visit(body)
                needed.append(name)

    visit(sql)
    if not needed:
        return sql.strip()
    head = ",\n".join(f"{name} AS ({CTES[name].strip()})" for name in needed)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


def nudge_ties(sql: str) -> str:
    """`round(x, 6)` with the same tiny shift as `columns.rounded`, so that exact ties do not
    depend on the order in which an engine adds floats."""
    out, at = [], 0
    for start in re.finditer(r"\bround\(", sql):
        depth, i = 1, start.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            i += 1
        if sql[start.end() : i].endswith(", 6)"):
            out.append(sql[at : i - 4] + f" + {TIE_SHIFT}, 6)")
            at = i
    return "".join(out) + sql[at:]


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = with_ctes(nudge_ties(oracle))
        return fn

    return register


def bind(fn: Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(Marts.of(spark, sf_dir))
