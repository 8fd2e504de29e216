"""Wide projections as SQL text.

Building ~100 column expressions through the Python Column API costs about ten
py4j round trips per column; the same projection written as SQL text and
passed to ``selectExpr`` is one call, parsed and analysed on the JVM side.
The expressions are still ordinary built-in Spark SQL (codegen, no UDFs).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame


def q(name: str) -> str:
    """Quoted identifier."""
    return "`" + name.replace("`", "``") + "`"


def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return f"CAST({v!r} AS DOUBLE)" if v == v and v not in (float("inf"), float("-inf")) else \
            f"CAST('{v}' AS DOUBLE)"
    return str(v)


def project(df: DataFrame, new: Mapping[str, str], drop: tuple[str, ...] = (),
            columns: list[str] | None = None) -> DataFrame:
    """Replace existing columns in place and append the others, in one ``selectExpr``
    (the ``withColumns`` contract)."""
    cols = columns if columns is not None else df.columns
    exprs = []
    for c in cols:
        if c in drop:
            continue
        exprs.append(f"{new[c]} AS {q(c)}" if c in new else q(c))
    exprs += [f"{e} AS {q(n)}" for n, e in new.items() if n not in cols]
    return df.selectExpr(*exprs)
