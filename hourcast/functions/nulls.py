"""Null handling (FN-NU1..7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in exclude]


def normalize_missing(df: DataFrame) -> DataFrame:
    """Turn NaN / ±inf of every float column into null, in one projection (FN-NU1)."""
    from hourcast.functions.sqlexpr import project, q

    fields = df.schema.fields
    repl = {f.name: f"CASE WHEN isnan({q(f.name)}) OR abs({q(f.name)}) = CAST('Infinity' AS DOUBLE) "
                    f"THEN NULL ELSE {q(f.name)} END"
            for f in fields if isinstance(f.dataType, FLOAT_TYPES)}
    return project(df, repl, columns=[f.name for f in fields]) if repl else df


def zero_if_null(c: Column) -> Column:
    """null / NaN → 0.0 (FN-NU5, FN-NU7)."""
    return F.coalesce(F.nanvl(c.cast("double"), F.lit(None).cast("double")), F.lit(0.0))
