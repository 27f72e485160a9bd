"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_fractional(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def missing(df: DataFrame, name: str) -> Column:
    """NULL, and NaN where the type has one."""
    c = F.col(name)
    return c.isNull() | F.isnan(c) if is_fractional(df.schema[name].dataType) else c.isNull()


def plain_double(name: str) -> Column:
    """Double without a negative zero, which prints and groups unlike zero elsewhere."""
    return F.col(name).cast("double") + F.lit(0.0)


def rounded(name: str, digits: int = 6) -> Column:
    return F.round(F.col(name), digits).alias(name)


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round the floating columns of a report, keeping names and order."""
    return df.select(
        *[
            rounded(f.name, digits) if is_fractional(f.dataType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def zero_one(df: DataFrame, name: str) -> Column:
    """A 0/1 column as it is, a BOOLEAN one as 0 and 1."""
    col = F.col(name)
    return col.cast("int") if df.schema[name].dataType.typeName() == "boolean" else col
