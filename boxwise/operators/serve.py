"""Tables as they are served: wide by stat, or stats as rows and types as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StringType, StructType


def wide(long: DataFrame, keys: list[str], names: list[str], key: str = "stat_key", value: Column | str = "value") -> DataFrame:
    """One row for each of ``keys``, a column for each stat of a given list."""
    return long.groupBy(*keys).pivot(key, names).agg(F.first(value if isinstance(value, Column) else F.col(value), ignorenulls=True))


def long(df: DataFrame, keys: list[str], names: list[str], key: str = "stat_key", value: str = "value") -> DataFrame:
    """One row for each stat of a row."""
    return df.unpivot(keys, [F.col(n).cast("double").alias(n) for n in names], key, value)


def without_empty(df: DataFrame, played: str) -> DataFrame:
    """Only rows that played: the amount is neither null nor 0."""
    return df.where(F.coalesce(F.col(played), F.lit(0)) != 0)


def cell(value: Column, digits: int = 2) -> Column:
    """Rounded half up; NaN is null."""
    scale = float(10**digits)
    return F.when(~F.isnan(value), F.floor(value * scale + 0.5) / scale)


def cleaned(df: DataFrame, digits: int = 2) -> DataFrame:
    """Every column cleaned at any depth of structs, arrays and maps: numbers rounded half up, NaN and the text ``NaN`` null, all else as it is."""
    return df.select(*[_clean(F.col(f"`{f.name}`"), f.dataType, digits).alias(f.name) for f in df.schema])


def _clean(value: Column, kind: DataType, digits: int) -> Column:
    if isinstance(kind, (DoubleType, FloatType)):
        return cell(value.cast("double"), digits)
    if isinstance(kind, StringType):
        return F.when(value != "NaN", value)
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*[_clean(value[f.name], f.dataType, digits).alias(f.name) for f in kind]))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _clean(x, kind.elementType, digits))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, v: _clean(v, kind.valueType, digits))
    return value
