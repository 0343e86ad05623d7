"""Rules that reach every part of nested columns, written out from their schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numbers import finite


def _holds(kind: T.DataType, wanted: tuple[type, ...]) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds(f.dataType, wanted) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _holds(kind.elementType, wanted)
    if isinstance(kind, T.MapType):
        return _holds(kind.valueType, wanted)
    return isinstance(kind, wanted)


def changed(value: Column, kind: T.DataType, rule: Callable[[Column], Column], wanted: tuple[type, ...]) -> Column:
    """value with rule applied to all parts of the wanted types: fields of structs, elements of arrays, values of maps (keys stay), at any depth.
    Parts without such types are passed on as they are; nulls stay null."""
    if not _holds(kind, wanted):
        return value
    if isinstance(kind, T.StructType):
        rebuilt = F.struct(*(changed(value[f.name], f.dataType, rule, wanted).alias(f.name) for f in kind.fields))
        return F.when(value.isNotNull(), rebuilt)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: changed(x, kind.elementType, rule, wanted))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: changed(x, kind.valueType, rule, wanted))
    return rule(value)


def finite_everywhere(df: DataFrame) -> DataFrame:
    """Null for NaN and the infinities in all columns, however deep they stand."""
    return df.select(*(changed(F.col(f"`{f.name}`"), f.dataType, finite, (T.DoubleType, T.FloatType)).alias(f.name) for f in df.schema.fields))
