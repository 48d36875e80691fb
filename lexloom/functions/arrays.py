"""Array functions: padding rows of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions.nested import NUMERIC, column_type


def pad_right(col: Column, length: Column | int, value: int | float, leaf: str = "int") -> Column:
    """Fill up with ``value`` to ``length``; rows already longer stay as they are."""
    target = F.lit(length) if isinstance(length, int) else length
    missing = F.greatest(target - F.size(col), F.lit(0))
    return F.concat(col, F.array_repeat(F.lit(value).cast(leaf), missing))


def pad_rows(rows: Column, length: int | None, value: int | float, leaf: str = "int") -> Column:
    """Pad every row of an array of rows; ``None`` pads to the longest row of the array."""
    target = F.lit(length) if length is not None else F.array_max(F.transform(rows, F.size))
    return F.transform(rows, lambda r: pad_right(r, target, value, leaf))


def _is_block(dtype: T.DataType) -> bool:
    return (
        isinstance(dtype, T.ArrayType)
        and isinstance(dtype.elementType, T.ArrayType)
        and isinstance(dtype.elementType.elementType, NUMERIC)
    )


def pad_structure(df: DataFrame, name: str, length: int | None = 1024, value: int | float = 0) -> Column:
    """Pad every array of number rows inside column ``name``; other leaves are an error."""
    dtype = column_type(df, name)

    def leaf_name(t: T.DataType) -> str:
        return leaf_name(t.elementType) if isinstance(t, T.ArrayType) else t.simpleString()

    def walk(col: Column, t: T.DataType) -> Column:
        if _is_block(t):
            return pad_rows(col, length, value, leaf_name(t))
        if isinstance(t, T.StructType):
            fields = [walk(col[f.name], f.dataType).alias(f.name) for f in t.fields]
            return F.when(col.isNotNull(), F.struct(*fields))
        if isinstance(t, T.MapType):
            return F.transform_values(col, lambda _, v: walk(v, t.valueType))
        if isinstance(t, T.ArrayType) and not isinstance(t.elementType, NUMERIC):
            return F.transform(col, lambda x: walk(x, t.elementType))
        if isinstance(t, NUMERIC) or isinstance(t, T.ArrayType):
            raise ValueError(f"cannot pad a single element of type {t.simpleString()}")
        raise ValueError(f"unknown type {t.simpleString()}")

    return walk(F.col(name), dtype)
