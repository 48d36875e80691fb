"""Walks over nested column types: structs, maps and arrays around leaves.

Each function reads the schema on the driver and builds one column expression,
so the data itself never leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def column_type(df: DataFrame, name: str) -> T.DataType:
    return df.select(name).schema[0].dataType


def map_leaves(
    col: Column,
    dtype: T.DataType,
    func: Callable[[Column], Column],
    is_leaf: Callable[[T.DataType], bool],
    other: str = "keep",
) -> Column:
    """Apply ``func`` to the leaves that ``is_leaf`` accepts and keep the structure.

    A type that is neither a container nor accepted is left alone
    (``other="keep"``) or is an error before any job starts (``other="raise"``).
    """
    if is_leaf(dtype):
        return func(col)

    def walk(inner: Column, inner_type: T.DataType) -> Column:
        return map_leaves(inner, inner_type, func, is_leaf, other)

    if isinstance(dtype, T.StructType):
        fields = [walk(col[f.name], f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(col.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: walk(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(col, lambda _, v: walk(v, dtype.valueType))
    if other == "raise":
        raise TypeError(f"unsupported type {dtype.simpleString()} in a nested value")
    return col


def map_strings(df: DataFrame, name: str, func: Callable[[Column], Column]) -> Column:
    """``func`` on every string inside column ``name``; other leaves are untouched."""
    return map_leaves(F.col(name), column_type(df, name), func, lambda t: isinstance(t, T.StringType))


def map_numbers(df: DataFrame, name: str, func: Callable[[Column], Column]) -> Column:
    """``func`` on every number inside column ``name``; any other leaf type is an error."""
    return map_leaves(F.col(name), column_type(df, name), func, lambda t: isinstance(t, NUMERIC), "raise")


def flatten_leaves(df: DataFrame, name: str, as_type: str) -> Column:
    """All leaves of column ``name``, depth first, as one array of ``as_type``.

    A null array or map has no leaves; a null scalar is one null leaf.
    """
    none = F.array().cast(f"array<{as_type}>")

    def walk(col: Column, dtype: T.DataType) -> Column:
        if isinstance(dtype, T.StructType):
            return F.concat(*[walk(col[f.name], f.dataType) for f in dtype.fields])
        if isinstance(dtype, T.MapType):
            return walk(F.map_values(col), T.ArrayType(dtype.valueType))
        if isinstance(dtype, T.ArrayType):
            if isinstance(dtype.elementType, (T.StructType, T.MapType, T.ArrayType)):
                return F.coalesce(F.flatten(F.transform(col, lambda x: walk(x, dtype.elementType))), none)
            return F.coalesce(col.cast(f"array<{as_type}>"), none)
        return F.array(col.cast(as_type))

    return walk(F.col(name), column_type(df, name))


def _array_shape(col: Column, dtype: T.DataType) -> list[Column]:
    """Sizes level by level, read along the first element, as for a rectangular block."""
    if not isinstance(dtype, T.ArrayType):
        return []
    return [F.size(col), *_array_shape(F.get(col, F.lit(0)), dtype.elementType)]


def _leaf_type(dtype: T.DataType) -> T.DataType:
    return _leaf_type(dtype.elementType) if isinstance(dtype, T.ArrayType) else dtype


def describe_structure(df: DataFrame, name: str) -> Column:
    """Path, shape and leaf type of each block of numbers or strings in column ``name``."""
    found: list[Column] = []

    def walk(col: Column, dtype: T.DataType, path: str) -> None:
        if isinstance(dtype, T.StructType):
            for f in dtype.fields:
                walk(col[f.name], f.dataType, f"{path}.{f.name}")
            return
        leaf = _leaf_type(dtype)
        if isinstance(leaf, (T.StructType, T.MapType)):
            raise TypeError(f"{path}: a shape needs plain arrays, not {dtype.simpleString()}")
        shape = F.concat_ws(",", *[s.cast("string") for s in _array_shape(col, dtype)])
        found.append(
            F.struct(F.lit(path).alias("path"), shape.alias("shape"), F.lit(leaf.simpleString()).alias("dtype"))
        )

    walk(F.col(name), column_type(df, name), name)
    return F.array(*found)


def slice_leaves(df: DataFrame, name: str, start: int, length: int) -> Column:
    """The same slice (zero-based ``start``) of every array leaf of column ``name``."""
    return map_leaves(
        F.col(name),
        column_type(df, name),
        lambda a: F.slice(a, start + 1, length),
        lambda t: isinstance(t, T.ArrayType),
        "raise",
    )
