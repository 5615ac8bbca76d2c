"""Column kinds (P2) and the canonical grouping key of a value.

Every profile groups values by a string key.  Short strings are their own key;
long strings become ``prefix || sha256`` so that shuffles carry at most
``2 * LONG_TEXT_CHARS`` characters per value no matter how long the text is.
Distinct counts stay exact up to SHA-256 collisions, and key order equals
value order except among long strings that share the whole prefix.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .constants import LONG_TEXT_CHARS

NUMERIC = "numeric"
CATEGORICAL = "categorical"   # string / boolean: top values + imbalance check
OTHER = "other"               # dates, timestamps, nested: top values only

_NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                  T.FloatType, T.DoubleType, T.DecimalType)


def kind_of(dt: T.DataType) -> str:
    """Numeric / categorical / other, from the Spark type alone."""
    if isinstance(dt, _NUMERIC_TYPES):
        return NUMERIC
    if isinstance(dt, (T.StringType, T.BooleanType)):
        return CATEGORICAL
    return OTHER


@dataclass(frozen=True)
class ColumnSpec:
    pos: int          # 0-based position in the input schema
    name: str
    dtype: str        # Spark simpleString
    kind: str
    dt: T.DataType

    @property
    def alias(self) -> str:
        """The column's name inside plans: by place, because names may hold
        any character and may differ in case only."""
        return f"__dq{self.pos}"

    @property
    def col(self) -> Column:
        return F.col(self.alias)


def specs_of(schema: T.StructType) -> list[ColumnSpec]:
    return [ColumnSpec(i, f.name, f.dataType.simpleString(), kind_of(f.dataType), f.dataType)
            for i, f in enumerate(schema.fields)]


@dataclass(frozen=True)
class Placed:
    """A frame whose columns are already named by their place in the input."""
    df: DataFrame


def positional(df: DataFrame | Placed) -> DataFrame:
    """The frame with every column named by its place."""
    if isinstance(df, Placed):
        return df.df
    return df.toDF(*[f"__dq{i}" for i in range(len(df.columns))])


def canonical_text(s: Column) -> Column:
    """Short strings verbatim, long ones as prefix + SHA-256 hex."""
    return F.when(F.length(s) <= LONG_TEXT_CHARS, s).otherwise(
        F.concat(F.substring(s, 1, LONG_TEXT_CHARS), F.sha2(s, 256)))


def is_long_key(key: Column) -> Column:
    return F.length(key) > LONG_TEXT_CHARS


def display_value(c: Column, dt: T.DataType) -> Column:
    """The string a value is shown as (top-value keys, X8)."""
    if isinstance(dt, T.BooleanType):
        return F.initcap(c.cast("string"))          # True / False
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return (c + F.lit(0.0).cast(dt)).cast("string")   # -0.0 -> 0.0 (D16)
    if isinstance(dt, T.MapType):
        # entries in key order: maps that differ in order only are equal
        return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))
    if isinstance(dt, (T.ArrayType, T.StructType, T.VariantType)):
        return F.to_json(c)
    if isinstance(dt, T.BinaryType):
        return F.hex(c)
    return c.cast("string")


_LONG_TYPES = (T.StringType, T.MapType, T.ArrayType, T.StructType, T.BinaryType, T.VariantType)


def value_key(c: Column, dt: T.DataType) -> Column:
    """Grouping key of a value: exact for short values, hashed for long ones."""
    shown = display_value(c, dt)
    return canonical_text(shown) if isinstance(dt, _LONG_TYPES) else shown


def row_key(c: Column, dt: T.DataType) -> Column:
    """Key used for whole-row duplicate detection (A8): raw value when it is
    cheap to shuffle and groupable, canonical text otherwise."""
    cheap = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    return c if isinstance(dt, cheap) else value_key(c, dt)
