"""Typing rules of table cells as column expressions.

Each takes a DataFrame and a column's name, as the rule depends on the column's type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts that count as missing.
MISSING = ("", "nan", "na", "n/a", "none", "null", "<na>")
#: A number as text; engines' casts also take suffixes such as ``1d``, which stay text here.
NUMERIC = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf|infinity|nan)$"
NAN = float("nan")


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def kind(df: DataFrame, name: str) -> T.DataType:
    if name not in df.columns:
        raise ValueError(f"missing table column {name!r}")
    return df.schema[name].dataType


def text_number(value: Column) -> Column:
    """A text as a double, or null; true and false count as 1 and 0."""
    t = F.lower(F.trim(value))
    return F.when(t == "true", 1.0).when(t == "false", 0.0).when(t.rlike(NUMERIC), t.try_cast("double"))


def number(df: DataFrame, name: str) -> Column:
    """A cell as a double: booleans as 0 and 1, texts parsed, null where it is none."""
    return text_number(col(name)) if isinstance(kind(df, name), T.StringType) else col(name).cast("double")


def or_nan(value: Column) -> Column:
    return F.coalesce(value, F.lit(NAN))


def whole(value: Column) -> Column:
    """A double as an integer, halves away from zero; null if not finite."""
    finite = ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(finite, F.round(value).cast("long"))


def integer(df: DataFrame, name: str) -> Column:
    """A cell as an integer id or frame."""
    return col(name).cast("long") if isinstance(kind(df, name), T.IntegralType) else whole(number(df, name))


def lossy(df: DataFrame, name: str) -> Column:
    """A cell as text: whole numbers without a fraction, missing cells empty."""
    value, of = col(name), kind(df, name)
    if isinstance(of, (T.DoubleType, T.FloatType)):
        is_whole = (value == F.floor(value)) & (F.abs(value) < 9.0e15)
        return F.coalesce(F.when(is_whole, value.cast("long").cast("string")).otherwise(value.cast("string")), F.lit(""))
    return F.coalesce(value.cast("string"), F.lit(""))


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, NaN, or a text that stands for nothing."""
    value, of = col(name), kind(df, name)
    if isinstance(of, T.StringType):
        return value.isNull() | F.lower(F.trim(value)).isin(*MISSING)
    if isinstance(of, (T.DoubleType, T.FloatType)):
        return value.isNull() | F.isnan(value)
    return value.isNull()


def truthy(df: DataFrame, name: str) -> Column:
    """Whether a cell reads as true: a true boolean, a number but 0 and NaN, or a text of yes."""
    value, of = col(name), kind(df, name)
    if isinstance(of, T.BooleanType):
        return F.coalesce(value, F.lit(False))
    if isinstance(of, T.StringType):
        n = text_number(value)
        return F.lower(F.trim(value)).isin("true", "yes", "y") | F.coalesce((n != 0) & ~F.isnan(n), F.lit(False))
    n = value.cast("double")
    return F.coalesce((n != 0) & ~F.isnan(n), F.lit(False))


def key(df: DataFrame, name: str) -> Column:
    """A join or group key: integers as they are, other cells as their text, so 1 and 1.0 agree."""
    return col(name).cast("long") if isinstance(kind(df, name), T.IntegralType) else lossy(df, name)


def alike(df: DataFrame, left: str, right: str) -> tuple[Column, Column]:
    """Two columns of one table as keys that can be compared with one another."""
    if all(isinstance(kind(df, x), T.IntegralType) for x in (left, right)):
        return key(df, left), key(df, right)
    return lossy(df, left), lossy(df, right)


def require(df: DataFrame, *names: str) -> None:
    lacking = [n for n in names if n not in df.columns]
    if lacking:
        raise ValueError(f"missing table column {lacking[0]!r}")
