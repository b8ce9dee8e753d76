"""Column types of a job: ``category`` columns are text, all others are integers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CATEGORY = "category"
NUMERIC = "numeric"


def to_category(col: Column) -> Column:
    return col.cast("string")


def to_numeric(col: Column, source: T.DataType) -> Column:
    """Integer value of a column, cut toward zero; text or magnitudes that do not fit give NULL."""
    if isinstance(source, T.StringType):
        return F.trim(col).try_cast("double").try_cast("int")
    return col.try_cast("int")


def typed(df: DataFrame, name: str, data_type: str) -> Column:
    """Column ``name`` of ``df`` as its job type, under its own name."""
    col = F.col(quoted(name))
    out = to_category(col) if data_type == CATEGORY else to_numeric(col, df.schema[name].dataType)
    return out.alias(name)


def quoted(name: str) -> str:
    """A column name safe against dots and dashes."""
    return "`" + name.replace("`", "``") + "`"
