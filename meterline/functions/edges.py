"""Shape of published columns: counts BIGINT, money DOUBLE at 4 places, other ratios DOUBLE at 6."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY_WORDS = ("arr", "carr", "dollars", "credits", "delta", "pay", "value")
RATIO_WORDS = ("pct", "share", "ratio", "rate")

# Sums of carr run over this type, so that a total does not depend on the order of the rows.
CARR_SUM = "decimal(28,6)"


def _is_money(name: str) -> bool:
    words = name.split("_")
    return any(w in MONEY_WORDS for w in words) and not any(w in RATIO_WORDS for w in words)


def carr_sum(name: str = "carr"):
    return F.sum(F.col(name).cast(CARR_SUM))


#: Marks a column that is in published form already.
PUBLISHED = "published"


def _published(f: T.StructField) -> Column:
    c = F.col(f"`{f.name}`")
    if f.metadata.get(PUBLISHED):
        return c
    if isinstance(f.dataType, T.DecimalType):
        return F.round(c.cast("double"), 4)
    if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
        return F.round(c.cast("double"), 4 if _is_money(f.name) else 6)
    if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
        return c.cast("bigint")
    return c


def publish(df: DataFrame) -> DataFrame:
    return df.select(*[_published(f).alias(f.name, metadata={}) for f in df.schema.fields])


def publish_early(df: DataFrame, columns: list[str]) -> DataFrame:
    """Some columns in published form before rows are unfolded, so that ``publish`` need not round each copy."""
    return df.select(*[
        _published(f).alias(f.name, metadata={PUBLISHED: True}) if f.name in columns else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])
