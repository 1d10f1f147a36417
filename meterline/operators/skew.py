"""Row-level lookups that survive a hot key.

A fact row picks one of ``salts`` copies of its key by a hash of its own id, and the (small per row)
dimension side is repeated once per salt. One key that holds a third of all rows is then spread over
``salts`` shuffle partitions, which adaptive execution can split further. The copies are never broadcast: Spark's
estimate does not see that the dimension was repeated, so it would send ``salts`` times what its threshold allows to every
executor. Both sides are shuffled and merged instead, which grows with the input at any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALT = "_salt"


def salted_join(
    fact: DataFrame, dim: DataFrame, keys: list[str], spread_on: list[str], salts: int, how: str = "left"
) -> DataFrame:
    """Join ``fact`` to a ``dim`` that is unique in ``keys``; ``how`` is left, inner, left_semi or left_anti.

    The salt is computed only from the row's own columns, so a retried task repeats it exactly.
    """
    salted = fact.withColumn(SALT, F.pmod(F.xxhash64(*spread_on), F.lit(salts)))
    copies = dim.withColumn(SALT, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return salted.join(copies.hint("merge"), [*keys, SALT], how).drop(SALT)
