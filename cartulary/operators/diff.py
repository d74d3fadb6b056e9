"""One comparison of two snapshots, shared by saves, tags and field patches."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame


def diff(old: DataFrame, new: DataFrame, key: list[str], compare: list[str]) -> DataFrame:
    """Full outer join on the key: ``op`` is add, remove, replace or same.

    The compared columns come out twice, prefixed ``old_`` and ``new_``.
    """
    a = old.select(*key, *[F.col(c).alias(f"old_{c}") for c in compare], F.lit(True).alias("_old"))
    b = new.select(*key, *[F.col(c).alias(f"new_{c}") for c in compare], F.lit(True).alias("_new"))
    same = F.lit(True)
    for c in compare:
        same = same & F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    op = (
        F.when(F.col("_old").isNull(), "add")
        .when(F.col("_new").isNull(), "remove")
        .when(same, "same")
        .otherwise("replace")
    )
    return a.join(b, key, "full").withColumn("op", op).drop("_old", "_new")
