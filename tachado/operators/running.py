"""Running totals that do not depend on one task per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def total_before(df: DataFrame, keys: list[str], order: str, value: Column, name: str, width: int = 4096) -> DataFrame:
    """``df`` with the sum of ``value`` over the earlier rows of its key.

    A plain window would pull a hot key's every row into one task.  Here a key is
    cut by ``order`` (a whole number) into stretches of ``width``: each stretch is
    summed on its own, the stretch totals (1/width of the rows) are summed across,
    and both parts are added.
    """
    cut = df.withColumn("_v", value).withColumn("_part", F.floor(F.col(order) / width))
    inside = Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = (cut.groupBy(*keys, "_part").agg(F.sum("_v").alias("_t"))
              .select(*keys, "_part", F.coalesce(F.sum("_t").over(across), F.lit(0)).alias("_base")))
    near = cut.withColumn("_near", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    return (near.join(totals, [*keys, "_part"])
            .withColumn(name, F.col("_base") + F.col("_near")).drop("_v", "_part", "_near", "_base"))
