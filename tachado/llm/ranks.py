"""Places and running totals inside groups of any size, by ranges of a total order instead of one task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tachado.llm.tables import written


def ranked(df: DataFrame, group: str, order: list[str], size: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``idx``, a row's place in its group from 0, and with ``size`` also ``before``, the sum over earlier rows.

    The second table has one row per group: the group, ``n`` rows and with ``size`` their ``total``.  ``order`` sorts
    ascending, nulls first; rows equal in it take their places in the order of the input.  Rows are sorted in ranges that
    a group may span, each range is counted by itself, and the counts, one row per range and group, are summed across.
    ``group`` must not be null; names that begin with ``_`` are taken.
    """
    keys = [group, *order, "_tie"]
    rows = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    # The number of a row counts on inside a partition, and its upper half is the partition: kept with the rows, so fixed.
    rows = written(rows.withColumn("_at", F.monotonically_increasing_id()), "sorted")
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    totals = [F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"), *([F.sum(size).alias("_sum")] if size else [])]
    parts = written(rows.groupBy(group, "_part").agg(*totals), "parts")
    across = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = [F.coalesce(F.sum(c).over(across), F.lit(0)).alias(f"_base{c}") for c in ("_n", "_sum")[:1 + bool(size)]]
    if size:
        inside = Window.partitionBy(group, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("_near", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    placed = rows.join(written(parts.select(group, "_part", "_first", *bases), "bases"), [group, "_part"])
    placed = placed.withColumn("idx", F.col("_at") - F.col("_first") + F.col("_base_n"))
    if size:
        placed = placed.withColumn("before", F.col("_near") + F.col("_base_sum"))
    groups = parts.groupBy(group).agg(F.sum("_n").alias("n"), *([F.sum("_sum").alias("total")] if size else []))
    return placed.select(*df.columns, "idx", *(["before"] if size else [])), groups
