"""Running sums in a global order, over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.session import materialize

#: Rows that one task sums in order, about.
RANGE_ROWS = 500_000


def running_sums(rows: DataFrame, order: list[Column], sums: dict[str, str], range_rows: int | None = None) -> DataFrame:
    """rows with the sums, under their names, of columns over all rows up to each one in the order, which has no ties.

    Rows are dealt by ranges of the order, each range is summed by itself, and the totals of all ranges before are added:
    a row a range comes to the driver. Without rows to speak of there is one range."""
    rows = materialize(rows, "unsummed")
    parts = max(1, -(-rows.count() // (range_rows or RANGE_ROWS)))
    dealt = materialize(rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_range").agg(*[F.sum(c).alias(n) for n, c in sums.items()]).orderBy("_range").collect()
    before, at = [], dict.fromkeys(sums)
    for r in totals:
        before.append((r["_range"], *at.values()))
        at = {n: (at[n] or 0) + (r[n] or 0) for n in sums}
    kinds = dealt.select(*[F.sum(c).alias(n) for n, c in sums.items()]).dtypes
    offsets = rows.sparkSession.createDataFrame(before, "_range int, " + ", ".join(f"_before_{n} {k}" for n, k in kinds))
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = dealt.join(F.broadcast(offsets), "_range")  # a row a range
    added = {n: F.coalesce(F.sum(c).over(within), F.lit(0)) + F.coalesce(F.col(f"_before_{n}"), F.lit(0)) for n, c in sums.items()}
    return joined.select(*rows.columns, *[c.alias(n) for n, c in added.items()])
