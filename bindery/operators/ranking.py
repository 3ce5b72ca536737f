"""Row numbers and pages over groups that may be too large for one task."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage


def number_rows(df: DataFrame, group: list[str], order: list[str], name: str = "n") -> DataFrame:
    """1-based row number inside each group, in `order` (ascending columns).

    Rows are range-partitioned over group and order, numbered inside each range
    and shifted by the sizes of the ranges before it, so one huge group is
    spread over all tasks.  The ranged rows are staged: the ranges must be the
    same ones for the rows and for their sizes."""
    ranged = df.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id())
    inner = Window.partitionBy("_range", *group).orderBy(*order)
    ranged = stage(ranged.withColumn("_local", F.row_number().over(inner)), "numbered")
    sizes = ranged.groupBy(*group, "_range").agg(F.max("_local").alias("_size"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*group, "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    return (ranged.join(shifts, [*group, "_range"])
            .withColumn(name, F.col("_shift") + F.col("_local")).drop("_range", "_local", "_shift"))


def page(df: DataFrame, order: list, page: int = 1, size: int = 50) -> DataFrame:
    """One page of an ordered list, with total, page, size and pages columns.

    Page and size are clamped (size to 1 at least, page to the last page)."""
    total = df.count()
    size = max(1, size)
    pages = max(1, -(-total // size))
    page = min(max(1, page), pages)
    rows = df.orderBy(*order).offset((page - 1) * size).limit(size)
    return rows.withColumns({k: F.lit(v).cast("bigint") for k, v in
                             {"total": total, "page": page, "size": size, "pages": pages}.items()})
