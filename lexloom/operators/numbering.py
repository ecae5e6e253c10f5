"""Dense numbers over a total order, without a window over all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.session import cut


def number_rows(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df plus name, 0 .. n - 1 in the order of the columns (which must tell the rows apart).

    Rows are spread by range, numbered within their partition and shifted by the rows before it; only one count for
    each partition is broadcast.
    """
    spread = cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    before = F.broadcast(spread.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(W.orderBy("_p")) - F.col("_n")).select("_p", "_before"))
    local = spread.withColumn("_r", F.row_number().over(W.partitionBy("_p").orderBy(*order)) - 1)
    return local.join(before, "_p").withColumn(name, F.col("_r") + F.col("_before")).drop("_p", "_r", "_before")


def running_sums(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """df plus, for every name: column of sums, the column's total up to and with the row, in the order of the columns
    (which must tell the rows apart). Distributed as number_rows is."""
    spread = cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    totals = spread.groupBy("_p").agg(*(F.sum(c).alias(f"_t_{n}") for n, c in sums.items()))
    by_part = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    before = F.broadcast(totals.select("_p", *(F.coalesce(F.sum(f"_t_{n}").over(by_part), F.lit(0)).alias(f"_b_{n}") for n in sums)))
    within = W.partitionBy("_p").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = spread.select("*", *(F.sum(c).over(within).alias(f"_l_{n}") for n, c in sums.items())).join(before, "_p")
    return local.select(*df.columns, *((F.col(f"_l_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums))
