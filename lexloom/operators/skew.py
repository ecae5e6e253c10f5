"""Equi-joins in which one key may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: A key is heavy if it holds more than one in HEAVY_SHARE of the rows, and more than LEAST_HEAVY. So there are fewer
#: than HEAVY_SHARE heavy keys, whatever the size of the data, and what is broadcast of them has that bound.
HEAVY_SHARE, LEAST_HEAVY = 2000, 1000


def join_by_size(rows: DataFrame, classes: DataFrame, on: list[str], n_rows: Column | str, total: int, how: str = "inner") -> DataFrame:
    """Joins rows (many a key) with classes (few rows a key, its number of rows in n_rows) without sending a heavy key to one task.

    Heavy keys (n_rows > total / HEAVY_SHARE) number fewer than HEAVY_SHARE. They are looked up in classes first, which
    should be cut; where there is none the join is a plain one. Else a heavy key is salted: its rows are spread over as
    many salts as it has shares of that size, by a hash of the whole row, and its class rows are repeated for each salt
    (fewer than 2 * HEAVY_SHARE repetitions in all). So rows, with whatever stages made them, run once and are shuffled
    once. how: inner, or left for rows without a class.
    """
    n = F.col(n_rows) if isinstance(n_rows, str) else n_rows
    limit = max(total // HEAVY_SHARE, LEAST_HEAVY)
    heavy = classes.where(n > limit).select(*on, F.ceil(n / limit).cast("int").alias("_salts")).distinct().collect()
    if not heavy:
        return rows.join(classes, on, how)
    schema = classes.select(*on).schema.add("_salts", IntegerType())
    keys = F.broadcast(rows.sparkSession.createDataFrame(heavy, schema))
    salt = F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("_salts").cast("bigint")), F.lit(0))
    salted = rows.join(keys, on, "left").withColumn("_salt", salt).drop("_salts")
    each = classes.join(keys, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("_salts"), F.lit(1)).cast("bigint") - 1))).drop("_salts")
    return salted.join(each, [*on, "_salt"], how).drop("_salt")
