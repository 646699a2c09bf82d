"""Ranges of an order: so that numbers and running sums over all rows need no task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of the sample for each range.
_EACH = 16


def with_range(rows: DataFrame, *order: str | Column, name: str = "_p") -> DataFrame:
    """Adds the number of the range that a row lies in; ranges follow the order.

    Bounds are taken from the rows of the smallest hashes, some for each shuffle partition.  They only balance the work, but they
    are constants: wherever the rows are computed again, each falls into the same range.  (Ranges of a range exchange are not:
    they come from a sample that differs between two exchanges of one plan.)
    """
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [(F.col(k) if isinstance(k, str) else k).alias(f"k{i}") for i, k in enumerate(order)]
    own = rows.select(*keys)
    some = own.orderBy(F.xxhash64(*own.columns), *own.columns).limit(_EACH * n).orderBy(*own.columns).collect()
    bounds = [F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, own.schema, strict=True))) for r in some[_EACH - 1 :: _EACH][: n - 1]]
    if not bounds:
        return rows.withColumn(name, F.lit(0))
    return rows.withColumn("_s", F.struct(*keys)).withColumn(name, F.aggregate(F.array(*bounds), F.lit(0), lambda a, b: a + (b < F.col("_s")).cast("int"))).drop("_s")
