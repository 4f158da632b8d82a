"""Zero-based positions in sort order, globally or per group.

``row_number`` over a whole group sorts that group in one task. So the rows are range-partitioned on (group, order), which
cuts a hot group at several points of its order, sorted within their partitions and written together with a number that
rises within a partition. One row per group and partition then tells by how much the numbers of that part are shifted.
The rows are shuffled once, and written because both branches must see the same cuts even if a task is run again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugework.session import materialise


def with_position(df: DataFrame, order: list[Column | str], out: str = "position",
                  group: list[str] | None = None) -> DataFrame:
    """Add ``out``. ``order`` must end in a unique column; rows with a NULL group are dropped."""
    group = group or []
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    for g in group:
        df = df.filter(F.col(g).isNotNull())
    keys = [*[F.col(g) for g in group], *order]
    cut = materialise(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}),
        "positions",
    )
    runs = cut.groupBy(*group, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__from"))
    earlier = W.partitionBy(*group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    shifts = runs.select(
        *group, "__part", (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__from")).alias("__shift"))
    return (
        cut.join(shifts, [*group, "__part"])
        .withColumn(out, (F.col("__at") + F.col("__shift")).cast("long"))
        .select(*df.columns, out)
    )
