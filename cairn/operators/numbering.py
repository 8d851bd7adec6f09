"""Places of rows within groups, whatever a group's share of the rows: a range partition and offsets of partition
counts instead of a window over a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored


def numbered(rows: DataFrame, group: list[str], order: list[Column], keep: list[str], name: str = "index", spread: list[Column] | None = None) -> DataFrame:
    """(group, keep, ``name``): each row's place from 0 within its group, in the order of ``order``.

    Rows are range partitioned by group and ``spread`` (a shorter key that sorts as ``order`` does; by default
    ``order`` itself), so a large group lies in many partitions, one after another. A place is the place in the
    partition's part of the group plus what earlier partitions hold of it. Rows equal in ``order`` get places of
    their own in no set order. A null group is a group."""
    by = [F.col(g) for g in group]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *by, *(order if spread is None else spread)).sortWithinPartitions(*by, *order)
    at = F.monotonically_increasing_id()
    placed = stored(placed.select(*by, *keep, at.alias("_at")).withColumn("_part", F.shiftright("_at", 33).cast("int")), "placed")

    held = placed.groupBy("_part", *group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    lists = held.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("_part", "_first", "_n"))).alias("_p"))
    earlier = lambda i: F.aggregate(F.slice("_p", 1, i), F.lit(0).cast("long"), lambda a, x: a + x["_n"])
    moved = F.explode(F.transform("_p", lambda x, i: F.struct(x["_part"].alias("_part"), (earlier(i) - x["_first"]).alias("_add"))))
    offsets = lists.select(*(F.col(g).alias(f"_{g}") for g in group), moved.alias("_m")).select("*", F.col("_m._part").alias("_in"), F.col("_m._add").alias("_add")).drop("_m")
    on = F.col("_part") == F.col("_in")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return placed.join(offsets, on).select(*by, *keep, (F.col("_at") + F.col("_add")).alias(name))
