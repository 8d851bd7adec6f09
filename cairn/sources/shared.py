"""The folder that driver and executors share, and tables written to it to cut a lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where that is unset and everything runs on one machine (tests)
    a temporary folder of this run."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return base.rstrip("/") if base else _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="cairn-"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back, so later jobs start from the table."""
    path = f"{shared_folder(df.sparkSession)}/graph-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, keys: list[str], fold: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Written to the shared folder in as many buckets by ``keys`` as a shuffle has partitions: joins on these keys
    shuffle the other side alone. ``fold`` may gather rows of equal keys, where they lie."""
    spark = df.sparkSession
    table, buckets = f"graph_{name}_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    fold(df.repartition(buckets, *keys)).write.bucketBy(buckets, *keys).sortBy(*keys).option("compression", "zstd").option("path", f"{shared_folder(spark)}/{table}").saveAsTable(table)
    return spark.table(table)


def spread(df: DataFrame) -> DataFrame:
    """The frame, dealt out anew if it has fewer partitions than there are cores: a few files hold a small table, and
    one core each would do all the work on it. Larger tables stay where they are. The partitions are counted by
    a pass over no columns but those the frame filters by."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0]
    return df if parts is None or parts + 1 >= cores else df.repartition(cores)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The frame, dealt by ``keys`` to two partitions a core at least: for work on each row that costs more than moving
    it. Neither the number of input files nor their row groups then say how many cores work."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(parts, *keys)
