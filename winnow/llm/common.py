"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from winnow.sources.scratch import new_path

#: One word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and survives the loss of any executor."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*written: DataFrame) -> None:
    """Delete what `materialise` wrote for these frames; nothing may read them, or what was made of them, afterwards."""
    for df in written:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def blocks_for(rows: int, per_block: int) -> int:
    return max(1, -(-int(rows) // per_block))


def running(
    df: DataFrame, keys: list[str], block: Column, order: list[Column], value: Column, out: str
) -> DataFrame:
    """Add `out`, the sum of value over the rows of the same keys up to and including this one, by block and then order.

    No group is gathered in one task: each (keys, block) is summed alone, and the blocks' sums, one row a block, are
    added up before them. `block` must not decrease along the order meant.
    """
    with_block = df.withColumn("_block", block).withColumn("_value", value)
    sums = with_block.groupBy(*keys, "_block").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_block").alias("_b"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"),
    )
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_block") == F.col("_b")]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        with_block.withColumn("_inside", F.sum("_value").over(inside))
        .join(offsets, condition)
        .withColumn(out, F.col("_inside") + F.col("_before"))
        .drop("_block", "_value", "_inside", "_before", "_b", *[f"_k{i}" for i in range(len(keys))])
    )
