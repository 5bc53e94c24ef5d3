"""Tables by folder and name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table folder/name.parquet.

    A table in fewer files than there are cores, and in no more splits, may have all its rows in one row group, hence in one
    task; such a small one is dealt out over the cores. Larger tables are read as they lie, without an exchange.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    few = len(df.inputFiles()) < cores and df.rdd.getNumPartitions() <= cores
    return df.repartition(cores) if few else df
