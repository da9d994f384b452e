"""Sources: whole files as rows, captured command output, captured engine payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, content), a row a file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("name"), F.col("value").alias("content"))


def table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table.  One that comes in fewer partitions than there are cores (few files of one row group) is dealt
    over them: what follows costs far more than that shuffle, which large tables don't have."""
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores and df.rdd.getNumPartitions() < cores else df


def captured(stdout: Column, stderr: Column, status: Column) -> Column:
    """What a command said: both outputs, or its exit code if it said nothing."""
    both = F.concat_ws("\n", F.nullif(stdout, F.lit("")), F.nullif(stderr, F.lit("")))
    return F.when(F.trim(both) == "", F.concat(F.lit("Command exited with code "), status.cast("string"))).otherwise(both)


def capped(text: Column, most: int, marker: str = "\n... (truncated)") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substr(text, F.lit(1), F.lit(most)), F.lit(marker))).otherwise(text)
