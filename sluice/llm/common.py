"""Helpers shared by the operators: table access, shared-folder checkpoints, word splitting."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes between words: space, and tab to carriage return.
SPACES = " \t\n\x0b\f\r"
SPACE_RE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: what the session names in ``spark.checkpoint.dir``.

    Only on one machine (master ``local``) may that be unset: a temporary
    folder is made then.  On a cluster it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        sc = spark.sparkContext
        named = sc.getCheckpointDir()
        if not named:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="sluice-"))
            named = sc.getCheckpointDir()
    return named.rstrip("/")


_FOLDERS: set[str] = set()


def _remove(spark: SparkSession, folder: str) -> None:
    """At the driver's end: the folder of its intermediate tables goes, if the session is still there to do it."""
    with contextlib.suppress(Exception):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(spark: SparkSession, df: DataFrame, label: str, small: bool = False) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back.

    The files are whole and replicated by the shared store, so a lost executor
    costs nothing that was written.  The driver's folder is removed when it ends.

    small: few rows come from many tasks, and are dealt into as few files as
    their size asks for.  In a file:// folder each file makes an executor start
    two processes (chmod, for it and its checksums), which count with the JVM's
    whole memory until they have begun.
    """
    folder = f"{shared_dir(spark)}/sluice-{os.getpid()}-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_remove, spark, folder)
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    (df.hint("rebalance") if small else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, everything else as it is."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The runs of characters other than space and tab..CR, as an array; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RE), lambda w: w != "")


def learned_fold(doc_id: Column) -> Column:
    """True where labels may be learned: crc32 of the id's decimal text, mod 4, is not 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(0)) != 2


LOW = -(1 << 63)
#: Ids up to which they are broadcast (about 16 MB); more are joined by shuffle.
BROADCAST_IDS = 500_000


def without(docs: DataFrame, id_col: str, dropped: DataFrame) -> DataFrame:
    """The rows of docs whose id is not in the one column of dropped; a null id is an id."""
    gone = dropped.toDF("gone").select(F.coalesce(F.col("gone").cast("long"), F.lit(LOW)).alias("gone"))
    side = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone.hint("shuffle_hash")
    return docs.join(side, F.coalesce(docs[id_col].cast("long"), F.lit(LOW)) == F.col("gone"), "left_anti")


_MODEL: dict = {}


def model(key=None, make=None):
    """What a Python worker keeps between tasks: one model with its caches, that of the last key; without a key, nothing."""
    if key not in _MODEL:
        _MODEL.clear()
        if make is not None:
            _MODEL[key] = make()
    return _MODEL.get(key)
