"""Where intermediate tables go: the shared checkpoint folder of the session."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which every executor can reach.

    Only a local master may do without the setting; it gets a fresh folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="ledgernet-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage that is no longer read."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise in reliable storage; later plans start from the stored rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def few_rows(df: DataFrame) -> DataFrame:
    """A table of a handful of rows, a top-k list or what hangs on one, as a local relation.

    Plans that use it several times then neither recompute nor shuffle it.
    """
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def concurrently(*steps: Callable[[], Any]) -> list:
    """Results of steps that do not need each other; their jobs share the cluster."""
    with ThreadPoolExecutor(len(steps)) as pool:
        inherit = inheritable_thread_target(SparkSession.active())
        running = [pool.submit(inherit(step)) for step in steps]
        return [step.result() for step in running]


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write as Parquet in the shared folder and read back: column pruning stays possible."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
