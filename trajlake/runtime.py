"""Session helpers shared by all operators: table access, shared checkpoints, written intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per session, for a driver that has it on its own path only."""
    sc = spark.sparkContext
    if not getattr(sc, "_trajlake_shipped", False):
        here = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="trajlake-code-")  # on the driver, whose file server sends it to the executors
        atexit.register(shutil.rmtree, folder, True)
        sc.addPyFile(shutil.make_archive(f"{folder}/trajlake", "zip", here.parent, here.name))
        sc._trajlake_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; only a local session may fall back to its own, gone when it ends."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared:
            sc.setCheckpointDir(shared)
        elif sc.master.startswith("local"):
            own = tempfile.mkdtemp(prefix="trajlake-checkpoint-")
            sc.setCheckpointDir(own)
            _drop_at_end(spark, own)
        else:
            raise ValueError("spark.checkpoint.dir is not set; a cluster needs a shared checkpoint folder")
    return sc.getCheckpointDir()


def _drop_at_end(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut at a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a parquet table in the shared folder, read back: lineage is cut as by a checkpoint, columns can be pruned,
    and the planner knows the table's true size, so that it broadcasts only what is small. Gone when the session ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    _drop_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)
