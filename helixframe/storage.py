"""Where intermediate tables are written: the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where that is unset, a temporary folder in local mode, and an error on a cluster."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        set_dir = sc._jsc.sc().getCheckpointDir()
        named = set_dir.get() if set_dir.isDefined() else None
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        named = _local.setdefault(sc.applicationId, "") or tempfile.mkdtemp(prefix="checkpoints-")
        _local[sc.applicationId] = named
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again.

    What follows survives lost executors, has no lineage before this, and knows the table's true size (a checkpointed plan
    would keep an estimate, which grows by the product of sizes with every join of a loop).  What earlier writes shuffled is of no
    use any more; executors delete it once the driver has collected its garbage, which a driver with room to spare does too late.
    """
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    df.sparkSession._jvm.System.gc()
    done = df.sparkSession.read.schema(df.schema).parquet(path)
    done._cut_path = path
    return done


def forget(*tables: DataFrame) -> None:
    """Deletes the files of tables that cut() wrote and nothing reads any more."""
    for df in tables:
        path = getattr(df, "_cut_path", None)
        if path:
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
