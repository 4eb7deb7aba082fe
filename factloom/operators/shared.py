"""Tables that several branches of a plan read: written once to the checkpoint folder, so they are not computed again.

They grow with the input, and files of few columns are a small part of the rows they hold, so Spark would take them for
small and send them whole through the driver. The hint ``merge`` has them joined by a shuffle; a table that is small by its
nature is broadcast where it is used.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only where that is unset and all runs on one machine."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The table read back from the shared folder, to be joined by a shuffle."""
    shared_folder(df.sparkSession)
    return df.checkpoint().hint("merge")


def written(df: DataFrame, **measures) -> tuple[DataFrame, dict]:
    """The table written to the shared folder in one job, and its number of rows ``n`` and other aggregates, observed as it was written; to be joined by a shuffle."""
    spark, seen = df.sparkSession, Observation()
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in measures.items()]).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path).hint("merge"), seen.get
