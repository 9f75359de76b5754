"""Tables in the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """spark.checkpoint.dir where the cluster names one; else a temporary folder in local mode, the warehouse otherwise."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    root = root or _own.get(spark.sparkContext.applicationId)
    if not root:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            root = "file://" + tempfile.mkdtemp(prefix="knotwork-")
        else:
            root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
            if root.startswith(("file:", "/")):
                raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
        root = _own.setdefault(spark.sparkContext.applicationId, root)
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, written to a table in the shared folder and read back."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/k-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """cut(), and the number of rows, counted while they are written."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, int(seen.get["n"])


def remove(*tables: DataFrame | None) -> None:
    for t in tables:
        if t is not None and getattr(t, "_scratch", None):
            path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._scratch)
            path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
