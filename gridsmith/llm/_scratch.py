"""Written tables in the cluster's shared folder: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir; where that is unset, a temporary folder if the master is local, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
        base = _OWN[app]
    return f"{base.rstrip('/')}/gridsmith-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again."""
    path = path or scratch_dir(df.sparkSession)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes what written() wrote for df, once nothing reads it any more."""
    spark, path = df.sparkSession, df._scratch_path
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
