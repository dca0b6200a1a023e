"""What a Spark session needs to run this package."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Make the package importable in the Python workers of the session, wherever they run; done once a session."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        here = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(), "foliant.zip")  # on the driver only; Spark serves it to the executors
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, files in os.walk(here):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(folder, f)
                        z.write(full, os.path.join("foliant", os.path.relpath(full, here)))
        sc.addPyFile(path)
        _shipped.add(sc.applicationId)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Where it names none, one beside the warehouse, if that is no folder of one machine, and under a local master a
    temporary one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        return tempfile.mkdtemp()
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if warehouse.startswith(("file:", "/")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return warehouse + "/_work"


def written(df: DataFrame) -> DataFrame:
    """df written once as a table in the shared folder and read back, so that several uses do not compute it again.

    The job runs when this is called; the table is deleted when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)
