"""Lineage cuts for operators that loop until nothing changes."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, as in tests, a temporary one is set; not on a cluster, whose executors would each write to their own disk."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        base = "file://" + tempfile.mkdtemp(prefix="quillspan-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


_folders: set[str] = set()


def own_dir(spark: SparkSession) -> str:
    """This application's folder for cut tables; it goes when the application ends."""
    folder = f"{shared_dir(spark)}/quillspan/{spark.sparkContext.applicationId}-tables"
    if folder not in _folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _folders.add(folder)
    return folder


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, by: str) -> DataFrame:
    """With ``n`` from 1 in order of ``by``, whose values are unique: ranges are numbered each on its own, then moved by the rows of the ranges before.

    The ranges are written first, since a second sampling could cut them elsewhere.
    """
    dealt = cut(df.repartitionByRange(by).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))  # a row per partition
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(F.asc_nulls_first(by)))
    return dealt.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part").withColumn("n", (F.col("_before") + own).cast("long")).drop("_part", "_before")
