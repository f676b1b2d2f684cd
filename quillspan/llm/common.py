"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.sources.tables import spread

_shipped: set[str] = set()
_folders: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that their Python workers can import it."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent.parent
        archive = Path(tempfile.mkdtemp(prefix="quillspan-")) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for source in sorted(package.rglob("*.py")):
                z.write(source, source.relative_to(package.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; the path may be one that only Spark can open."""
    ship(spark)
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in ("documents", "pages") else rows


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below the one that the cluster shares; it goes when the application ends.

    Where no shared folder is set, as in tests, a temporary one is set; not on a cluster,
    whose executors would each write to their own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not base:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        base = "file://" + tempfile.mkdtemp(prefix="quillspan-")
        spark.conf.set("spark.checkpoint.dir", base)
    folder = f"{base}/quillspan/{context.applicationId}"
    if folder not in _folders:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _folders.add(folder)
    return folder


def stage(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage, so that what follows neither recomputes ``df`` nor depends on
    executors that may be lost. The schema is given on reading, so that no job infers it.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if (staged := _staged.get()) is not None:
        staged.append(path)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_staged: ContextVar[list[str] | None] = ContextVar("staged", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables that are staged inside go at its end, so that the disk does not hold them until the application ends.

    Yields a :func:`stage` for the result, whose table stays; nothing lazy that reads the others may leave.
    """
    outer, paths = _staged.get(), []
    token = _staged.set(paths)

    def keep(df: DataFrame, tag: str) -> DataFrame:
        inner = _staged.set(outer)
        try:
            return stage(df, tag)
        finally:
            _staged.reset(inner)

    try:
        yield keep
    finally:
        _staged.reset(token)
        for name in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of texts in a batch that goes to a Python worker. A task holds a batch several times: where the JVM writes it and reads the answer, in the worker as it came, as objects, and as what is made of them.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on the session sends batches of BATCH_BYTES and one row at most to Python workers, unless smaller ones are set; however long the texts are, rows by the number do not bound them.

    A setting of the session, as it holds when a plan runs, after the operator has returned it.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


#: A key with more rows than this is joined by broadcast, so that its rows stay where they are; of N rows, N / HOT_ROWS keys at most are that frequent.
HOT_ROWS = 100_000
#: Up to so many narrow rows are sent to every executor.
BROADCAST_ROWS = 1 << 18


def join_split(rows: DataFrame, table: DataFrame, keys: list[str], times: str) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has each key once and in ``times`` how many rows have it.

    Frequent keys go to all executors, the others through a shuffle, in which no key then
    has more than ``HOT_ROWS`` rows.
    """
    hot = table.where(F.col(times) > HOT_ROWS)
    n = hot.count()
    if not n or n > BROADCAST_ROWS:
        return rows.join(table, keys)
    there = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(table.where(F.col(times) <= HOT_ROWS), keys)
    return there.unionByName(rest)


def ranked(rows: DataFrame, group: list[str], order: list[str], tag: str = "ranked") -> DataFrame:
    """``rows`` with ``rank``, the place from 0 of each row in its group by ``order``, and ``n``, the group's size.

    Group columns must not be null. No task gets a whole group: rows are dealt by ranges of
    group and order and written with their places within the parts; a group's places go on
    from one part to the next by the parts' counts, of which there are at most as many as
    parts and groups together. Rows equal in both keep the order in which they were read.
    """
    keys = [*group, *order, "_read"]
    parts = rows.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    parts = stage(parts.withColumn("_at", F.monotonically_increasing_id()).drop("_read"), tag)
    part = F.shiftright("_at", 33).alias("_part")  # the id's upper bits
    held = parts.groupBy(*group, part).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    every = Window.partitionBy(*group)
    before = F.coalesce(F.sum("_n").over(every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.withColumns({"_before": before, "n": F.sum("_n").over(every)}).drop("_n")
    rank = (F.col("_at") - F.col("_first") + F.col("_before")).alias("rank")
    return parts.withColumn("_part", part).join(held, [*group, "_part"]).select(*rows.columns, rank, "n")


def fold(doc_id: Column | str, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``: the same rows on any engine."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % of


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)
