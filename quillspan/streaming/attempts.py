"""Attempt logs and section files as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quillspan.operators.sets import stale


def latest_attempt_stream(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Streaming form of the latest attempt per question, with its correctness; update mode.

    Taking the highest id commutes and repeats without effect, so replayed or late attempts
    change nothing: no watermark is needed and the state is one row per question.
    """
    last = F.max_by(F.struct("id", "score", "disputed"), "id")
    got = attempts.groupBy(*keys).agg(last.alias("a"))
    return got.select(*keys, F.col("a.id").alias("id"), F.col("a.score").alias("score"), ((F.col("a.score") == 2) | F.col("a.disputed")).alias("correct"))


def _with(schema: StructType, *names: str) -> StructType:
    return StructType([*schema.fields, *(StructField(n, LongType()) for n in names)])


def _last(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Of a question's rows that of the last epoch."""
    rest = [c for c in parts.columns if c not in (*keys, "epoch")]
    return parts.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("a")).select(*keys, *[F.col(f"a.{c}").alias(c) for c in rest])


def run_latest_attempts(spark: SparkSession, source: str, schema: StructType | str, keys: list[str], table: str, checkpoint: str, prepare=lambda df: df, files_per_trigger: int = 1, most_parts: int = 16) -> DataFrame:
    """Drain a folder of attempt files through the stream; the current row of every question.

    Each batch's updated rows are one part of the table, by epoch; of a question's rows the
    one of the last epoch counts. After ``most_parts`` epochs a new generation begins with
    one part that sums up the one before, which stays for readers until the next but one begins,
    so there are never more than about three times as many parts. A batch that is delivered again
    replaces its own parts, and a restart without new files changes nothing.
    """
    stream = prepare(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source))
    rows = latest_attempt_stream(stream, keys)
    held = rows.schema

    def add(batch: DataFrame, epoch: int) -> None:
        session, generation = batch.sparkSession, epoch // most_parts
        if generation and epoch % most_parts == 0:
            before = session.read.schema(_with(held, "epoch")).parquet(f"{table}/generation={generation - 1}")
            _last(before, keys).select(*held.names).write.mode("overwrite").parquet(f"{table}/generation={generation}/epoch={epoch - 1}")
            if generation > 1:  # one empty part instead of all of them
                batch.limit(0).withColumn("epoch", F.lit(0)).coalesce(1).write.mode("overwrite").partitionBy("epoch").parquet(f"{table}/generation={generation - 2}")
        batch.write.mode("overwrite").parquet(f"{table}/generation={generation}/epoch={epoch}")

    q = rows.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(add).trigger(availableNow=True).start()
    q.awaitTermination()
    parts = spark.read.schema(_with(held, "generation", "epoch")).parquet(table)
    now = parts.agg(F.max("generation")).first()[0]
    return _last(parts.where(F.col("generation") == now).drop("generation"), keys).select(*held.names)


def ingest_chapters(spark: SparkSession, source: str, schema: StructType | str, fingerprint, keys: list[str], manifest: str, work: str, checkpoint: str, files_per_trigger: int | None = 1) -> int:
    """Process only chapters whose content is new: each batch is fingerprinted and anti-joined to a manifest of content keys.

    Delivered again or late, a chapter with the same content is a no-op. A batch is one part
    of ``work`` and then one of ``manifest``, both by epoch and replaced when it is delivered
    again; it is compared with the epochs before it only. So a failure at any point leaves
    either no manifest part, and the work is done again into the same place, or both. Work counts once the
    manifest lists it: read it with :func:`ingested`. Both tables belong to one checkpoint.
    ``files_per_trigger`` None makes one batch of all new files, so its tasks and not the batches grow with
    them: for a delivery of many files that holds each chapter once and is ingested before the next one comes.
    Returns the number of chapters worked on.
    """
    done: dict[int, int] = {}
    reader = spark.readStream.schema(schema)
    stream = (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(source)
    shape = fingerprint(spark.createDataFrame([], stream.schema)).schema
    spark.createDataFrame([], shape).write.mode("ignore").parquet(f"{manifest}/epoch=-1")  # there is always one to read

    def step(batch: DataFrame, epoch: int) -> None:
        known = batch.sparkSession.read.schema(_with(shape, "epoch")).parquet(manifest).where(F.col("epoch") < epoch)
        todo = stale(fingerprint(batch), known, keys).select(*shape.names).persist()
        todo.write.mode("overwrite").parquet(f"{work}/epoch={epoch}")
        todo.write.mode("overwrite").parquet(f"{manifest}/epoch={epoch}")
        done[epoch] = todo.count()
        todo.unpersist()

    q = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step).trigger(availableNow=True).start()
    q.awaitTermination()
    return sum(done.values())


def ingested(spark: SparkSession, schema: StructType, keys: list[str], manifest: str, work: str) -> DataFrame:
    """Rows of ``work`` that the manifest lists for the same epoch."""
    listed = spark.read.schema(_with(schema, "epoch")).parquet(manifest).select(*keys, "epoch").distinct()
    return spark.read.schema(_with(schema, "epoch")).parquet(work).join(listed, [*keys, "epoch"], "left_semi").select(*schema.names)
