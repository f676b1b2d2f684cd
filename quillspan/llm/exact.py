"""Exact deduplication through a log-structured merge index (operator 10).

A batch of documents is the memtable: it is flushed as a *run*, a table of
(digest, smallest id, largest id, count) sorted by digest within its files, with a bit
filter over the first bits of its digests. Runs of one level are compacted into one of the
next: equal digests are merged, the smallest identifiers (and the largest and the counts,
which merge alike) are kept, and so are all bits. Before a memtable is flushed its digests
are looked up: the filters of the runs leave out those that are surely new, the others
meet the runs in a join. Hits, among the runs or inside a memtable, are compared byte for
byte before they count as equal.

DataFrame operations only.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import BROADCAST_ROWS, join_split, shared_dir, stage

RUN = "digest binary, min_id long, max_id long, n long"
#: A filter has 2**FILTER_BITS bits in 64-bit words (262,144 rows at most); a run of very many digests fills it, and then all digests are looked up.
FILTER_BITS = 24


def _bit(digest: Column) -> Column:
    """Number of the filter's bit: the digest's first bits."""
    return F.shiftright(F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("long"), 32 - FILTER_BITS)


@dataclass
class MergeIndex:
    """Sorted runs by level, each with its filter. ``fanout`` runs of a level are compacted into one of the next."""

    spark: SparkSession
    fanout: int = 4
    levels: dict[int, list[str]] = field(default_factory=dict)
    home: str = ""

    def __post_init__(self) -> None:
        self.home = self.home or f"{shared_dir(self.spark)}/lsm-{uuid.uuid4().hex}"

    def _write(self, run: DataFrame, level: int) -> None:
        path = f"{self.home}/{level}-{uuid.uuid4().hex}"
        run.sortWithinPartitions("digest").write.option("compression", "zstd").parquet(f"{path}/run")
        bits = self._read([path]).select(_bit(F.col("digest")).alias("bit"))
        bits = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
        bits.write.parquet(f"{path}/filter")
        self.levels.setdefault(level, []).append(path)
        if len(self.levels[level]) >= self.fanout:
            self.compact(level)

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(*[f"{p}/run" for p in paths]) if paths else self.spark.createDataFrame([], RUN)

    def _every(self) -> list[str]:
        return [p for ps in self.levels.values() for p in ps]

    def flush(self, digests: DataFrame) -> None:
        """Add a batch with columns digest and id as a sorted run; repeated digests are combined before the shuffle."""
        run = digests.groupBy("digest").agg(F.min("id").alias("min_id"), F.max("id").alias("max_id"), F.count(F.lit(1)).alias("n"))
        self._write(run, 0)

    def compact(self, level: int) -> None:
        """Merge the runs of ``level`` into one run of the next level."""
        paths = self.levels.pop(level, [])
        if paths:
            self._write(self.merged(paths), level + 1)

    def merged(self, paths: list[str] | None = None) -> DataFrame:
        """One row per digest over the given runs, or over all."""
        paths = self._every() if paths is None else paths
        runs = self._read(paths)
        if len(paths) == 1:
            return runs  # a single run has one row per digest already
        return runs.groupBy("digest").agg(F.min("min_id").alias("min_id"), F.max("max_id").alias("max_id"), F.sum("n").alias("n"))

    def may_hold(self, digests: DataFrame) -> DataFrame:
        """Rows of ``digests`` that the filters do not exclude."""
        filters = self.spark.read.schema("word long, bits long").parquet(*[f"{p}/filter" for p in self._every()])
        held = F.broadcast(filters.groupBy("word").agg(F.bit_or("bits").alias("bits")))  # 2**(FILTER_BITS - 6) rows at most
        bit = _bit(F.col("digest"))
        seen = digests.withColumns({"word": F.shiftright(bit, 6), "bit": bit}).join(held, "word").where(F.expr("shiftright(bits, cast(bit & 63 as int)) & 1") == 1)
        return seen.select(*digests.columns)

    def lookup(self, digests: DataFrame) -> DataFrame:
        """Rows of ``digests`` that the index holds."""
        if not self.levels:
            return digests.join(self.merged(), "digest")
        return self.may_hold(digests).join(self.merged(), "digest")


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", batches: int = 2) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their UTF-8 bytes are; null counts as empty, so nulls and empty
    texts form one class. ``keep`` is ``"max"`` or ``"min"``: which id of a class stays.
    Rows that repeat an id with an equal text each count in group_size and are all kept if
    theirs is the id that stays. A null id never stays unless its class has no other
    (then keep_id is null and kept is true). An empty table gives an empty result; other
    columns are not read. ``batches`` is the number of memtables the input is dealt into.

    Equal digests are merged with map-side combining, so a class that holds a third of all
    rows costs one row per task. Byte verification compares, per digest with several
    documents, the smallest with the largest text (again combined before the shuffle); a
    digest whose texts differ is split by the text itself.
    """
    if keep not in ("max", "min"):
        raise ValueError("keep is 'max' or 'min'")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    digests = stage(rows.select("id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")), "digests-by-id")
    index = MergeIndex(docs.sparkSession, fanout=max(2, batches))
    found = []
    for k in range(batches):
        memtable = digests.where(F.pmod(F.coalesce(F.xxhash64("id"), F.lit(0)), F.lit(batches)) == k)
        if k:
            found.append(stage(index.lookup(memtable.select("digest").distinct()).select("digest"), "hits"))
        repeated = memtable.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
        found.append(stage(repeated, "hits"))
        index.flush(memtable)
    classes = stage(index.merged(), "digests")
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionAll(more)
    hits = stage(hits.distinct(), "all-hits")
    if hits.count() <= BROADCAST_ROWS:
        hits = F.broadcast(hits)
    with_text = rows.select("id", "text", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    texts = with_text.join(hits, "digest", "left_semi")
    clash = stage(texts.groupBy("digest").agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a <> b").select("digest"), "clashes")

    kept_id = F.col("max_id" if keep == "max" else "min_id")
    result = ["id", kept_id.alias("keep_id"), F.col("n").alias("group_size"), "digest"]
    every = join_split(digests, classes, ["digest"], "n")
    if clash.isEmpty():
        every = every.select(*result)
    else:
        clash_rows = with_text.join(clash, "digest", "left_semi")
        split = clash_rows.groupBy("digest", "text").agg(F.min("id").alias("min_id"), F.max("id").alias("max_id"), F.count(F.lit(1)).alias("n"))
        every = every.join(clash, "digest", "left_anti").select(*result).unionByName(clash_rows.join(split, ["digest", "text"]).select(*result))
    return every.select(
        F.col("id").alias(id_col), "keep_id", F.col("group_size").cast("long"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )
