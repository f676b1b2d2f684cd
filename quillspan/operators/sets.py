"""Set operations, change detection and incremental work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chapter_fingerprint(sections: DataFrame, version: str, keys: Sequence[str] = ("book_id", "chapter"), order: str = "number", body: str = "body") -> DataFrame:
    """sha1 over version and the chapter's sections in order; equal content gives an equal key."""
    parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, body))), lambda x: F.concat_ws(":", x[order].cast("string"), x[body])), "\n")
    return sections.groupBy(*keys).agg(F.sha1(F.concat(F.lit(version + "\n"), parts).cast("binary")).alias("fingerprint"))


def stale(now: DataFrame, manifest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys and fingerprint the manifest does not hold."""
    return now.join(manifest, [*keys, "fingerprint"], "left_anti")


def section_mismatch(old: DataFrame, new: DataFrame, key: str, path: str) -> DataFrame:
    """Stored against re-parsed sections: missing, added, or with another path."""
    a, b = old.select(key, F.col(path).alias("_old"), F.lit(True).alias("_a")), new.select(key, F.col(path).alias("_new"), F.lit(True).alias("_b"))
    both = a.join(b, key, "full_outer")
    problem = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "added").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return both.select(key, problem.alias("problem")).where("problem is not null")


def changed_sections(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """Sections in both parses whose content differs, and those in one only."""
    return section_mismatch(old, new, key, content).select(key)


def replace_sources(old: DataFrame, new: DataFrame, replaced: DataFrame) -> DataFrame:
    """Sources of the replaced sections go, the new ones come in; no row twice."""
    return old.join(replaced, "section_id", "left_anti").unionByName(new).distinct()


def left_with_sources(concepts: DataFrame, sources: DataFrame) -> DataFrame:
    """Concepts that a source names; each id is sent once by a task, however many sources name it."""
    return concepts.join(sources.select(F.col("concept_id").alias("id")).distinct(), "id", "left_semi")


def conflicts(selected: DataFrame, used: DataFrame, keys: Sequence[str], value: str, n: int = 5) -> DataFrame:
    """Selected values already used, per key: the first ``n`` and how many more."""
    hit = selected.select(*keys, value).distinct().join(used.select(*keys, value), [*keys, value], "left_semi")
    got = hit.groupBy(*keys).agg(F.sort_array(F.collect_set(value)).alias("v"))
    shown = F.array_join(F.transform(F.slice("v", 1, n), lambda x: x.cast("string")), ", ")
    more = F.size("v") - n
    return got.select(*keys, F.when(more > 0, F.concat(shown, F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(shown).alias("conflicts"))


def dedupe_first(df: DataFrame, key: Column, *order: Column) -> DataFrame:
    """The first row of each key, case aside."""
    w = Window.partitionBy(F.lower(key)).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def union_ignore(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of ``first`` and those of ``second`` with new keys."""
    return first.unionByName(second.join(first, list(keys), "left_anti"))


def blob_ids(df: DataFrame, data: str) -> DataFrame:
    """One row per content: the first 16 hex digits of its sha256, and how often it occurs."""
    return df.groupBy(F.substring(F.sha2(F.col(data).cast("binary"), 256), 1, 16).alias("blob_id")).agg(F.count(F.lit(1)).alias("uses"), F.max(F.octet_length(data)).cast("long").alias("n_bytes"))


def unread_blobs(sections: DataFrame, readings: DataFrame) -> DataFrame:
    """Distinct image ids of sections that have no reading."""
    return sections.select(F.explode("images").alias("image_id")).distinct().join(readings, "image_id", "left_anti")


def without_subject(tables: dict[str, DataFrame], subject_id: int) -> dict[str, DataFrame]:
    """What is left of every table when a subject is deleted with all that hangs on it."""
    gone_books = tables["books"].where(F.col("subject_id") == subject_id).select("book_id")
    gone_concepts = tables["concepts"].where(F.col("subject_id") == subject_id).select(F.col("id").alias("concept_id"))
    sections = tables["sections"].join(gone_books, "book_id", "left_anti")
    gone_sections = tables["sections"].join(gone_books, "book_id", "left_semi").select("section_id")
    return {
        "subjects": tables["subjects"].where(F.col("subject_id") != subject_id),
        "books": tables["books"].where(F.col("subject_id") != subject_id),
        "sections": sections,
        "concepts": tables["concepts"].where(F.col("subject_id") != subject_id),
        "sources": tables["sources"].join(gone_concepts, "concept_id", "left_anti").join(gone_sections, "section_id", "left_anti"),
    }
