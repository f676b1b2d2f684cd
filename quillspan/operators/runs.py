"""Reports over a parsed book and over a run: what was read, kept, skipped and asked for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SKIPPED_WORDS = 300


def parse_report(sections: DataFrame, skipped: DataFrame, checklist: DataFrame, entries: DataFrame, book: str = "book") -> DataFrame:
    """One row per book: chapters, sections, words, source_words, skipped_words, checklist_items, glossary_entries, index_entries.

    ``sections`` (book, chapter, words, source_words); ``skipped`` (book, words) are parts
    outside the chapters; ``checklist`` has a row per item, ``entries`` a row per entry with
    its ``kind``, glossary or index.
    """
    count = lambda df, name: df.groupBy(book).agg(F.count(F.lit(1)).alias(name))
    own = sections.groupBy(book).agg(F.countDistinct("chapter").alias("chapters"), F.count(F.lit(1)).alias("sections"), F.sum("words").alias("words"), F.sum("source_words").alias("source_words"))
    parts = [
        skipped.groupBy(book).agg(F.sum("words").alias("skipped_words")),
        count(checklist, "checklist_items"),
        entries.groupBy(book).agg(*[F.sum((F.col("kind") == k).cast("long")).alias(f"{k}_entries") for k in ("glossary", "index")]),
    ]
    for part in parts:
        own = own.join(part, book, "left")
    return own.na.fill(0)


def request_plan(groups: DataFrame, cached: DataFrame, images: DataFrame, book: str = "book") -> tuple[DataFrame, DataFrame]:
    """Requests per chapter and per book.

    A chapter costs two requests for each of its ``groups`` (book, chapter, groups), none of
    these if it is ``cached``, one for the merge, and one for each of its unread ``images``
    (book, chapter, image). The book's total counts an image of several chapters once.
    """
    keys = [book, "chapter"]
    known = cached.select(*keys).distinct().withColumn("cached", F.lit(True))
    per = images.groupBy(*keys).agg(F.countDistinct("image").alias("images"))
    chapters = groups.join(known, keys, "left").join(per, keys, "left").na.fill(0, ["images"]).na.fill(False, ["cached"])
    base = F.when(F.col("cached"), 0).otherwise(2 * F.col("groups")) + 1
    chapters = chapters.select(*keys, "cached", "images", (base + F.col("images")).cast("long").alias("requests"))
    once = images.groupBy(book).agg(F.countDistinct("image").alias("images"))
    total = chapters.groupBy(book).agg(F.sum(F.col("requests") - F.col("images")).alias("_base")).join(once, book, "left").na.fill(0, ["images"])
    return chapters, total.select(book, "images", (F.col("_base") + F.col("images")).alias("requests"))


def chapter_report(sections: DataFrame, facts: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """One row per chapter: its sections and, for each of ``facts``, how many rows that table has for it.

    The facts of a run are concepts, added, joined, empty, missing, minor, quote_warnings and skipped_items.
    """
    keys = list(keys)
    out = sections.groupBy(*keys).agg(F.count(F.lit(1)).alias("sections"))
    for name, rows in facts.items():
        out = out.join(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)), keys, "left")
    return out.na.fill(0, list(facts))


def fetch_report(pages: DataFrame, images: DataFrame, skipped: DataFrame, key: str) -> DataFrame:
    """Per group: pages kept, their words, distinct images, and the skipped pages as (url, reason) in the order of their addresses.

    A crawl skips few pages of a site; the list is the report itself.
    """
    kept = pages.groupBy(key).agg(F.count(F.lit(1)).alias("pages"), F.sum("words").alias("words"))
    pictures = images.groupBy(key).agg(F.countDistinct("image").alias("images"))
    left = skipped.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("url", "reason"))).alias("skipped"))
    out = kept.join(pictures, key, "full_outer").join(left, key, "full_outer").na.fill(0, ["pages", "words", "images"])
    return out.withColumn("skipped", F.coalesce("skipped", F.expr("cast(array() as array<struct<url: string, reason: string>>)")))


def book_warnings(parts: DataFrame, files: DataFrame, unassigned: DataFrame, images: DataFrame, book: str = "book") -> DataFrame:
    """(book, code, about, n): what a book's parse left out.

    skipped_text: a part outside the chapters (book, title, kind, words) of 300 words or more,
    glossaries and indexes aside; not_in_toc: a file inside a chapter that no entry names
    (book, file, words); unassigned_terms and unread_images: how many of ``unassigned``
    (book, term) and of the distinct ``images`` without a text (book, image) there are.
    """
    row = lambda df, code, about, n: df.select(book, F.lit(code).alias("code"), about.alias("about"), n.cast("long").alias("n"))
    long_ = parts.where((F.col("words") >= SKIPPED_WORDS) & ~F.col("kind").isin("glossary", "index", "chapter", "appendix"))
    none = F.lit(None).cast("string")
    found = [
        row(long_, "skipped_text", F.col("title"), F.col("words")),
        row(files, "not_in_toc", F.col("file"), F.col("words")),
        row(unassigned.groupBy(book).agg(F.count(F.lit(1)).alias("_n")), "unassigned_terms", none, F.col("_n")),
        row(images.groupBy(book).agg(F.countDistinct("image").alias("_n")), "unread_images", none, F.col("_n")),
    ]
    out = found[0]
    for one in found[1:]:
        out = out.unionAll(one)
    return out
