"""Predicates, joins, rollups and windows over subjects, books, sections and concepts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.plans.adapters import STATUSES

#: Status classes of the board.
CLASSES = {
    "learned": ("known", "mastered"),
    "learning": ("learning",),
    "queued": ("queued",),
    "not-chosen": ("new", "to_test", "failed"),
    "skipped": ("skipped",),
}
DONE = CLASSES["learned"]


def has_all_words(columns: Sequence[str], find: str) -> Column:
    """Every word of ``find`` is a substring of the lower-cased columns together; an empty search matches all."""
    text = F.lower(F.concat_ws(" ", *columns))
    cond = F.lit(True)
    for word in find.lower().split():
        cond = cond & text.contains(word)
    return cond


def search_all_words(df: DataFrame, columns: Sequence[str], find: str) -> DataFrame:
    return df.where(has_all_words(columns, find))


def in_class(show: str) -> Column:
    return F.lit(True) if show == "all" else F.col("status").isin(*CLASSES[show])


def board_filter(df: DataFrame, show: str = "all", starred: bool = False, find: str = "") -> DataFrame:
    """Concepts of a status class, optionally starred ones only, with all words of ``find`` in the name."""
    out = df.where(in_class(show) & has_all_words(["name"], find))
    return out.where("starred") if starred else out


def facet_counts(df: DataFrame, show: str = "all", starred: bool = False, find: str = "") -> DataFrame:
    """One row: the count of each class under the other filters, and of starred ones under the class. One pass."""
    found = df.where(has_all_words(["name"], find))
    star = F.col("starred") if starred else F.lit(True)
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    shows = [count(star & in_class(s)).alias("n_" + s.replace("-", "_")) for s in ("all", *CLASSES)]
    return found.agg(*shows, count(F.col("starred") & in_class(show)).alias("n_starred"))


def select_sections(df: DataFrame, chapters: Sequence[int] = (), sections: Sequence[int] = ()) -> DataFrame:
    """Sections of the listed chapters or the listed sections; no list selects all."""
    if not chapters and not sections:
        return df
    return df.where(F.col("chapter").isin(*chapters) | F.col("section_id").isin(*sections))


def unknown_ids(df: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """Asked ids that no row has."""
    return asked.join(df, key, "left_anti")


def expand_ranges(df: DataFrame, column: str) -> DataFrame:
    """ "1-3,5" to distinct numbers, one row each; parts that are no range are left out."""
    part = df.select(F.explode(F.split(column, ",")).alias("part")).select(F.trim("part").alias("part"))
    lo, hi = F.regexp_extract("part", r"^([0-9]+)", 1), F.regexp_extract("part", r"^[0-9]+\s*-\s*([0-9]+)$", 1)
    part = part.where(r"part rlike '^[0-9]+(\\s*-\\s*[0-9]+)?$'").select(lo.cast("long").alias("lo"), F.when(hi == "", lo).otherwise(hi).cast("long").alias("hi"))
    return part.where("lo <= hi").select(F.explode(F.sequence("lo", "hi")).alias("n")).distinct()


def format_ranges(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Numbers per key as "1-3, 5": islands of consecutive numbers."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(column)
    islands = df.select(*keys, column).distinct().withColumn("island", F.col(column) - F.row_number().over(w))
    spans = islands.groupBy(*keys, "island").agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    text = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat_ws("-", F.col("lo").cast("string"), F.col("hi").cast("string")))
    got = spans.withColumn("text", text).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("lo", "text"))).alias("all"))
    return got.select(*keys, F.array_join(F.transform("all", lambda x: x["text"]), ", ").alias("ranges"))


def book_order(df: DataFrame) -> Column:
    return F.struct("book_id", "chapter", "number")


def section_range(df: DataFrame, first: tuple[int, int], last: tuple[int, int], book: str = "book_id") -> DataFrame:
    """Sections of every book between two (chapter, number) places in book order, both included."""
    place = F.struct(F.col("chapter"), F.col("number"))
    lit = lambda p: F.struct(F.lit(p[0]).cast("long").alias("chapter"), F.lit(p[1]).cast("long").alias("number"))
    return df.where((place >= lit(first)) & (place <= lit(last)))


def latest_by(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row per key in the given order; the filter on the rank is pushed below the window's sort."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def top_by(df: DataFrame, keys: Sequence[str], n: int, *order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)


def sources_of(sources: DataFrame, sections: DataFrame, books: DataFrame) -> DataFrame:
    """Concept, source, section and book, for ordering by (book, chapter, number)."""
    return sources.join(sections, "section_id").join(books.select("book_id", "title"), "book_id").select("concept_id", "book_id", "title", "chapter", "number", "section_id")


def question_view(questions: DataFrame, sections: DataFrame) -> DataFrame:
    """Questions with the section that each one cites, if it is known."""
    return questions.join(sections, "section_id", "left")


def unsaved_books(runs: DataFrame, books: DataFrame) -> DataFrame:
    """The latest run of each book that is not saved."""
    return latest_by(runs, ["book_id"], F.desc("id")).join(books, "book_id", "left_anti")


def orphans(concepts: DataFrame, sources: DataFrame, others: Sequence[DataFrame] = ()) -> DataFrame:
    """New, unstarred concepts that no source, lesson, question or session refers to."""
    out = concepts.where("status = 'new' and not starred").join(sources.select(F.col("concept_id").alias("id")).distinct(), "id", "left_anti")
    for o in others:
        out = out.join(o.select(F.col("concept_id").alias("id")).distinct(), "id", "left_anti")
    return out


def empty_modules(modules: DataFrame, concepts: DataFrame) -> DataFrame:
    return modules.join(concepts, ["subject_id", "module"], "left_anti")


def affected(concepts: DataFrame, sources: DataFrame, changed: DataFrame, taught: DataFrame) -> DataFrame:
    """Names of concepts with a source in a changed section and at least one lesson."""
    hit = sources.join(changed, "section_id", "left_semi").select(F.col("concept_id").alias("id"))
    return concepts.join(hit, "id", "left_semi").join(taught, "id", "left_semi").select("subject_id", "name").distinct()


def status_counts(concepts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of all statuses per key, zero where there is none."""
    return concepts.groupBy(*keys).pivot("status", list(STATUSES)).count().na.fill(0)


def status_totals(concepts: DataFrame) -> DataFrame:
    """Counts per (subject, module), per subject and in all; a null key is the total over it."""
    return concepts.rollup("subject_id", "module").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("status").isin(*DONE).cast("long")).alias("learned"))


def subject_summary(subjects: DataFrame, books: DataFrame, modules: DataFrame, concepts: DataFrame) -> DataFrame:
    count = lambda df, name: df.groupBy("subject_id").agg(F.count(F.lit(1)).alias(name))
    out = subjects
    for df, name in ((books, "n_books"), (modules, "n_modules"), (concepts, "n_concepts")):
        out = out.join(count(df, name), "subject_id", "left")
    return out.join(status_counts(concepts, ["subject_id"]), "subject_id", "left").na.fill(0, ["n_books", "n_modules", "n_concepts", *STATUSES])


def book_rollup(books: DataFrame, sections: DataFrame, sources: DataFrame) -> DataFrame:
    """Per book: chapters, chapters with concepts, sections, words, distinct concepts; books with none are kept."""
    per = sections.groupBy("book_id").agg(F.countDistinct("chapter").alias("chapters"), F.count(F.lit(1)).alias("sections"), F.sum("words").alias("words"))
    used = sources.join(sections, "section_id").groupBy("book_id").agg(F.countDistinct("chapter").alias("used_chapters"), F.countDistinct("concept_id").alias("concepts"))
    out = books.join(per, "book_id", "left").join(used, "book_id", "left")
    counts = ("chapters", "used_chapters", "sections", "words", "concepts")
    return out.select("book_id", "title", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts])


def not_chosen(concepts: DataFrame) -> DataFrame:
    return concepts.where(in_class("not-chosen")).groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("module").alias("modules"))


def module_progress(concepts: DataFrame) -> DataFrame:
    """Learned of those not skipped, per module."""
    live = F.col("status") != "skipped"
    return concepts.groupBy("subject_id", "module").agg(F.sum(F.col("status").isin(*DONE).cast("long")).alias("learned"), F.sum(live.cast("long")).alias("total"))


def chapters_with_concepts(sources: DataFrame, sections: DataFrame) -> DataFrame:
    return sources.join(sections, "section_id").select("book_id", "chapter").distinct()


def concept_place(sources: DataFrame, sections: DataFrame) -> DataFrame:
    """(concept_id, place): the first place in book order of each concept with a source."""
    return sources.join(sections, "section_id").groupBy("concept_id").agg(F.min(book_order(sections)).alias("place"))


def concept_order(concepts: DataFrame, sources: DataFrame, sections: DataFrame) -> DataFrame:
    """Position per subject by first source; those without one last, then by id."""
    placed = concepts.join(concept_place(sources, sections).withColumnRenamed("concept_id", "id"), "id", "left")
    w = Window.partitionBy("subject_id").orderBy(F.asc_nulls_last("place"), "id")
    return placed.select("subject_id", "id", F.row_number().over(w).cast("long").alias("position"))


def renumber_modules(modules: DataFrame, concepts: DataFrame, sources: DataFrame, sections: DataFrame) -> DataFrame:
    """Modules by the first place of their concepts; those without a place last, in their old order."""
    placed = concepts.join(concept_place(sources, sections).withColumnRenamed("concept_id", "id"), "id")
    first = placed.groupBy("subject_id", "module").agg(F.min("place").alias("place"))
    w = Window.partitionBy("subject_id").orderBy(F.asc_nulls_last("place"), "position", "module")
    return modules.join(first, ["subject_id", "module"], "left").select("subject_id", "module", F.row_number().over(w).cast("long").alias("position"))


def run_groups(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Gaps and islands: neighbours with an equal value form a group; the same value later starts a new one."""
    w = Window.partitionBy(*keys).orderBy(order)
    flag = (~F.col(value).eqNullSafe(F.lag(value).over(w))) | (F.row_number().over(w) == 1)
    marked = df.withColumn("_new", flag.cast("long"))
    return marked.withColumn("group_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def batches(df: DataFrame, keys: Sequence[str], order: str, size: int = 4) -> DataFrame:
    """Fixed-size batches in order, from 0."""
    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1) / size).cast("long"))


def next_to_learn(concepts: DataFrame, exclude: int | None = None) -> DataFrame:
    """Per subject the first queued or learning concept."""
    waiting = concepts.where(F.col("status").isin("queued", "learning"))
    if exclude is not None:
        waiting = waiting.where(F.col("id") != exclude)
    return latest_by(waiting, ["subject_id"], F.asc("queue_pos"), F.asc("id"))


def section_by_id(sections: DataFrame, books: DataFrame, section_id: int) -> DataFrame:
    """Point lookup; the filter reaches the scan."""
    return sections.where(F.col("section_id") == section_id).join(books.select("book_id", "title"), "book_id")


def usage_rollup(runs: DataFrame, key: str) -> DataFrame:
    """Requests, tokens, cost (null if never given) and seconds per key."""
    return runs.groupBy(key).agg(F.count(F.lit(1)).alias("requests"), *[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cost", "seconds")])


def upper_median(column: Column) -> Column:
    """Element floor(n/2) of the sorted values; an aggregate."""
    values = F.sort_array(F.collect_list(column))
    return F.element_at(values, (F.floor(F.size(values) / 2) + 1).cast("int"))
