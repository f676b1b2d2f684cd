"""Marked terms, checklists, glossary and index entries, and their coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.text import normalize_quote, normalize_space, once
from quillspan.operators.patterns import find_strings
from quillspan.sources.tables import spread

#: Words that are no terms on their own, and label words.
COMMON_WORDS = (
    "a an the and or but nor not no yes so if then than that this these those it its is are was were be been "
    "do does did can cannot could will would should must may might shall to of in on at by for from with as "
    "all any some each every both either neither none only also just even very really much many more most less "
    "least first last next new old same other another own one two always never often sometimes usually here "
    "there now when where why how what which who whom whose you your we our they their he she his her i me my "
    "before after above below again still already else ever too quite rather enough exactly actually"
)
#: Fixed value: what goes from a term's start and end.
AROUND = r"^[\s\"“'‘(\[]+|[\s\"”'’)\].,;:\-–—]+$"
LABEL = r"(?i)^(notes?|tips?|warnings?|important|caution|examples?|figure|table|listing|hint|step\s*[0-9]+|(short |long )?answer|solution|output|results?|syntax|explanation|definition|summary)$"
SUMMARY_TITLE = r"(?i)\b(summary|key takeaways|takeaways|recap|objectives|in this chapter|what you('ll| will) learn|chapter goals|key points|key concepts)\b"
#: Tags, source name and most words of marked terms, and the rank of sources.
MARKS = (("dfn", "dfn", 8), ("strong|b", "bold", 6), ("em|i", "emphasis", 4))
RANK = ("summary", "glossary", "index", "dfn", "bold", "emphasis")


def marked_terms(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """(id, term, source, max_words) of dfn, bold and emphasised text; not in code, headings or captions, not a whole paragraph (but for dfn).

    A mark ends at its end tag; where that is missing, at the next block tag or line break.
    """
    body = F.regexp_replace(F.col(html), r"(?is)<(script|style|code|pre|h[1-6]|figcaption|caption)\b[^>]*>.*?</\1>", " ")
    block = r"/?(?:p|div|li|ul|ol|dl|dt|dd|br|hr|h[1-6]|table|tr|td|th|section|article|header|footer|blockquote|body|html)\b"
    out = None
    for tags, source, most in MARKS:
        own = rf"[^<]*+(?:<(?!/(?:{tags})>|{block})[^<]*+)*+"
        whole = rf"(?i)<p[^>]*>\s*<(?:{tags})(?:\s[^>]*)?>{own}(?:</(?:{tags})>)?\s*(?=</p>|<p\b|<br)"
        text = body if source == "dfn" else F.regexp_replace(body, whole, "<p>")
        found = F.regexp_extract_all(text, F.lit(rf"(?i)<(?:{tags})(?:\s[^>]*)?>({own})"), F.lit(1))
        found = F.transform(found, lambda t: F.when(t.contains("<"), F.regexp_replace(t, "<[^>]*>", "")).otherwise(t))
        one = pages.select(id_col, F.posexplode(found).alias("at", "term")).select(id_col, "at", "term", F.lit(source).alias("source"), F.lit(most).alias("max_words"))
        out = one if out is None else out.unionAll(one)
    return out


def clean_term(term: Column, max_words: Column, max_length: int = 60) -> Column:
    """The term without quotes and marks around it, or null where it is none."""
    trimmed = F.regexp_replace(normalize_space(term), AROUND, "")

    def kept(t: Column) -> Column:
        common = F.array(*[F.lit(w) for w in COMMON_WORDS.split()])
        ok = (
            (t != "")
            & (F.length(t) <= max_length)
            & (F.size(F.split(t, " ")) <= max_words)
            & t.rlike(r"\p{L}")
            & ~t.rlike(r"[.!?]\s")
            & ~t.rlike("[=<>]")
            & ~t.rlike(LABEL)
            & ~(~t.contains(" ") & F.array_contains(common, F.lower(t)))
        )
        return F.when(ok, t)

    return once(trimmed, kept)


def clean_terms(terms: DataFrame) -> DataFrame:
    return terms.withColumn("term", clean_term(F.col("term"), F.col("max_words"))).where("term is not null").drop("max_words")


def summary_items(blocks: DataFrame, key: str, order: str = "pos", most: int = 20) -> DataFrame:
    """List items, else paragraphs, of summary sections: three words at least, cut to 300 characters, the first 20."""
    has = F.max((F.col("kind") == "item").cast("int")).over(Window.partitionBy(key)) == 1
    b = blocks.withColumn("_has", has).where((F.col("_has") & (F.col("kind") == "item")) | (~F.col("_has") & (F.col("kind") == "paragraph"))).where(F.size(F.split(F.trim("text"), r"\s+")) >= 3)
    cut = F.when(F.length("text") > 300, F.concat(F.substring("text", 1, 297), F.lit("..."))).otherwise(F.col("text"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return b.withColumn("_r", rank).where(F.col("_r") <= most).select(key, order, cut.alias("item"))


def glossary_entries(items: DataFrame, key: str, order: str = "pos") -> DataFrame:
    """Entries of definition lists: a dt and the dd's that follow; or a paragraph led by a bold term. The first of equal terms counts."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    lists = items.where("tag in ('dt', 'dd')").withColumn("_n", F.sum((F.col("tag") == "dt").cast("int")).over(w)).where("_n > 0")
    got = lists.groupBy(key, "_n").agg(F.min(order).alias(order), F.max(F.when(F.col("tag") == "dt", F.col("text"))).alias("term"), F.sort_array(F.collect_list(F.when(F.col("tag") == "dd", F.struct(order, "text")))).alias("d"))
    a = got.select(key, order, "term", F.array_join(F.transform("d", lambda x: x["text"]), " ").alias("definition"))
    led = r"(?is)^\s*<(b|strong)>(.*?)</\1>\s*[:\-–—]?\s*(.*)$"
    b = items.where(F.col("tag") == "p").where(F.col("html").rlike(led)).select(key, order, normalize_space(F.regexp_replace(F.regexp_extract("html", led, 2), "<[^>]+>", "")).alias("term"), normalize_space(F.regexp_replace(F.regexp_extract("html", led, 3), "<[^>]+>", "")).alias("definition"))
    every = a.unionAll(b).where("term <> ''")
    first = F.row_number().over(Window.partitionBy(key, F.lower("term")).orderBy(order))
    return every.withColumn("_r", first).where("_r = 1").drop("_r")


def index_entries(items: DataFrame) -> DataFrame:
    """Index entries (pos, parent, text, hrefs): the term without page numbers, the parent's in parentheses, link targets one row each."""
    term = lambda c: F.trim(F.regexp_replace(c, r"[,\s]*(?:[0-9]+(?:\s*[-–]\s*[0-9]+)?(?:\s*,\s*)?)+$", ""))
    own = items.withColumn("term", term(F.col("text")))
    up = own.select(F.col("pos").alias("parent"), F.col("term").alias("_p"))
    got = own.join(up, "parent", "left").withColumn("term", F.when(F.col("_p").isNotNull(), F.concat("term", F.lit(" ("), "_p", F.lit(")"))).otherwise(F.col("term")))
    return got.where("term <> ''").select("pos", "term", F.explode_outer("hrefs").alias("href"))


def chapter_checklist(terms: DataFrame, key: str) -> DataFrame:
    """One row per lower-case term of a chapter, from its strongest source, earliest first."""
    rank = F.array_position(F.array(*[F.lit(r) for r in RANK]), F.col("source"))
    w = Window.partitionBy(key, F.lower("term")).orderBy(rank, "at", "term")
    return terms.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def term_counts(terms: DataFrame) -> DataFrame:
    return terms.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.lower("term")).alias("terms"))


def review_items(terms: DataFrame, key: str, most: int = 60) -> DataFrame:
    """The first 60 unmatched terms per chapter by source rank; and how many more there were, on each row."""
    rank = F.array_position(F.array(*[F.lit(r) for r in RANK]), F.col("source"))
    w = Window.partitionBy(key).orderBy(rank, "at", "term")
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    return terms.withColumns({"rank": F.row_number().over(w).cast("long"), "skipped": F.greatest(n - most, F.lit(0)).cast("long")}).where(F.col("rank") <= most)


def uncovered_terms(terms: DataFrame, concepts: DataFrame, key: str) -> DataFrame:
    """Terms that no concept of the chapter covers: the term in a concept's name, objective or quote, or the name in the term."""
    t = terms.withColumn("_t", normalize_quote(F.regexp_replace("term", r" \(.*\)$", "")))
    c = concepts.select(F.col(key).alias("_k"), normalize_quote("name").alias("_n"), normalize_quote("objective").alias("_o"), normalize_quote("quote").alias("_q"))
    hit = (F.col("_k") == F.col(key)) & (F.col("_n").contains(F.col("_t")) | F.col("_o").contains(F.col("_t")) | F.col("_q").contains(F.col("_t")) | F.col("_t").contains(F.col("_n")))
    return t.where("_t <> ''").join(c, hit, "left_anti").drop("_t")


def first_section_with(terms: DataFrame, sections: DataFrame, term: str = "term", order: str = "section_id", text: str = "text") -> DataFrame:
    """(term, section): the first section that holds a term as full words; the terms in lower case, those with a letter or digit.

    All terms are looked for in one pass over the sections; of a term that stands in very many,
    each task sends on one row.
    """
    t = terms.select(F.lower(term).alias("term")).where(F.col("term").rlike(r"[\p{L}\p{N}]"))
    s = sections.select(F.col(order).alias("section"), F.lower(text).alias("body"))
    found = find_strings(spread(s), "section", "body", t, "term", whole_words=True)
    return found.groupBy(F.col("string").alias("term")).agg(F.min("section").alias("section"))


def assign_terms(terms: DataFrame, targets: DataFrame, sections: DataFrame, most: int = 3) -> DataFrame:
    """Sections of a term: up to three from its links, else the first that holds it, else none (null)."""
    linked = terms.join(targets, "href").select("term", "section").distinct()
    rank = F.row_number().over(Window.partitionBy("term").orderBy("section"))
    linked = linked.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")
    rest = terms.select("term").distinct().join(linked, "term", "left_anti")
    found = first_section_with(rest, sections).withColumnRenamed("term", "_l")
    return linked.unionAll(rest.join(found, F.lower("term") == F.col("_l"), "left").select("term", "section"))
