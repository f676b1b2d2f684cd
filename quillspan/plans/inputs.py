"""Queries over sources, sinks, run reports and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillspan.functions.text import ascii_slug, count_words
from quillspan.operators import runs as U
from quillspan.operators import structure as S
from quillspan.operators.fixpoint import cut, own_dir
from quillspan.plans.adapters import view
from quillspan.plans.registry import query
from quillspan.sources.tables import read_table, write_sections
from quillspan.sources.video import playlist_entries, video_facts
from quillspan.streaming.attempts import run_latest_attempts

_WORDS = "cast(len(list_filter(string_split_regex(text, '\\s+'), lambda t: regexp_matches(t, '[\\p{L}\\p{N}]'))) AS bigint)"


@query("io1_scan", "SELECT doc_id, lang, source, n_chars FROM {documents}")
def io1(spark, d):
    return read_table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")


@query("io4_video_facts", "SELECT conv_id, turn, 'T' || turn AS title, turn % 4 AS n_chapters FROM {conversations}")
def io4(spark, d):
    k = F.col("turn") % 4
    chapters = F.transform(F.sequence(F.lit(0), k), lambda i: F.struct(F.lit("").alias("title"), (i * 10).alias("start_time"), F.when(i == k, 0).otherwise(i * 10 + 10).alias("end_time")))
    json = view(spark, d, "conversations").select("conv_id", "turn", F.to_json(F.struct(F.concat(F.lit("T"), F.col("turn").cast("string")).alias("title"), F.lit(40.0).alias("duration"), chapters.alias("chapters"))).alias("json"))
    return video_facts(json, "json").select("conv_id", "turn", "title", F.size("chapters").cast("long").alias("n_chapters"))


@query("io4_playlist_entries", "SELECT conv_id, turn AS pos, role AS title FROM {conversations} WHERE turn % 3 <> 0")
def io4p(spark, d):
    from pyspark.sql import Window

    c = view(spark, d, "conversations")
    e = F.struct("turn", F.lpad(F.col("turn").cast("string"), 11, "x").alias("id"), F.when(F.col("turn") % 3 == 0, "[Private video]").otherwise(F.col("role")).alias("title"), F.lit(5.0).alias("duration"))
    lists = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(e)).alias("e")).select("conv_id", F.to_json(F.struct(F.lit("L").alias("title"), F.transform("e", lambda x: F.struct(x["id"].alias("id"), x["title"].alias("title"), x["duration"].alias("duration"))).alias("entries"))).alias("json"))
    return playlist_entries(lists, "json").select("conv_id", F.col("pos").cast("long").alias("pos"), "title")


@query("io5_write_sections", "SELECT source, doc_id, lpad(cast(doc_id // 100 AS varchar), 2, '0') || '-' || lpad(cast(doc_id % 100 AS varchar), 2, '0') || '-' || lang || '.md' AS file, md5(text) AS text_md5 FROM {documents}")
def io5(spark, d):
    docs = view(spark, d, "documents")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    rows = docs.select(F.col("source").alias("book"), "doc_id", "text", F.concat_ws("-", two(F.floor(F.col("doc_id") / 100)), two(F.col("doc_id") % 100), F.concat(ascii_slug("lang"), F.lit(".md"))).alias("file"))
    path = f"{own_dir(spark)}/sections-{uuid.uuid4().hex}"
    write_sections(rows, path)
    back = spark.read.schema("doc_id long, text string, file string, book string").parquet(path)
    return back.select(F.col("book").alias("source"), "doc_id", "file", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(
    "io6_parse_report",
    f"""SELECT s.source, chapters, sections, words, source_words, coalesce(k.skipped_words, 0) AS skipped_words, coalesce(c.n, 0) AS checklist_items, coalesce(e.g, 0) AS glossary_entries, coalesce(e.i, 0) AS index_entries FROM
    (SELECT source, count(DISTINCT lang) AS chapters, count(*) AS sections, cast(sum({_WORDS}) AS bigint) AS words, cast(sum(n_chars // 5) AS bigint) AS source_words FROM {{documents}} GROUP BY 1) s
    LEFT JOIN (SELECT source, cast(sum({_WORDS}) AS bigint) AS skipped_words FROM {{documents}} WHERE doc_id % 4 = 0 GROUP BY 1) k USING (source) LEFT JOIN (SELECT source, count(*) AS n FROM {{documents}} JOIN {{labels}} USING (doc_id) WHERE quality = 1 GROUP BY 1) c USING (source)
    LEFT JOIN (SELECT source, count(*) FILTER (WHERE toxic = 1) AS g, count(*) FILTER (WHERE toxic = 0) AS i FROM {{documents}} JOIN {{labels}} USING (doc_id) GROUP BY 1) e USING (source)""".replace("{{", "{").replace("}}", "}"),
)
def io6(spark, d):
    docs = view(spark, d, "documents").select("source", "doc_id", F.col("lang").alias("chapter"), count_words("text").alias("words"), F.floor(F.col("n_chars") / 5).alias("source_words"))
    marks = docs.join(view(spark, d, "labels"), "doc_id")
    entries = marks.select("source", F.when(F.col("toxic") == 1, "glossary").when(F.col("toxic") == 0, "index").alias("kind"))
    return U.parse_report(docs, docs.where("doc_id % 4 = 0"), marks.where("quality = 1"), entries, "source")


#: Images of chapters: the parts of an order stand for those of a section; every third one has been read.
_IMAGES = "(SELECT DISTINCT s.book_id, s.chapter, l.l_suppkey AS image FROM {lineitem} l JOIN {v_sections} s ON s.section_id = l.l_orderkey WHERE l.l_suppkey % 3 <> 0)"
_CHAPTERS = f"(SELECT g.book_id, g.chapter, g.chapter % 4 = 0 AS cached, coalesce(i.images, 0) AS images, CASE WHEN g.chapter % 4 = 0 THEN 0 ELSE 2 * g.groups END + 1 + coalesce(i.images, 0) AS requests FROM (SELECT book_id, chapter, cast(ceil(count(*) / 8.0) AS bigint) AS groups FROM {{v_sections}} GROUP BY 1, 2) g LEFT JOIN (SELECT book_id, chapter, count(DISTINCT image) AS images FROM {_IMAGES} x GROUP BY 1, 2) i ON i.book_id = g.book_id AND i.chapter = g.chapter)"


def _plan(spark, d):
    s = view(spark, d, "v_sections")
    groups = S.group_sections(s, ["book_id", "chapter"], 8, 10**9).groupBy("book_id", "chapter").agg(F.max("grp").alias("groups"))
    images = view(spark, d, "lineitem").where("l_suppkey % 3 <> 0").select(F.col("l_orderkey").alias("section_id"), F.col("l_suppkey").alias("image")).join(s, "section_id").select("book_id", "chapter", "image")
    return U.request_plan(groups, s.where("chapter % 4 = 0"), images, "book_id")


@query("r15_request_plan", f"SELECT * FROM {_CHAPTERS} c")
def r15(spark, d):
    return _plan(spark, d)[0]


@query("r15_request_total", f"SELECT c.book_id, coalesce(i.images, 0) AS images, cast(base + coalesce(i.images, 0) AS bigint) AS requests FROM (SELECT book_id, sum(requests - images) AS base FROM {_CHAPTERS} t GROUP BY 1) c LEFT JOIN (SELECT book_id, count(DISTINCT image) AS images FROM {_IMAGES} x GROUP BY 1) i ON i.book_id = c.book_id")
def r15t(spark, d):
    return _plan(spark, d)[1]


_FACTS = {"concepts": "true", "added": "concept_id % 2 = 0", "joined": "concept_id % 2 = 1", "empty": "words < 100", "missing": "words between 100 and 150", "minor": "concept_id % 7 = 0", "quote_warnings": "concept_id % 11 = 0", "skipped_items": "concept_id % 13 = 0"}


@query(
    "r16_chapter_report",
    f"""SELECT s.book_id, s.chapter, s.sections, {", ".join(f"coalesce(c.{k}, 0) AS {k}" for k in _FACTS)} FROM (SELECT book_id, chapter, count(*) AS sections FROM {{v_sections}} GROUP BY 1, 2) s
    LEFT JOIN (SELECT book_id, chapter, {", ".join(f"count(*) FILTER (WHERE {v}) AS {k}" for k, v in _FACTS.items())} FROM {{v_sources}} JOIN {{v_sections}} USING (section_id) GROUP BY 1, 2) c ON c.book_id = s.book_id AND c.chapter = s.chapter""",
)
def r16(spark, d):
    s = view(spark, d, "v_sections")
    rows = view(spark, d, "v_sources").join(s, "section_id")
    return U.chapter_report(s, {k: rows.where(v) for k, v in _FACTS.items()}, ["book_id", "chapter"])


@query(
    "r17_fetch_report",
    "SELECT page_id % 5 AS grp, count(*) FILTER (WHERE page_id % 4 <> 0) AS pages, cast(coalesce(sum(length(html)) FILTER (WHERE page_id % 4 <> 0), 0) AS bigint) AS words, count(DISTINCT url) FILTER (WHERE page_id % 4 = 1) AS images, md5(coalesce(string_agg(url || ' ' || CASE WHEN page_id % 8 = 0 THEN 'robots' ELSE 'same text' END, chr(10) ORDER BY url, page_id % 8) FILTER (WHERE page_id % 4 = 0), '')) AS skipped_md5 FROM {pages} GROUP BY 1",
)
def r17(spark, d):
    p = view(spark, d, "pages").select((F.col("page_id") % 5).alias("grp"), "page_id", "url", F.length("html").cast("long").alias("words"))
    skipped = p.where("page_id % 4 = 0").select("grp", "url", F.when(F.col("page_id") % 8 == 0, "robots").otherwise("same text").alias("reason"))
    got = U.fetch_report(p.where("page_id % 4 <> 0"), p.where("page_id % 4 = 1").select("grp", F.col("url").alias("image")), skipped, "grp")
    lines = F.array_join(F.transform("skipped", lambda x: F.concat(x["url"], F.lit(" "), x["reason"])), "\n")
    return got.select("grp", "pages", "words", "images", F.md5(lines.cast("binary")).alias("skipped_md5"))


@query(
    "b13_book_warnings",
    """SELECT source, 'skipped_text' AS code, lang AS about, n_chars // 5 AS n FROM {documents} WHERE n_chars // 5 >= 300 AND doc_id % 5 IN (1, 2) UNION ALL SELECT source, 'not_in_toc', 'f' || doc_id, n_chars % 90 FROM {documents} WHERE n_chars % 90 > 50 AND doc_id % 3 <> 0 AND doc_id % 2 = 0
    UNION ALL SELECT source, 'unassigned_terms', NULL, count(*) FROM {documents} WHERE doc_id % 7 = 0 GROUP BY 1 UNION ALL SELECT source, 'unread_images', NULL, count(DISTINCT doc_id % 20) FROM {documents} WHERE doc_id % 6 = 0 GROUP BY 1""",
)
def b13b(spark, d):
    docs, i = view(spark, d, "documents"), F.col("doc_id")
    kinds = F.array(*[F.lit(k) for k in ("glossary", "front", "back", "index", "chapter")])
    parts = docs.select("source", F.col("lang").alias("title"), F.get(kinds, (i % 5).cast("int")).alias("kind"), F.floor(F.col("n_chars") / 5).alias("words"))
    files = docs.select(F.col("source").alias("book"), F.concat(F.lit("f"), i.cast("string")).alias("file"), F.when(i % 2 == 0, "chapter").otherwise("front").alias("kind"), (F.col("n_chars") % 90).alias("words"), "doc_id")
    unlisted = S.unlisted_files(files, files.where("doc_id % 3 = 0").select("book", "file")).withColumnRenamed("book", "source")
    return U.book_warnings(parts, unlisted, docs.where("doc_id % 7 = 0"), docs.where("doc_id % 6 = 0").select("source", (i % 20).alias("image")), "source")


@query("st1_stream_latest_attempts", "SELECT session_id, concept, id, score, score = 2 OR disputed AS correct FROM (SELECT *, row_number() OVER (PARTITION BY session_id, concept ORDER BY id DESC) AS r FROM {v_attempts}) t WHERE r = 1")
def st1(spark, d):
    log = cut(view(spark, d, "v_attempts").repartition(3, "id"), "attempt-log")
    base = f"{own_dir(spark)}/stream-{uuid.uuid4().hex}"
    path = log.inputFiles()[0].rsplit("/", 1)[0]
    return run_latest_attempts(spark, path, log.schema, ["session_id", "concept"], f"{base}/table", f"{base}/state")
