"""Queries over the report operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators import reports as R
from quillspan.plans.adapters import STATUSES, view
from quillspan.plans.registry import query

_COUNTS = ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in STATUSES)


@query("p1_search_all_words", "SELECT id, name FROM {v_concepts} WHERE contains(lower(name || ' ' || objective), 'e') AND contains(lower(name || ' ' || objective), 'a')")
def p1(spark, d):
    return R.search_all_words(view(spark, d, "v_concepts"), ["name", "objective"], "E a").select("id", "name")


@query("p2_board_filter", "SELECT id, status FROM {v_concepts} WHERE status IN ('new', 'to_test', 'failed') AND starred AND contains(lower(name), 'a')")
def p2(spark, d):
    return R.board_filter(view(spark, d, "v_concepts"), "not-chosen", True, "a").select("id", "status")


@query("p3_select_sections", "SELECT section_id, chapter FROM {v_sections} WHERE chapter IN (2, 5) OR section_id IN (7, 33)")
def p3(spark, d):
    return R.select_sections(view(spark, d, "v_sections"), [2, 5], [7, 33]).select("section_id", "chapter")


@query("p4_expand_ranges", "WITH r AS (SELECT DISTINCT chapter AS lo, chapter + number % 3 AS hi FROM {v_sections}) SELECT DISTINCT n FROM (SELECT unnest(range(lo, hi + 1)) AS n FROM r)")
def p4(spark, d):
    s = view(spark, d, "v_sections")
    text = s.select(F.concat_ws("-", F.col("chapter").cast("string"), (F.col("chapter") + F.col("number") % 3).cast("string")).alias("text")).distinct()
    return R.expand_ranges(text, "text")


@query("p5_section_range", "SELECT section_id FROM {v_sections} WHERE (chapter > 2 OR chapter = 2 AND number >= 2) AND (chapter < 4 OR chapter = 4 AND number <= 1)")
def p5(spark, d):
    return R.section_range(view(spark, d, "v_sections"), (2, 2), (4, 1)).select("section_id")


@query("p9_section_lookup", "SELECT s.section_id, s.chapter, s.number, b.title FROM {v_sections} s JOIN {v_books} b USING (book_id) WHERE s.section_id = 33")
def p9(spark, d):
    return R.section_by_id(view(spark, d, "v_sections"), view(spark, d, "v_books"), 33).select("section_id", "chapter", "number", "title")


@query("j1_sources_of", "SELECT x.concept_id, s.book_id, b.title, s.chapter, s.number, s.section_id FROM {v_sources} x JOIN {v_sections} s USING (section_id) JOIN {v_books} b ON b.book_id = s.book_id")
def j1(spark, d):
    return R.sources_of(view(spark, d, "v_sources"), view(spark, d, "v_sections"), view(spark, d, "v_books"))


@query("j2_question_view", "SELECT q.session_id, q.concept, s.book_id, s.words FROM {v_questions} q LEFT JOIN {v_sections} s ON s.section_id = q.session_id")
def j2(spark, d):
    q, s = view(spark, d, "v_questions"), view(spark, d, "v_sections")
    return R.question_view(q.withColumn("section_id", F.col("session_id")), s).select("session_id", "concept", "book_id", "words")


@query("j3_unsaved_books", "SELECT book_id, id, status FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY id DESC) AS r FROM {v_runs}) t WHERE r = 1 AND book_id NOT IN (SELECT book_id FROM {v_books} WHERE book_id % 3 <> 0)")
def j3(spark, d):
    return R.unsaved_books(view(spark, d, "v_runs"), view(spark, d, "v_books").where("book_id % 3 <> 0")).select("book_id", "id", "status")


@query("j4_orphans", "SELECT id, name FROM {v_concepts} WHERE status = 'new' AND NOT starred AND id NOT IN (SELECT concept_id FROM {v_sources}) AND id NOT IN (SELECT prereq_id FROM {v_prereqs}) UNION ALL SELECT -id, name FROM {v_concepts} WHERE status = 'new' AND NOT starred")
def j4(spark, d):
    """Every concept once more without sources, under its negative id."""
    src, con = view(spark, d, "v_sources"), view(spark, d, "v_concepts")
    pre = view(spark, d, "v_prereqs").select(F.col("prereq_id").alias("concept_id"))
    return R.orphans(con.unionAll(con.withColumn("id", -F.col("id"))), src, [pre]).select("id", "name")


@query("j4_empty_modules", "SELECT subject_id, module FROM {v_modules} m WHERE NOT EXISTS (SELECT 1 FROM {v_concepts} c WHERE c.subject_id = m.subject_id AND c.module = m.module AND status = 'mastered')")
def j4b(spark, d):
    return R.empty_modules(view(spark, d, "v_modules"), view(spark, d, "v_concepts").where("status = 'mastered'")).select("subject_id", "module")


@query("j5_affected_lessons", "SELECT DISTINCT subject_id, name FROM {v_concepts} WHERE id IN (SELECT concept_id FROM {v_sources} x JOIN {v_sections} s USING (section_id) WHERE s.words < 100) AND id IN (SELECT l_partkey FROM {lineitem} WHERE l_returnflag = 'R')")
def j5(spark, d):
    changed = view(spark, d, "v_sections").where("words < 100").select("section_id")
    taught = view(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("id"))
    return R.affected(view(spark, d, "v_concepts"), view(spark, d, "v_sources"), changed, taught)


@query("r1_status_counts", f"SELECT subject_id, module, {_COUNTS} FROM {{v_concepts}} GROUP BY subject_id, module")
def r1(spark, d):
    return R.status_counts(view(spark, d, "v_concepts"), ["subject_id", "module"])


@query("r1_status_totals", "SELECT subject_id, module, count(*) AS n, count(*) FILTER (WHERE status IN ('known', 'mastered')) AS learned FROM {v_concepts} GROUP BY ROLLUP (subject_id, module)")
def r1t(spark, d):
    return R.status_totals(view(spark, d, "v_concepts"))


_SUM = ", ".join(f"coalesce(c.{s}, 0) AS {s}" for s in STATUSES)


@query(
    "r2_subject_summary",
    f"""SELECT s.subject_id, s.name, coalesce(b.n, 0) AS n_books, coalesce(m.n, 0) AS n_modules, coalesce(c.n, 0) AS n_concepts, {_SUM} FROM {{v_subjects}} s
    LEFT JOIN (SELECT subject_id, count(*) AS n FROM {{v_books}} GROUP BY 1) b USING (subject_id) LEFT JOIN (SELECT subject_id, count(*) AS n FROM {{v_modules}} GROUP BY 1) m USING (subject_id)
    LEFT JOIN (SELECT subject_id, count(*) AS n, {_COUNTS} FROM {{v_concepts}} GROUP BY 1) c USING (subject_id)""",
)
def r2(spark, d):
    return R.subject_summary(*[view(spark, d, v) for v in ("v_subjects", "v_books", "v_modules", "v_concepts")])


@query(
    "r3_book_rollup",
    """SELECT b.book_id, b.title, coalesce(p.chapters, 0) AS chapters, coalesce(u.used_chapters, 0) AS used_chapters, coalesce(p.sections, 0) AS sections, cast(coalesce(p.words, 0) AS bigint) AS words, coalesce(u.concepts, 0) AS concepts
    FROM {v_books} b LEFT JOIN (SELECT book_id, count(DISTINCT chapter) AS chapters, count(*) AS sections, sum(words) AS words FROM {v_sections} GROUP BY 1) p USING (book_id)
    LEFT JOIN (SELECT book_id, count(DISTINCT chapter) AS used_chapters, count(DISTINCT concept_id) AS concepts FROM {v_sources} JOIN {v_sections} USING (section_id) GROUP BY 1) u USING (book_id)""",
)
def r3(spark, d):
    return R.book_rollup(view(spark, d, "v_books"), view(spark, d, "v_sections"), view(spark, d, "v_sources"))


@query("r5_not_chosen", "SELECT subject_id, count(*) AS n, count(DISTINCT module) AS modules FROM {v_concepts} WHERE status IN ('new', 'to_test', 'failed') GROUP BY 1")
def r5(spark, d):
    return R.not_chosen(view(spark, d, "v_concepts"))


@query("r9_latest_run", "SELECT book_id, id, status FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY id DESC) AS r FROM {v_runs}) t WHERE r = 1")
def r9(spark, d):
    return R.latest_by(view(spark, d, "v_runs"), ["book_id"], F.desc("id")).select("book_id", "id", "status")


_F = "count(*) FILTER (WHERE starred AND status IN ({})) AS n_{}"
_FACETS = ", ".join(_F.format(", ".join(f"'{x}'" for x in v), k.replace("-", "_")) for k, v in R.CLASSES.items())


@query("r12_facet_counts", f"SELECT count(*) FILTER (WHERE starred) AS n_all, {_FACETS}, count(*) FILTER (WHERE starred AND status = 'queued') AS n_starred FROM {{v_concepts}} WHERE contains(lower(name), 'e')")
def r12(spark, d):
    return R.facet_counts(view(spark, d, "v_concepts"), "queued", True, "e")


@query("r13_module_progress", "SELECT subject_id, module, count(*) FILTER (WHERE status IN ('known', 'mastered')) AS learned, count(*) FILTER (WHERE status <> 'skipped') AS total FROM {v_concepts} GROUP BY 1, 2")
def r13(spark, d):
    return R.module_progress(view(spark, d, "v_concepts"))


@query("r14_usage_rollup", "SELECT user_id, count(*) AS requests, cast(sum(event_id % 100) AS bigint) AS input_tokens, cast(sum(event_id % 10) AS bigint) AS output_tokens, cast(sum(CASE WHEN event_type = 'error' THEN event_id % 7 END) AS bigint) AS cost, cast(sum(event_id % 60) AS bigint) AS seconds FROM {events} GROUP BY 1")
def r14(spark, d):
    e = view(spark, d, "events").selectExpr("user_id", "event_id % 100 input_tokens", "event_id % 10 output_tokens", "case when event_type = 'error' then event_id % 7 end cost", "event_id % 60 seconds")
    return R.usage_rollup(e, "user_id")


@query("r18_chapters_with_concepts", "SELECT DISTINCT book_id, chapter FROM {v_sources} JOIN {v_sections} USING (section_id)")
def r18(spark, d):
    return R.chapters_with_concepts(view(spark, d, "v_sources"), view(spark, d, "v_sections"))


_PLACE = "SELECT concept_id, min((book_id, chapter, number)) AS place FROM {v_sources} JOIN {v_sections} USING (section_id) GROUP BY 1"


@query(
    "r21_renumber_modules",
    f"""SELECT m.subject_id, m.module, row_number() OVER (PARTITION BY m.subject_id ORDER BY f.place NULLS LAST, m.position, m.module) AS position FROM {{v_modules}} m LEFT JOIN
    (SELECT subject_id, module, min(place) AS place FROM {{v_concepts}} c JOIN ({_PLACE}) p ON p.concept_id = c.id GROUP BY 1, 2) f USING (subject_id, module)""",
)
def r21(spark, d):
    return R.renumber_modules(*[view(spark, d, v) for v in ("v_modules", "v_concepts", "v_sources", "v_sections")])


@query("r22_concept_order", f"SELECT c.subject_id, c.id, row_number() OVER (PARTITION BY c.subject_id ORDER BY p.place NULLS LAST, c.id) AS position FROM {{v_concepts}} c LEFT JOIN ({_PLACE}) p ON p.concept_id = c.id")
def r22(spark, d):
    return R.concept_order(*[view(spark, d, v) for v in ("v_concepts", "v_sources", "v_sections")])


@query(
    "r23_run_groups",
    "SELECT subject_id, id, module, cast(sum(new) OVER (PARTITION BY subject_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS bigint) AS group_no FROM (SELECT *, CASE WHEN module IS DISTINCT FROM lag(module) OVER (PARTITION BY subject_id ORDER BY id) THEN 1 ELSE 0 END AS new FROM {v_concepts}) t",
)
def r23(spark, d):
    return R.run_groups(view(spark, d, "v_concepts").select("subject_id", "id", "module"), ["subject_id"], "id", "module")


@query(
    "r24_format_ranges",
    """SELECT book_id, string_agg(CASE WHEN lo = hi THEN cast(lo AS varchar) ELSE lo || '-' || hi END, ', ' ORDER BY lo) AS ranges FROM (SELECT book_id, min(chapter) AS lo, max(chapter) AS hi
    FROM (SELECT book_id, chapter, chapter - row_number() OVER (PARTITION BY book_id ORDER BY chapter) AS island FROM (SELECT DISTINCT book_id, chapter FROM {v_sections}) a) b GROUP BY book_id, island) c GROUP BY book_id""",
)
def r24(spark, d):
    return R.format_ranges(view(spark, d, "v_sections"), ["book_id"], "chapter")


@query("r25_batches", "SELECT subject_id, id, cast(floor((row_number() OVER (PARTITION BY subject_id ORDER BY id) - 1) / 4) AS bigint) AS batch FROM {v_concepts} WHERE status = 'to_test'")
def r25(spark, d):
    return R.batches(view(spark, d, "v_concepts").where("status = 'to_test'").select("subject_id", "id"), ["subject_id"], "id", 4)


@query("k1_next_to_learn", "SELECT subject_id, id, queue_pos FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY queue_pos, id) AS r FROM {v_concepts} WHERE status IN ('queued', 'learning') AND id <> 5) t WHERE r = 1")
def k1(spark, d):
    return R.next_to_learn(view(spark, d, "v_concepts"), exclude=5).select("subject_id", "id", "queue_pos")


@query("k2_top_sources", "SELECT concept_id, section_id, rank FROM (SELECT concept_id, section_id, row_number() OVER (PARTITION BY concept_id ORDER BY book_id, chapter, number, section_id) AS rank FROM {v_sources} JOIN {v_sections} USING (section_id)) t WHERE rank <= 6")
def k2(spark, d):
    s = view(spark, d, "v_sources").join(view(spark, d, "v_sections"), "section_id")
    return R.top_by(s, ["concept_id"], 6, F.col("book_id"), F.col("chapter"), F.col("number"), F.col("section_id")).select("concept_id", "section_id", "rank")


@query("k5_upper_median", "SELECT book_id, list_sort(list(words))[cast(floor(count(*) / 2) AS bigint) + 1] AS mid FROM {v_sections} GROUP BY 1")
def k5(spark, d):
    return view(spark, d, "v_sections").groupBy("book_id").agg(R.upper_median(F.col("words")).alias("mid"))
