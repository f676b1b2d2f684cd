"""Queries over outlines, glossaries, indexes, addresses and section files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.operators import learner as L
from quillspan.operators import sets as D
from quillspan.operators import structure as S
from quillspan.operators import terms as M
from quillspan.operators.fixpoint import own_dir
from quillspan.plans.adapters import view
from quillspan.plans.registry import query
from quillspan.streaming.attempts import ingest_chapters, ingested


def _docs(spark, d):
    return view(spark, d, "documents")


def _text(c):
    return c.cast("string")


#: Outlines: one entry per document; every fifth one is the parent of the next four.
_ENTRIES = """(SELECT source AS book, doc_id AS entry, CASE WHEN doc_id % 5 <> 0 THEN doc_id - doc_id % 5 END AS parent, CASE WHEN doc_id % 35 IN (0, 3) THEN 'Part IV' ELSE 'About ' || lang END AS title,
    'f' || CASE WHEN doc_id % 2 = 0 THEN doc_id - doc_id % 5 ELSE doc_id END AS file, n_chars % 300 AS words FROM {documents})"""


@query(
    "b4_mark_parts",
    f"""SELECT e.book, e.entry, k.away IS NOT NULL AND (e.title = 'Part IV' OR k.away >= 0.5 AND e.words < 150) AS is_part, CASE WHEN k.away IS NOT NULL AND (e.title = 'Part IV' OR k.away >= 0.5) AND e.words < 150 THEN 'part' END AS kind FROM {_ENTRIES} e
    LEFT JOIN (SELECT c.book, c.parent AS entry, avg(CASE WHEN c.file <> p.file THEN 1.0 ELSE 0.0 END) AS away FROM {_ENTRIES} c JOIN {_ENTRIES} p ON p.book = c.book AND p.entry = c.parent GROUP BY 1, 2) k ON k.book = e.book AND k.entry = e.entry""",
)
def b4(spark, d):
    i = F.col("doc_id")
    e = _docs(spark, d).select(
        F.col("source").alias("book"),
        i.alias("entry"),
        F.when(i % 5 != 0, i - i % 5).alias("parent"),
        F.when((i % 35).isin(0, 3), "Part IV").otherwise(F.concat(F.lit("About "), "lang")).alias("title"),
        F.concat(F.lit("f"), _text(F.when(i % 2 == 0, i - i % 5).otherwise(i))).alias("file"),
        (F.col("n_chars") % 300).alias("words"),
    )
    return S.mark_parts(e).select("book", "entry", "is_part", "kind")


@query("b5_unlisted_files", "SELECT source AS book, 'f' || doc_id AS file, n_chars % 90 AS words FROM {documents} WHERE doc_id % 3 <> 0 AND n_chars % 90 > 50 AND doc_id % 4 > 1")
def b5(spark, d):
    i = F.col("doc_id")
    kinds = F.array(*[F.lit(k) for k in ("front", "back", "chapter", "appendix")])
    files = _docs(spark, d).select(F.col("source").alias("book"), F.concat(F.lit("f"), _text(i)).alias("file"), F.get(kinds, (i % 4).cast("int")).alias("kind"), (F.col("n_chars") % 90).alias("words"), "doc_id")
    return S.unlisted_files(files, files.where("doc_id % 3 = 0").select("book", "file")).select("book", "file", "words")


_LINES = "(SELECT doc_id, source, unnest(range(0, len(ls))) AS pos, unnest(ls) AS line FROM (SELECT doc_id, source, string_split_regex(text, '\\r?\\n') AS ls FROM {documents}) s)"


@query(
    "b5_split_unlisted",
    f"""WITH b AS (SELECT doc_id AS span, pos, line, doc_id % 3 AS k, pos // 2 AS f, pos % 2 = 1 AS head FROM {_LINES} l),
    n AS (SELECT *, k <> 0 AND f % 3 = 2 AND pos > 0 AND pos % 2 = 0 AS new FROM b), p AS (SELECT *, cast(sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY span ORDER BY pos) AS bigint) AS part FROM n),
    q AS (SELECT *, first_value(f) OVER (PARTITION BY span, part ORDER BY pos) AS ff FROM p)
    SELECT span, part, CASE WHEN k = 0 THEN 'chapter' WHEN part = 0 AND k = 2 THEN 'index' WHEN k = 1 THEN 'front' ELSE 'back' END AS kind, md5(CASE WHEN part = 0 THEN 'T' ELSE coalesce(min_by(line, pos) FILTER (WHERE head AND f = ff AND line <> ''), 'f' || ff) END) AS title_md5, cast(min(pos) AS bigint) AS start, cast(max(pos) + 1 AS bigint) AS "end" FROM q GROUP BY span, part, k, ff""",
)
def b5s(spark, d):
    kinds = F.array(*[F.lit(k) for k in ("chapter", "front", "index")])
    f = F.floor(F.col("pos") / 2)
    b = S.line_blocks(_docs(spark, d)).select(F.lit(1).alias("book"), F.col("doc_id").alias("span"), F.get(kinds, (F.col("doc_id") % 3).cast("int")).alias("span_kind"), F.lit("T").alias("span_title"), "pos", F.concat(F.lit("x/f"), _text(f)).alias("file"), F.when(F.col("pos") % 2 == 1, "heading").otherwise("content").alias("kind"), "text", "words")
    listed = b.where(f % 3 != 2).select("book", "file").distinct()
    return S.split_unlisted(b, listed).select("span", "part", "kind", F.md5(F.col("title").cast("binary")).alias("title_md5"), "start", "end")


@query(
    "b11_heading_titles",
    f"""SELECT doc_id, cast(pos AS bigint) AS pos, md5(CASE WHEN pos % 6 = 0 AND nxt IS NOT NULL AND nw BETWEEN 1 AND 30 THEN 'Question ' || pos || ': ' || nxt WHEN pos % 6 = 0 THEN 'Question ' || pos || '.' ELSE line END) AS title_md5 FROM
    (SELECT *, lead(line) OVER w AS nxt, lead(len(list_filter(string_split_regex(line, '\\s+'), lambda t: regexp_matches(t, '[\\p{{L}}\\p{{N}}]')))) OVER w AS nw FROM {_LINES} l WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) t WHERE pos % 3 = 0""",
)
def b11(spark, d):
    p = F.col("pos")
    b = S.line_blocks(_docs(spark, d)).withColumns({"kind": F.when(p % 3 == 0, "heading").otherwise("content"), "html": F.concat(F.lit("<p class=x><b>"), T.escape_html("text"), F.lit("</b></p>")), "text": F.when(p % 6 == 0, F.concat(F.lit("Question "), _text(p), F.lit("."))).otherwise(F.col("text"))})
    return S.heading_titles(b, ["doc_id"]).select("doc_id", "pos", F.md5(F.col("title").cast("binary")).alias("title_md5"))


@query("b14_demote_title_page", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'appendix' WHEN doc_id % 3 = 0 AND n_chars % 400 < 150 THEN 'front' ELSE 'chapter' END AS kind FROM {documents}")
def b14(spark, d):
    spans = _docs(spark, d).select("doc_id", F.col("source").alias("book"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" THE  BOOK\tOF "), "source")).otherwise(F.col("lang")).alias("title"), F.when(F.col("doc_id") % 5 == 0, "appendix").otherwise("chapter").alias("kind"), (F.col("n_chars") % 400).alias("words"))
    books = _docs(spark, d).select(F.col("source").alias("book"), F.concat(F.lit("The Book of "), "source").alias("title")).distinct()
    return S.demote_title_page(spans, books).select("doc_id", "kind")


@query(
    "l10_join_labels",
    f"""WITH e AS (SELECT doc_id AS doc, pos, pos // 5 AS page, CASE WHEN pos % 6 IN (0, 1) THEN CASE WHEN pos % 4 = 0 THEN 'SECTION ' ELSE 'Unit ' END || pos || ':' WHEN pos % 6 = 3 THEN '' || pos ELSE line END AS title FROM {_LINES} l),
    a AS (SELECT *, pos % 6 IN (0, 1) AND coalesce(lead(page) OVER w = page, false) AS lab, lead(title) OVER w AS nxt FROM e WINDOW w AS (PARTITION BY doc ORDER BY pos)),
    j AS (SELECT *, CASE WHEN pos % 6 = 0 THEN lab WHEN pos % 6 = 1 THEN lab AND NOT coalesce(lag(lab) OVER w, false) ELSE false END AS joins FROM a WINDOW w AS (PARTITION BY doc ORDER BY pos))
    SELECT doc, cast(pos AS bigint) AS pos, md5(CASE WHEN joins THEN title || ' ' || nxt ELSE title END) AS title_md5 FROM j QUALIFY NOT coalesce(lag(joins) OVER (PARTITION BY doc ORDER BY pos), false)""",
)
def l10(spark, d):
    p = F.col("pos")
    label = F.concat(F.when(p % 4 == 0, "SECTION ").otherwise("Unit "), _text(p), F.lit(":"))
    e = S.line_blocks(_docs(spark, d)).select(F.col("doc_id").alias("doc"), "pos", F.floor(p / 5).alias("page"), F.when((p % 6).isin(0, 1), label).when(p % 6 == 3, _text(p)).otherwise(F.col("text")).alias("title"))
    # lines that happen to look like labels would join as well
    e = e.withColumn("title", F.when((p % 6).isin(2, 4, 5) & F.col("title").rlike(S.LABEL), F.concat(F.lit("x "), "title")).otherwise(F.col("title")))
    return S.join_labels(e).select("doc", "pos", F.md5(F.col("title").cast("binary")).alias("title_md5"))


@query(
    "t4_glossary_entries",
    """WITH i AS (SELECT conv_id, turn, turn % 5 AS k, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM {conversations}), g AS (SELECT *, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, k < 3 ORDER BY turn) AS n FROM i),
    d AS (SELECT conv_id, min(turn) AS pos, 'Term ' || (min(turn) % 10) AS term, coalesce(string_agg('d' || turn, ' ' ORDER BY turn) FILTER (WHERE k > 0), '') AS definition FROM g WHERE k < 3 AND n > 0 GROUP BY conv_id, n),
    p AS (SELECT conv_id, turn AS pos, 'term ' || (turn % 4) AS term, 'said by ' || role AS definition FROM i WHERE k = 3), u AS (SELECT * FROM d UNION ALL SELECT * FROM p)
    SELECT conv_id, pos, term, definition FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, lower(term) ORDER BY pos) AS r FROM u) t WHERE r = 1""",
)
def t4(spark, d):
    k, t = F.col("turn") % 5, F.col("turn")
    tag = F.when(k == 0, "dt").when(k < 3, "dd").when(k == 3, "p").otherwise("h2")
    text = F.when(k == 0, F.concat(F.lit("Term "), _text(t % 10))).otherwise(F.concat(F.lit("d"), _text(t)))
    html = F.concat(F.lit(" <b>term <i>"), _text(t % 4), F.lit("</i></b>: said by "), "role")
    items = view(spark, d, "conversations").select("conv_id", F.col("turn").alias("pos"), tag.alias("tag"), text.alias("text"), html.alias("html"))
    return M.glossary_entries(items, "conv_id").select("conv_id", "pos", "term", "definition")


@query(
    "t5_index_entries",
    """SELECT pos, CASE WHEN pos % 4 = 0 THEN 'word ' || lang ELSE 'part of ' || lang || ' (word ' || up || ')' END AS term, CASE WHEN pos % 3 = 0 THEN NULL WHEN pos % 3 = 1 THEN '#a' || pos ELSE h END AS href FROM
    (SELECT d.doc_id AS pos, d.lang, p.lang AS up, unnest(CASE WHEN d.doc_id % 3 = 2 THEN ['#b' || d.doc_id, '#c' || d.doc_id] ELSE [''] END) AS h FROM {documents} d LEFT JOIN {documents} p ON d.doc_id % 4 <> 0 AND p.doc_id = d.doc_id - d.doc_id % 4) t""",
)
def t5(spark, d):
    i = F.col("doc_id")
    pages = F.when(i % 2 == 0, ", 12, 14-15").when(i % 7 == 0, " 3 – 5, 9").otherwise("")
    refs = F.when(i % 3 == 0, F.expr("cast(array() as array<string>)")).when(i % 3 == 1, F.array(F.concat(F.lit("#a"), _text(i)))).otherwise(F.array(F.concat(F.lit("#b"), _text(i)), F.concat(F.lit("#c"), _text(i))))
    items = _docs(spark, d).select(i.alias("pos"), F.when(i % 4 != 0, i - i % 4).alias("parent"), F.concat(F.when(i % 4 == 0, "word ").otherwise("part of "), "lang", pages).alias("text"), refs.alias("hrefs"))
    return M.index_entries(items)


#: Video ids and addresses from document ids.
_ID = "lpad(cast(doc_id AS varchar), 11, 'V')"


@query(
    "s7_parse_video_url",
    f"""SELECT doc_id, CASE WHEN doc_id % 8 IN (0, 1, 2, 3, 6) THEN 'video' WHEN doc_id % 8 = 4 THEN 'playlist' END AS kind, CASE WHEN doc_id % 8 IN (0, 1, 2, 3, 6) THEN {_ID} WHEN doc_id % 8 = 4 THEN 'PL' || {_ID} END AS id, CASE WHEN doc_id % 8 = 3 THEN 'PL' || {_ID} END AS playlist FROM {{documents}}""",
)
def s7(spark, d):
    i = F.col("doc_id") % 8
    vid = F.lpad(_text(F.col("doc_id")), 11, "V")
    url = (
        F.when(i == 0, F.concat(F.lit("https://youtu.be/"), vid, F.lit("?t=5")))
        .when(i == 1, F.concat(F.lit("http://www.youtube.com/watch?v="), vid))
        .when(i == 2, F.concat(F.lit(" https://m.youtube.com/shorts/"), vid))
        .when(i == 3, F.concat(F.lit("https://youtube.com/watch?list=PL"), vid, F.lit("&v="), vid))
        .when(i == 4, F.concat(F.lit("https://music.youtube.com/playlist?list=PL"), vid))
        .when(i == 5, F.concat(F.lit("https://example.com/watch?v="), vid))
        .when(i == 6, F.concat(F.lit("https://www.youtube.com/embed/"), vid, F.lit("/")))
        .otherwise(F.concat(F.lit("https://youtu.be/x"), vid))
    )
    return _docs(spark, d).select("doc_id", T.parse_video_url(url).alias("v")).select("doc_id", "v.kind", "v.id", "v.playlist")


@query(
    "s8_time_links",
    f"""SELECT doc_id, 'https://www.youtube.com/watch?v=' || {_ID} AS video, 'https://www.youtube.com/watch?v=' || {_ID} || '&t=' || (n_chars // 7) || 's' AS at, CASE WHEN doc_id % 4 <> 0 THEN {_ID} END AS id, CASE WHEN doc_id % 4 <> 0 THEN n_chars // 7 END AS start FROM {{documents}}""",
)
def s8(spark, d):
    vid = F.lpad(_text(F.col("doc_id")), 11, "V")
    at = T.time_url(vid, F.col("n_chars") / 7)
    link = F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("see [1:02]("), at, F.lit(") and [more](https://www.youtube.com/watch?v=aaaaaaaaaaa&t=1s)"))).otherwise(F.concat(F.lit("no link: "), at))
    return _docs(spark, d).select("doc_id", T.video_url(vid).alias("video"), at.alias("at"), T.time_link(link).alias("l")).select("doc_id", "video", "at", "l.id", F.col("l.start").cast("long").alias("start"))


@query(
    "s11_page_number",
    "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN CASE WHEN doc_id < 10000 THEN cast(doc_id AS varchar) END WHEN 1 THEN 'xiv' WHEN 2 THEN 'MCMXCIX' WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE CASE WHEN doc_id < 10000 THEN cast(doc_id AS varchar) END END AS page FROM {documents}",
)
def s11(spark, d):
    i = F.col("doc_id")
    shown = F.when(i % 6 == 0, F.concat(F.lit("- "), _text(i), F.lit(" -"))).when(i % 6 == 1, " [xiv] ").when(i % 6 == 2, "MCMXCIX").when(i % 6 == 3, "iixx").when(i % 6 == 4, F.concat(F.lit("Page "), _text(i))).otherwise(_text(i))
    return _docs(spark, d).select("doc_id", T.page_number(shown).alias("page"))


@query(
    "s13_strip_mdx",
    "SELECT doc_id, md5(chr(10) || 'a ' || lang || ' b' || chr(10) || '```js' || chr(10) || 'import x from \"y\"' || chr(10) || '<Tab/>' || chr(10) || '```' || chr(10) || 'text ' || doc_id || chr(10) || chr(10) || '<p>kept</p>') AS text_md5 FROM {documents}",
)
def s13(spark, d):
    body = F.concat(F.lit("import A from 'a'\na <Card title=\"x\">"), "lang", F.lit("</Card> b\n```js\nimport x from \"y\"\n<Tab/>\n```\ntext "), _text(F.col("doc_id")), F.lit("\nexport const y = 1\n<p>kept</p>"))
    return _docs(spark, d).select("doc_id", F.md5(T.strip_mdx(body).cast("binary")).alias("text_md5"))


@query("s14_split_authors", "SELECT doc_id, unnest(CASE doc_id % 3 WHEN 0 THEN ['A ' || lang, source, 'Andy Sand'] WHEN 1 THEN ['A ' || lang, source] ELSE ['A ' || lang] END) AS author FROM {documents}")
def s14(spark, d):
    i, a = F.col("doc_id") % 3, F.concat(F.lit("A "), "lang")
    names = F.when(i == 0, F.concat(a, F.lit(" , "), "source", F.lit(" and Andy Sand"))).when(i == 1, F.concat(a, F.lit("; "), "source", F.lit(" & "))).otherwise(a)
    return _docs(spark, d).select("doc_id", F.explode(T.split_authors(names)).alias("author"))


@query(
    "s15_resolve_href",
    "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'b/text/' || lang || '.html' WHEN 1 THEN 'b/img/a b.png' WHEN 2 THEN 'b/text/x/y.html' ELSE 'z.html' END AS file, CASE doc_id % 4 WHEN 0 THEN 'p ' || doc_id WHEN 2 THEN '' END AS anchor FROM {documents}",
)
def s15(spark, d):
    i = F.col("doc_id")
    base = F.concat(F.lit("b/text/"), "lang", F.lit(".html"))
    href = F.when(i % 4 == 0, F.concat(F.lit("#p%20"), _text(i))).when(i % 4 == 1, "../img/./a%20b.png").when(i % 4 == 2, "x/../x/y.html#").otherwise("../../z.html")
    return _docs(spark, d).select("doc_id", T.resolve_href(base, href).alias("h")).select("doc_id", "h.file", "h.anchor")


@query("s16_folder_title", "SELECT doc_id, 'Set ' || lang || ' of parts ' || doc_id AS title FROM {documents}")
def s16(spark, d):
    return _docs(spark, d).select("doc_id", T.folder_title(F.concat(F.lit("set-"), "lang", F.lit("__of%20parts-"), _text(F.col("doc_id")))).alias("title"))


@query("s19_sniff_image_type", "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/gif' WHEN 3 THEN 'image/webp' END AS type FROM {documents}")
def s19(spark, d):
    i = F.col("doc_id") % 6
    head = F.when(i == 0, "89504E470D0A1A0A").when(i == 1, "FFD8FFE0").when(i == 2, "474946383961").when(i == 3, "52494646AABBCCDD57454250").when(i == 4, "52494646AABBCCDD41564920").otherwise("")
    return _docs(spark, d).select("doc_id", T.sniff_image_type(F.concat(F.unhex(head), F.col("text").cast("binary"))).alias("type"))


#: Queues of up to 400 concepts, with the prerequisites that lie in the same queue.
_STUDY = "SELECT id // 400 AS subject_id, id, module, level, status, queue_pos FROM {v_concepts}"
_NEEDS = "SELECT DISTINCT concept_id, concept_id // 400 * 400 + prereq_id % 400 AS prereq_id FROM {v_prereqs} WHERE concept_id <> concept_id // 400 * 400 + prereq_id % 400"


@query(
    "q3_suggested_order",
    f"""WITH RECURSIVE s AS ({_STUDY}), e AS ({_NEEDS}), q AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY module, CASE level WHEN 'basic' THEN 1 WHEN 'intermediate' THEN 2 ELSE 3 END, queue_pos, id) AS rank FROM s WHERE status IN ('queued', 'learning')),
    n AS (SELECT q.subject_id, q.id, q.rank, coalesce(list(e.prereq_id) FILTER (WHERE p.id IS NOT NULL), []) AS needs FROM q LEFT JOIN e ON e.concept_id = q.id LEFT JOIN q p ON p.id = e.prereq_id AND p.subject_id = q.subject_id GROUP BY 1, 2, 3),
    l AS (SELECT subject_id, list({{'id': id, 'needs': needs}} ORDER BY rank) AS items FROM n GROUP BY 1),
    t(subject_id, k, items, placed) AS (SELECT subject_id, 0, items, cast([] AS bigint[]) FROM l
    UNION ALL SELECT subject_id, k + 1, list_filter(items, lambda x: x.id <> nxt), list_append(placed, nxt) FROM (SELECT *, coalesce(list_filter(items, lambda x: len(list_filter(x.needs, lambda y: NOT list_contains(placed, y))) = 0)[1].id, items[1].id) AS nxt FROM t WHERE len(items) > 0) u)
    SELECT subject_id, unnest(placed) AS id, unnest(range(1, len(placed) + 1)) AS position FROM t WHERE len(items) = 0""",
)
def q3(spark, d):
    c, p = view(spark, d, "v_concepts"), view(spark, d, "v_prereqs")
    block = F.floor(F.col("concept_id") / 400) * 400
    needs = p.select("concept_id", (block + F.col("prereq_id") % 400).alias("prereq_id")).where("concept_id <> prereq_id").distinct()
    return L.suggested_order(c.withColumn("subject_id", F.floor(F.col("id") / 400)), needs)


@query("st2_ingest_chapters", "SELECT book_id, chapter, sha1_hex AS fingerprint FROM (SELECT book_id, chapter, sha1('v1' || chr(10) || string_agg(number || ':' || section_id || ' ' || words, chr(10) ORDER BY number)) AS sha1_hex FROM {v_sections} GROUP BY 1, 2) t")
def st2(spark, d):
    """Two deliveries of all chapters, each one batch of as many files as its size asks for: the second one, in another order of files, is worked on no more."""
    base = f"{own_dir(spark)}/ingest-{uuid.uuid4().hex}"
    kinds = "book_id long, chapter long, number long, body string"
    s = view(spark, d, "v_sections").select("book_id", "chapter", "number", F.concat_ws(" ", _text(F.col("section_id")), _text(F.col("words"))).alias("body"))
    s.repartition("book_id", "chapter").write.parquet(f"{base}/in")
    args = (spark, f"{base}/in", kinds, lambda df: D.chapter_fingerprint(df, "v1"), ["book_id", "chapter"], f"{base}/manifest", f"{base}/work", f"{base}/state", None)
    ingest_chapters(*args)
    spark.read.schema(kinds).parquet(f"{base}/in").repartition("chapter", "book_id").write.mode("append").parquet(f"{base}/in")
    ingest_chapters(*args)
    shape = D.chapter_fingerprint(s, "v1").schema
    return ingested(spark, shape, ["book_id", "chapter"], f"{base}/manifest", f"{base}/work").select("book_id", "chapter", "fingerprint")
