"""Queries over blocks, sections and layout items."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions.text import count_words
from quillspan.operators import structure as S
from quillspan.plans.adapters import view
from quillspan.plans.registry import query
from quillspan.sources.tables import page_text, to_lines

_WORDS = "cast(len(list_filter(string_split_regex({}, '\\s+'), lambda t: regexp_matches(t, '[\\p{{L}}\\p{{N}}]'))) AS bigint)"
_LINES = "(SELECT doc_id, source, unnest(range(0, len(ls))) AS pos, unnest(ls) AS line FROM (SELECT doc_id, source, string_split_regex(text, '\\r?\\n') AS ls FROM {documents}) s)"
_BLOCKS = f"(SELECT doc_id, source, pos, line AS text, CASE WHEN pos = 0 THEN 'heading' ELSE 'content' END AS kind, {_WORDS.format('line')} AS words FROM {_LINES} l)"


def _docs(spark, d):
    return view(spark, d, "documents")


def _blocks(spark, d):
    return S.line_blocks(_docs(spark, d))


def _items(spark, d):
    return S.items_of(_blocks(spark, d).join(_docs(spark, d).select("doc_id", "source"), "doc_id"))


@query("io2_lines", f"SELECT doc_id, cast(pos AS bigint) AS pos, md5(line) AS line_md5 FROM {_LINES} t")
def io2(spark, d):
    return to_lines(_docs(spark, d), "doc_id").select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5(F.col("line").cast("binary")).alias("line_md5"))


@query("s2_count_words", f"SELECT doc_id, {_WORDS.format('text')} AS words FROM {{documents}}")
def s2(spark, d):
    return _docs(spark, d).select("doc_id", count_words("text").alias("words"))


@query("io3_page_words", "SELECT page_id, " + _WORDS.format("regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)^.*?<body[^>]*>', ''), '(?is)<script\\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g')") + " AS words FROM {pages}")
def io3(spark, d):
    return view(spark, d, "pages").select("page_id", count_words(page_text("html")).alias("words"))


_BODY = "regexp_replace(html, '(?is)^.*?<body[^>]*>', '')"
for _t in ("script", "style", "nav", "template", "noscript"):
    _BODY = f"regexp_replace({_BODY}, '(?is)<{_t}\\b[^>]*>.*?</{_t}>', ' ', 'g')"
_TAGS = "(p|h[1-6]|li|div|article|footer|ul|ol|dt|dd|tr)"
#: A separator before each block tag and instead of each end tag.
_PARTS = f"string_split(regexp_replace(regexp_replace(regexp_replace({_BODY}, '(?s)<!--.*?-->', ' ', 'g'), '(?i)</{_TAGS}>', chr(1), 'g'), '(?i)(<{_TAGS}\\b)', chr(1) || '\\1', 'g'), chr(1))"


def _html_sql(pages: str, more: str = "") -> str:
    """Blocks of pages as SQL, with further columns of the pages."""
    rows = f"SELECT page_id{more}, unnest({_PARTS}) AS html, unnest(range(0, len({_PARTS}))) AS k FROM {pages} p"
    text = f"SELECT *, regexp_extract(html, '(?i)^<h([1-6])\\b', 1) AS h, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM ({rows}) r"
    words = _WORDS.format("text")
    return f"(SELECT page_id{more}, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS pos, CASE WHEN h <> '' THEN 'heading' ELSE 'content' END AS kind, CASE WHEN h <> '' THEN cast(h AS bigint) ELSE 0 END AS level, text, html, {words} AS words FROM ({text}) t WHERE text <> '')"


@query("b1_html_blocks", f"SELECT page_id, pos, kind, level, text, words FROM {_html_sql('{pages}')} b")
def b1(spark, d):
    return S.html_blocks(view(spark, d, "pages")).select("page_id", "pos", "kind", "level", "text", "words")


@query("b2_page_at", f"SELECT doc_id, cast(pos AS bigint) AS pos, last_value(CASE WHEN pos % 3 = 0 THEN 'p' || pos END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS page FROM {_LINES} t")
def b2(spark, d):
    b = _blocks(spark, d).withColumn("label", F.when(F.col("pos") % 3 == 0, F.concat(F.lit("p"), F.col("pos").cast("string"))))
    return S.page_at(b, ["doc_id"], "pos", "label").select("doc_id", "pos", "page")


_SPLIT = f"(SELECT *, cast(sum(CASE WHEN pos > 0 AND words <= 4 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS bigint) AS section FROM {_BLOCKS} b)"


def _split(spark, d):
    b = _blocks(spark, d).withColumn("kind", F.when((F.col("pos") == 0) | (F.col("words") <= 4), "heading").otherwise("content")).withColumn("level", F.when(F.col("pos") == 0, 1).otherwise(2))
    return S.split_sections(b, ["doc_id"])


@query("b6_split_sections", f"SELECT doc_id, cast(pos AS bigint) AS pos, section FROM {_SPLIT} s")
def b6(spark, d):
    return _split(spark, d).select("doc_id", "pos", "section")


_SECT = f"(SELECT doc_id, section, cast(sum(words) AS bigint) AS words, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS text, min(pos) AS start FROM {_SPLIT} s GROUP BY 1, 2)"


@query("b7_merge_small", f"SELECT doc_id, section, greatest(cast(sum(CASE WHEN words >= 40 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY section) AS bigint), 1) AS merged FROM {_SECT} t")
def b7(spark, d):
    s = _split(spark, d).groupBy("doc_id", "section").agg(F.sum("words").alias("words"))
    return S.merge_small(s, ["doc_id"]).select("doc_id", "section", "merged")


@query(
    "b9_split_by_size",
    f"""WITH RECURSIVE b AS (SELECT doc_id, pos, words FROM {_BLOCKS} x), r AS (SELECT doc_id, pos, words AS total, cast(1 AS bigint) AS part FROM b WHERE pos = 0
    UNION ALL SELECT b.doc_id, b.pos, CASE WHEN r.total > 0 AND r.total + b.words > 200 THEN b.words ELSE r.total + b.words END, CASE WHEN r.total > 0 AND r.total + b.words > 200 THEN r.part + 1 ELSE r.part END FROM r JOIN b ON b.doc_id = r.doc_id AND b.pos = r.pos + 1)
    SELECT doc_id, cast(pos AS bigint) AS pos, part FROM r""",
)
def b9(spark, d):
    return S.split_by_size(_blocks(spark, d), ["doc_id"], 200)


@query("b10_assemble_sections", f"SELECT doc_id, section, words, cast(start AS bigint) AS start, md5(text) AS text_md5 FROM {_SECT} t")
def b10(spark, d):
    s = S.assemble_sections(_split(spark, d), ["doc_id", "section"])
    return s.select("doc_id", "section", "words", "start", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(
    "b12_group_sections",
    """WITH RECURSIVE b AS (SELECT book_id, chapter, number, cast(ceil(words * 1.4) AS bigint) AS t FROM {v_sections}), r AS (SELECT book_id, chapter, number, t AS total, 1 AS n, cast(1 AS bigint) AS grp FROM b WHERE number = 1
    UNION ALL SELECT b.book_id, b.chapter, b.number, CASE WHEN r.n >= 2 OR r.total + b.t > 2500 THEN b.t ELSE r.total + b.t END, CASE WHEN r.n >= 2 OR r.total + b.t > 2500 THEN 1 ELSE r.n + 1 END, CASE WHEN r.n >= 2 OR r.total + b.t > 2500 THEN r.grp + 1 ELSE r.grp END
    FROM r JOIN b ON b.book_id = r.book_id AND b.chapter = r.chapter AND b.number = r.number + 1) SELECT book_id, chapter, number, grp FROM r""",
)
def b12(spark, d):
    return S.group_sections(view(spark, d, "v_sections"), ["book_id", "chapter"], 2, 2500)


@query("b8_refine")
def b8(spark, d):
    blocks = _split(spark, d).select("doc_id", "pos", "kind", "level", "words", "section")
    return S.refine(blocks, ["doc_id"], 300, 40).groupBy("doc_id", "path", "part").agg(F.sum("words").alias("words"), F.min("pos").alias("start"))


@query("b3_chapter_spans", f"SELECT doc_id AS book, cast(pos AS bigint) AS start, cast(coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos), n) AS bigint) AS \"end\" FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id) AS n FROM {_LINES} l) t QUALIFY pos = 0 OR pos % 4 = 2".replace("coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos), n)", "coalesce(min(CASE WHEN pos % 4 = 2 THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), n)"))
def b3(spark, d):
    b = _blocks(spark, d)
    starts = b.where("pos % 4 = 2").select(F.col("doc_id").alias("book"), F.col("pos").alias("entry"), F.col("text").alias("title"), "pos")
    ends = b.groupBy(F.col("doc_id").alias("book")).agg(F.count(F.lit(1)).alias("n"))
    alone = ends.join(starts, "book", "left_anti").select("book", F.lit(0).cast("long").alias("entry"), F.lit("All").alias("title"), F.lit(0).cast("long").alias("pos"))
    return S.chapter_spans(starts.unionAll(alone), ends).select("book", "start", "end")


@query(
    "j6_locate",
    f"""WITH b AS (SELECT 'f' || doc_id % 50 AS file, md5(substring(text, 1, 5)) AS anchor, doc_id * 10000 + pos AS pos FROM {_BLOCKS} x), t AS (SELECT DISTINCT file, CASE WHEN pos % 2 = 0 THEN anchor ELSE 'none' END AS anchor FROM b WHERE pos % 7 = 0),
    a AS (SELECT file, anchor, min(pos) AS pos FROM b GROUP BY 1, 2), f AS (SELECT file, min(pos) AS pos FROM b GROUP BY 1) SELECT t.file, t.anchor, coalesce(a.pos, f.pos) AS pos FROM t LEFT JOIN a ON a.file = t.file AND a.anchor = t.anchor LEFT JOIN f ON f.file = t.file""",
)
def j6(spark, d):
    b = _blocks(spark, d).select(F.concat(F.lit("f"), (F.col("doc_id") % 50).cast("string")).alias("file"), F.array(F.md5(F.substring("text", 1, 5).cast("binary"))).alias("anchors"), (F.col("doc_id") * 10000 + F.col("pos")).alias("pos"))
    targets = b.where("pos % 7 = 0").select("file", F.when(F.col("pos") % 2 == 0, F.get("anchors", F.lit(0))).otherwise("none").alias("anchor")).distinct()
    return S.locate(targets, b)


#: A book per document: every third line is an entry, every ninth has no target, each second of the others points two lines back; texts of no such line have no entry.
_TOC = f"(SELECT doc_id AS book, pos AS entry, CASE WHEN pos % 9 = 4 THEN NULL WHEN pos % 2 = 0 THEN pos - 2 ELSE pos END AS pos FROM {_LINES} l WHERE pos % 3 = 1)"


def _toc(spark, d):
    p = F.col("pos")
    return _blocks(spark, d).where(p % 3 == 1).select(F.col("doc_id").alias("book"), p.alias("entry"), F.col("text").alias("title"), F.when(p % 9 == 4, None).when(p % 2 == 0, p - 2).otherwise(p).alias("pos"))


@query("b13_toc_warnings", f"SELECT book, entry, CASE WHEN pos IS NULL THEN 'toc_target_missing' ELSE 'toc_order' END AS code FROM (SELECT *, max(pos) OVER (PARTITION BY book ORDER BY entry ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM {_TOC} t) u WHERE pos IS NULL OR pos < top")
def b13t(spark, d):
    return S.order_warnings(_toc(spark, d))


@query(
    "b3_file_chapters",
    f"""WITH b AS (SELECT doc_id AS book, pos, 'f' || pos // 5 AS file, line, CASE WHEN pos % 5 = 1 THEN 'heading' ELSE 'content' END AS kind FROM {_LINES} l), t AS (SELECT book, entry, pos FROM {_TOC} t WHERE pos IS NOT NULL AND book % 2 = 0)
    SELECT book, entry, pos, NULL AS title FROM t UNION ALL SELECT book, row_number() OVER (PARTITION BY book ORDER BY min(pos)), min(pos), coalesce(arg_min(line, pos) FILTER (WHERE kind = 'heading' AND line <> ''), file) FROM b WHERE book NOT IN (SELECT book FROM t) GROUP BY book, file""",
)
def b3f(spark, d):
    p = F.col("pos")
    b = _blocks(spark, d).select(F.col("doc_id").alias("book"), "pos", F.concat(F.lit("f"), F.floor(p / 5).cast("string")).alias("file"), "text", F.when(p % 5 == 1, "heading").otherwise("content").alias("kind"))
    starts = _toc(spark, d).where("book % 2 = 0").withColumn("title", F.lit(None).cast("string"))
    return S.starts_or_files(starts, b).select("book", "entry", "pos", "title")


@query("b13_quality_warnings", f"SELECT doc_id, code FROM (SELECT doc_id, unnest(['empty_section', 'lost_text', 'size_split']) AS code, w, s FROM (SELECT doc_id, {_WORDS.format('text')} AS w, n_chars / 5 AS s FROM {{documents}}) a) b WHERE code = 'empty_section' AND w = 0 OR code = 'lost_text' AND s >= 30 AND w < s * 0.9 OR code = 'size_split' AND w > 500")
def b13(spark, d):
    s = _docs(spark, d).select("doc_id", count_words("text").alias("words"), (F.col("n_chars") / 5).alias("source_words"))
    return S.quality_warnings(s, "doc_id", 500)


_ACROSS = f"(SELECT doc_id, pos, line AS text, NOT regexp_matches(lag(line) OVER (PARTITION BY doc_id ORDER BY pos), '[.!?:;]\\s*$') AND regexp_matches(line, '^\\s*\\p{{Ll}}') AS on_ FROM {_LINES} l)"


@query("b15_join_across_pages", f"SELECT doc_id, para, md5(string_agg(text, ' ' ORDER BY pos)) AS text_md5 FROM (SELECT *, cast(sum(CASE WHEN on_ THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS bigint) AS para FROM {_ACROSS} a) t GROUP BY 1, 2")
def b15(spark, d):
    got = S.join_across_pages(_blocks(spark, d), ["doc_id"])
    return got.select("doc_id", "para", F.md5(F.col("text").cast("binary")).alias("text_md5"))


_MAIN = "(SELECT page_id, title, coalesce(" + ", ".join(f"nullif(regexp_extract(html, '(?is)<{t}\\b[^>]*>(.*?)</{t}>', 1), '')" for t in ("main", "article", "body")) + ", html) AS html FROM (SELECT page_id, html, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title FROM {pages}) q)"


#: Put at the end of every article: elements inside elements of their kind and hidden ones, all to go, an anchor mark, a heading with a block inside, levels above and far below the first.
_NESTED = """<nav>a<nav>b</nav>c</nav><div hidden>x<div>y</div>z</div><svg><g><svg></svg>t</g></svg><form>q<label>l</label><p>f</p></form><h3>Part {id}<a href="#p">¶</a></h3><p class="x hidden y">Kept<br>line</p><h2><div>Sum</div> up</h2><dialog><h1>no</h1></dialog><h6>Far down</h6>"""
def _plain(c: str) -> str:
    """SQL for a text with its character references as characters."""
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        c = f"replace({c}, '{a}', '{b}')"
    return c


#: Key of a title: accents off, lower case, letters, digits, + and #.
_KEY = "regexp_replace(lower(strip_accents({})), '[^\\p{{L}}\\p{{N}}+#]', '', 'g')"


@query(
    "b16_clean_pages",
    f"""WITH b AS (SELECT page_id, title, pos, kind, level, {_plain('text')} AS text, words, min(CASE WHEN kind = 'heading' THEN pos END) OVER (PARTITION BY page_id) AS first FROM {_html_sql(_MAIN, ", title")} x),
    k AS (SELECT * FROM b WHERE first IS NULL OR NOT (kind = 'heading' AND pos = first AND {_KEY.format("text")} = {_KEY.format(_plain("title"))})),
    t AS (SELECT page_id, count(*) AS n, arg_min(level, pos) FILTER (WHERE kind = 'heading') AS top FROM k GROUP BY 1),
    base AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS pos, kind, CASE WHEN kind = 'heading' THEN least(greatest(level - top + 2, 2), 6) ELSE 0 END AS level, text, words FROM k JOIN t USING (page_id)),
    a AS (SELECT p.page_id, coalesce(n, 0) + x.k AS pos, x.kind, CASE WHEN x.kind = 'heading' THEN least(greatest(x.level - coalesce(top, 3) + 2, 2), 6) ELSE 0 END AS level, replace(x.text, '{{id}}', cast(p.page_id AS VARCHAR)) AS text, 2 AS words
    FROM {{pages}} p LEFT JOIN t USING (page_id), (VALUES (0, 'heading', 3, 'Part {{id}}'), (1, 'content', 0, 'Kept line'), (2, 'heading', 2, 'Sum up'), (3, 'heading', 6, 'Far down')) x(k, kind, level, text) WHERE contains(html, '</article>'))
    SELECT * FROM base UNION ALL SELECT * FROM a""",
)
def b16(spark, d):
    added = F.replace(F.lit(_NESTED), F.lit("{id}"), F.col("page_id").cast("string"))
    return S.clean_pages(view(spark, d, "pages").withColumn("html", F.replace("html", F.lit("</article>"), F.concat(added, F.lit("</article>")))))


_MD = "html"
for _p, _r in (("(?is)<(?:b|strong)>(.*?)</(?:b|strong)>", "**\\1**"), ("(?is)<(?:i|em)>(.*?)</(?:i|em)>", "*\\1*"), ("(?is)<code>(.*?)</code>", "`\\1`"), ('(?is)<a [^>]*href="(https?://[^"]+)"[^>]*>(.*?)</a>', "[\\2](\\1)"), ("(?i)^<li[^>]*>", "- "), ("<[^>]+>", "")):
    _MD = f"regexp_replace({_MD}, '{_p}', '{_r}', 'g')"


@query("b17_blocks_markdown", f"SELECT page_id, pos, CASE WHEN kind = 'heading' THEN repeat('#', cast(level AS integer)) || ' ' ELSE '' END || trim(regexp_replace({_MD}, '\\s+', ' ', 'g')) AS markdown FROM {_html_sql('{pages}')} b")
def b17(spark, d):
    return S.blocks_markdown(S.html_blocks(view(spark, d, "pages")))


#: Titles and types of a chapter with the kind they give.
_KINDS = (
    ("Glossary of terms", "chapter", "glossary"), ("Appendix B", "chapter", "appendix"), ("Preface to it", "chapter", "front"), ("Further Reading", "chapter", "back"), ("General Index", "chapter", "index"),
    ("Words", "toc", "front"), ("Words", "chapter", "chapter"), ("Part one", "chapter", "chapter"), ("Words", "glossary", "glossary"), ("Words", "index", "index"), ("Words", "backmatter", "back"), ("Words", None, "chapter"),
)


@query("p8_classify_kind", "SELECT doc_id, CASE doc_id % 12 " + " ".join(f"WHEN {k} THEN '{kind}'" for k, (_, _, kind) in enumerate(_KINDS)) + " END AS kind FROM {documents}")
def p8(spark, d):
    at = (F.col("doc_id") % len(_KINDS)).cast("int")
    pick = lambda j: F.get(F.array(*[F.lit(x[j]) for x in _KINDS]), at)
    docs = _docs(spark, d).select("doc_id", pick(0).alias("title"), F.when(pick(1).isNotNull(), F.array(pick(1))).alias("types"))
    return docs.select("doc_id", S.classify_kind("title", "types").alias("kind"))


@query("l1_group_lines", f"SELECT source AS doc, doc_id AS page, cast(pos + 1 AS bigint) AS line, md5(line) AS text_md5 FROM {_LINES} l")
def l1(spark, d):
    return S.group_lines(_items(spark, d)).select("doc", "page", "line", F.md5(F.col("text").cast("binary")).alias("text_md5"))


#: Lines of the documents as layout lines, from the top down; the first two and the last two are margins.
#: A page per document: a head of one or two items at slightly different heights, three body lines; on every fourth page the head is no farther from these than they are from each other, on every fifth it is code.
_HEAD = """(SELECT *, CASE WHEN number IS NULL THEN title ELSE title || ' ' || number END AS text FROM (SELECT source AS doc, doc_id AS page, CASE WHEN doc_id % 4 = 0 THEN 754.0 ELSE 800.0 + doc_id % 7 * 0.75 END AS y,
    CASE WHEN doc_id % 2 = 0 THEN 'GUIDE to ' ELSE 'Guide to ' END || lang AS title, CASE WHEN doc_id % 2 = 1 OR doc_id % 7 > 4 THEN cast(doc_id % 1000 AS varchar) END AS number, doc_id % 5 = 0 AS code FROM {documents}) h)"""


@query(
    "l2_running_lines",
    f"""WITH h AS (SELECT * FROM {_HEAD} x), p AS (SELECT doc, count(*) AS pages FROM h GROUP BY 1), c AS (SELECT *, y > min(y) OVER (PARTITION BY doc) + 3 AS band, regexp_replace(lower(text), '[0-9]+', '#', 'g') AS masked FROM h WHERE page % 4 <> 0 AND NOT code),
    b AS (SELECT doc, band, count(*) AS n, avg(CASE WHEN number IS NULL THEN 0.0 ELSE 1.0 END) AS numbered FROM c GROUP BY 1, 2), o AS (SELECT doc, band, masked, count(*) AS times FROM c GROUP BY 1, 2, 3)
    SELECT c.doc, c.page, 1 AS line, c.text, CASE WHEN numbered >= 0.5 THEN c.number END AS number FROM c JOIN b USING (doc, band) JOIN o USING (doc, band, masked) JOIN p USING (doc) WHERE n >= greatest(3, ceil(pages * 0.25)) AND (numbered >= 0.5 AND c.number IS NOT NULL OR times >= 3)""",
)
def l2(spark, d):
    i = F.col("doc_id")
    y = F.when(i % 4 == 0, 754.0).otherwise(800.0 + i % 7 * 0.75)
    title = F.concat(F.when(i % 2 == 0, "GUIDE to ").otherwise("Guide to "), "lang")
    number = F.when((i % 2 == 1) | (i % 7 > 4), (i % 1000).cast("string"))
    item = lambda idx, text, x, y, mono: F.struct(F.lit(idx).alias("idx"), text.alias("str"), F.lit(x).alias("x"), y.alias("y"), mono.alias("mono"))
    body = [item(2 + k, F.concat(F.lit(f"body {k} "), i.cast("string")), 72.0, F.lit(740.0 - 14 * k), F.lit(False)) for k in range(3)]
    items = F.filter(F.array(item(0, title, 72.0, y, i % 5 == 0), item(1, number, 300.0, y, i % 5 == 0), *body), lambda x: x["str"].isNotNull())
    rows = _docs(spark, d).select(F.col("source").alias("doc"), i.alias("page"), F.explode(items).alias("x")).select("doc", "page", "x.*", F.lit(40.0).alias("width"), F.lit(10.0).alias("size"))
    return S.running_lines(S.group_lines(rows))


@query("l3_body_size", f"SELECT doc, max_by(size, (chars, size)) AS body FROM (SELECT source AS doc, CASE WHEN pos = 0 THEN 18.0::DOUBLE ELSE 10.0::DOUBLE END AS size, sum(length(line)) AS chars FROM {_LINES} l GROUP BY 1, 2) t GROUP BY 1")
def l3(spark, d):
    return S.body_size(_items(spark, d))


@query(
    "l4_heading_levels",
    f"""WITH i AS (SELECT source AS doc, CASE WHEN pos = 0 THEN 12.0::DOUBLE + doc_id % 5 ELSE 10.0::DOUBLE END AS size, length(line) AS c FROM {_LINES} l), b AS (SELECT doc, max_by(size, (c, size)) AS body FROM (SELECT doc, round(size * 2) / 2 AS size, sum(c) AS c FROM i GROUP BY 1, 2) t GROUP BY 1),
    s AS (SELECT DISTINCT doc, size FROM i JOIN b USING (doc) WHERE size >= 1.15 * body) SELECT doc, size, cast(least(1 + sum(CASE WHEN size < 0.96 * before THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY size DESC), 6) AS bigint) AS level FROM (SELECT *, lag(size) OVER (PARTITION BY doc ORDER BY size DESC) AS before FROM s) t""",
)
def l4(spark, d):
    i = _items(spark, d)
    return S.heading_levels(i.withColumn("size", F.when(F.col("idx") == 0, 12.0 + F.col("page") % 5).otherwise(F.col("size"))))


@query(
    "l8_largest_text",
    f"""WITH p AS (SELECT source AS doc, doc_id AS page, dense_rank() OVER (PARTITION BY source ORDER BY doc_id) AS r, pos, line FROM {_LINES} l), t AS (SELECT doc, page, CASE WHEN pos = 0 THEN 18 ELSE 10 END AS size, trim(regexp_replace(string_agg(line, ' ' ORDER BY pos), '\\s+', ' ', 'g')) AS text FROM p WHERE r <= 5 GROUP BY 1, 2, 3)
    SELECT doc, max_by(text, (size, -page)) AS title FROM t WHERE length(text) BETWEEN 3 AND 150 AND NOT regexp_matches(text, '{S.FRONT_TITLE}') AND NOT regexp_matches(text, '{S.BACK_TITLE}') GROUP BY 1""",
)
def l8(spark, d):
    return S.largest_text(_items(spark, d))


@query("l11_join_hyphenated", "SELECT doc_id, md5(regexp_replace(replace(text, ' ', '-' || chr(10)), '(\\p{L})-\\n(\\p{Ll})', '\\1\\2', 'g')) AS text_md5 FROM {documents}")
def l11(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(S.join_hyphenated(F.replace("text", F.lit(" "), F.lit("-\n"))).cast("binary")).alias("text_md5"))


@query("l12_boilerplate_lines", f"SELECT source, line, docs FROM (SELECT source, line, count(*) AS docs FROM (SELECT DISTINCT source, doc_id, regexp_replace(trim(line), '[0-9]+', '#', 'g') AS line FROM {_LINES} l) a WHERE line <> '' GROUP BY 1, 2) b JOIN (SELECT source, count(*) AS n FROM {{documents}} GROUP BY 1) c USING (source) WHERE docs >= greatest(3, n * 0.02)")
def l12(spark, d):
    return S.boilerplate_lines(_docs(spark, d), share=0.02)


@query("l9_lossy_pages", f"SELECT source AS doc, doc_id AS page, w AS words, k AS kept FROM (SELECT source, doc_id, {_WORDS.format('text')} AS w, cast(floor(n_chars / 6) AS bigint) AS k FROM {{documents}}) t WHERE w >= 30 AND k < 0.9 * w")
def l9(spark, d):
    return S.lossy_pages(_docs(spark, d).select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), count_words("text").alias("words"), F.floor(F.col("n_chars") / 6).alias("kept")))


@query("l13_page_labels", "SELECT source AS doc, doc_id AS page, CASE WHEN source = 'src0' THEN cast(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS varchar) WHEN doc_id % 2 = 0 THEN 'p' || doc_id ELSE 'f' || doc_id END AS label FROM {documents}")
def l13(spark, d):
    has = F.col("source") != "src0"
    p = _docs(spark, d).select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.when(has & (F.col("doc_id") % 2 == 0), F.concat(F.lit("p"), F.col("doc_id").cast("string"))).alias("label"), F.when(has, F.concat(F.lit("f"), F.col("doc_id").cast("string"))).alias("footer"))
    return S.page_labels(p)


@query("j13_place_anchors", f"SELECT a.source AS doc, a.doc_id AS page, a.pos AS anchor, max_by(b.pos, (-14 * b.pos, -b.pos)) AS pos FROM {_LINES} a LEFT JOIN {_LINES} b ON a.doc_id = b.doc_id AND -14 * b.pos <= -14 * a.pos + 4 + 7 WHERE a.pos % 5 = 0 GROUP BY 1, 2, 3")
def j13(spark, d):
    i = _items(spark, d)
    blocks = i.select("doc", "page", F.col("idx").alias("pos"), (F.col("y") - 800).alias("top"))
    anchors = i.where("idx % 5 = 0").select("doc", "page", F.col("idx").alias("anchor"), (F.col("y") - 800 + 7).alias("anchor_top"))
    return S.place_anchors(blocks, anchors)


#: Anchors on every fifth line, images on every fourth, some without a height; each third block has none.
_TOPS = f"(SELECT source AS doc, doc_id AS page, pos, CASE WHEN pos % 3 <> 2 THEN -14 * (pos // 2 * 2) END AS top FROM {_LINES} l)"
_PLACED = f"(SELECT source AS doc, doc_id AS page, pos AS mark, 'anchor' AS kind, CASE WHEN pos % 10 <> 5 THEN -14 * pos + 7 END AS top FROM {_LINES} l WHERE pos % 5 = 0 UNION ALL SELECT source, doc_id, pos, 'image', CASE WHEN pos % 8 <> 4 THEN -14 * pos - 30 END FROM {_LINES} l WHERE pos % 4 = 0)"


@query(
    "j13_place_marks",
    f"""SELECT m.doc, m.page, m.mark, m.kind, CASE WHEN kind = 'image' THEN min(b.pos) FILTER (WHERE b.top <= m.top) WHEN m.top IS NULL THEN min(b.pos) ELSE arg_min(b.pos, (-b.top, b.pos)) FILTER (WHERE b.top <= m.top + 4) END AS pos
    FROM {_PLACED} m JOIN {_TOPS} b ON b.doc = m.doc AND b.page = m.page GROUP BY m.doc, m.page, m.mark, m.kind, m.top""",
)
def j13m(spark, d):
    i, k = _items(spark, d), F.col("idx")
    blocks = i.select("doc", "page", k.alias("pos"), F.when(k % 3 != 2, F.floor(k / 2) * -28).alias("top"))
    anchors = i.where(k % 5 == 0).select("doc", "page", k.alias("mark"), F.lit("anchor").alias("kind"), F.when(k % 10 != 5, k * -14 + 7).alias("top"))
    images = i.where(k % 4 == 0).select("doc", "page", k.alias("mark"), F.lit("image").alias("kind"), F.when(k % 8 != 4, k * -14 - 30).alias("top"))
    return S.place_marks(blocks, anchors.unionByName(images))


def _two_columns(spark, d):
    """Every second item moves to a right column at the height of the item before."""
    i = _items(spark, d)
    right = F.col("idx") % 2 == 1
    return i.withColumns({"x": F.when(right, 320.0).otherwise(72.0), "y": F.when(right, F.col("y") + 14).otherwise(F.col("y")), "width": F.lit(200.0)})


@query("l5_column_gutter", f"SELECT source AS doc, doc_id AS page, 272.0::DOUBLE AS gutter FROM {_LINES} l GROUP BY 1, 2 HAVING count(*) >= 20")
def l5(spark, d):
    return S.column_gutter(_two_columns(spark, d))


@query("l5_reading_order", f"SELECT source AS doc, doc_id AS page, cast(pos AS bigint) AS idx, row_number() OVER (PARTITION BY source, doc_id ORDER BY CASE WHEN n >= 20 THEN pos % 2 ELSE 0 END, pos // 2, pos % 2) AS position FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM {_LINES} l) t")
def l5r(spark, d):
    return S.reading_order(_two_columns(spark, d)).select("doc", "page", "idx", "position")


@query("l6_toc_from_headings", f"SELECT source AS doc, doc_id AS page, md5(line) AS text_md5 FROM {_LINES} l WHERE pos = 0 AND source IN (SELECT source FROM {{documents}} GROUP BY 1 HAVING count(*) >= 2)")
def l6(spark, d):
    i = _items(spark, d)
    headings = i.join(S.heading_levels(i), ["doc", "size"])
    return S.toc_from_headings(headings).select("doc", "page", F.md5(F.col("str").cast("binary")).alias("text_md5"))


@query("l7_drop_repeated_images", "SELECT l_suppkey AS doc, l_partkey % 97 AS image, l_orderkey AS page FROM {lineitem} WHERE (l_suppkey, l_partkey % 97) NOT IN (SELECT (l_suppkey, l_partkey % 97) FROM {lineitem} GROUP BY l_suppkey, l_partkey % 97 HAVING count(DISTINCT l_orderkey) >= 9)")
def l7(spark, d):
    placed = view(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc"), (F.col("l_partkey") % 97).alias("image"), F.col("l_orderkey").alias("page"))
    return S.drop_repeated_images(placed, 9)
