"""Queries over terms, web corpora and transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.operators import markup as K
from quillspan.operators import terms as M
from quillspan.operators import transcripts as V
from quillspan.operators import web as W
from quillspan.plans.adapters import view
from quillspan.plans.registry import query


def _pages(spark, d):
    return view(spark, d, "pages")


def _marked(spark, d):
    """Pages with the first two words of each paragraph in bold."""
    return _pages(spark, d).withColumn("html", F.regexp_replace("html", r"<p>([\p{L}]+ [\p{L}]+) ", "<p><b>$1</b> "))


def _terms(spark, d):
    return M.clean_terms(M.marked_terms(_marked(spark, d)))


#: In the given pages all marks but the added ones stand before a line break and fill a paragraph's first part; those are no terms.
_TERMS = "(SELECT page_id, unnest(m) AS term, unnest(range(0, len(m))) AS k FROM (SELECT page_id, regexp_extract_all(html, '<p>([\\p{L}]+ [\\p{L}]+) ', 1) AS m FROM {pages}) t)"


@query("t1_marked_terms", f"SELECT page_id, k AS \"at\", term, 'bold' AS source, 6 AS max_words FROM {_TERMS} t")
def t1(spark, d):
    return M.marked_terms(_marked(spark, d))


@query("t2_clean_terms", f"SELECT page_id, k AS \"at\", term, 'bold' AS source FROM {_TERMS} t WHERE length(term) <= 60 AND NOT regexp_matches(term, '{M.LABEL}')")
def t2(spark, d):
    return _terms(spark, d)


#: Navigation texts stand in for marked terms in the SQL forms below.
_LINKS = "(SELECT page_id, i AS \"at\", m[i] AS term FROM (SELECT page_id, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1) AS m FROM {pages}) a) b)"


def _links(spark, d):
    m = F.regexp_extract_all("html", F.lit('<a href="[^"]*">([^<]*)</a>'), F.lit(1))
    return _pages(spark, d).select("page_id", F.posexplode(m).alias("at", "term")).withColumns({"source": F.when(F.col("at") % 2 == 0, "bold").otherwise("emphasis"), "at": F.col("at").cast("long") + 1})


_RANKED = f"(SELECT *, CASE WHEN \"at\" % 2 = 1 THEN 'bold' ELSE 'emphasis' END AS source FROM {_LINKS} l)"


@query("t7_chapter_checklist", f"SELECT page_id, term, source FROM (SELECT *, row_number() OVER (PARTITION BY page_id, lower(term) ORDER BY source, \"at\", term) AS r FROM {_RANKED} t) u WHERE r = 1")
def t7(spark, d):
    return M.chapter_checklist(_links(spark, d), "page_id").select("page_id", "term", "source")


@query("t9_term_counts", f"SELECT source, count(*) AS n, count(DISTINCT lower(term)) AS terms FROM {_RANKED} t GROUP BY 1")
def t9(spark, d):
    return M.term_counts(_links(spark, d))


@query("k4_review_items", f"SELECT page_id, term, rank, skipped FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY source, \"at\", term) AS rank, greatest(count(*) OVER (PARTITION BY page_id) - 4, 0) AS skipped FROM {_RANKED} t) u WHERE rank <= 4")
def k4(spark, d):
    return M.review_items(_links(spark, d), "page_id", 4).select("page_id", "term", "rank", "skipped")


_TERM = "lower(trim(regexp_replace(term, '\\s+', ' ', 'g')))"


@query(
    "t8_uncovered_terms",
    f"""SELECT page_id, "at", term FROM (SELECT *, {_TERM} AS t, min({_TERM}) OVER (PARTITION BY page_id) AS name, max({_TERM}) OVER (PARTITION BY page_id) AS objective FROM {_LINKS} l) x
    WHERE t <> '' AND NOT contains(name, t) AND NOT contains(t, name) AND NOT contains('about ' || objective, t) AND NOT contains('x', t)""",
)
def t8(spark, d):
    """A page has one concept, named by its first term and with its last one as objective."""
    links = _links(spark, d)
    term = F.lower(F.trim(F.regexp_replace("term", r"\s+", " ")))
    con = links.groupBy("page_id").agg(F.min(term).alias("name"), F.concat(F.lit("About "), F.max(term)).alias("objective"), F.lit("x").alias("quote"))
    return M.uncovered_terms(links, con, "page_id").select("page_id", "at", "term")


_BENCH = "(SELECT DISTINCT trim(array_to_string(string_split(lower(replace(text, chr(10), ' ')), ' ')[2:4], ' '), ' .,') AS term FROM {benchmark})"


@query("j7_first_section_with", f"SELECT term, min(doc_id) AS section FROM {_BENCH} b JOIN {{documents}} ON regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}])' || replace(replace(term, '.', '\\.'), ',', ',') || '($|[^\\p{{L}}\\p{{N}}])') GROUP BY 1".replace("{{", "{").replace("}}", "}"))
def j7(spark, d):
    words = F.slice(F.split(F.lower(F.replace("text", F.lit("\n"), F.lit(" "))), " "), 2, 3)
    terms = view(spark, d, "benchmark").select(F.expr("1").alias("one"), F.array_join(words, " ").alias("t")).select(F.regexp_replace("t", "^[ .,]+|[ .,]+$", "").alias("term"))
    return M.first_section_with(terms, view(spark, d, "documents").withColumnRenamed("doc_id", "section_id"))


#: Terms that begin with words which most texts hold.
_COMMON = "(SELECT DISTINCT x.w || ' ' || y.w AS term FROM (SELECT DISTINCT regexp_extract(lower(text), '^[^a-z]*([a-z]+)', 1) AS w FROM {benchmark}) y, (VALUES ('the'), ('and'), ('of')) x(w) WHERE y.w <> '')"


@query("j7_common_first_words", f"SELECT term, min(doc_id) AS section FROM {_COMMON} b JOIN {{documents}} ON contains(lower(text), term) AND regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}])' || term || '($|[^\\p{{L}}\\p{{N}}])') GROUP BY 1".replace("{{", "{").replace("}}", "}"))
def j7c(spark, d):
    word = F.regexp_extract(F.lower("text"), "^[^a-z]*([a-z]+)", 1)
    terms = view(spark, d, "benchmark").select(word.alias("w")).where("w <> ''").select(F.explode(F.array(*[F.concat(F.lit(x + " "), "w") for x in ("the", "and", "of")])).alias("term"))
    return M.first_section_with(terms, view(spark, d, "documents").withColumnRenamed("doc_id", "section_id"))


@query(
    "t6_assign_terms",
    """WITH b AS (SELECT array_to_string(string_split(text, ' ')[1:3], ' ') AS term, item_id % 10 = 3 AS linked FROM {benchmark}), l AS (SELECT DISTINCT term, 7 AS section FROM b WHERE linked), r AS (SELECT DISTINCT term FROM b WHERE term NOT IN (SELECT term FROM l)),
    c AS MATERIALIZED (SELECT r.term, doc_id, lower(text) AS t FROM r JOIN {documents} ON contains(lower(text), lower(r.term))), f AS (SELECT term, min(doc_id) AS section FROM c WHERE regexp_matches(t, '(^|[^\\p{L}\\p{N}])' || regexp_replace(lower(term), '([.?+*()|\\[\\]{}^$\\\\])', '\\\\\\1', 'g') || '($|[^\\p{L}\\p{N}])') GROUP BY 1)
    SELECT term, section FROM l UNION ALL SELECT r.term, f.section FROM r LEFT JOIN f USING (term)""",
)
def t6(spark, d):
    b = view(spark, d, "benchmark").select(F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("term"), F.concat(F.lit("#"), F.col("item_id").cast("string")).alias("href"))
    targets = b.where("href like '%3'").select("href", F.lit(7).cast("long").alias("section"))
    return M.assign_terms(b, targets, view(spark, d, "documents").withColumnRenamed("doc_id", "section_id"))


@query("p6_in_scope", "SELECT page_id, starts_with(a, s) OR a || '/' = s AS inside FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS a, 'http://ththre.example.com/fr/' AS s FROM {pages}) t")
def p6(spark, d):
    return _pages(spark, d).select("page_id", W.in_scope("url", F.lit("http://ththre.example.com/fr/")).alias("inside"))


@query("w1_absolute_url", "SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) || '/up/x%20y?q=1' AS target FROM {pages}")
def w1(spark, d):
    return _pages(spark, d).select("page_id", W.absolute_url(F.lit("/a/../up/./x%20y?q=1#part"), F.col("url")).alias("target"))


@query("w2_scope_of", "SELECT DISTINCT url AS start, CASE WHEN EXISTS (SELECT 1 FROM {pages} p WHERE starts_with(p.url, u || '/')) THEN u || '/' ELSE regexp_extract(u, '^(.*/)[^/]*$', 1) END AS scope FROM (SELECT url, regexp_replace(url, '[?#].*$', '') AS u FROM {pages}) t")
def w2(spark, d):
    p = _pages(spark, d)
    return W.scope_of(p.select(F.col("url").alias("start")).distinct(), p)


#: Put before the end of every page: a group, a child that holds a list, a mail address, a card, links named by an attribute, without text and without address, and one that stands twice.
_BLOCK = """<ul><li>Group {id}<ul><li><a href="/g{id}">G<b>{id}</b></a></li></ul></li><li><div>Gone<ul><li><a href="mailto:a{id}@x.org">Mail</a></li></ul></div></li><li><svg/>Same <i>depth</i></li></ul><a href="/card{id}"><span>Day</span><h4>Card {id}</h4><p>more</p></a><a href='/icon' aria-label="Icon > {id}"><img src="i.png"></a><a href=/titled title="Titled &amp; {id}"><img></a><a href="/empty"> <br> </a><a name="n">No address</a><a href="/same">Same<br>link</a><a href="/same">Same link</a><iframe src="/toc{id}.html"></iframe><iframe src="https://other.test/x"></iframe>"""
#: What it gives: text, address on the page's site, depth.
_ADDED = "(0, 'Group {id}', NULL, 1), (1, 'G{id}', '/g{id}', 2), (2, 'Same depth', NULL, 1), (3, 'Card {id}', '/card{id}', 0), (4, 'Icon > {id}', '/icon', 0), (5, 'Titled & {id}', '/titled', 0), (6, 'Same link', '/same', 0)"


def _with_links(spark, d):
    added = F.replace(F.lit(_BLOCK), F.lit("{id}"), F.col("page_id").cast("string"))
    return _pages(spark, d).withColumn("html", F.replace("html", F.lit("</body>"), F.concat(added, F.lit("</body>"))))


#: The given pages: one list of links without groups, then paragraphs in an article; a list item of plain text is a group title.
_MENU = """(SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS o, unnest(regexp_extract_all(html, '<li>(<a href="[^"]*">[^<]*</a>|[^<]*)')) AS t, unnest(range(0, len(regexp_extract_all(html, '<li>(<a href="[^"]*">[^<]*</a>|[^<]*)')))) AS k FROM {pages})"""
_ITEMS = f"""(SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS pos FROM (SELECT *, lag(text) OVER w = text AND lag(url) OVER w = url AS again FROM (SELECT page_id, k, o, replace(trim(regexp_replace(regexp_replace(t, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')), '&amp;', '&') AS text, CASE WHEN contains(t, '<a ') THEN o || replace(regexp_extract(t, 'href="([^"]*)"', 1), '&amp;', '&') END AS url FROM {_MENU} m) a WHERE text <> '' AND (url IS NOT NULL OR length(text) <= 100) WINDOW w AS (PARTITION BY page_id ORDER BY k)) b WHERE NOT coalesce(again, false))"""


@query(
    "w5_collect_links",
    f"""SELECT page_id, pos, text, url, 1 AS depth FROM {_ITEMS} i UNION ALL SELECT p.page_id, coalesce(n, 0) + x.k, replace(x.text, '{{id}}', cast(p.page_id AS VARCHAR)), regexp_extract(url, '^(https?://[^/?#]+)', 1) || replace(x.path, '{{id}}', cast(p.page_id AS VARCHAR)), x.depth
    FROM {{pages}} p CROSS JOIN (VALUES {_ADDED}) x(k, text, path, depth) LEFT JOIN (SELECT page_id, count(*) AS n FROM {_ITEMS} i GROUP BY 1) c ON c.page_id = p.page_id WHERE contains(html, '</body>')""",
)
def w5(spark, d):
    return K.collect_links(_with_links(spark, d)).select("page_id", "pos", "text", "url", "depth")


@query("w5_collect_frames", "SELECT page_id, 0 AS pos, regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/toc' || page_id || '.html' AS url FROM {pages} WHERE contains(html, '</body>')")
def w5f(spark, d):
    return K.collect_frames(_with_links(spark, d))


#: Places of a page's list in turn: titles (t) and links (l) with their depth; every second page's last kind of link leads out of the scope.
_TURNS = ("t1", "l1", "t2", "l1", "t1", "t2", "l3", "t3", "t1", "l2")


@query(
    "w6_scoped_items",
    f"""WITH i AS (SELECT page_id, pos, text, CASE WHEN pos % 10 IN (1, 3, 6, 9) THEN CASE WHEN pos % 10 = 9 AND page_id % 2 = 0 THEN 'https://other.test/' ELSE 'https://in.test/' END || pos END AS url, [{", ".join(x[1] for x in _TURNS)}][pos % 10 + 1] AS depth FROM {_ITEMS} x WHERE pos % 11 <> 10),
    k AS (SELECT * FROM i WHERE url IS NULL OR starts_with(url, 'https://in.test/')),
    n AS (SELECT t.*, (SELECT min(l.pos) FROM k l WHERE l.page_id = t.page_id AND l.pos > t.pos AND l.url IS NOT NULL) AS next FROM k t WHERE t.url IS NULL)
    SELECT * FROM k WHERE url IS NOT NULL UNION ALL SELECT page_id, pos, text, url, depth FROM n t WHERE (SELECT l.depth FROM k l WHERE l.page_id = t.page_id AND l.pos = t.next) >= t.depth
    AND NOT EXISTS (SELECT 1 FROM k b WHERE b.page_id = t.page_id AND b.pos > t.pos AND b.pos < t.next AND b.depth <= t.depth)""",
)
def w6(spark, d):
    turn, link = F.col("pos") % 10, F.col("pos").cast("string")
    url = F.when((turn == 9) & (F.col("page_id") % 2 == 0), F.concat(F.lit("https://other.test/"), link)).otherwise(F.concat(F.lit("https://in.test/"), link))
    depth = F.get(F.array(*[F.lit(int(x[1])) for x in _TURNS]), turn)
    links = K.collect_links(_pages(spark, d)).where("pos % 11 <> 10").withColumns({"url": F.when(turn.isin(1, 3, 6, 9), url), "depth": depth})
    return K.scoped_items(links, "page_id", F.lit("https://in.test/"))


@query(
    "w3_robots_allow",
    """SELECT DISTINCT host, path, NOT (starts_with(path, '/fr') OR regexp_matches(path, '^/.*5$')) AS allowed FROM
    (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, '/' || regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS path FROM {pages}) t""",
)
def w3(spark, d):
    p = _pages(spark, d).select(F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"), F.concat(F.lit("/"), F.regexp_extract("url", "^https?://[^/]+/([^?#]*)", 1)).alias("path"))
    text = ["User-agent: other", "Disallow: /", "User-agent: *", "Disallow: /fr # folder", "Disallow: /*5$", "Allow: /en", "Disallow:", "User-agent: GPTBot", "Disallow: /nothing"]
    text[5] = "Allow: /zz"
    lines = p.select("host").distinct().select("host", F.posexplode(F.array(*[F.lit(x) for x in text])).alias("pos", "line"))
    return W.robots_allow(p, W.robots_rules(lines, "own-agent"))


@query(
    "w10_llms_urls",
    """WITH u AS (SELECT DISTINCT url AS start, regexp_extract(url, '^(https?://[^/]+)', 1) AS o, CASE WHEN p = '' THEN '/' ELSE p END AS p FROM (SELECT url, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]+', '') AS p FROM {pages}) t),
    f AS (SELECT *, list_filter(string_split(regexp_replace(p, '[^/]*$', ''), '/'), lambda x: x <> '') AS parts FROM u)
    SELECT start, o || '/' || array_to_string(parts[1:i], '/') || CASE WHEN i > 0 THEN '/' ELSE '' END || 'llms.txt' AS url FROM (SELECT *, unnest(range(0, len(parts) + 1)) AS i FROM f) g
    UNION ALL SELECT start, o || p || '/llms.txt' FROM u WHERE NOT ends_with(p, '/') AND NOT regexp_matches(lower(p), '\\.[a-z0-9]+$')""",
)
def w10(spark, d):
    p = _pages(spark, d).select(F.col("url").alias("start")).distinct()
    return W.llms_urls(p).select("start", "url")


@query(
    "w9_resolve_redirects",
    """SELECT url, 'http://h/' || (k - n) AS final, n, problem FROM (SELECT 'http://h/' || page_id AS url, page_id AS k, CASE WHEN r >= 9 THEN r - 9 WHEN r > 5 THEN 5 ELSE r END AS n,
    CASE WHEN r >= 9 THEN 'not http' WHEN r > 5 THEN 'too many redirects' END AS problem FROM (SELECT page_id, page_id % 13 AS r FROM {pages}) t) u""",
)
def w9(spark, d):
    """Pages lead to the one before, up to every thirteenth; the ninth from there leads to an address of mail."""
    k = F.col("page_id")
    to = F.when(k % 13 == 9, "mailto:a@h").when(k % 13 != 0, F.concat(F.lit("/"), (k - 1).cast("string"), F.lit("#x")))
    log = _pages(spark, d).select(F.concat(F.lit("http://h/"), k.cast("string")).alias("url"), F.when(k % 13 == 0, 200).otherwise(301).alias("status"), to.alias("location"))
    return W.resolve_redirects(log)


@query("w11_apply_toc_picks", "SELECT chapter, number, url FROM (SELECT page_id % 7 AS chapter, page_id AS number, url, row_number() OVER (PARTITION BY url ORDER BY page_id % 7, page_id) AS r FROM {pages} WHERE page_id % 2 = 0) t WHERE r = 1")
def w11(spark, d):
    items = _pages(spark, d).select(F.col("page_id").alias("number"), "url")
    return W.apply_toc_picks(items, items.where("number % 2 = 0").select((F.col("number") % 7).alias("chapter"), "number"))


@query("w12_check_toc", "SELECT url, CASE WHEN NOT starts_with(url, 'http://ththre.example.com') THEN 'other site' ELSE 'out of scope' END AS problem FROM {pages} WHERE NOT starts_with(regexp_replace(url, '[?#].*$', ''), 'http://ththre.example.com/fr/')")
def w12(spark, d):
    return W.check_toc(_pages(spark, d).select("url"), "http://ththre.example.com/fr/")


@query("w8_skip_report", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'robots' ELSE 'same text' END AS reason FROM {pages} WHERE page_id % 3 = 0 OR page_id % 4 = 0")
def w8(spark, d):
    p = _pages(spark, d).select("page_id")
    return W.skip_report(p, [("robots", p.where("page_id % 3 = 0")), ("same text", p.where("page_id % 4 = 0"))], "page_id")


# transcripts


def _transcript(spark, d):
    return view(spark, d, "v_transcript")


def _videos(spark, d):
    return _transcript(spark, d).select("video", "duration").distinct()


def _lines(spark, d):
    t = _transcript(spark, d)
    return t.select("video", (F.col("turn") * 2).alias("pos"), F.concat(F.lit("["), T.format_time("start"), F.lit("] "), F.regexp_replace("text", r"\s+", " ")).alias("line"))


_VIDEOS = "(SELECT DISTINCT video, duration FROM {v_transcript})"


@query("v1_parse_transcript", "SELECT video, turn + 1 AS para, start, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS text_md5 FROM {v_transcript} WHERE trim(text) <> ''")
def v1(spark, d):
    return V.parse_transcript(_lines(spark, d)).select("video", "para", "start", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(
    "v2_check_transcript",
    """WITH v AS (SELECT DISTINCT video, CASE WHEN video % 7 = 2 THEN cast(floor(duration * 0.5) AS bigint) ELSE duration END AS duration FROM {v_transcript}),
    p AS (SELECT video, turn, CASE WHEN video % 7 = 1 AND turn = 2 THEN 0 ELSE start END AS s FROM {v_transcript} WHERE video % 7 <> 3),
    b AS (SELECT *, coalesce(max(s) OVER (PARTITION BY video ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM p),
    c AS (SELECT *, CASE WHEN s < b - 5 THEN 'back' WHEN s > duration + 5 THEN 'past_end' WHEN s - b > 180 THEN 'gap' END AS code FROM b JOIN v USING (video)),
    g AS (SELECT video, min_by(code, turn) FILTER (WHERE code IS NOT NULL) AS code, max(s) AS last FROM c GROUP BY 1)
    SELECT v.video, CASE WHEN v.video % 10 = 0 THEN 'token_limit' WHEN v.video % 11 = 5 THEN 'finish_reason' WHEN g.video IS NULL THEN 'no_rows' WHEN code IS NOT NULL THEN code WHEN duration - last > greatest(120, duration * 0.1) THEN 'tail' END AS problem
    FROM v LEFT JOIN g ON g.video = v.video""",
)
def v2(spark, d):
    """By seventh video: one time falls back, the video is half as long as its times, no paragraphs."""
    t = _transcript(spark, d)
    videos = t.selectExpr("video", "case when video % 7 = 2 then cast(floor(duration * 0.5) as bigint) else duration end duration").distinct()
    videos = videos.withColumn("finish", F.when(F.col("video") % 10 == 0, "length").when(F.col("video") % 11 == 5, "content_filter").otherwise("stop"))
    return V.check_transcript(t.where("video % 7 <> 3").selectExpr("video", "turn para", "case when video % 7 = 1 and turn = 2 then 0 else start end start"), videos)


_CLIPS = "SELECT video, i, cast(floor(i * l + 0.5) AS bigint) AS start, CASE WHEN i = n - 1 THEN duration ELSE cast(floor((i + 1) * l + 0.5) AS bigint) + 20 END AS \"end\" FROM (SELECT video, duration, n, duration / n AS l, unnest(range(0, n)) AS i FROM (SELECT video, duration, cast(greatest(ceil(duration / 100.0), 1) AS bigint) AS n FROM {v}) a) b"


@query("v3_plan_clips", _CLIPS.replace("{v}", f"{_VIDEOS} v"))
def v3(spark, d):
    return V.plan_clips(_videos(spark, d), 100, 20)


@query(
    "v4_clip_problems",
    """WITH v AS (SELECT DISTINCT video, CASE video % 4 WHEN 1 THEN 100 WHEN 2 THEN 10 ELSE 0 END AS c, duration AS e FROM {v_transcript}),
    p AS (SELECT video, turn, start, greatest(start - c, 0) AS s, e - c AS d FROM {v_transcript} JOIN v USING (video) WHERE trim(text) <> ''),
    b AS (SELECT *, coalesce(max(s) OVER (PARTITION BY video ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM p),
    g AS (SELECT video, min_by(code, turn) FILTER (WHERE code IS NOT NULL) AS code, max(s) AS last, min(start) AS first FROM (SELECT *, CASE WHEN s < b - 5 THEN 'back' WHEN s > d + 5 THEN 'past_end' WHEN s - b > 180 THEN 'gap' END AS code FROM b) x GROUP BY 1)
    SELECT v.video, CASE WHEN c > 0 AND coalesce(first, 0) < c - 15 THEN 'before_clip' WHEN v.video % 10 = 0 THEN 'token_limit' WHEN g.video IS NULL THEN 'no_rows' WHEN code IS NOT NULL THEN code WHEN e - c - last > greatest(120, (e - c) * 0.1) THEN 'tail' END AS problem
    FROM v LEFT JOIN g ON g.video = v.video""",
)
def v4(spark, d):
    """Clips that begin at 0, 10 and 100 seconds."""
    clips = _videos(spark, d).selectExpr("video", "cast(case video % 4 when 1 then 100 when 2 then 10 else 0 end as bigint) start", "duration end", "case when video % 10 = 0 then 'length' else 'stop' end finish")
    return V.clip_problems(_lines(spark, d), clips)


@query("v5_placed_words", "SELECT video, count(*) AS words, max(t0) AS last_at FROM (SELECT video, start AS t0, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) AS w FROM {v_transcript}) t GROUP BY 1")
def v5(spark, d):
    return V.placed_words(_lines(spark, d)).groupBy("video").agg(F.count(F.lit(1)).alias("words"), F.max("at").alias("last_at"))


@query(
    "v6_join_clips",
    """WITH n AS (SELECT video, count(*) // 2 AS half, max(duration) AS duration FROM {v_transcript} GROUP BY 1), t AS (SELECT video, turn, half, start, regexp_extract_all(text, '[\\p{L}\\p{N}'']+[^\\p{L}\\p{N}'']*') AS ws FROM {v_transcript} JOIN n USING (video)),
    w AS (SELECT video, turn, half, start AS tm, unnest(ws) AS x, unnest(range(0, len(ws))) AS j FROM t), y AS (SELECT video, turn, half, tm, j, lower(regexp_extract(x, '^[\\p{L}\\p{N}'']+')) AS word, regexp_matches(x, '^[\\p{L}\\p{N}'']+[^\\s\\p{L}\\p{N}]*[.!?]') AS fin FROM w),
    f AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY turn, j) - 1 AS k FROM y WHERE turn <= half + 1), s AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY turn, j) - 1 AS k FROM y WHERE turn >= half),
    o AS (SELECT video, s0, e0, (s0 + e0) / 2 AS mid FROM (SELECT video, max(CASE WHEN turn = half THEN start END) AS s0, coalesce(max(CASE WHEN turn = half + 2 THEN start END), max(duration)) AS e0 FROM {v_transcript} JOIN n USING (video, duration) GROUP BY 1) z),
    a AS (SELECT f.* FROM f JOIN o USING (video) WHERE tm >= s0 - 60), b AS (SELECT s.* FROM s JOIN o USING (video) WHERE tm <= e0),
    ga AS (SELECT video, k, tm, list(word) OVER (PARTITION BY video ORDER BY k ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS g FROM a), gb AS (SELECT video, k, tm, list(word) OVER (PARTITION BY video ORDER BY k ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS g FROM b),
    best AS (SELECT video, min({'d': abs(ga.tm - mid), 'ak': ga.k, 'bk': gb.k}) AS x FROM ga JOIN gb USING (video, g) JOIN o USING (video) WHERE len(g) = 8 AND abs(ga.tm - gb.tm) <= 120 GROUP BY 1),
    di AS (SELECT a.video, a.k - x.ak AS i, a.fin AS ea, b.fin AS eb, row_number() OVER (PARTITION BY a.video ORDER BY a.k) - 1 AS r FROM best JOIN a ON a.video = best.video AND a.k >= x.ak JOIN b ON b.video = a.video AND b.k = x.bk + a.k - x.ak AND b.word = a.word),
    ends AS (SELECT video, coalesce(min(CASE WHEN ea AND eb THEN i END), min(CASE WHEN ea THEN i END), max(i)) AS i FROM di WHERE i = r GROUP BY 1)
    SELECT best.video, 'text' AS method, x.ak + i AS first_k, x.bk + i AS second_k, a.tm AS "at" FROM best JOIN ends USING (video) JOIN a ON a.video = best.video AND a.k = x.ak + i
    UNION ALL SELECT video, 'time', (SELECT min(k) FROM f WHERE f.video = o.video AND f.tm >= floor(mid + 0.5)), (SELECT min(k) FROM s WHERE s.video = o.video AND s.tm >= floor(mid + 0.5)), cast(floor(mid + 0.5) AS bigint) FROM o WHERE video NOT IN (SELECT video FROM best)""",
)
def v6(spark, d):
    t = _transcript(spark, d)
    turns = t.groupBy("video").agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.floor(F.col("n") / 2))
    lines = _lines(spark, d).join(turns, "video")
    first, second = (lines.where(x).select("video", "pos", "line") for x in ("pos / 2 <= k + 1", "pos / 2 >= k"))
    at = t.join(turns, "video").groupBy("video").agg(F.max(F.when(F.col("turn") == F.col("k"), F.col("start"))).alias("start"), F.coalesce(F.max(F.when(F.col("turn") == F.col("k") + 2, F.col("start"))), F.max("duration")).alias("end"))
    return V.join_clip_lines(first, second, at)


@query("v7_time_parts", "SELECT video, p AS part, cast(floor(p * duration / n + 0.5) AS bigint) AS start, cast(floor((p + 1) * duration / n + 0.5) AS bigint) AS \"end\" FROM (SELECT video, duration, n, unnest(range(0, n)) AS p FROM (SELECT video, duration, cast(greatest(ceil(duration / 60.0), 1) AS bigint) AS n FROM {x}) a) b".replace("{x}", f"{_VIDEOS} v"))
def v7(spark, d):
    return V.time_parts(_videos(spark, d), 60).drop("title")


_PARTS = "(SELECT video, p AS part, n, cast(floor(p * duration / n + 0.5) AS bigint) AS s, cast(floor((p + 1) * duration / n + 0.5) AS bigint) AS e FROM (SELECT video, duration, n, unnest(range(0, n)) AS p FROM (SELECT video, duration, cast(greatest(ceil(duration / 60.0), 1) AS bigint) AS n FROM " + _VIDEOS + " v) a) b)"
_J9 = f"""SELECT video, turn AS para, max_by(part, (share, -part)) AS part FROM (SELECT t.video, t.turn, p.part, least(t.stop, CASE WHEN p.part = p.n - 1 THEN 1000000000000 ELSE p.e END) - greatest(t.start, CASE WHEN p.part = 0 THEN -1000000000000 ELSE p.s END) AS share FROM
    (SELECT *, greatest(coalesce(lead(start) OVER (PARTITION BY video ORDER BY turn), duration), start + 1) AS stop FROM {{v_transcript}}) t JOIN {_PARTS} p USING (video)) u WHERE share > 0 GROUP BY 1, 2"""


@query("j9_split_by_parts", _J9)
def j9(spark, d):
    v = _videos(spark, d)
    return V.split_by_parts(_transcript(spark, d).select("video", F.col("turn").alias("para"), "start"), V.time_parts(v, 60), v)


@query("v8_timed_chapters", f"SELECT video, CASE WHEN duration > 300 THEN nth ELSE 1 END AS chapter, CASE WHEN duration > 300 THEN 1 ELSE nth END AS section, paragraphs FROM (SELECT video, count(*) AS paragraphs, row_number() OVER (PARTITION BY video ORDER BY part) AS nth FROM ({_J9}) j GROUP BY video, part) k JOIN {_VIDEOS} v USING (video)")
def v8(spark, d):
    v = _videos(spark, d)
    got = V.timed_chapters(_transcript(spark, d).select("video", F.col("turn").alias("para"), "start"), V.time_parts(v, 60), v, 300)
    return got.select("video", "chapter", "section", "paragraphs")


@query(
    "v9_quote_moment",
    """WITH p AS (SELECT video, turn, start, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS n FROM {v_transcript}), w AS (SELECT *, array_to_string(list(n) OVER (PARTITION BY video ORDER BY turn ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING), ' ') AS w FROM p), x AS (SELECT *, coalesce(lead(w) OVER (PARTITION BY video ORDER BY turn), '') AS x FROM w),
    q AS (SELECT video, turn AS quote_id, lower(trim(regexp_replace(array_to_string(string_split_regex(text, '\\s+')[3:14], ' '), '\\s+', ' ', 'g'))) AS q FROM {v_transcript}),
    s AS (SELECT *, list_filter(list_transform(string_split(q, '...'), lambda t: trim(t)), lambda t: t <> '') AS parts, regexp_replace(array_to_string(string_split(trim(string_split(q, '...')[1]), ' ')[1:6], ' '), '[^\\p{L}\\p{N}]+$', '') AS six FROM q),
    j AS (SELECT s.video, quote_id, turn, start, len(parts) > 0 AND len(list_filter(parts, lambda t: NOT contains(w, t))) = 0 AS here, len(parts) > 0 AND len(list_filter(parts, lambda t: NOT contains(x, t))) = 0 AS later, six <> '' AND contains(n, six) AS words FROM s JOIN x USING (video))
    SELECT video, quote_id, coalesce(min_by(start, turn) FILTER (WHERE here AND NOT later), min_by(start, turn) FILTER (WHERE words), min_by(start, turn)) AS start FROM j GROUP BY 1, 2""",
)
def v9(spark, d):
    t = _transcript(spark, d).withColumnRenamed("turn", "para")
    quotes = t.select("video", F.col("para").alias("quote_id"), F.array_join(F.slice(F.split("text", r"\s+"), 3, 12), " ").alias("quote"))
    return V.quote_moment(quotes, t.select("video", "para", "start", "text"))


@query("v11_estimates", f"SELECT video, round(duration * 100 * 0.000001 + duration / 60 * 550 * 0.000004, 6) AS cost, cast(least(65536, 1000 + ceil(duration / 60) * 700) AS bigint) AS max_tokens FROM {_VIDEOS} v")
def v11(spark, d):
    return V.estimates(_videos(spark, d), 0.000001, 0.000004)


@query("p7_too_long", f"SELECT video, duration FROM {_VIDEOS} v WHERE duration > 150")
def p7(spark, d):
    return V.too_long(_videos(spark, d), 150)


@query(
    "v12_selection_title",
    """WITH s AS (SELECT DISTINCT book_id, chapter FROM {v_sections} WHERE (chapter + book_id) % 5 <> 0), i AS (SELECT *, chapter - row_number() OVER (PARTITION BY book_id ORDER BY chapter) AS g FROM s),
    r AS (SELECT book_id, string_agg(CASE WHEN lo = hi THEN '' || lo ELSE lo || '-' || hi END, ', ' ORDER BY lo) AS ranges FROM (SELECT book_id, min(chapter) AS lo, max(chapter) AS hi FROM i GROUP BY book_id, g) t GROUP BY 1),
    n AS (SELECT book_id, count(*) AS n, string_agg('Chapter ' || chapter, ', ' ORDER BY chapter) AS names FROM s GROUP BY 1)
    SELECT book_id, CASE WHEN n = total THEN title WHEN n <= 3 THEN title || ': ' || names ELSE title || ': ' || ranges END AS title FROM n JOIN r USING (book_id) JOIN (SELECT book_id, count(DISTINCT chapter) AS total FROM {v_sections} GROUP BY 1) b USING (book_id) JOIN {v_books} USING (book_id)""",
)
def v12(spark, d):
    s = view(spark, d, "v_sections")
    sel = s.where("(chapter + book_id) % 5 <> 0").select("book_id", "chapter", F.concat(F.lit("Chapter "), F.col("chapter").cast("string")).alias("name")).distinct()
    totals = s.groupBy("book_id").agg(F.countDistinct("chapter").alias("total"))
    return V.selection_title(sel, totals, view(spark, d, "v_books").select("book_id", "title"), "book_id", "chapter", "name")


# scalar functions


@query("s6_format_time", "SELECT section_id, CASE WHEN words >= 3600 THEN '' ELSE (words // 60) || ':' || lpad(cast(words % 60 AS varchar), 2, '0') END AS clock, CASE WHEN floor(words / 60 + 0.5) < 60 THEN cast(floor(words / 60 + 0.5) AS bigint) || ' min' END AS length FROM {v_sections}")
def s6(spark, d):
    return view(spark, d, "v_sections").select("section_id", T.format_time("words").alias("clock"), T.format_length("words").alias("length"))


@query("s9_source_display", "SELECT section_id, title || ', ' || chapter || '.' || number || ' S' || CASE WHEN words % 2 = 0 THEN ', p. ' || words ELSE '' END AS shown, book_id * 1000000000000 + chapter * 1000000 + number AS place FROM {v_sections} JOIN {v_books} USING (book_id)")
def s9(spark, d):
    s = view(spark, d, "v_sections").join(view(spark, d, "v_books"), "book_id")
    return s.select("section_id", T.source_display("title", "chapter", "number", F.lit("S"), F.when(F.col("words") % 2 == 0, F.col("words"))).alias("shown"), T.section_place("book_id", "chapter", "number").alias("place"))


@query("s_text_functions", "SELECT doc_id, md5(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS escaped, md5(regexp_replace(text, '[0-9]+', '#', 'g')) AS masked, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS spaced FROM {documents}")
def s_text(spark, d):
    h = lambda c: F.md5(c.cast("binary"))
    return view(spark, d, "documents").select("doc_id", h(T.escape_html("text")).alias("escaped"), h(T.mask_digits("text")).alias("masked"), h(T.normalize_space("text")).alias("spaced"))


@query("s5_slugify", "SELECT doc_id, coalesce(nullif(rtrim(substring(trim(regexp_replace(lower(strip_accents(replace(text, 'ß', '|'))), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60), '-'), ''), 'untitled') AS slug FROM {documents}")
def s5(spark, d):
    return view(spark, d, "documents").select("doc_id", T.slugify("text").alias("slug"))


@query(
    "t3_summary_items",
    """SELECT doc_id, pos, item_md5 FROM (SELECT doc_id, pos, md5(CASE WHEN length(line) > 300 THEN substring(line, 1, 297) || '...' ELSE line END) AS item_md5, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM
    (SELECT doc_id, cast(pos AS bigint) AS pos, line, bool_or(pos % 5 = 1) OVER (PARTITION BY doc_id) AS has FROM (SELECT doc_id, unnest(range(0, len(ls))) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {documents}) s) l) m
    WHERE (has AND pos % 5 = 1 OR NOT has) AND len(string_split_regex(trim(line), '\\s+')) >= 3) t WHERE r <= 20""",
)
def t3(spark, d):
    b = view(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text")).withColumns({"kind": F.when(F.col("pos") % 5 == 1, "item").otherwise("paragraph"), "pos": F.col("pos").cast("long")})
    return M.summary_items(b, "doc_id").select("doc_id", "pos", F.md5(F.col("item").cast("binary")).alias("item_md5"))


@query("w4_llms_chapters", "SELECT page_id, url FROM (SELECT page_id, regexp_replace(url, '#.*$', '') AS url, row_number() OVER (PARTITION BY regexp_replace(url, '#.*$', '') ORDER BY page_id) AS r FROM {pages} WHERE starts_with(url, 'https://')) t WHERE r = 1")
def w4(spark, d):
    p = _pages(spark, d)
    lines = p.select(F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("site"), F.col("page_id").alias("pos"), F.concat(F.lit("- [T]("), F.col("url"), F.lit("): note")).alias("line"))
    return W.llms_chapters(lines, "https://").select(F.col("pos").alias("page_id"), "url")
