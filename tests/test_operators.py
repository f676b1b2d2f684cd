"""Operators on small hand-made tables with exact expectations, and invariants on the given tables."""

import pytest
from pyspark.sql import functions as F

from quillspan.operators import concepts as C
from quillspan.operators import learner as L
from quillspan.operators import markup as K
from quillspan.operators import near as N
from quillspan.operators import reports as R
from quillspan.operators import sets as D
from quillspan.operators import structure as S
from quillspan.operators import terms as M
from quillspan.operators import transcripts as V
from quillspan.operators import web as W

SMALL = "/root/testdata/sf0.001"

@pytest.fixture
def garden(spark):
    """Two learners. The first queues a chain of four over one bed that waits for a task not begun, and two tasks of their own; the second two that wait for each other's bed."""
    rows = [
        (31, 7, 1, "advanced", "queued", 10), (32, 7, 1, "advanced", "queued", 20), (33, 7, 1, "intermediate", "learning", 30),
        (34, 7, 1, "intermediate", "queued", 40), (35, 7, 2, "basic", "queued", 50), (38, 7, 2, "advanced", "queued", 60),
        (36, 7, 2, "advanced", "failed", None), (39, 7, 3, "basic", "mastered", None), (41, 8, 1, "basic", "queued", 1), (42, 8, 1, "basic", "queued", 2),
    ]
    concepts = spark.createDataFrame(rows, "id long, subject_id long, module long, level string, status string, queue_pos long")
    prereqs = spark.createDataFrame([(31, 32), (32, 33), (33, 34), (34, 36), (34, 39), (35, 39), (41, 42)], "concept_id long, prereq_id long")
    return concepts, prereqs


def ordered(df, subject=7):
    return [r["id"] for r in df.where(f"subject_id = {subject}").orderBy("position").collect()]


def test_queue(spark, garden):
    concepts, prereqs = garden
    got = {r["concept_id"]: (r["warning"], r["later"], r["missing"]) for r in L.queue_warnings(concepts, prereqs).collect()}
    assert got == {31: ("later", [32], []), 32: ("later", [33], []), 33: ("later", [34], []), 34: ("missing", [], [36]), 41: ("later", [42], [])}
    order = L.suggested_order(concepts, prereqs)
    assert ordered(order) == [34, 33, 32, 31, 35, 38] and ordered(order, 8) == [42, 41]
    sections = spark.createDataFrame([(501, 2, 1, 1), (502, 1, 4, 2), (503, 1, 4, 1), (504, 1, 9, 1)], "section_id long, book_id long, chapter long, number long")
    sources = spark.createDataFrame([(31, 501), (31, 504), (33, 502), (34, 503), (42, 501)], "concept_id long, section_id long")
    assert ordered(L.queue_book_order(concepts, sources, sections)) == [34, 33, 31, 32, 35, 38]
    edits = spark.createDataFrame([(7, 34, "remove"), (7, 35, "top"), (7, 32, "end")], "subject_id long, id long, edit string")
    assert ordered(L.queue_edit(L.queue(concepts), edits)) == [35, 31, 33, 38, 32] and ordered(L.queue_edit(L.queue(concepts), edits), 8) == [41, 42]


def test_suggested_order_follows_long_chains(spark, garden):
    concepts, _ = garden
    chain = spark.createDataFrame([(33, 31), (31, 35), (35, 34), (34, 32), (32, 38)], "concept_id long, prereq_id long")
    assert ordered(L.suggested_order(concepts, chain)) == [38, 32, 34, 35, 31, 33]


def test_attempts(spark):
    q = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "session_id long, concept string")
    a = spark.createDataFrame([(1, 1, "a", 0, False), (2, 1, "a", 2, False), (3, 1, "b", 1, True), (4, 2, "a", 0, False)], "id long, session_id long, concept string, score int, disputed boolean")
    assert sorted(map(tuple, L.test_score(q, a).collect())) == [(1, 2, 2, True), (2, 0, 1, False)]
    waiting = q.withColumn("status", F.lit("to_test")).unionAll(spark.createDataFrame([(2, "z", "to_test"), (2, "k", "known")], "session_id long, concept string, status string"))
    assert {(r["session_id"], r["concept"]): r["outcome"] for r in L.diagnosis_outcome(waiting, q, a).collect()} == {(1, "a"): "known", (1, "b"): "known", (2, "a"): "failed", (2, "z"): "new"}


def test_renumber_modules(spark):
    sections = spark.createDataFrame([(1, 1, 1, 1), (2, 1, 2, 1)], "section_id long, book_id long, chapter long, number long")
    modules = spark.createDataFrame([(1, "Joins", 1), (1, "Old", 2), (1, "Basics", 3)], "subject_id long, module string, position long")
    concepts = spark.createDataFrame([(1, 1, "Joins"), (2, 1, "Old"), (3, 1, "Basics")], "id long, subject_id long, module string")
    sources = spark.createDataFrame([(1, 2), (3, 1)], "concept_id long, section_id long")
    got = R.renumber_modules(modules, concepts, sources, sections).orderBy("position").collect()
    assert [r["module"] for r in got] == ["Basics", "Joins", "Old"]


def test_ranges(spark):
    df = spark.createDataFrame([("1-3,5",), ("4 - 4, x",)], "t string")
    assert sorted(r["n"] for r in R.expand_ranges(df, "t").collect()) == [1, 2, 3, 4, 5]
    n = spark.createDataFrame([(1, k) for k in (1, 2, 3, 5, 5)], "b long, n long")
    assert R.format_ranges(n, ["b"], "n").first()["ranges"] == "1-3, 5"


def test_request_groups(spark):
    sizes = lambda words, n, tokens: [r["count"] for r in S.group_sections(spark.createDataFrame([(1, k, words) for k in range(10)], "c long, number long, words long"), ["c"], n, tokens).groupBy("grp").count().orderBy("grp").collect()]
    assert sizes(5000, 8, 24000) == [3, 3, 3, 1] and sizes(10, 4, 24000) == [4, 4, 2]


def test_clip_plans(spark):
    plan = lambda d, n=2700: [(r["start"], r["end"]) for r in V.plan_clips(spark.createDataFrame([("v", d)], "video string, duration int"), n).orderBy("i").collect()]
    assert plan(1800) == [(0, 1800)] and plan(2760) == [(0, 1440), (1380, 2760)]
    assert plan(7200) == [(0, 2460), (2400, 4860), (4800, 7200)] and plan(600, 240) == [(0, 260), (200, 460), (400, 600)]


def test_transcripts(spark):
    text = ["intro", "# Head", "[0:05] First line", "more", "```", "[9:99] code", "# not a heading", "```", "[1:04:05] Last."]
    lines = spark.createDataFrame([("v", k, x) for k, x in enumerate(text)], "video string, pos int, line string")
    got = [(r["start"], r["text"]) for r in V.parse_transcript(lines).orderBy("para").collect()]
    assert got == [(0, "intro"), (5, "First line\nmore\n```\n[9:99] code\n# not a heading\n```"), (3845, "Last.")]
    words = [(r["word"], r["at"], r["sentence_end"]) for r in V.placed_words(lines).orderBy("k").collect()]
    assert words == [("intro", 0, False), ("first", 5, False), ("line", 5, False), ("more", 5, False), ("last", 3845, True)]
    par = lambda *starts: spark.createDataFrame([("v", k, s) for k, s in enumerate(starts)], "video string, para int, start long")
    video = lambda d, f="stop": spark.createDataFrame([("v", d, f)], "video string, duration long, finish string")
    check = lambda p, v: V.check_transcript(p, v).first()["problem"]
    assert check(par(0, 100, 190), video(200)) is None and check(par(0, 50, 40), video(60)) == "back" and check(par(0, 300), video(310)) == "gap"
    assert check(par(0, 90), video(50)) == "past_end" and check(par(0, 10), video(600)) == "tail" and check(par(0), video(9, "length")) == "token_limit"


def test_clip_problems(spark):
    """Each problem of a clip that begins at 600 and ends at 1200 seconds."""
    times = {"good": (10, 12, 14, 16, 18), "early": (2, 11, 14, 17), "late_end": (10, 12, 13), "hole": (10, 15, 18), "back": (10, 12, 11, 13, 16, 18), "past": (10, 12, 14, 16, 18, 21), "empty": ()}
    lines = [(v, k, f"[{m}:00] some words") for v, at in times.items() for k, m in enumerate(at)] + [("empty", 0, "# only a head")]
    clips = spark.createDataFrame([(v, 600, 1200, "stop") for v in times], "video string, start long, end long, finish string")
    got = {r["video"]: r["problem"] for r in V.clip_problems(spark.createDataFrame(lines, "video string, pos int, line string"), clips).collect()}
    assert got == {"good": None, "early": "before_clip", "late_end": "tail", "hole": "gap", "back": "back", "past": "past_end", "empty": "before_clip"}
    plain = spark.createDataFrame([("short", 0, "no time here"), ("long", 0, "no time here"), ("none", 0, "# only a head")], "video string, pos int, line string")
    clips = spark.createDataFrame([("short", 0, 100, "stop"), ("long", 0, 600, "stop"), ("none", 0, 100, "stop")], "video string, start long, end long, finish string")
    assert {r["video"]: r["problem"] for r in V.clip_problems(plain, clips).collect()} == {"short": None, "long": "tail", "none": "no_rows"}


def test_join_clips(spark):
    say = "here and the program prints the result of it. Then more words follow"
    a = spark.createDataFrame([("v", 0, "[44:30] before this"), ("v", 1, f"[45:10] {say}")], "video string, pos int, line string")
    b = spark.createDataFrame([("v", 0, f"[45:09] {say}"), ("v", 1, "[46:00] after that")], "video string, pos int, line string")
    over = spark.createDataFrame([("v", 2700, 2760)], "video string, start long, end long")
    got = V.join_clips(V.placed_words(a), V.placed_words(b), over).first()
    assert (got["method"], got["first_k"], got["second_k"], got["at"]) == ("text", 10, 8, 2710)
    c = spark.createDataFrame([("v", 0, "[45:40] other words altogether")], "video string, pos int, line string")
    late = V.join_clips(V.placed_words(a), V.placed_words(c), over).first()
    assert (late["method"], late["at"], late["second_k"]) == ("time", 2730, 0)


def test_kinds(spark):
    rows = [("Glossary", []), ("General Index", []), ("Appendix A", []), ("Preface", ["chapter"]), ("Bibliography", []), ("One", ["toc"]), ("Two", ["backmatter"]), ("Three", None)]
    df = spark.createDataFrame([(k, t, y) for k, (t, y) in enumerate(rows)], "k int, title string, types array<string>")
    assert [r["x"] for r in df.select("k", S.classify_kind("title", "types").alias("x")).orderBy("k").collect()] == ["glossary", "index", "appendix", "front", "back", "front", "back", "chapter"]


def test_sections_keep_every_word(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    blocks = S.line_blocks(docs)
    parts = S.split_by_size(blocks, ["doc_id"], 100).join(blocks, ["doc_id", "pos"])
    per = parts.groupBy("doc_id", "part").agg(F.sum("words").alias("words"), F.count(F.lit(1)).alias("n"))
    assert per.where("words > 100 and n > 1").isEmpty()
    assert per.agg(F.sum("words")).first()[0] == blocks.agg(F.sum("words")).first()[0]
    small = spark.createDataFrame([(1, k, w) for k, w in enumerate([5, 50, 10, 60, 3])] + [(2, 0, 1), (2, 1, 2)], "d long, section long, words long")
    got = [(r["d"], r["merged"]) for r in S.merge_small(small, ["d"]).orderBy("d", "section").collect()]
    assert got == [(1, 1), (1, 1), (1, 1), (1, 2), (1, 2), (2, 1), (2, 1)]


def test_refine_splits_large_sections_and_keeps_all(spark):
    rows = []
    pos = 0
    for kind, level, words in [("heading", 1, 2), ("content", 0, 50), ("heading", 2, 2), ("content", 0, 90), ("heading", 3, 2), ("content", 0, 60), ("heading", 3, 2), ("content", 0, 5), ("heading", 2, 2), ("content", 0, 400)]:
        rows.append((1, pos, kind, level, words, 0))
        pos += 1
    b = spark.createDataFrame(rows, "d long, pos long, kind string, level long, words long, section long")
    got = S.refine(b, ["d"], 160, 40)
    assert got.count() == len(rows)
    per = got.groupBy("path", "part").agg(F.sum("words").alias("w"), F.min("pos").alias("s")).orderBy("s").collect()
    assert [(r["s"], r["w"]) for r in per] == [(0, 52), (2, 92), (4, 69), (8, 2), (9, 400)]
    assert sum(r["w"] for r in per) == sum(r[4] for r in rows)


def test_parts_files_titles(spark):
    e = spark.createDataFrame([("b", 1, None, "Part I", "p1", 10), ("b", 2, 1, "One", "c1", 900), ("b", 3, None, "Tools", "t", 20), ("b", 4, 3, "A", "x", 500), ("b", 5, None, "Long", "l", 900), ("b", 6, 5, "S", "m", 9), ("b", 7, None, "Part 2", "n", 9)], "book string, entry long, parent long, title string, file string, words long")
    assert {r["entry"]: r["is_part"] for r in S.mark_parts(e).collect()} == {1: True, 2: False, 3: True, 4: False, 5: False, 6: False, 7: False}
    files = spark.createDataFrame([("b", "a", "chapter", 60), ("b", "c", "front", 70), ("b", "d", "chapter", 10), ("b", "e", "back", 99)], "book string, file string, kind string, words long")
    listed = spark.createDataFrame([("b", "e")], "book string, file string")
    assert [r["file"] for r in S.unlisted_files(files, listed).collect()] == ["a"]
    spans = spark.createDataFrame([("b", " My  Book", "chapter", 20), ("b", "My Book", "chapter", 900), ("b", "X", "chapter", 5), ("b", "My Book", "glossary", 5)], "book string, title string, kind string, words long")
    books = spark.createDataFrame([("b", "my book")], "book string, title string")
    assert sorted(r["kind"] for r in S.demote_title_page(spans, books).collect()) == ["chapter", "chapter", "front", "glossary"]
    heads = spark.createDataFrame([(1, 0, "heading", "Question 1", 2, "<h3>Question 1</h3>"), (1, 1, "content", "What is it?", 3, "<p><b>What is it?</b></p>"), (1, 2, "heading", "Plain", 1, "<h3>Plain</h3>"), (1, 3, "heading", "Q 2.", 2, "<h3>Q 2.</h3>"), (1, 4, "content", "no bold", 2, "<p>no bold</p>")], "p long, pos int, kind string, text string, words long, html string")
    assert [r["title"] for r in S.heading_titles(heads, ["p"]).orderBy("pos").collect()] == ["Question 1: What is it?", "Plain", "Q 2."]
    assert spark.createDataFrame([("exam-\nple A-\nB",)], "t string").select(S.join_hyphenated(F.col("t")).alias("x")).first()["x"] == "example A-\nB"


def test_clean_pages(spark):
    cases = {
        1: ("<title>Flow</title><body><h1>site</h1><main><h1>FLÔW!</h1><h3>If</h3><h4>Else</h4><h2>Summary</h2></main><h2>after</h2>", [("heading", 2, "If"), ("heading", 3, "Else"), ("heading", 2, "Summary")]),
        2: ("<body><p>a<nav>b<nav>c</nav>d</nav>e</p><div HIDDEN=''>f<div>g</div></div><svg/><p title='x hidden'>h<p hidden>i</body>", [("content", 0, "a"), ("content", 0, "e"), ("content", 0, "h"), ("content", 0, "i")]),
        3: ("<title>Other</title><body><article><h2>One<a href='#one'>#</a> <a href='#x'>two</a></h2>x<form>y<p>z</form></article><article>no</article>", [("heading", 2, "One two"), ("content", 0, "x")]),
        4: (None, []), 5: ("", []),
    }
    df = spark.createDataFrame([(k, x) for k, (x, _) in cases.items()], "page_id long, html string")
    got = S.clean_pages(df).orderBy("page_id", "pos").collect()
    for k, (_, want) in cases.items():
        assert [(r["kind"], r["level"], r["text"]) for r in got if r["page_id"] == k] == want


def test_a_chapter_per_file_without_contents(spark):
    starts = spark.createDataFrame([("a", 1, "One", 3), ("b", 1, "Lost", None)], "book string, entry long, title string, pos long")
    rows = [("a", "x", 0, "heading", "No"), ("b", "x", 0, "content", "t"), ("b", "x", 1, "heading", ""), ("b", "x", 2, "heading", "Named"), ("b", "y", 3, "content", "t"), ("c", "z", 0, "heading", "Z")]
    blocks = spark.createDataFrame(rows, "book string, file string, pos long, kind string, text string")
    assert sorted((r["book"], r["entry"], r["title"], r["pos"]) for r in S.starts_or_files(starts, blocks).collect()) == [("a", 1, "One", 3), ("b", 1, "Named", 0), ("b", 2, "y", 3), ("c", 1, "Z", 0)]


def test_summary_and_assignment(spark):
    b = spark.createDataFrame([("s", 1, "item", "one two three"), ("s", 2, "item", "too short"), ("s", 3, "paragraph", "not taken at all"), ("t", 1, "paragraph", "a b " + "c" * 400)], "s string, pos int, kind string, text string")
    got = {(r["s"], r["pos"]): r["item"] for r in M.summary_items(b, "s").collect()}
    assert set(got) == {("s", 1), ("t", 1)} and len(got["t", 1]) == 300 and got["t", 1].endswith("...")
    terms = spark.createDataFrame([("inner join", "#a"), ("outer", "#b"), ("absent", "#c")], "term string, href string")
    targets = spark.createDataFrame([("#a", k) for k in (9, 8, 7, 6)], "href string, section long")
    sections = spark.createDataFrame([(1, "the outermost"), (2, "An OUTER join"), (3, "outer")], "section_id long, text string")
    assert sorted((r["term"], r["section"] or 0) for r in M.assign_terms(terms, targets, sections).collect()) == [("absent", 0), ("inner join", 6), ("inner join", 7), ("inner join", 8), ("outer", 2)]


def test_layout(spark):
    two = [("d", 1, k, f"L{k}", 50.0, 700.0 - 20 * k, 200.0, 10.0, False) for k in range(12)] + [("d", 1, 20 + k, f"R{k}", 320.0, 700.0 - 20 * k, 200.0, 10.0, False) for k in range(12)]
    items = spark.createDataFrame(two, "doc string, page int, idx int, str string, x double, y double, width double, size double, mono boolean")
    assert 250 <= S.column_gutter(items).first()["gutter"] <= 320
    assert [r["str"] for r in S.reading_order(items).orderBy("position").collect()] == [f"L{k}" for k in range(12)] + [f"R{k}" for k in range(12)]
    assert S.group_lines(items).count() == 12 and S.column_gutter(items.limit(10)).count() == 0
    labels = spark.createDataFrame([("d", 1, 5, "CHAPTER 1:"), ("d", 2, 5, "Start"), ("d", 3, 6, "7"), ("d", 4, 9, "Other")], "doc string, pos int, page int, title string")
    assert [r["title"] for r in S.join_labels(labels).orderBy("pos").collect()] == ["CHAPTER 1: Start", "7", "Other"]


def test_running_lines_have_gaps_and_bands(spark):
    def page(n, tops, body=4, gap=40.0, code=False, foot=None):
        rows = [("d", n, k, t, x, y, 10.0, code) for k, (t, x, y) in enumerate(tops)]
        start = min([y for _, _, y in tops], default=800.0) - gap
        rows += [("d", n, 10 + k, f"Body {n} {k}", 72.0, start - 14 * k, 10.0, False) for k in range(body)]
        return rows + ([("d", n, 90, foot, 72.0, start - 14 * body - 30, 10.0, False)] if foot else [])

    rows = []
    for n in range(8):  # a two-line head with a number first or last, at heights that drift within a band
        rows += page(n, [("Title", 72.0, 800.0 + n * 0.4), (f"{n + 1}", 300.0, 800.0 + n * 0.4), (f"Part {n}", 72.0, 786.0 + n * 0.4)], foot="})" if n % 2 else f"{n + 1} | end")
    rows += page(8, [("Title", 72.0, 800.0)], gap=14.0)  # no gap: part of the body
    rows += page(9, [("Title", 72.0, 800.0)], code=True)
    items = spark.createDataFrame([(*r[:6], 30.0, *r[6:]) for r in rows], "doc string, page int, idx int, str string, x double, y double, width double, size double, mono boolean")
    got = sorted((r["page"], r["text"], r["number"]) for r in S.running_lines(S.group_lines(items)).collect())
    want = [(n, f"Title {n + 1}", f"{n + 1}") for n in range(8)] + [(n, f"Part {n}", None) for n in range(8)] + [(n, f"{n + 1} | end", None) for n in range(0, 8, 2)]
    assert [x for x in got if "end" not in x[1]] == sorted(want[:16]) and [x[:2] for x in got if "end" in x[1]] == [x[:2] for x in want[16:]]


def test_anchors_and_images_by_height(spark):
    blocks = spark.createDataFrame([("d", 1, 0, 700.0), ("d", 1, 1, 700.0), ("d", 1, 2, None), ("d", 1, 3, 500.0), ("d", 1, 4, 600.0)], "doc string, page int, pos long, top double")
    rows = [("a", "anchor", 696.0, 0), ("b", "anchor", 695.0, 4), ("c", "anchor", None, 0), ("e", "anchor", 400.0, None), ("f", "image", 800.0, 0), ("g", "image", 650.0, 3), ("h", "image", 499.0, None), ("i", "image", None, None)]
    marks = spark.createDataFrame([("d", 1, *r[:3]) for r in rows] + [("d", 2, "z", "anchor", 5.0)], "doc string, page int, mark string, kind string, top double")
    placed = S.place_marks(blocks, marks)
    assert {r["mark"]: r["pos"] for r in placed.collect()} == {r[0]: r[3] for r in rows} | {"z": None}
    assert "Join" not in placed._jdf.queryExecution().optimizedPlan().toString()


def test_chapter_spans(spark):
    starts = spark.createDataFrame([("b", 1, "One", 3), ("b", 2, "Dup", 3), ("b", 3, "Two", 8), ("b", 4, "Lost", None), ("b", 5, "Back", 5)], "book string, entry long, title string, pos long")
    ends = spark.createDataFrame([("b", 12)], "book string, n long")
    got = [(r["title"], r["start"], r["end"]) for r in S.chapter_spans(starts, ends).orderBy("start").collect()]
    assert got == [("Front", 0, 3), ("One", 3, 5), ("Back", 5, 8), ("Two", 8, 12)]
    assert sorted((r["entry"], r["code"]) for r in S.order_warnings(starts).collect()) == [(4, "toc_target_missing"), (5, "toc_order")]


def test_terms(spark):
    raw = ["“Big Data”,", "only", "Note", "a = b", "x" * 70, "one two three four five six seven", "42", "Ends. Here", " join  order "]
    df = spark.createDataFrame([(k, t, 6) for k, t in enumerate(raw)], "k int, term string, max_words int")
    assert [r["term"] for r in M.clean_terms(df).orderBy("k").collect()] == ["Big Data", "join order"]
    page = spark.createDataFrame([(1, "<p>A <b>bold term</b> and <em>stress</em>.</p><p><strong>Whole</strong></p><h2><b>no</b></h2><dfn>def</dfn>")], "page_id long, html string")
    assert sorted((r["source"], r["term"]) for r in M.marked_terms(page).collect()) == [("bold", "bold term"), ("dfn", "def"), ("emphasis", "stress")]
    items = spark.createDataFrame([(1, 1, "dt", "Join", ""), (1, 2, "dd", "two tables", ""), (1, 3, "dd", "on keys", ""), (1, 4, "dt", "join", ""), (1, 5, "p", "", "<b>Key</b>: a column")], "c long, pos int, tag string, text string, html string")
    assert [(r["term"], r["definition"]) for r in M.glossary_entries(items, "c").orderBy("pos").collect()] == [("Join", "two tables on keys"), ("Key", "a column")]
    idx = spark.createDataFrame([(1, None, "joins, 4, 9-11", ["a#1"]), (2, 1, "outer, 12", ["b", "c"])], "pos int, parent int, text string, hrefs array<string>")
    assert [(r["term"], r["href"]) for r in M.index_entries(idx).orderBy("pos", "href").collect()] == [("joins", "a#1"), ("outer (joins)", "b"), ("outer (joins)", "c")]


def test_strings_in_texts(spark):
    from quillspan.operators.patterns import find_strings

    texts = spark.createDataFrame([(1, "the cat, the théâtre"), (2, "a theatre cat2 the cats"), (3, None), (4, ""), (5, "cat")], "id long, t string")
    wanted = spark.createDataFrame([(x,) for x in ("the", "the cat", "cat", "cat, the", "é", "atr", "", None, "cat", "zz")], "s string")
    for options in ({}, {"block_strings": 2}, {"block_chars": 3}):
        got = sorted((r["string"], r["id"]) for r in find_strings(texts, "id", "t", wanted, "s", **options).collect())
        assert got == sorted([(s, i) for i, t in ((1, "the cat, the théâtre"), (2, "a theatre cat2 the cats"), (5, "cat")) for s in ("the", "the cat", "cat", "cat, the", "é", "atr") if s in t])
        words = sorted((r["string"], r["id"]) for r in find_strings(texts, "id", "t", wanted, "s", whole_words=True, **options).collect())
        assert words == [("cat", 1), ("cat", 5), ("cat, the", 1), ("the", 1), ("the", 2), ("the cat", 1)]
    assert find_strings(texts.limit(0), "id", "t", wanted, "s").count() == find_strings(texts, "id", "t", wanted.limit(0), "s").count() == 0


def test_short_quotes_and_terms_need_no_nested_loop(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumnRenamed("doc_id", "section_id")
    quotes = spark.createDataFrame([(1, "the"), (2, "of the"), (3, "in the o"), (4, "no such quote here"), (5, "")], "quote_id long, quote string")
    found = C.ground_quotes(quotes, docs, "quote_id", "quote", "section_id", "text")
    terms = M.first_section_with(spark.createDataFrame([("the",), ("The and",), ("of the",)], "term string"), docs)
    for df in (found, terms):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    plain = {r["section_id"]: " ".join(r["text"].lower().split()) for r in docs.collect()}
    got = {}
    for r in found.collect():
        got.setdefault(r["quote_id"], set()).add(r["section_id"])
    assert set(got) == {1, 2, 3} and {k: len(v) for k, v in got.items()} == {k: sum(q in t for t in plain.values()) for k, q in ((1, "the"), (2, "of the"), (3, "in the o"))}


def test_quotes_and_references(spark):
    pairs = spark.createDataFrame([("A **quick** test … of it", "quick ... of it"), ("text", ""), ("text", "other"), ("It’s", "it's")], "text string, quote string")
    assert [r["found"] for r in C.ground_known(pairs, "text", "quote").collect()] == [True, False, False, True]
    answers = spark.createDataFrame([(1, "A [1] b [2][2] c `[1]` d [3]."), (2, "none [1]")], "answer long, text string")
    refs = spark.createDataFrame([(1, 1, "s", "missing words"), (1, 2, "s", "some text"), (1, 3, "t", "more")], "answer long, number long, source_id string, quote string")
    src = spark.createDataFrame([("s", "Some *text* here"), ("t", "much more")], "source_id string, source_text string")
    fixed, kept = C.check_references(answers, refs, src)
    assert {r["answer"]: r["text"] for r in fixed.collect()} == {1: "A b [1] c `[1]` d [2].", 2: "none"}
    assert sorted((r["number"], r["new"]) for r in kept.collect()) == [(2, 1), (3, 2)]
    q = spark.createDataFrame([("s", 1, "T", ["a", "b"], 1), ("s", 2, "", ["a", "b"], 0), ("s", 3, "T", ["a", "a"], 0), ("s", 4, "Open", [], None), ("u", 1, "T", ["a", "b"], 0)], "set_id string, pos int, text string, choices array<string>, answer int")
    assert sorted((r["set_id"], r["pos"]) for r in C.usable_questions(q).collect()) == [("s", 1), ("s", 4)]


def test_prerequisites_are_resolved_in_order_of_the_concepts(spark):
    wanted = [
        ("ale", "nobody", 1), ("ale", "n2", 2), ("ale", "ale", 3), ("ale", "dew", 4),
        ("bun", "ale", 1), ("bun", "cob", 2), ("bun", "n3", 3),
        ("cob", "dew", 1), ("dew", "ale", 1), ("dew", "old", 2),
    ]
    known = spark.createDataFrame([("n2", "bun"), ("n3", "cob"), *[(x, x) for x in ("ale", "bun", "cob", "dew", "old")]], "reference string, slug string")
    existing = spark.createDataFrame([("old", "dew")], "concept string, needs string")
    got = C.prerequisite_edges(spark.createDataFrame(wanted, "concept string, needs string, pos long"), existing, known)
    # ale comes first, so bun may not need it, though that is bun's first wish; the fourth wish of ale does not move up
    assert sorted(tuple(r) for r in got.collect()) == [("ale", "bun"), ("bun", "cob"), ("cob", "dew"), ("dew", "ale")]


def _marks_one_by_one(concepts, marks, sessions, members):
    """The marks applied to dictionaries, in order of the ids."""
    concepts, sessions, members = {c["id"]: dict(c) for c in concepts}, {s["session_id"]: dict(s) for s in sessions}, list(members)
    new, results = {}, {}
    for i, mark in sorted(marks.items()):
        c = concepts[i]
        out = results.setdefault(c["subject_id"], {"reused": [], "queued": 0, "skipped": 0})
        own = [s for s, x in members if x == i and sessions[s]["kind"] == "diagnose" and sessions[s]["status"] != "finished"]
        waits = own if c["status"] == "to_test" else []
        if mark == "test" and waits:
            out["reused"].append(max(waits))
            continue
        if waits:
            members = [(s, x) for s, x in members if x != i or s not in waits]
            for s in waits:
                sessions[s]["total"] = sum(1 for t, _ in members if t == s)
                if not sessions[s]["total"]:
                    del sessions[s]
        out["queued"] += mark == "learn"
        out["skipped"] += mark == "skip"
        if mark == "learn":
            if c["status"] != "queued":
                places = [x["queue_pos"] for x in concepts.values() if x["subject_id"] == c["subject_id"] and x["queue_pos"] is not None]
                c |= {"status": "queued", "queue_pos": max(places, default=0) + 1}
        else:
            c |= {"status": {"later": "new", "skip": "skipped", "test": "to_test"}[mark], "queue_pos": None}
            if mark == "test":
                new.setdefault(c["subject_id"], []).append(i)
    top = 900  # the highest id given below
    for k, subject in enumerate(sorted(new), 1):
        modules = {concepts[i]["module"] for i in new[subject]}
        sessions[top + k] = {"session_id": top + k, "subject_id": subject, "module": modules.pop() if len(modules) == 1 else None, "kind": "diagnose", "status": "preparing", "total": len(new[subject])}
        members += [(top + k, i) for i in new[subject]]
        results[subject]["session"] = top + k
    rows = [(x, r.get("session") or max(r["reused"], default=None), "session" in r, r["queued"], r["skipped"]) for x, r in results.items()]
    return concepts.values(), sessions.values(), members, rows


@pytest.mark.parametrize("seed", [5, 6])
def test_marks_and_their_sessions(spark, seed):
    import random

    rng = random.Random(seed)
    statuses = ["new", "to_test", "to_test", "known", "queued", "learning", "skipped"]
    concepts = []
    for i in range(1, 81):
        status = rng.choice(statuses)
        concepts.append({"id": i, "subject_id": i % 7, "module": f"m{rng.randrange(2)}", "status": status, "queue_pos": rng.randrange(1, 50) if status in ("queued", "learning") else None})
    sessions = [{"session_id": s, "subject_id": s % 7, "module": None, "kind": rng.choice(["diagnose", "diagnose", "test"]), "status": rng.choice(["ready", "preparing", "finished"])} for s in [*range(100, 170), 900]]
    members = sorted({(s["session_id"], c["id"]) for c in concepts for s in rng.sample([s for s in sessions if s["subject_id"] == c["subject_id"]], 2)})
    for s in sessions:
        s["total"] = sum(1 for t, _ in members if t == s["session_id"])
    sessions = [s for s in sessions if s["total"] or s["session_id"] == 900]
    marks = {i: rng.choice(["learn", "later", "skip", "test", "test"]) for i in rng.sample(range(1, 81), 50) if i % 7 != 3}
    marked = [*marks.items(), (4000, "learn"), (2, "nonsense") if 2 not in marks else (4001, "skip"), (4002, None)]
    c = spark.createDataFrame([tuple(x.values()) for x in concepts], "id long, subject_id long, module string, status string, queue_pos long")
    s = spark.createDataFrame([tuple(x.values()) for x in sessions], "session_id long, subject_id long, module string, kind string, status string, total long")
    m = spark.createDataFrame(marked, "id long, mark string")
    got = L.apply_marks(c, m, s, spark.createDataFrame(members, "session_id long, concept_id long"))
    want = _marks_one_by_one(concepts, marks, sessions, members)
    key = lambda r: tuple((x is not None, x) for x in r)
    rows = lambda df, names: sorted((tuple(r[n] for n in names) for r in df.collect()), key=key)
    for df, plain, names in ((got.concepts, want[0], ["id", "status", "queue_pos"]), (got.sessions, want[1], ["session_id", "subject_id", "module", "kind", "status", "total"])):
        assert rows(df, names) == sorted((tuple(x[n] for n in names) for x in plain), key=key)
    assert rows(got.members, ["session_id", "concept_id"]) == sorted(want[2])
    assert rows(got.left, ["session_id", "concept_id"]) == sorted(set(members) - set(want[2]))
    assert rows(got.results, ["subject_id", "session_id", "new_session", "queued", "skipped"]) == sorted(want[3], key=key)
    bad = {(r["id"], r["problem"]) for r in L.bad_marks(c, m).collect()}
    assert {(4000, "no_concept"), (4002, "no_concept")} <= bad and all(i not in marks for i, _ in bad)


def test_no_marks_and_no_sessions(spark):
    c = spark.createDataFrame([(1, 1, "m", "to_test", None), (2, 1, "m", "learning", 3)], "id long, subject_id long, module string, status string, queue_pos long")
    s = spark.createDataFrame([], "session_id long, subject_id long, module string, kind string, status string, total long")
    m = spark.createDataFrame([], "session_id long, concept_id long")
    none = L.apply_marks(c, spark.createDataFrame([], "id long, mark string"), s, m)
    assert none.concepts.count() == 2 and not none.sessions.take(1) and not none.results.take(1)
    some = L.apply_marks(c, spark.createDataFrame([(1, "test"), (2, "learn")], "id long, mark string"), s, m)
    assert some.sessions.select("session_id", "module", "total").collect() == [(1, "m", 1)]
    assert {(r["id"], r["status"], r["queue_pos"]) for r in some.concepts.collect()} == {(1, "to_test", None), (2, "queued", 4)}


def test_choices_after_results(spark):
    c = spark.createDataFrame([(1, 1, "queued", 9), (2, 1, "known", None), (3, 1, "queued", 4), (4, 1, "failed", None)], "id long, subject_id long, status string, queue_pos long")
    got = L.apply_choices(c, spark.createDataFrame([(1, "skip"), (2, "keep"), (3, "learn"), (4, "learn")], "id long, choice string"))
    assert {(r["id"], r["status"], r["queue_pos"]) for r in got.collect()} == {(1, "skipped", None), (2, "known", None), (3, "queued", 5), (4, "queued", 6)}


def test_decisions_and_slugs(spark):
    d = spark.createDataFrame([(10, 1, "add", None), (11, 2, "join", 10), (12, 3, "join", 11), (13, 4, "join", 14), (14, 5, "join", 99)], "id long, pos long, action string, join_with long")
    assert {r["id"]: r["target"] for r in C.apply_decisions(d).collect()} == {10: 10, 11: 10, 12: 10, 13: 13, 14: 99}
    s = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a-2"), (4, "a"), (5, "b")], "id long, base string")
    got = {r["id"]: r["slug"] for r in C.unique_slugs(s, "base", "id", spark.createDataFrame([("a-3",)], "slug string")).collect()}
    assert got[1] == "a" and got[2] == "a-2" and got[5] == "b" and len(set(got.values())) == 5 and "a-3" not in got.values()


def test_robots_and_redirects(spark):
    text = "User-agent: *\nDisallow: /private\nAllow: /private/open\nDisallow: /*.pdf$\n\nUser-agent: GPTBot\nUser-agent: CCBot\nDisallow: /secret"
    lines = spark.createDataFrame([("h", k, x) for k, x in enumerate(text.split("\n"))], "host string, pos int, line string")
    paths = spark.createDataFrame([("h", p) for p in ("/", "/private/x", "/private/open/y", "/a.pdf", "/a.pdf?x", "/secret")] + [("other", "/private")], "host string, path string")
    got = {(r["host"], r["path"]): r["allowed"] for r in W.robots_allow(paths, W.robots_rules(lines, "mine")).collect()}
    assert got == {("h", "/"): True, ("h", "/private/x"): False, ("h", "/private/open/y"): True, ("h", "/a.pdf"): False, ("h", "/a.pdf?x"): True, ("h", "/secret"): False, ("other", "/private"): True}
    own = lines.unionAll(spark.createDataFrame([("h", 90, "User-agent: Mine"), ("h", 91, "Disallow:")], lines.schema))
    assert all(r["allowed"] for r in W.robots_allow(paths, W.robots_rules(own, "mine")).collect())


def test_addresses(spark):
    df = spark.createDataFrame([("../c?x=1#y", "https://S.com/a/b/d"), ("mailto:x", "https://s.com/"), ("//t.com/z", "http://s.com/"), ("#only", "https://s.com/p?q")], "h string, b string")
    assert [r["x"] for r in df.select(W.absolute_url("h", "b").alias("x")).collect()] == ["https://s.com/a/c?x=1", None, "http://t.com/z", "https://s.com/p"]
    urls = spark.createDataFrame([("https://s.com/en/docs/first",), ("https://s.com/a.html",)], "start string")
    got = [(r["start"], r["url"]) for r in W.llms_urls(urls).orderBy("start", "rank").collect()]
    assert [u for s, u in got if s.endswith("first")] == [f"https://s.com/{p}llms.txt" for p in ("en/docs/first/", "en/docs/", "en/", "")]
    assert [u for s, u in got if s.endswith("html")] == ["https://s.com/llms.txt"]
    md = ["# Site", "## Guide", "- [One](https://s.com/g/1): x", "- [Out](https://o.com/)", "## API", "- [Two](https://s.com/a/2)", "- [One again](https://s.com/g/1#h)"]
    lines = spark.createDataFrame([("s", k, x) for k, x in enumerate(md)], "site string, pos int, line string")
    assert [(r["chapter"], r["title"]) for r in W.llms_chapters(lines, "https://s.com/").orderBy("pos").collect()] == [("Guide", "One"), ("API", "Two")]


def test_near_duplicates_anchor_and_invariant(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    links, classes = N.near_duplicates(docs)
    same = {r["id"]: r["cls"] for r in classes.collect()}
    pairs = [(r["a"], r["b"]) for r in links.collect()]
    assert all(same[a] == a and same[b] == b and a < b for a, b in pairs)
    gone = set()
    for x in sorted(set(same.values())):
        if any(b == x and a not in gone for a, b in pairs):
            gone.add(x)
    gone |= {i for i, c in same.items() if i != c}
    assert len(gone) == 13
    assert {r["doc_id"] for r in N.drop_near_duplicates(docs).collect()} == {r["doc_id"] for r in docs.collect()} - gone


def test_near_duplicates_keep_the_first_of_each(spark):
    """Rounds give what a pass in order gives, where families overlap, chains alternate and many share a passage without being similar."""
    import random

    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = []
    for _ in range(6):
        base = words(70)
        for _ in range(12):
            base = [w if rng.random() > 0.008 else f"x{rng.randrange(10**6)}" for w in base]  # drifts away step by step
            texts.append(list(base))
    passage = words(40)
    texts += [passage + words(15) for _ in range(40)]
    rng.shuffle(texts)
    rows = [(k * 7 % 1009, " ".join(t)) for k, t in enumerate(texts)] + [(2000, "too short"), (2001, None)]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows[: len(texts)]}
    kept = []
    for i in sorted(sets):
        if not any(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8 for j in kept):
            kept.append(i)
    got = N.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == [*kept, 2000, 2001] and 40 < len(kept) < len(sets)


def test_a_large_family_is_dropped_in_one_round(spark, monkeypatch):
    """Of 10,000 texts that differ in the last word each meets the first one only."""
    met = []
    similar = N._similar

    def counted(pairs, *rest):
        met.append(pairs.count())
        return similar(pairs, *rest)

    monkeypatch.setattr(N, "_similar", counted)
    base = " ".join(f"word{k}" for k in range(60))
    docs = spark.range(10_000).select(F.col("id").alias("doc_id"), F.concat(F.lit(base + " end"), F.col("id").cast("string")).alias("text"))
    assert [r["doc_id"] for r in N.drop_near_duplicates(docs).collect()] == [0]
    assert met == [9_999]


def test_shingle_sets_are_those_of_the_words(spark):
    """Words are told apart by letters and digits of any script, whatever stands between; sets by their shingles, in texts before and after each other and across slices."""
    import random
    import re

    rng = random.Random(3)
    some = ["a", "aa", "ab", "ba", "b", "é", "e", "über", "中文", "𝒳", "x1", "1x", "٣"]
    texts = [None, "", " ", "...", "one two three four", "one two three four five", "  One--two THREE_four\n five  ", "Five four three two one."]
    texts += [rng.choice(["", "-"]) + rng.choice([" ", ", ", "\n"]).join(rng.choice(some) for _ in range(rng.randrange(4, 60))) for _ in range(300)]
    texts += [" ".join(f"w{rng.randrange(50)}" for _ in range(60_000)), texts[4], texts[5]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r["id"]: r for r in N.shingle_sets(docs, min_words=5).collect()}
    words = [re.findall(r"[^\W_]+", (t or "").lower()) for t in texts]
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, w in enumerate(words) if len(w) >= 5}
    assert {k: (r["words"], r["n"]) for k, r in got.items()} == {k: (len(words[k]), len(x)) for k, x in sets.items()}
    assert all(r["grams"] == sorted(set(r["grams"])) for r in got.values())
    assert len({g for x in sets.values() for g in x}) == len({g for r in got.values() for g in r["grams"]})
    assert all(len(sets[a] & sets[b]) == len(set(got[a]["grams"]) & set(got[b]["grams"])) and (sets[a] == sets[b]) == (got[a]["same"] == got[b]["same"]) for a in sets for b in sets if a < b)


def test_texts_that_share_rare_shingles_are_compared_at_once(spark, monkeypatch):
    """A passage in a few texts costs no rounds, and a line in most texts no second count of all prefixes; a large family still meets its first member only."""
    import random

    tags, met = [], []
    cut, similar = N.cut, N._similar
    monkeypatch.setattr(N, "cut", lambda df, tag: tags.append(tag) or cut(df, tag))
    monkeypatch.setattr(N, "_similar", lambda pairs, *rest: (met.append(pairs.count()), similar(pairs, *rest))[1])
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, line = words(30), words(7)
    texts = [passage + words(60) for _ in range(20)] + [line + words(60) for _ in range(120)]
    pairs = [words(80) for _ in range(15)]
    texts += pairs + [[*t[:-1], "other"] for t in pairs]
    docs = lambda rows: spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(rows)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in N.drop_near_duplicates(docs(texts)).collect()) == list(range(155))
    assert tags.count("shared") == 1 and tags.count("leaders") == 0 and len(met) == 1
    met.clear()
    base = words(80)
    family = [[*base, f"end{k}"] for k in range(100)]
    assert sorted(r["doc_id"] for r in N.drop_near_duplicates(docs(texts + family)).collect()) == [*range(155), 170]
    assert sum(met) < 500


def test_marks_with_tags_inside(spark):
    from quillspan.operators import terms as M

    page = "<p>An <b>alpha <i>beta</i></b> and <strong>gamma<p>next <em>delta</em></p><p><b>a whole paragraph</b></p><h2><b>no</b></h2><p><dfn>whole</dfn></p>"
    got = sorted((r["source"], r["term"]) for r in M.marked_terms(spark.createDataFrame([(1, page)], "page_id long, html string")).collect())
    assert got == [("bold", "alpha beta"), ("bold", "gamma"), ("dfn", "whole"), ("emphasis", "beta"), ("emphasis", "delta")]


def _links(spark, page):
    got = K.collect_links(spark.createDataFrame([(1, "http://s.org/x/", page), (2, "http://s.org/x/", ""), (3, "http://s.org/x/", None)], "page_id long, url string, html string")).orderBy("pos").collect()
    return [(r["text"], r["url"] and r["url"].removeprefix("http://s.org/x/"), r["depth"]) for r in got]


def test_link_groups(spark):
    page = "<body><ul><li><b>Start</b> here<ul><li><a href='a'>A</a><li><a href='b'>B</a></ul></li><li>Alone</li><li><a href='#x'>C</a> more<ol><li>deep<ul><li><a href='c'>D</a></ul></ol></ul><li>no list <script>var a = '<li>';</script>"
    assert _links(spark, page) == [("Start here", None, 1), ("A", "a", 2), ("B", "b", 2), ("Alone", None, 1), ("C", "", 1), ("deep", None, 2), ("D", "c", 3), ("no list", None, 0)]
    # a child that holds a list is no part of the item, whatever it holds besides; tags that are never closed do not matter
    page = "<ol><li><label>Guides</label><nav>menu<div><ul><li><a href='g'>G</a></ul></div>end</nav> too<li><p>Open<div><a>anchor</a></div><li>x<!-- <ul> --><p>y</ol>"
    assert _links(spark, page) == [("Guides too", None, 1), ("G", "g", 2), ("x y", None, 1)]
    assert _links(spark, f"<ul><li>{'w' * 101}</li><li>{'v' * 100}</li></ul>") == [("v" * 100, None, 1)]


def test_link_texts(spark):
    page = "<a href='mailto:x'>mail</a><a href='day'><span>Day 1</span><h4>What<br>is it?</h4><h5>no</h5></a><h2><a href='q'>in <b>a</b>head</a></h2><a href=q><img alt=x></a><a href=i aria-label='Next &amp; on'><img></a><a href=t title=T></a>"
    page += "<a name=x>no address</a><a href='z'>Z<b>z</b><br>y</a><a title='a > b' href='z'>Zz y</a><a href=''>here</a>"
    assert _links(spark, page) == [("What is it?", "day", 0), ("in ahead", "q", 0), ("Next & on", "i", 0), ("T", "t", 0), ("Zz y", "z", 0)]


def test_frames_of_the_site(spark):
    page = "<noscript><iframe src='toc.html'></iframe></noscript><iframe src='//other.test/a'></iframe><iframe src='/x/toc.html#a'></iframe><iframe></iframe><IFRAME SRC=b.html>"
    rows = K.collect_frames(spark.createDataFrame([(1, "http://s.org/x/", page)], "page_id long, url string, html string")).orderBy("pos").collect()
    assert [(r["pos"], r["url"]) for r in rows] == [(0, "http://s.org/x/toc.html"), (1, "http://s.org/x/b.html")]


def test_group_titles_with_links_below(spark):
    rows = [("g", None, 1), ("a", "h", 1), ("h", None, 2), ("b", "h", 1), ("i", None, 1), ("j", None, 2), ("c", "h", 3), ("k", None, 2), ("l", None, 1), ("out", "x", 2), ("m", None, 1), ("d", "h", 1), ("n", None, 1)]
    items = spark.createDataFrame([(1, k, *r) for k, r in enumerate(rows)], "page_id long, pos long, text string, url string, depth long")
    assert [r["text"] for r in K.scoped_items(items, "page_id", F.lit("h")).orderBy("pos").collect()] == ["g", "a", "b", "i", "j", "c", "m", "d"]


def test_links_of_a_large_page_cost_no_more_than_its_tags(spark):
    """Each row of the plan comes from one tag: the only join is with the pages' addresses, no window collects."""
    page = "<body>" + "".join(f"<p><a href='p{k}'>Link {k}</a> text</p><ul><li>item {k}</ul>" for k in range(4000))
    df = K.collect_links(spark.createDataFrame([(1, "http://s.org/x/", page)], "page_id long, url string, html string"))
    assert df.count() == 8000
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and not [x for x in plan.split("\n") if "Window" in x and "collect_list" in x]


def test_fences_close_by_their_own_kind(spark):
    text = ["[0:05] one", "```", "~~~", "[0:07] code", "```", "[0:09] two", "~~~", "```", "~~~", "[0:11] three", "```", "[0:13] code to the end"]
    lines = spark.createDataFrame([("v", k, x) for k, x in enumerate(text)], "video string, pos int, line string")
    assert [r["start"] for r in V.parse_transcript(lines).orderBy("para").collect()] == [5, 9, 11]
    words = [(r["word"], r["pos"], r["offset"], r["length"]) for r in V.placed_words(lines).orderBy("k").collect()]
    assert words == [("one", 0, 7, 3), ("two", 5, 7, 3), ("three", 9, 7, 5)]


def test_suggested_order(spark):
    rows = [(9, "b", "basic", 1), (8, "a", "advanced", 2), (7, "a", "basic", 3), (6, "b", "basic", 4), (5, "c", "basic", 5)]
    concepts = spark.createDataFrame([(i, 1, m, lv, "queued", p) for i, m, lv, p in rows], "id long, subject_id long, module string, level string, status string, queue_pos long")
    order = lambda edges: [r["id"] for r in L.suggested_order(concepts, spark.createDataFrame(edges, "concept_id long, prereq_id long")).orderBy("position").collect()]
    assert order([(7, 5), (99, 7)]) == [8, 9, 6, 5, 7]
    assert order([(8, 7), (7, 9), (9, 7)]) == [6, 5, 7, 8, 9]


def test_split_unlisted_files(spark):
    rows = [(1, 0, "front", "Preface", 0, "a", "heading", "P", 2), (1, 0, "front", "Preface", 1, "x/ad.html", "content", "buy", 9), (1, 0, "front", "Preface", 2, "b", "content", "t", 4), (1, 1, "chapter", "One", 3, "c", "heading", "One", 1), (1, 1, "chapter", "One", 4, "d", "content", "more", 70), (1, 2, "index", "Index", 5, "e", "content", "i", 3), (1, 2, "index", "Index", 6, "f", "content", "s", 1), (1, 2, "index", "Index", 7, "f", "heading", "Other books", 2)]
    blocks = spark.createDataFrame(rows, "book long, span long, span_kind string, span_title string, pos long, file string, kind string, text string, words long")
    listed = spark.createDataFrame([(1, f) for f in "abce"], "book long, file string")
    got = [tuple(r) for r in S.split_unlisted(blocks, listed).orderBy("start").collect()]
    assert got == [(1, 0, 0, "front", "Preface", 0, 1, 2), (1, 0, 1, "front", "ad.html", 1, 3, 13), (1, 1, 0, "chapter", "One", 3, 5, 71), (1, 2, 0, "index", "Index", 5, 6, 3), (1, 2, 1, "back", "Other books", 6, 8, 3)]
    files = spark.createDataFrame([(1, "d", "chapter", 70), (1, "f", "index", 60), (1, "g", "chapter", 50)], "book long, file string, kind string, words long")
    assert [r["file"] for r in S.unlisted_files(files.where("kind = 'chapter'"), listed).collect()] == ["d"]


def test_incremental_ingest_and_stream(spark, tmp_path):
    from quillspan.streaming.attempts import ingest_chapters

    src = str(tmp_path / "in")
    rows = spark.createDataFrame([(1, 1, 1, "a"), (1, 1, 2, "b"), (1, 2, 1, "c")], "book_id long, chapter long, number long, body string")
    rows.coalesce(1).write.parquet(src)
    args = (spark, src, rows.schema, lambda df: D.chapter_fingerprint(df, "v"), ["book_id", "chapter"], str(tmp_path / "manifest"), str(tmp_path / "work"), str(tmp_path / "state"))
    assert ingest_chapters(*args) == 2
    rows.where("chapter = 1").coalesce(1).write.mode("append").parquet(src)
    assert ingest_chapters(*args) == 0
    rows.where("chapter = 2").withColumn("body", F.lit("new")).coalesce(1).write.mode("append").parquet(src)
    assert ingest_chapters(*args) == 1


def test_ingest_survives_a_failure_between_its_tables(spark, tmp_path, monkeypatch):
    """The work of a batch is written, the manifest is not; the batch that is delivered again takes its place."""
    from pyspark.errors import StreamingQueryException
    from pyspark.sql.readwriter import DataFrameWriter

    from quillspan.streaming.attempts import ingest_chapters, ingested

    src, manifest, work = (str(tmp_path / x) for x in ("in", "manifest", "work"))
    rows = spark.createDataFrame([(1, c, 1, f"text {c}") for c in range(4)], "book_id long, chapter long, number long, body string")
    for c in range(4):
        rows.where(f"chapter = {c}").coalesce(1).write.mode("append").parquet(src)
    schema, keys = D.chapter_fingerprint(rows, "v").schema, ["book_id", "chapter"]
    args = (spark, src, rows.schema, lambda df: D.chapter_fingerprint(df, "v"), keys, manifest, work, str(tmp_path / "state"))
    write = DataFrameWriter.parquet

    def fails(self, path, *rest, **named):
        if path.endswith("manifest/epoch=2"):
            raise RuntimeError("lost")
        return write(self, path, *rest, **named)

    monkeypatch.setattr(DataFrameWriter, "parquet", fails)
    with pytest.raises(StreamingQueryException):
        ingest_chapters(*args)
    read = lambda: sorted(r["chapter"] for r in ingested(spark, schema, keys, manifest, work).collect())
    assert len(read()) == 2 and spark.read.parquet(work).count() == 3
    monkeypatch.setattr(DataFrameWriter, "parquet", write)
    assert ingest_chapters(*args) == 2
    assert read() == [0, 1, 2, 3] and spark.read.parquet(work).count() == 4


def test_parts_of_the_stream_are_summed_up(spark, tmp_path):
    from quillspan.streaming.attempts import run_latest_attempts

    src, table = str(tmp_path / "in"), str(tmp_path / "table")
    rows = [(k, k % 5, k % 3, k % 4 == 0) for k in range(45)]
    log = spark.createDataFrame(rows, "id long, session_id long, score long, disputed boolean")
    args = (spark, src, log.schema, ["session_id"], table, str(tmp_path / "state"))
    for k in range(9):
        log.where(f"id % 9 = {k}").coalesce(1).write.mode("append").parquet(src)
    got = run_latest_attempts(*args, most_parts=2)
    want = {s: max(r for r in rows if r[1] == s) for s in range(5)}
    assert {r["session_id"]: (r["id"], r["score"], r["correct"]) for r in got.collect()} == {s: (i, sc, sc == 2 or d) for s, (i, _, sc, d) in want.items()}
    assert len(list((tmp_path / "table").glob("generation=*/epoch=*"))) <= 6
    assert run_latest_attempts(*args, most_parts=2).count() == 5


def test_request_groups_stream_over_small_and_large_keys(spark):
    import random

    rng = random.Random(3)
    rows = [(b, c, k, rng.randrange(60)) for b in (1, None, 2) for c in range(40) for k in range(rng.choice((1, 2, 3, 300)))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "b long, c long, number long, words long").repartition(7)
    want, at = {}, None
    for b, c, k, words in sorted(rows, key=lambda r: (r[0] or 0, *r[1:])):
        size = -(-words * 14 // 10)
        if (b, c) != at:
            at, group, held, total = (b, c), 1, 0, 0
        elif held >= 4 or total + size > 90:
            group, held, total = group + 1, 0, 0
        held, total = held + 1, total + size
        want[b, c, k] = group
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        got = S.group_sections(df, ["b", "c"], 4, 90)
        assert {(r["b"], r["c"], r["number"]): r["grp"] for r in got.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()  # a batch per key


def test_links_of_many_that_share_a_passage_move_few_sets(spark, monkeypatch):
    """Every similar pair is found, in a family as large as a frequent shingle and more; texts that only share a passage are no candidates."""
    import random

    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    base, passage = words(80), words(9)
    texts = [[w if rng.random() > 0.012 else f"x{rng.randrange(10**6)}" for w in base] for _ in range(50)] + [passage + words(60) for _ in range(120)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    want = {(a, b) for b in range(len(sets)) for a in range(b) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8 and sets[a] != sets[b]}
    met = []
    similar = N._similar
    monkeypatch.setattr(N, "_similar", lambda pairs, *rest: (met.append(pairs.count()), similar(pairs, *rest))[1])
    links, classes = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    own = {r["id"]: r["cls"] for r in classes.collect()}
    assert {(r["a"], r["b"]) for r in links.collect()} == {(a, b) for a, b in want if own[a] == a and own[b] == b} and len(want) > 100
    assert met[0] <= 50 * 49 // 2


def test_sources_are_reduced_to_their_concepts_before_the_join(spark):
    """A concept that many sections name meets the concepts once, not once for each source."""
    from quillspan.operators import sets

    concepts = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    sources = spark.createDataFrame([(k % 2 + 1, k) for k in range(50)] + [(None, 9)], "concept_id long, section_id long")
    got = sets.left_with_sources(concepts, sources)
    assert sorted(r["id"] for r in got.collect()) == [1, 2]
    assert "Aggregate [id" in got._jdf.queryExecution().optimizedPlan().toString()


def test_clips_join_by_lines_as_by_words(spark):
    """Words of lines far from the overlap never become rows; the results stay those of the placed words."""
    import random

    rng = random.Random(3)
    words = [f"w{k}{'.' if k % 9 == 0 else ''}" for k in range(60)]
    one, two, over = [], [], []
    for v in range(30):
        at, said = 0, [rng.choice(words) for _ in range(200)]
        for k in range(12):
            at += rng.choice((0, 20, 90))
            line = f"[{at // 60:02d}:{at % 60:02d}] " * (k % 5 != 3) + " ".join(said[k * 15 : k * 15 + 15]) * (k % 7 != 6)
            one.append((v, k, "# head" if k == 4 else line))
            two.append((v, k, line if v % 3 else line.replace("w1", "x1")))
        over.append((v, None if v == 7 else 100, at - 60))
    a, b = (spark.createDataFrame(x, "video long, pos int, line string") for x in (one, two))
    o = spark.createDataFrame(over, "video long, start long, end long")
    want = sorted(map(str, V.join_clips(V.placed_words(a), V.placed_words(b), o).collect()))
    got = V.join_clip_lines(a, b, o)
    assert sorted(map(str, got.collect())) == want and len({x.split("method='")[1][:4] for x in want}) == 2


def test_ingest_takes_a_delivery_of_many_files_as_one_batch(spark, tmp_path):
    from quillspan.operators.sets import chapter_fingerprint
    from quillspan.streaming.attempts import ingest_chapters, ingested

    source, keys = str(tmp_path / "in"), ["book_id", "chapter"]
    rows = spark.createDataFrame([(b, c, n, f"{b}-{c}-{n}") for b in range(4) for c in range(3) for n in (1, 2)], "book_id long, chapter long, number long, body string")
    args = (spark, source, rows.schema, lambda df: chapter_fingerprint(df, "v1"), keys, str(tmp_path / "manifest"), str(tmp_path / "work"), str(tmp_path / "state"), None)
    rows.repartition(3, *keys).write.parquet(source)
    assert ingest_chapters(*args) == 12
    rows.repartition(4, "chapter", "book_id").write.mode("append").parquet(source)
    assert ingest_chapters(*args) == 0
    assert sorted(p.name for p in (tmp_path / "manifest").iterdir() if p.is_dir()) == ["epoch=-1", "epoch=0", "epoch=1"]
    wanted = chapter_fingerprint(rows, "v1")
    assert sorted(ingested(spark, wanted.schema, keys, str(tmp_path / "manifest"), str(tmp_path / "work")).collect()) == sorted(wanted.collect())


def test_refine_makes_its_blocks_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = [(1, p, "heading" if p % 2 == 0 else "content", 1 if p == 0 else 2, 90, 0) for p in range(6)]
    kinds = "d long, pos long, kind string, level int, words long, section long"
    got = S.refine(spark.createDataFrame(rows, kinds).mapInArrow(count, kinds), ["d"], 160, 40)
    assert got.count() == 6 and made.value == 6


def test_refine_deals_its_rows_over_more_tasks_as_they_grow(spark, monkeypatch):
    rows = [(d, p, "heading" if p % 2 == 0 else "content", 1 if p == 0 else 2, 90, 0) for d in range(5) for p in range(6)]
    b = spark.createDataFrame(rows, "d long, pos long, kind string, level int, words long, section long")
    one = sorted(S.refine(b, ["d"], 160, 40).collect())
    monkeypatch.setattr(S, "TASK_ROWS", 1)
    dealt, repartition = [], type(b).repartition
    monkeypatch.setattr(type(b), "repartition", lambda self, n, *by: dealt.append(n) or repartition(self, n, *by))
    assert sorted(S.refine(b, ["d"], 160, 40).collect()) == one and 30 in dealt


def test_tag_rows_come_in_more_parts_than_their_pages(spark):
    from quillspan.operators.markup import TAG_PARTS, tag_rows

    df = spark.createDataFrame([(i, "<body><p>a</p>b") for i in range(40)], "page_id long, html string").repartition(3)
    rows = tag_rows(df, ["page_id"])
    assert rows.rdd.getNumPartitions() == 3 * TAG_PARTS and rows.count() == 120
