"""Blocks, chapters and sections, and layout items."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.text import count_words, mask_digits, normalize_space, page_number, title_key, unescape_html
from quillspan.operators.fixpoint import cut
from quillspan.operators.markup import BLOCK, attribute, drop_elements, joined, tag_rows, with_partner
from quillspan.sources.tables import to_lines

#: Titles and semantic types that tell the kind of a chapter.
PART_TITLE = r"(?i)^part\s+([ivxlcdm]+|[0-9]+|one|two|three|four|five|six|seven|eight|nine|ten)\b"
GLOSSARY_TITLE = r"(?i)^glossary( of .*)?$"
INDEX_TITLE = r"(?i)^((general|subject) )?index$"
APPENDIX_TITLE = r"(?i)^appendix\b"
FRONT_TITLE = r"(?i)^((preface|foreword)\b.*|licen[cs]e|dedications?|acknowledge?ments?|about (the )?(authors?|this book|the cover.*)|copyright( page)?|title page|half title|cover|(table of )?contents?|contributors|praise for\b.*|also by\b.*|epigraph|notice of (rights|liability)|(trademark|legal) notices?|disclaimer)$"
BACK_TITLE = r"(?i)^(references|further reading|colophon|endnotes|notes|about the authors?|other books( by .*)?)$|(?i)\bbibliography\b"
CHAPTER_TYPES = ("chapter", "introduction", "bodymatter")
FRONT_TYPES = ("cover", "titlepage", "halftitlepage", "copyright-page", "dedication", "epigraph", "foreword", "preface", "acknowledgments", "toc", "frontmatter", "imprint", "contributors", "other-credits")
BACK_TYPES = ("backmatter", "bibliography", "colophon", "endnotes", "rearnotes", "loi", "lot")
GENERIC_HEADING = r"(?i)^(question|exercise|problem|example|case|lesson|step|tip|puzzle|quiz|q)\s*\.?\s*[0-9]+[.:)]?$"


def classify_kind(title: str, types: str) -> Column:
    """Kind of a chapter: glossary, index, appendix, front and back titles first, then the semantic types, else chapter."""
    t, all_ = F.col(title), F.coalesce(F.col(types), F.expr("cast(array() as array<string>)"))
    has = lambda *names: F.arrays_overlap(all_, F.array(*[F.lit(n) for n in names]))
    return (
        F.when(t.rlike(GLOSSARY_TITLE) | has("glossary"), "glossary")
        .when(t.rlike(INDEX_TITLE) | has("index"), "index")
        .when(t.rlike(APPENDIX_TITLE) | has("appendix"), "appendix")
        .when(t.rlike(FRONT_TITLE), "front")
        .when(t.rlike(BACK_TITLE), "back")
        .when(has(*CHAPTER_TYPES), "chapter")
        .when(has(*FRONT_TYPES), "front")
        .when(has(*BACK_TYPES), "back")
        .otherwise("chapter")
    )


def line_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines of a text as blocks: (id, pos, kind, level, text, words); the first line is a heading."""
    b = to_lines(docs, id_col, text_col)
    head = F.col("pos") == 0
    return b.select(id_col, F.col("pos").cast("long").alias("pos"), F.when(head, "heading").otherwise("content").alias("kind"), F.when(head, F.col(id_col) % 3 + 1).otherwise(0).cast("long").alias("level"), F.col("line").alias("text"), count_words("line").alias("words"))


def html_blocks(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """Ordered heading and content blocks of pages by splitting at block tags (no tree is built).

    Scripts, styles, navigation, templates and comments go first; a block's kind and level
    come from the tag it begins with; blocks without text are left out.
    """
    body = F.regexp_replace(F.col(html), r"(?is)^.*?<body[^>]*>", "")
    for tag in ("script", "style", "nav", "template", "noscript"):
        body = F.regexp_replace(body, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    body = F.regexp_replace(body, r"(?s)<!--.*?-->", " ")
    parts = F.split(body, r"(?i)(?=<(?:p|h[1-6]|li|div|article|footer|ul|ol|dt|dd|tr)\b)|</(?:p|h[1-6]|li|div|article|footer|ul|ol|dt|dd|tr)>", -1)
    b = pages.select(id_col, F.posexplode(parts).alias("at", "html"))
    level = F.regexp_extract("html", r"(?i)^<h([1-6])\b", 1)
    text = normalize_space(F.regexp_replace("html", "<[^>]+>", " "))
    b = b.select(id_col, "at", "html", level.alias("h"), text.alias("text")).where("text <> ''")
    pos = F.row_number().over(Window.partitionBy(id_col).orderBy("at")) - 1
    return b.select(id_col, pos.cast("long").alias("pos"), F.when(F.col("h") != "", "heading").otherwise("content").alias("kind"), F.when(F.col("h") != "", F.col("h").cast("long")).otherwise(0).cast("long").alias("level"), "text", "html", count_words("text").alias("words"))


def page_at(blocks: DataFrame, keys: Sequence[str], order: str, label: str) -> DataFrame:
    """The last page label before each block."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("page", F.last(label, True).over(w))


def locate(targets: DataFrame, blocks: DataFrame) -> DataFrame:
    """Position of (file, anchor): the anchor's first block, else the file's start, else null."""
    anchors = blocks.select("file", F.explode("anchors").alias("anchor"), "pos").groupBy("file", "anchor").agg(F.min("pos").alias("_a"))
    files = blocks.groupBy("file").agg(F.min("pos").alias("_f"))
    return targets.join(anchors, ["file", "anchor"], "left").join(files, "file", "left").withColumn("pos", F.coalesce("_a", "_f")).drop("_a", "_f")


def chapter_spans(starts: DataFrame, ends: DataFrame, book: str = "book") -> DataFrame:
    """[start, end) of chapters from their starts: of equal starts the first entry counts, text before the first is a front span."""
    w1 = Window.partitionBy(book, "pos").orderBy("entry")
    one = starts.where("pos is not null").withColumn("_r", F.row_number().over(w1)).where("_r = 1").drop("_r")
    front = one.groupBy(book).agg(F.min("pos").alias("first")).where("first > 0").select(book, F.lit(-1).cast("long").alias("entry"), F.lit("Front").alias("title"), F.lit(0).cast("long").alias("pos"))
    every = one.select(book, "entry", "title", "pos").unionAll(front)
    w = Window.partitionBy(book).orderBy("pos")
    return every.join(ends, book).select(book, "entry", "title", F.col("pos").alias("start"), F.coalesce(F.lead("pos").over(w), F.col("n")).alias("end"))


def order_warnings(starts: DataFrame, book: str = "book") -> DataFrame:
    """Entries without a target, and those that lie before an earlier entry."""
    w = Window.partitionBy(book).orderBy("entry").rowsBetween(Window.unboundedPreceding, -1)
    top = F.max("pos").over(w)
    return starts.select(book, "entry", F.when(F.col("pos").isNull(), "toc_target_missing").when(F.col("pos") < top, "toc_order").alias("code")).where("code is not null")


def starts_or_files(starts: DataFrame, blocks: DataFrame, book: str = "book") -> DataFrame:
    """Chapter starts (book, entry, title, pos) with a target; in books that have none, one for each file of ``blocks`` (book, file, pos, kind, text).

    A file's chapter begins with its first block and is called by its first heading, else by the file's name.
    """
    own = starts.where("pos is not null").select(book, "entry", "title", "pos")
    heading = F.when((F.col("kind") == "heading") & (F.col("text") != ""), F.col("text"))
    files = blocks.join(own.select(book).distinct(), book, "left_anti").groupBy(book, "file").agg(F.min("pos").alias("pos"), F.min_by(heading, F.when(heading.isNotNull(), F.col("pos"))).alias("title"))
    entry = F.row_number().over(Window.partitionBy(book).orderBy("pos")).cast("long")
    return own.unionByName(files.select(book, entry.alias("entry"), F.coalesce("title", "file").alias("title"), F.col("pos").cast("long").alias("pos")))


def mark_parts(entries: DataFrame) -> DataFrame:
    """Entries (book, entry, parent, title, file, words) that are parts: they have children, and a part's title, or at least half of these in other files and under 150 own words."""
    kids = entries.select("book", F.col("parent").alias("entry"), F.col("file").alias("kid")).where("entry is not null")
    share = kids.join(entries.select("book", "entry", "file"), ["book", "entry"]).groupBy("book", "entry").agg(F.avg((F.col("kid") != F.col("file")).cast("int")).alias("away"))
    part = F.col("away").isNotNull() & (F.col("title").rlike(PART_TITLE) | ((F.col("away") >= 0.5) & (F.col("words") < 150)))
    return entries.join(share, ["book", "entry"], "left").withColumn("is_part", part).withColumn("kind", F.when(part & (F.col("words") < 150), "part")).drop("away")


def unlisted_files(files: DataFrame, listed: DataFrame) -> DataFrame:
    """Files of chapters (book, file, kind, words) that no entry names, with over 50 words; those of front and back matter are split off by :func:`split_unlisted`."""
    return files.join(listed, ["book", "file"], "left_anti").where("words > 50 and kind not in ('front', 'back')")


def split_unlisted(blocks: DataFrame, listed: DataFrame) -> DataFrame:
    """Spans (book, span, part, kind, title, start, end, words) of blocks (book, span, span_kind, span_title, pos, file, kind, text, words).

    Inside front and back matter each file that no entry names begins a part of its own, with
    the title of the file's first heading, else its name; other spans stay whole.
    """
    w = Window.partitionBy("book", "span").orderBy("pos")
    known = listed.select("book", "file").distinct().withColumn("_known", F.lit(True))
    b = blocks.join(known, ["book", "file"], "left")
    new = ~F.col("span_kind").isin("chapter", "appendix") & F.col("_known").isNull() & (F.lag("file").over(w) != F.col("file"))
    b = b.withColumn("_new", F.coalesce(new, F.lit(False)).cast("long"))
    b = b.withColumn("part", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = Window.partitionBy("book", "span", "part")
    b = b.withColumn("_file", F.first("file").over(first.orderBy("pos")))
    head = F.min_by(F.when((F.col("kind") == "heading") & (F.col("file") == F.col("_file")) & (F.col("text") != ""), F.col("text")), F.when((F.col("kind") == "heading") & (F.col("file") == F.col("_file")) & (F.col("text") != ""), F.col("pos")))
    got = b.groupBy("book", "span", "part").agg(F.first("span_kind").alias("_k"), F.first("span_title").alias("_t"), F.first("_file").alias("_file"), head.alias("_h"), F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), F.sum("words").alias("words"))
    name = F.regexp_extract("_file", "([^/]*)$", 1)
    kind = F.when(F.col("part") == 0, F.col("_k")).when(F.col("_k") == "front", "front").otherwise("back")
    return got.select("book", "span", "part", kind.alias("kind"), F.when(F.col("part") == 0, F.col("_t")).otherwise(F.coalesce("_h", name)).alias("title"), "start", "end", "words")


def split_sections(blocks: DataFrame, keys: Sequence[str], order: str = "pos") -> DataFrame:
    """Section numbers from 0 at the highest heading level (the smallest number) of a chapter, title headings (``order`` 0) aside."""
    keys = list(keys)
    whole, run = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    head = (F.col("kind") == "heading") & (F.col(order) > 0)
    top = F.min(F.when(head, F.col("level"))).over(whole)
    return blocks.withColumn("_top", top).withColumn("section", F.sum(F.when(head & (F.col("level") == F.col("_top")), 1).otherwise(0)).over(run).cast("long")).drop("_top")


def merge_small(sections: DataFrame, keys: Sequence[str], order: str = "section", least: int = 40) -> DataFrame:
    """Small sections join the large one before, leading ones the first large one; without a large one all become one."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    large = (F.col("words") >= least).cast("long")
    return sections.withColumn("merged", F.greatest(F.sum(large).over(w), F.lit(1)))


def _fold(df: DataFrame, keys: Sequence[str], order: str, size: Column, count: int | None, most: int, name: str, fill: bool) -> DataFrame:
    """Group numbers from 1 over ordered rows: a new group where ``count`` or the sum ``most`` would be passed; ``fill``: a group without size takes any row.

    Rows come sorted, all of a key in one task, and are folded as they stream by: small keys
    share a batch and a large one is never held.
    """
    import pyarrow as pa

    keys = list(keys)
    rows = df.select(*keys, order, size.cast("long").alias("_size"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, held, total = None, 0, 0, 0
        for batch in batches:
            out = []
            for key, x in zip(zip(*(batch.column(k).to_pylist() for k in keys)), batch.column("_size").to_pylist()):
                if key != now:
                    now, number = key, 0
                over = total + x > most and (not fill or total > 0)
                if not number or over or count is not None and held >= count:
                    number, held, total = number + 1, 0, 0
                held, total = held + 1, total + x
                out.append(number)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keys, order)), pa.array(out, pa.int64())], names=[*keys, order, name])

    rows = rows.repartition(*keys).sortWithinPartitions(*keys, F.asc_nulls_last(order))
    return rows.mapInArrow(fold, ", ".join(f"`{c}` {kinds[c]}" for c in (*keys, order)) + f", `{name}` long")


def split_by_size(blocks: DataFrame, keys: Sequence[str], most: int = 2500, order: str = "pos") -> DataFrame:
    """Parts from 1 of a section's blocks, each of at most ``most`` words (or one block)."""
    return _fold(blocks, keys, order, F.col("words"), None, most, "part", True)


#: So many rows at most, on the average, go to one task of a round; they are narrow, so their bytes in a shuffle say little of the memory they take.
TASK_ROWS = 1 << 17


def refine(blocks: DataFrame, keys: Sequence[str], most: int = 2500, least: int = 40, order: str = "pos", levels: int = 6) -> DataFrame:
    """Sections (``path``, ``part``) of blocks that already have a ``section``: one over ``most`` words splits at its best sub-heading level, small pieces join their neighbours, and again, at most once per heading level; what is still too large splits by size.

    Only sections that are too large and have a heading after their first block change in a
    round, so the rounds end with the headings. ``blocks`` are made once and written, since each round and the end read them.
    """
    keys = list(keys)
    b = cut(blocks.withColumn("path", F.format_string("%04d", F.col("section"))), "sections")
    parts = max(b.sparkSession.sparkContext.defaultParallelism, -(-b.count() // TASK_ROWS))
    for _ in range(levels):
        per = b.groupBy(*keys, "path").agg(F.sum("words").alias("w"), F.min(order).alias("f"), F.max(F.when(F.col("kind") == "heading", F.col(order))).alias("h"))
        if per.where((F.col("w") > most) & (F.col("h") > F.col("f"))).isEmpty():
            break
        b = b.repartition(parts, *keys)  # all windows of the round are within it
        own = Window.partitionBy(*keys, "path")
        run = own.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        b = b.withColumns({"_w": F.sum("words").over(own), "_first": F.min(order).over(own)})
        head = (F.col("kind") == "heading") & (F.col(order) > F.col("_first"))
        b = b.withColumn("_top", F.when(F.col("_w") > most, F.min(F.when(head, F.col("level"))).over(own)))
        b = b.withColumn("_sub", F.sum(F.when(head & (F.col("level") == F.col("_top")), 1).otherwise(0)).over(run))
        size = F.sum("words").over(Window.partitionBy(*keys, "path", "_sub"))
        starts = (F.row_number().over(Window.partitionBy(*keys, "path", "_sub").orderBy(order)) == 1) & (size >= least)
        b = b.withColumn("_start", starts.cast("int")).withColumn("_m", F.greatest(F.sum("_start").over(run), F.lit(1)))
        b = b.withColumn("path", F.when(F.col("_top").isNotNull(), F.concat("path", F.lit("."), F.format_string("%04d", F.col("_m")))).otherwise(F.col("path")))
        b = cut(b.drop("_w", "_first", "_top", "_sub", "_start", "_m"), "refined")
    sized = split_by_size(b, [*keys, "path"], most, order)
    return b.join(sized, [*keys, "path", order])


def group_sections(sections: DataFrame, keys: Sequence[str], count: int = 8, tokens: int = 24000, order: str = "number") -> DataFrame:
    """Request groups of at most ``count`` sections and ``tokens`` tokens (words x 1.4, rounded up)."""
    return _fold(sections, keys, order, F.ceil(F.col("words") * 1.4), count, tokens, "grp", False)


def assemble_sections(blocks: DataFrame, keys: Sequence[str], order: str = "pos") -> DataFrame:
    """Text of a section's blocks joined by blank lines, its words and first position."""
    got = blocks.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, "text"))).alias("b"), F.sum("words").alias("words"), F.min(order).alias("start"))
    return got.withColumn("text", F.array_join(F.transform("b", lambda x: x["text"]), "\n\n")).drop("b")


def heading_titles(blocks: DataFrame, keys: Sequence[str], order: str = "pos") -> DataFrame:
    """Titles of headings; a generic one ("Question 1") takes the short bold paragraph or heading after it."""
    w = Window.partitionBy(*keys).orderBy(order)
    nxt, words, kind, html = F.lead("text").over(w), F.lead("words").over(w), F.lead("kind").over(w), F.lead("html").over(w)
    rest = F.trim(F.regexp_replace(F.regexp_replace(html, r"(?s)<(strong|b)>.*?</\1>", ""), "<[^>]+>", ""))
    bold = html.rlike(r"^<p[\s>]") & html.rlike("<(strong|b)>") & (rest == "")
    take = F.col("text").rlike(GENERIC_HEADING) & words.between(1, 30) & ((kind == "heading") | bold)
    titled = blocks.withColumn("title", F.when(F.coalesce(take, F.lit(False)), F.concat(F.regexp_replace("text", "[.:)]$", ""), F.lit(": "), nxt)).otherwise(F.col("text")))
    return titled.where("kind = 'heading'")


def quality_warnings(sections: DataFrame, id_col: str, most: int = 2500) -> DataFrame:
    """One row per problem of a section with words and source_words: empty, lost or over-long text."""
    w, s = F.col("words"), F.col("source_words")
    codes = F.array_compact(F.array(F.when(w == 0, F.lit("empty_section")), F.when((s >= 30) & (w < s * 0.9), F.lit("lost_text")), F.when(w > most, F.lit("size_split"))))
    return sections.select(id_col, F.explode(codes).alias("code"))


def demote_title_page(spans: DataFrame, books: DataFrame) -> DataFrame:
    """A chapter of under 150 words with the book's title, but for case and white space, is front matter."""
    got = spans.join(books.select("book", F.lower(normalize_space("title")).alias("_t")), "book", "left")
    page = (F.col("kind") == "chapter") & (F.col("_t") != "") & (F.lower(normalize_space("title")) == F.col("_t")) & (F.col("words") < 150)
    return got.withColumn("kind", F.when(page, "front").otherwise(F.col("kind"))).drop("_t")


def join_across_pages(blocks: DataFrame, keys: Sequence[str], order: str = "pos") -> DataFrame:
    """Paragraphs that go on after a border become one: the one before has no end mark and the next begins in lower case."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(order)
    goes_on = ~F.lag("text").over(w).rlike(r"[.!?:;]\s*$") & F.col("text").rlike(r"^\s*\p{Ll}")
    marked = blocks.withColumn("_n", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("para", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    got = marked.groupBy(*keys, "para").agg(F.sort_array(F.collect_list(F.struct(order, "text"))).alias("b"))
    return got.select(*keys, F.col("para").cast("long").alias("para"), F.array_join(F.transform("b", lambda x: x["text"]), " ").alias("text"))


#: Elements without text of the page.
REMOVED = ("nav", "script", "style", "noscript", "template", "button", "form", "input", "select", "textarea", "label", "iframe", "svg", "footer", "link", "meta", "dialog", "object", "embed", "canvas", "video", "audio", "source")


def clean_pages(pages: DataFrame, base: int = 2, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """Blocks (id, pos, kind, level, text, words) of a page's main part: the first main element, else article, else the body.

    Elements without text of the page and hidden ones go with all inside them, and links to a
    place in the page that show no letter or digit. A heading ends only with its own tag. A
    first heading that is the page's title, but for case, accents and marks, goes. The first heading that is left gets
    level ``base`` and the others move with it, from ``base`` to 6.
    """
    key, page = [id_col], Window.partitionBy(id_col)
    rows = with_partner(tag_rows(pages, key, html), key)
    opens = ~F.col("closes")
    for name in ("article", "main"):  # each bounds the page where there is one; the last one wins
        root = F.min(F.when(opens & (F.col("tag") == name), F.struct("at", "partner"))).over(page)
        rows = rows.withColumn(f"_{name}", root)
    root = F.coalesce("_main", "_article")
    rows = rows.where(root.isNull() | ((F.col("at") >= root["at"]) & (F.col("at") < F.coalesce(root["partner"], F.lit(1 << 30))))).drop("_main", "_article")
    unquoted = F.regexp_replace("token", "\"[^\"]*\"|'[^']*'", "''")
    rows = drop_elements(rows, key, F.col("tag").isin(*REMOVED) | unquoted.rlike(r"(?i)\shidden(?=[\s=/>])"))
    run = page.orderBy("at")
    upto = run.rowsBetween(Window.unboundedPreceding, 0)
    mark = (F.col("tag") == "a") & attribute("token", "href").startswith("#") & (F.lead("at").over(run) == F.col("partner")) & ~F.col("text").rlike(r"[\p{L}\p{N}]")
    heading = F.col("tag").rlike("^h[1-6]$") & (F.col("token") != "")
    inside = F.coalesce(F.last(F.when(heading, opens), True).over(upto), F.lit(False))
    rows = rows.withColumns({"text": F.when(F.coalesce(mark, F.lit(False)), "").otherwise(F.col("text")), "_in": inside, "_head": heading})
    border = F.col("tag").isin(*[t for t in BLOCK if t != "br"]) & (F.col("_head") | ~F.col("_in"))
    space = F.when(F.col("tag").isin(*BLOCK), " ").otherwise("")
    rows = rows.withColumns({"_block": F.sum(border.cast("int")).over(upto), "s": F.concat(space, "text")})
    level = F.when(F.col("_head") & opens, F.substring("tag", 2, 1).cast("int"))
    b = rows.groupBy(id_col, "_block").agg(F.min_by(F.struct(level.alias("level")), "at").alias("x"), F.collect_list(F.struct("at", "s")).alias("p"))
    b = b.select(id_col, "_block", F.col("x.level").alias("level"), F.explode(F.array(joined(F.col("p")))).alias("text")).where("text <> ''")
    title = normalize_space(unescape_html(F.regexp_extract(F.col(html), r"(?is)<title[^>]*>(.*?)</title>", 1)))
    b = b.join(pages.select(id_col, title_key(title).alias("_title")), id_col)
    first = lambda: F.min(F.when(F.col("level").isNotNull(), F.struct("_block", "level"))).over(page)
    b = b.withColumn("_first", first()).where(F.coalesce((F.col("_block") != F.col("_first._block")) | (title_key("text") != F.col("_title")), F.lit(True)))
    moved = F.least(F.greatest(F.col("level") - F.col("_first.level") + base, F.lit(base)), F.lit(6))
    pos = F.row_number().over(page.orderBy("_block")) - 1
    b = b.withColumn("_first", first())
    return b.select(id_col, pos.cast("long").alias("pos"), F.when(F.col("level").isNull(), "content").otherwise("heading").alias("kind"), F.when(F.col("level").isNull(), 0).otherwise(moved).cast("long").alias("level"), "text", count_words("text").alias("words"))


def blocks_markdown(blocks: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Blocks as light Markdown: headings, list items, bold, emphasis, code, external links; internal links as text."""
    t = F.col("html")
    for pattern, by in ((r"(?is)<(?:b|strong)>(.*?)</(?:b|strong)>", "**$1**"), (r"(?is)<(?:i|em)>(.*?)</(?:i|em)>", "*$1*"), (r"(?is)<code>(.*?)</code>", "`$1`"), (r'(?is)<a [^>]*href="(https?://[^"]+)"[^>]*>(.*?)</a>', "[$2]($1)"), (r"(?i)^<li[^>]*>", "- "), (r"<[^>]+>", "")):
        t = F.regexp_replace(t, pattern, by)
    line = F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level").cast("int")), F.lit(" "), normalize_space(t))).otherwise(normalize_space(t))
    return blocks.select(id_col, "pos", line.alias("markdown"))


# layout items: (doc, page, idx, str, x, y, width, size, mono)


def items_of(blocks: DataFrame, id_col: str = "doc_id", source: str = "source") -> DataFrame:
    """Lines as positioned items, for corpora without a layout: one line per item, first lines larger."""
    return blocks.select(F.col(source).alias("doc"), F.col(id_col).alias("page"), F.col("pos").alias("idx"), F.col("text").alias("str"), F.lit(72.0).alias("x"), (800.0 - 14.0 * F.col("pos")).alias("y"), (5.0 * F.length("text")).alias("width"), F.when(F.col("pos") == 0, 18.0).otherwise(10.0).alias("size"), F.lit(False).alias("mono"))


def group_lines(items: DataFrame) -> DataFrame:
    """Lines of a page: items sorted down and right; one joins the line of the *previous* item if they differ in height by at most half the smaller size."""
    w = Window.partitionBy("doc", "page").orderBy(F.desc("y"), "x", "idx")
    same = F.abs(F.col("y") - F.lag("y").over(w)) <= 0.5 * F.least("size", F.lag("size").over(w))
    got = items.withColumn("_n", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("line", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    got = got.groupBy("doc", "page", "line").agg(F.sort_array(F.collect_list(F.struct("x", "idx", "str"))).alias("s"), F.max("y").alias("y"), F.max("size").alias("size"), F.min("x").alias("x"), F.bool_and("mono").alias("code"))
    parts = F.transform("s", lambda i: i["str"])
    return got.select("doc", "page", F.col("line").cast("long").alias("line"), F.array_join(parts, " ").alias("text"), "x", "y", "size", parts.alias("parts"), "code")


#: How far apart, in sizes of a margin line, it is from the body; and the height of a band.
MARGIN_GAP, BAND = 1.5, 3.0


def _bands(edge: DataFrame) -> DataFrame:
    """(doc, y, band): the heights of a document from low to high; a band takes those within 3 of its first one."""
    heights = edge.groupBy("doc").agg(F.array_sort(F.collect_set("y")).alias("ys"))
    begins = F.aggregate("ys", F.array().cast("array<double>"), lambda acc, y: F.when(F.coalesce(y - F.try_element_at(acc, F.lit(-1)) <= BAND, F.lit(False)), acc).otherwise(F.concat(acc, F.array(y))))
    each = heights.withColumn("bs", begins).select("doc", "bs", F.explode("ys").alias("y"))
    return each.select("doc", "y", F.array_max(F.filter("bs", lambda b: b <= F.col("y"))).alias("band"))


def running_lines(lines: DataFrame) -> DataFrame:
    """Running heads and feet (doc, page, line, text, number), with the page number found.

    Candidates are one or two lines at the top and at the bottom of a page that a gap parts from the body, of
    at most 100 characters and not code. A band of heights counts if it has candidates on three pages and a quarter of all at least.
    In it a line runs if half of the band has numbers and it has one, first or last in the line, or if
    its text, in lower case and with digits masked, occurs three times and has a letter.
    """
    shown = lines.where("trim(text) <> ''").withColumn("text", normalize_space("text"))
    pages = shown.select("doc", "page").distinct().groupBy("doc").agg(F.count(F.lit(1)).alias("pages"))
    w = Window.partitionBy("doc", "page").orderBy(F.desc("y"), "line")
    at = lambda c, k: (F.lead(c, k) if k > 0 else F.lag(c, -k)).over(w) if k else F.col(c)
    gap = lambda k, size: F.coalesce(at("y", k) - at("y", k + 1) >= MARGIN_GAP * at("size", size), F.lit(False))
    rows = shown.withColumns({"_r": F.row_number().over(w), "_n": F.count(F.lit(1)).over(Window.partitionBy("doc", "page"))})
    low = F.col("_n") - F.col("_r")
    top = (F.col("_r") == 1) & (gap(0, 0) | gap(1, 1)) | (F.col("_r") == 2) & ~gap(-1, -1) & gap(0, 0)
    foot = (low == 0) & (gap(-1, 0) | gap(-2, -1)) | (low == 1) & ~gap(0, 1) & gap(-1, 0)
    edge = rows.withColumn("_margin", top | foot).where("_margin and not code").where(F.length("text") <= 100)
    number = F.coalesce(page_number(F.element_at("parts", -1)), page_number(F.element_at("parts", 1)))
    edge = cut(edge.select("doc", "page", "line", "text", "y", F.lower(mask_digits("text")).alias("masked"), number.alias("number")), "edges")
    edge = edge.join(_bands(edge), ["doc", "y"])
    band = edge.groupBy("doc", "band").agg(F.countDistinct("page").alias("on"), F.avg(F.col("number").isNotNull().cast("int")).alias("numbered")).join(pages, "doc").where(F.col("on") >= F.greatest(F.lit(3.0), F.ceil(F.col("pages") * 0.25)))
    often = edge.groupBy("doc", "band", "masked").agg(F.count(F.lit(1)).alias("times"))
    got = edge.join(band, ["doc", "band"]).join(often, ["doc", "band", "masked"])
    is_number = (F.col("numbered") >= 0.5) & F.col("number").isNotNull()
    keep = is_number | ((F.col("times") >= 3) & F.col("masked").rlike(r"\p{L}"))
    return got.where(keep).select("doc", "page", "line", "text", F.when(is_number, F.col("number")).alias("number"))


def body_size(items: DataFrame) -> DataFrame:
    """Size (in steps of a half) with most characters outside code, per document."""
    per = items.where("not mono").groupBy("doc", (F.round(F.col("size") * 2) / 2).alias("size")).agg(F.sum(F.length("str")).alias("chars"))
    return per.groupBy("doc").agg(F.max_by("size", F.struct("chars", "size")).alias("body"))


def heading_levels(items: DataFrame) -> DataFrame:
    """Sizes of at least 1.15 times the body in falling order; a new level where one is under 0.96 of the size before; at most 6."""
    sizes = items.select("doc", "size").distinct().join(body_size(items), "doc").where(F.col("size") >= 1.15 * F.col("body"))
    w = Window.partitionBy("doc").orderBy(F.desc("size"))
    new = F.when(F.col("size") < 0.96 * F.lag("size").over(w), 1).otherwise(0)
    return sizes.withColumn("_n", new).select("doc", "size", F.least(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1, F.lit(6)).cast("long").alias("level"))


def column_gutter(items: DataFrame) -> DataFrame:
    """x of a page's column gutter: in the middle 40% in steps of 2, crossed by at most 12% of the items with 25% on either side; least crossing, then leftmost; pages with under 20 items have none."""
    span = items.groupBy("doc", "page").agg(F.min("x").alias("lo"), F.max(F.col("x") + F.col("width")).alias("hi"), F.count(F.lit(1)).alias("n")).where("n >= 20")
    a, b = F.col("lo") + 0.3 * (F.col("hi") - F.col("lo")), F.col("lo") + 0.7 * (F.col("hi") - F.col("lo"))
    tries = span.select("doc", "page", "n", F.explode(F.sequence(F.ceil(a / 2).cast("int"), F.floor(b / 2).cast("int"))).alias("k")).withColumn("g", F.col("k") * 2.0)
    end = F.col("x") + F.col("width")
    got = tries.join(items, ["doc", "page"]).groupBy("doc", "page", "n", "g").agg(F.sum(((F.col("x") < F.col("g")) & (end > F.col("g"))).cast("int")).alias("cross"), F.sum((end <= F.col("g")).cast("int")).alias("left"), F.sum((F.col("x") >= F.col("g")).cast("int")).alias("right"))
    ok = got.where("cross <= 0.12 * n and left >= 0.25 * n and right >= 0.25 * n")
    return ok.groupBy("doc", "page").agg(F.min_by("g", F.struct("cross", "g")).alias("gutter"))


def reading_order(items: DataFrame) -> DataFrame:
    """Items in reading order: down the left column, then the right; an item across the gutter ends the columns above it."""
    got = items.join(column_gutter(items), ["doc", "page"], "left")
    wide = F.col("gutter").isNotNull() & (F.col("x") < F.col("gutter")) & (F.col("x") + F.col("width") > F.col("gutter"))
    above = F.sum(wide.cast("int")).over(Window.partitionBy("doc", "page").orderBy(F.desc("y"), "x", "idx"))
    got = got.withColumns({"_above": above, "_wide": wide}).withColumn("_col", F.when(F.col("_wide") | F.col("gutter").isNull() | (F.col("x") < F.col("gutter")), 0).otherwise(1))
    w = Window.partitionBy("doc", "page").orderBy("_above", F.when(F.col("_wide"), 0).otherwise(1), "_col", F.desc("y"), "x", "idx")
    return got.withColumn("position", F.row_number().over(w).cast("long")).drop("_above", "_wide", "_col")


def toc_from_headings(headings: DataFrame) -> DataFrame:
    """Headings of the lowest level number that occurs at least twice."""
    often = headings.groupBy("doc", "level").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").groupBy("doc").agg(F.min("level").alias("level"))
    return headings.join(often, ["doc", "level"])


def drop_repeated_images(placed: DataFrame, pages: int = 3) -> DataFrame:
    often = placed.groupBy("doc", "image").agg(F.countDistinct("page").alias("n")).where(F.col("n") >= pages)
    return placed.join(often, ["doc", "image"], "left_anti")


def largest_text(items: DataFrame, pages: int = 5) -> DataFrame:
    """Title candidate per document: the text in the largest size on its first pages, 3 to 150 characters, no front or back matter."""
    rank = F.dense_rank().over(Window.partitionBy("doc").orderBy("page"))
    first = items.withColumn("_p", rank).where(F.col("_p") <= pages)
    text = first.groupBy("doc", "page", F.round("size").alias("size")).agg(F.sort_array(F.collect_list(F.struct("idx", "str"))).alias("s"))
    text = text.select("doc", "page", "size", normalize_space(F.array_join(F.transform("s", lambda x: x["str"]), " ")).alias("text"))
    ok = text.where(F.length("text").between(3, 150) & ~F.col("text").rlike(FRONT_TITLE) & ~F.col("text").rlike(BACK_TITLE))
    return ok.groupBy("doc").agg(F.max_by("text", F.struct("size", -F.col("page"))).alias("title"))


def lossy_pages(pages: DataFrame) -> DataFrame:
    """Pages of at least 30 words of which under 90% are kept."""
    return pages.where("words >= 30 and kept < 0.9 * words")


def lossy_books(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc").agg(F.sum("words").alias("words"), F.sum("kept").alias("kept")).where("kept < 0.97 * words")


#: Fixed value: outline entries that are a label only.
LABEL = r"(?i)^(chapter|part|appendix|section|unit|lesson|module|book)\s+[\w.-]+\s*[:.\-–—]?$"


def join_labels(entries: DataFrame) -> DataFrame:
    """A label entry ("CHAPTER 1:") and the next entry of the same page become one; inside a run of labels every second one joins."""
    w = Window.partitionBy("doc").orderBy("pos")
    is_label = F.col("title").rlike(LABEL) & (F.lead("page").over(w) == F.col("page"))
    e = entries.withColumn("_l", F.coalesce(is_label, F.lit(False)))
    run = F.sum(F.when(F.col("_l"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    e = e.withColumn("_run", run)
    nth = F.row_number().over(Window.partitionBy("doc", "_run", "_l").orderBy("pos"))
    e = e.withColumn("_join", F.col("_l") & (nth % 2 == 1))
    after = F.coalesce(F.lag("_join").over(w), F.lit(False))
    title = F.when(F.col("_join"), F.concat_ws(" ", "title", F.lead("title").over(w))).otherwise(F.col("title"))
    return e.withColumns({"title": title, "_after": after}).where("not _after").select("doc", "pos", "page", "title")


def join_hyphenated(text: Column) -> Column:
    """Words cut at a line end are made whole: a letter, a hyphen, a newline and a lower-case letter."""
    return F.regexp_replace(text, r"(\p{L})-\n(\p{Ll})", "$1$2")


def boilerplate_lines(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text_col: str = "text", share: float = 0.25) -> DataFrame:
    """Masked lines on at least max(3, ``share``) of the documents of a source."""
    n = docs.groupBy(source).agg(F.count(F.lit(1)).alias("n"))
    masked = to_lines(docs.withColumn("_k", F.struct(F.col(source).alias("s"), F.col(id_col).alias("i"))), "_k", text_col).select(F.col("_k.s").alias(source), F.col("_k.i").alias("i"), mask_digits(F.trim("line")).alias("line")).where("line <> ''").distinct()
    return masked.groupBy(source, "line").agg(F.count(F.lit(1)).alias("docs")).join(n, source).where(F.col("docs") >= F.greatest(F.lit(3.0), F.col("n") * share)).select(source, "line", "docs")


def page_labels(pages: DataFrame) -> DataFrame:
    """The given label, else the footer's number; 1..n where a document has none at all."""
    own = F.coalesce("label", "footer")
    any_ = F.count(own).over(Window.partitionBy("doc"))
    nth = F.row_number().over(Window.partitionBy("doc").orderBy("page")).cast("string")
    return pages.select("doc", "page", F.when(any_ == 0, nth).otherwise(own).alias("label"))


def place_marks(blocks: DataFrame, marks: DataFrame) -> DataFrame:
    """(doc, page, mark, kind, pos) of anchors and images (doc, page, mark, kind, top) among a page's blocks (doc, page, pos, top).

    An anchor goes to the block with the greatest top up to 4 above it, earliest on a tie; one
    without a height to the page's first block. An image goes before the first block whose top is
    not above its own: ``pos`` is that block's, null at the page's end. Blocks and marks are one
    set of rows in the order of height, along which the nearest block and the first one so far
    are carried; blocks and marks of a page are never paired.
    """
    anchor = F.col("kind") == "anchor"
    none = lambda kind: F.lit(None).cast(kind)
    mark = marks.schema["mark"].dataType.simpleString()
    b = blocks.select("doc", "page", F.col("top").cast("double").alias("h"), F.col("pos").cast("long").alias("at"), none(mark).alias("mark"), none("string").alias("kind"))
    height = F.col("top").cast("double") + F.when(anchor, 4).otherwise(0)
    m = marks.select("doc", "page", height.alias("h"), none("long").alias("at"), "mark", "kind")
    page = Window.partitionBy("doc", "page")
    # at one height blocks come first, the earliest block last, so that it is the nearest
    up = page.orderBy(F.col("h").asc_nulls_first(), F.col("kind").isNotNull(), F.desc("at")).rowsBetween(Window.unboundedPreceding, 0)
    low = F.when(F.col("h").isNotNull(), F.col("at"))
    rows = b.unionByName(m).withColumns({"_near": F.last(low, True).over(up), "_first": F.min(low).over(up), "_top": F.min("at").over(page)})
    pos = F.when(~anchor, F.when(F.col("h").isNotNull(), F.col("_first"))).when(F.col("h").isNull(), F.col("_top")).otherwise(F.col("_near"))
    return rows.where("kind is not null").select("doc", "page", "mark", "kind", pos.alias("pos"))


def place_anchors(blocks: DataFrame, anchors: DataFrame) -> DataFrame:
    """(doc, page, anchor, pos): the anchors (doc, page, anchor, anchor_top) alone, see :func:`place_marks`."""
    marks = anchors.select("doc", "page", F.col("anchor").alias("mark"), F.lit("anchor").alias("kind"), F.col("anchor_top").alias("top"))
    return place_marks(blocks, marks).select("doc", "page", F.col("mark").alias("anchor"), "pos")
