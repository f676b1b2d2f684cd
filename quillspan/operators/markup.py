"""Markup as rows of tags: pairs of tags, whole elements and the links of a page.

A page becomes one row per tag with the text up to the next one. Opening and closing tags of
one name on one level alternate, so each finds its partner in the row beside it; what lies
between is told by running sums. No tree is built, no row looks at more than its neighbours,
and the cost is linear in a page's tags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.text import normalize_space, once, unescape_html
from quillspan.sources.tables import spread

#: Elements without an end tag.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
#: Elements that stand on lines of their own.
BLOCK = ("address", "article", "aside", "blockquote", "br", "caption", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul")
COMMENT = r"(?s)<!--(?:-?>|.*?--!?>)"
RAW = r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>"
#: A tag; values in quotes may hold what would end it.
TAG = r"""</?[a-zA-Z](?:[^<>"']++|"[^"]*+"|'[^']*+')*+>|</?[a-zA-Z][^>]*>"""


def attribute(token: Column | str, name: str) -> Column:
    """Value of a tag's attribute, empty if it has none, null if it is not there."""
    t = F.col(token) if isinstance(token, str) else token
    pattern = rf"""(?is)\s{name}(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?=[\s/>]))"""
    value = F.concat(*[F.regexp_extract(t, pattern, k) for k in (1, 2, 3)])
    return F.when(t.rlike(pattern), unescape_html(value))


#: Parts of tag rows for each part in which pages are read: a part's pages make several times their bytes in rows, which every window sorts.
TAG_PARTS = 16


def tag_rows(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """(keys, at, tag, closes, token, text) of a page's body: each tag with the text after it. Comments, scripts and styles are no tags; an empty or null page has no row."""
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(html), COMMENT, " "), RAW, " "), r"(?is)^.*?<body\b[^>]*>", "<body>")
    pieces = F.arrays_zip(F.regexp_extract_all(body, F.lit(TAG), F.lit(0)).alias("token"), F.slice(F.split(body, TAG, -1), 2, 1 << 30).alias("text"))
    rows = spread(pages.select(*keys, html)).select(*keys, F.posexplode(pieces).alias("at", "x")).select(*keys, "at", "x.token", "x.text")
    rows = rows.repartition(TAG_PARTS * pages.rdd.getNumPartitions(), *keys)  # the one shuffle: all windows below are within a page
    return rows.select(*keys, "at", F.lower(F.regexp_extract("token", "^</?([a-zA-Z][a-zA-Z0-9-]*)", 1)).alias("tag"), F.col("token").startswith("</").alias("closes"), "token", "text")


def with_partner(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Tag rows with ``partner``, the place of the tag that ends or begins the element; null where there is none.

    Levels are counted per name, so a tag that is never closed disturbs only those of its name.
    """
    step = F.when(F.col("tag").isin(*VOID) | F.col("token").endswith("/>"), 0).when(F.col("closes"), -1).otherwise(1)
    running = Window.partitionBy(*keys, "tag").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_step", step).withColumn("_level", F.sum("_step").over(running) + F.col("closes").cast("int"))
    w = Window.partitionBy(*keys, "tag", "_level").orderBy("at")
    after, before = F.lead(F.struct("at", "closes")).over(w), F.lag(F.struct("at", "closes")).over(w)
    partner = F.when(~F.col("closes"), F.when(after["closes"], after["at"])).otherwise(F.when(~before["closes"], before["at"]))
    return rows.withColumn("partner", F.when(F.col("_step") != 0, partner)).drop("_step", "_level")


def drop_elements(rows: DataFrame, keys: list[str], bad: Column) -> DataFrame:
    """Tag rows with partners without the elements whose opening tag is ``bad``, and all inside them.

    The text after an element stays, in a row whose token is empty. Of an element that is
    never closed only the tag goes.
    """
    w = Window.partitionBy(*keys, "tag").orderBy(F.least("at", F.coalesce("partner", "at")), "at")
    opens = ~F.col("closes") & F.coalesce(bad, F.lit(False))
    rows = rows.withColumn("_bad", opens)
    ends = F.col("closes") & F.col("partner").isNotNull() & F.coalesce(F.lag("_bad").over(w), F.lit(False))
    rows = rows.withColumn("_ends", ends)
    step = F.when(F.col("_bad") & F.col("partner").isNotNull(), 1).when(F.col("_ends"), -1).otherwise(0)
    run = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    kept = rows.withColumn("_in", F.sum(step).over(run)).where("_in = 0")
    gone = F.col("_ends") | F.col("_bad")
    return kept.withColumn("token", F.when(gone, "").otherwise(F.col("token"))).drop("_bad", "_ends", "_in")


def joined(pieces: Column) -> Column:
    """The texts of an array of (at, s) in order."""
    return normalize_space(unescape_html(F.array_join(F.transform(F.array_sort(pieces), lambda x: x["s"]), "")))


#: Longest title of a group of links.
LABEL_LENGTH = 100


def collect_links(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(id, pos, text, url, depth): links in page order with their list depth; the same link twice in a row counts once.

    A link's text is that of the first heading in it, else its own, else its ``aria-label`` or
    ``title``; links without text, and those that lead to no http(s) address, are left out.
    A list item whose own part has no link is a group title without url, if its text has at
    most 100 characters. The own part leaves out lists, and children that hold a list.
    """
    from quillspan.operators.web import absolute_url

    key = [id_col]
    rows = with_partner(tag_rows(pages, key, html), key)
    tag, closes = F.col("tag"), F.col("closes")
    is_list, page = tag.isin("ul", "ol"), Window.partitionBy(id_col).orderBy("at")
    run = page.rowsBetween(Window.unboundedPreceding, 0)
    inner = F.col("partner").isNotNull() & ~tag.isin("ul", "ol", "li")
    heading, anchor = tag.rlike("^h[1-6]$"), tag == "a"
    up = lambda c: F.when(c, F.when(closes, -1).otherwise(1)).otherwise(0)
    state = {
        "depth": F.sum(up(is_list)).over(run).cast("long"),
        "_e": F.sum(up(inner)).over(run),
        "_list_next": F.coalesce(F.lead(is_list & ~closes).over(page), F.lit(False)),
        "_a": F.sum(F.when(anchor & ~closes, 1).otherwise(0)).over(run),
        "_in_a": F.coalesce(F.last(F.when(anchor, ~closes), True).over(run), F.lit(False)),
        "_h": F.sum(F.when(heading & ~closes, 1).otherwise(0)).over(run),
        "_in_h": F.coalesce(F.last(F.when(heading, ~closes), True).over(run), F.lit(False)),
    }
    rows = rows.withColumns(state)
    space = F.when(tag.isin(*BLOCK), " ").otherwise("")

    # links: everything from an anchor's tag to its end
    piece = F.struct("at", F.concat(space, "text").alias("s"), F.when(F.col("_in_h"), F.col("_h")).alias("h"))
    links = rows.where("_in_a").groupBy(id_col, "_a").agg(F.min("at").alias("at"), F.min_by("token", "at").alias("token"), F.min_by("depth", "at").alias("depth"), F.min("_h").alias("_h0"), F.max("_h").alias("_h1"), F.collect_list(piece).alias("p"))
    first = F.filter("p", lambda x: F.coalesce(x["h"] == F.col("_h0") + 1, F.lit(False)))
    text = F.when(F.col("_h1") > F.col("_h0"), joined(first)).otherwise(joined(F.col("p")))
    label = normalize_space(F.coalesce(attribute("token", "aria-label"), attribute("token", "title"), F.lit("")))
    shown = once(text, lambda t: F.when(t == "", label).otherwise(t))
    links = links.select(id_col, "at", "depth", shown.alias("text"), attribute("token", "href").alias("href")).where("href <> ''")
    bases = pages.select(F.col(id_col), F.col(url).alias("_base"))
    # in an array, so that the conditions do not make it twice
    made = F.explode(F.array(F.struct("text", absolute_url("href", "_base").alias("url"))))
    links = links.join(bases, id_col).select(id_col, "at", "depth", made.alias("x")).select(id_col, "at", "depth", "x.text", "x.url").where("url is not null and text <> ''")

    # items: what stands at an item's depth from its tag up to the next item tag there, or the end of the list
    level = Window.partitionBy(id_col, "depth").orderBy("at")
    rows = rows.withColumn("_own", F.sum((tag.isin("li") | is_list & ~closes).cast("int")).over(level.rowsBetween(Window.unboundedPreceding, 0)))
    item = Window.partitionBy(id_col, "depth", "_own").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_e": F.col("_e") - F.first("_e").over(item), "_item": F.first((tag == "li") & ~closes).over(item)}).where("_item")
    begins = inner & ~closes & (F.col("_e") == 1)
    rows = rows.withColumns({"_child": F.when(F.col("_e") > 0, F.sum(begins.cast("int")).over(item)).otherwise(0), "s": F.concat(F.when(begins | inner & closes & (F.col("_e") == 0), " ").otherwise(space), "text")})
    child = rows.groupBy(id_col, "depth", "_own", "_child").agg(F.min("at").alias("at"), F.max((F.col("_child") > 0) & F.col("_list_next")).alias("_nested"), F.max(anchor & ~closes).alias("_link"), F.collect_list(F.struct("at", "s")).alias("p"))
    items = child.where("not _nested").groupBy(id_col, "depth", "_own").agg(F.min("at").alias("at"), F.max("_link").alias("_link"), F.flatten(F.collect_list("p")).alias("p")).where("not _link")
    titles = items.select(id_col, "at", "depth", F.explode(F.array(joined(F.col("p")))).alias("text")).withColumn("url", F.lit(None).cast("string")).where(f"text <> '' and length(text) <= {LABEL_LENGTH}")

    every = links.unionByName(titles)
    same = F.coalesce((F.lag("url").over(page) == F.col("url")) & (F.lag("text").over(page) == F.col("text")), F.lit(False))
    every = every.withColumn("_same", same).where("not _same")
    return every.select(id_col, (F.row_number().over(page) - 1).cast("long").alias("pos"), "text", "url", "depth")


def collect_frames(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(id, pos, url): the frames of a page that come from its own site, each address once, in page order."""
    from quillspan.operators.web import absolute_url

    rows = tag_rows(pages, [id_col, url], html).where("tag = 'iframe' and not closes")
    origin = lambda c: F.lower(F.regexp_extract(c, r"^([a-zA-Z]+://[^/?#]+)", 1))
    rows = rows.select(id_col, "at", F.col(url).alias("_base"), absolute_url(attribute("token", "src"), F.col(url)).alias("url")).where(origin("url") == origin("_base"))
    rows = rows.groupBy(id_col, "url").agg(F.min("at").alias("at"))
    return rows.select(id_col, (F.row_number().over(Window.partitionBy(id_col).orderBy("at")) - 1).cast("long").alias("pos"), "url")


def scoped_items(items: DataFrame, key: str, scope: Column) -> DataFrame:
    """In-scope links; a group title (null url) only if a kept link comes under it.

    That is: the next kept link is at the title's depth or deeper, and no other title at that
    depth or above stands between them. Titles carry the next link's place backwards, and the
    least depth of the titles on the way.
    """
    from quillspan.operators.web import in_scope

    kept = items.withColumn("_link", F.col("url").isNotNull()).where(~F.col("_link") | F.coalesce(in_scope("url", scope), F.lit(False)))
    back = Window.partitionBy(key).orderBy(F.desc("pos"))
    there = F.last(F.when(F.col("_link"), F.struct("pos", "depth")), True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    kept = kept.withColumn("_next", there)
    way = Window.partitionBy(key, F.col("_next.pos")).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    nearer = F.min(F.when(~F.col("_link"), F.col("depth"))).over(way)
    kept = kept.withColumn("_nearer", nearer)
    under = (F.col("_next.depth") >= F.col("depth")) & (F.col("_nearer").isNull() | (F.col("_nearer") > F.col("depth")))
    return kept.where(F.col("_link") | F.coalesce(under, F.lit(False))).select(*items.columns)
