"""Main text of web pages by consensus host paths (operator 7).

Each page is parsed once. Its containers are scored by the text they hold against the link
text they hold; the best ones vote, under a generalised path of tags and classes without
digits, for their host. The path with most votes of a host is then used on all its pages;
a page without text under that path falls back to its own best containers.

What is left out: by tag (menus, footers, sidebars, forms and the like), by role, by being
hidden, and by class or id. A class says little by itself, so it only counts where all of
its words are about boilerplate, and not where the page has less text outside the element
than inside. Elements marked as comments are left out however much they hold.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import ship, stage

#: Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Whose content is no markup; an unclosed one of the first five runs to the end of the page.
RAW = frozenset("script style textarea xmp title noscript template iframe noembed noframes".split())
ENDLESS = frozenset("script style textarea xmp".split())
#: Whose content is not text of the page; without an end tag they are taken as empty.
EMBEDDED = frozenset("svg object audio video canvas".split())
BLOCK = frozenset(
    "html body head div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption section article main nav header footer aside form fieldset legend blockquote pre figure figcaption address details summary hr dialog menu center option select button".split()
)
CONTAINER = frozenset("div section article main td body html form blockquote center details".split())
DROPPED = frozenset("nav footer aside select button dialog menu head label input option fieldset".split())
ROLES = frozenset("navigation complementary contentinfo search dialog alertdialog alert form menu menubar toolbar".split())
#: An open element that a new one of the same kind ends, and what bounds the search for it.
SIBLINGS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
TWINS = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}
#: Words in a class or id that are about boilerplate, about readers' comments, and that say nothing either way.
MARKS = frozenset(
    "ad ads adbox advert advertisement advertising adv sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer foot sidebar aside widget cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe signup login register share sharing social related recommended recommendations pagination pager toolbar skip hidden search searchform form copyright legal disclaimer".split()
)
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
NEUTRAL = frozenset("area articles bar block bottom box button buttons col column container content count first global google group head id inner item items js last left line link links list main note outer page panel posts rail right row section secondary site slot small stories text thread top unit view wrap wrapper".split())
#: Beside a comment word these say that comments are there, or not, not that this is one.
STATES = frozenset("has have no non with without open closed enabled disabled allow allowed".split())
#: Marks of headers, which an article may have as well.
HEADERS = frozenset("header masthead topbar banner".split())
#: Marks that also hold for an article element, which may be a comment or a link to another article.
STRICT = frozenset("ad ads advert advertisement sponsored promo related recommended widget".split())
INNER = MARKS - HEADERS
CACHE_ROWS = 50_000
#: Dropped unless they hold most of the page's text, by how many times the rest; or always.
FREE, SOFT, DOUBT, HARD = range(4)
MOST = {SOFT: 3, DOUBT: 20}

ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
END_COMMENT = re.compile("--!?>")
TAG = re.compile(r"[A-Za-z][^\s/>]*")


@dataclass(slots=True)
class Node:
    tag: str
    path: int  # a hash of the tags and classes from the root
    parent: int
    drop: int  # FREE, SOFT (a form, or by a class), DOUBT (perhaps comments) or HARD, of its own
    inside: bool  # within an article or main element


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=lambda: [Node("", 0, 0, FREE, False)])
    blocks: list[tuple[int, str, int]] = field(default_factory=list)  # node, text, characters in links
    dropped: list[bool] = field(default_factory=list)  # by node, from ``settle``


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): next((g for g in m.groups()[1:] if g is not None), "") for m in ATTRIBUTE.finditer(text)}


def _names(value: str) -> list[list[str]]:
    """The names in a class or id, each as its words."""
    return [[w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if w] for name in value.split()]


def _comments(names: list[list[str]]) -> bool:
    """Whether a name has a word for comments, and none that only says whether there are any."""
    return any(any(w in COMMENTS for w in parts) and not any(w in STATES for w in parts) for parts in names)


def _marked(names: list[list[str]], words: frozenset[str]) -> bool:
    """Whether a name consists of such words, beside others about boilerplate and neutral ones."""
    return any(any(w in words for w in parts) and all(w in words or w in MARKS or w in NEUTRAL for w in parts) for parts in names)


def _tag_end(html: str, at: int) -> int:
    """Where the tag that begins before ``at`` ends; a quoted > does not end it unless the quote stays open."""
    plain = html.find(">", at)
    k = at
    while 0 <= plain:
        quotes = [q for q in (html.find('"', k, plain), html.find("'", k, plain)) if q >= 0]
        if not quotes:
            return plain
        q = min(quotes)
        close = html.find(html[q], q + 1)
        if close < 0:
            return plain
        if close > plain:
            if "<" in html[plain:close] and "=" not in html[max(at, q - 1) : q]:
                return plain  # a stray quote, not an attribute's
            plain = html.find(">", close)
        k = close + 1
    return plain


class Parser:
    """Elements with hashed paths and blocks of text in page order; every step takes the same time at any depth."""

    def __init__(self) -> None:
        self.page = Page()
        self.stack: list[int] = [0]  # nodes
        self.open: dict[str, list[int]] = {}  # places in the stack by tag
        self.blocks: list[int] = [0]  # places of block elements
        self.bounds: list[int] = [0]  # places of elements that an open paragraph cannot reach over
        self.words: list[str] = []
        self.links = self.link_depth = self.muted = 0
        self.unclosed: set[str] = set()

    def flush(self) -> None:
        if self.words:
            text = " ".join("".join(self.words).split())
            if text:
                top = self.stack[-1]
                self.page.blocks.append((self.stack[self.blocks[-1]] if self.page.nodes[top].drop == FREE else top, text, self.links))
            self.words.clear()
            self.links = 0

    def push(self, tag: str, attributes: dict[str, str]) -> None:
        nodes, place = self.page.nodes, len(self.stack)
        up = nodes[self.stack[-1]]
        names = attributes.get("class", "")
        path = up.path
        if tag in BLOCK:
            classes = sorted({re.sub(r"\d+", "", c) for c in names.lower().split()} - {""})
            path = _path(path, ".".join([tag, *classes]))
        role = attributes.get("role", "").lower()
        inside = up.inside or tag in ("article", "main") or role == "main"
        hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
        both = f"{names} {attributes.get('id', '')}"
        drop = FREE
        if tag in DROPPED and not (tag == "label" and up.inside) or hidden or role in ROLES or (tag == "header" or role == "banner") and not up.inside:
            drop = HARD
        elif both != " " and tag not in ("html", "body", "main"):
            parts = _names(both)
            if tag in BLOCK and _comments(parts):
                drop = HARD if _marked(parts, COMMENTS) else DOUBT
            elif _marked(parts, STRICT if tag == "article" else INNER if up.inside else MARKS):
                drop = SOFT
        if tag == "form" and drop == FREE:
            drop = SOFT
        nodes.append(Node(tag, path, self.stack[-1], drop, inside))
        self.stack.append(len(nodes) - 1)
        self.open.setdefault(tag, []).append(place)
        if tag in BLOCK:
            self.blocks.append(place)
        if tag in CONTAINER or tag in ("li", "th"):
            self.bounds.append(place)
        self.link_depth += tag == "a"
        self.muted += drop == HARD and tag not in BLOCK

    def close_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            node = self.page.nodes[self.stack.pop()]
            tag = node.tag
            self.open[tag].pop()
            self.muted -= node.drop == HARD and tag not in BLOCK
            for places in (self.blocks, self.bounds):
                if places[-1] == len(self.stack):
                    places.pop()
            self.link_depth -= tag == "a"

    def last(self, *tags: str) -> int:
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)

    def end_tag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        depth = self.last(tag)
        if depth and (tag in BLOCK or self.blocks[-1] < depth):  # an inline end tag does not close blocks
            self.close_to(depth)

    def begin_block(self, tag: str) -> None:
        self.flush()
        if tag in SIBLINGS:
            depth = self.last(*TWINS.get(tag, (tag,)))
            if depth > self.last(*SIBLINGS[tag]):
                self.close_to(depth)
        depth = self.last("p")
        if depth and self.bounds[-1] < depth:
            self.close_to(depth)  # a block ends an open paragraph

    def end_of(self, tag: str, html: str, at: int) -> int:
        """Where the content of a raw or embedded element ends, or -1; an end tag that was not found once is not looked for again."""
        if tag in self.unclosed:
            return -1
        close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
        if close is None:
            self.unclosed.add(tag)
            return -1
        return close.end()

    def parse(self, html: str) -> Page:
        at, size = 0, len(html)
        while at < size:
            lt = html.find("<", at)
            if lt < 0:
                lt = size
            if lt > at and not self.muted:
                piece = html[at:lt]
                if "&" in piece:
                    piece = entities.unescape(piece)
                self.words.append(piece)
                if self.link_depth:
                    self.links += len(piece)
            if lt >= size:
                break
            second = html[lt + 1 : lt + 2]
            if second == "!" and html.startswith("<!--", lt):
                if short := next((x for x in (">", "->") if html.startswith(x, lt + 4)), ""):
                    at = lt + 4 + len(short)
                else:
                    end = END_COMMENT.search(html, lt + 4)
                    at = end.end() if end else size
                continue
            closing = second == "/"
            name = TAG.match(html, lt + 1 + closing)
            if not name:
                if second and second in "!?/":
                    end = html.find(">", lt)
                    at = size if end < 0 else end + 1
                else:
                    self.words.append("<")
                    at = lt + 1
                continue
            tag = name[0].lower()
            end = name.end() if html.startswith(">", name.end()) else _tag_end(html, name.end())
            if end < 0:
                break
            at = end + 1
            if closing:
                self.end_tag(tag)
                continue
            if tag == "br":
                self.words.append(" ")
                continue
            if tag in BLOCK:
                self.begin_block(tag)
            if tag in VOID:
                continue
            if tag in RAW or tag in EMBEDDED:
                if tag not in RAW and html[end - 1] == "/":
                    continue
                upto = self.end_of(tag, html, at)
                at = upto if upto >= 0 else size if tag in ENDLESS else at
                continue
            if html[end - 1] == "/" and tag not in BLOCK and end > name.end():
                continue
            self.push(tag, _attributes(html[name.end() : end]) if end > name.end() else {})
        self.flush()
        return self.page


_paths: dict[tuple[int, str], int] = {}


def _path(up: int, label: str) -> int:
    """A 63-bit number for a path, from that of its parent; the same on every worker."""
    key = (up, label)
    if key not in _paths:
        import xxhash

        if len(_paths) > 1 << 17:
            _paths.clear()
        _paths[key] = xxhash.xxh64_intdigest(f"{up}>{label}".encode(errors="replace")) >> 1
    return _paths[key]


def parse(html: str) -> Page:
    page = Parser().parse(html)
    settle(page)
    return page


def settle(page: Page) -> None:
    """Decide what is dropped: all hard cases, and the others unless they hold most of the page.

    That is over three times the text outside of such elements, for a form or a class about
    boilerplate; over twenty times where a name has a word for comments among others, as an
    article's own name may: readers can write much more than the author. On pages with an article or
    main element only text in these is compared, as long as it is a quarter of all.
    """
    nodes = page.nodes
    own = [0] * len(nodes)
    for node, text, links in page.blocks:
        if links * 2 <= len(text):
            own[node] += len(text)
    hard = [n.drop == HARD for n in nodes]
    soft = [0] * len(nodes)  # the innermost soft element around each node; 0 stands for none
    for k in range(1, len(nodes)):
        up = nodes[k].parent
        hard[k] = hard[k] or hard[up]
        soft[k] = k if nodes[k].drop in MOST else soft[up]
    held: dict[int, int] = {}
    core: dict[int, int] = {}
    for k, x in enumerate(own):
        if x and not hard[k]:
            held[soft[k]] = held.get(soft[k], 0) + x
            if nodes[k].inside:
                core[soft[k]] = core.get(soft[k], 0) + x
    weigh = core if sum(core.values()) * 4 >= sum(held.values()) else held
    free = weigh.get(0, 0)
    kept = {0}
    for k in sorted(weigh, key=lambda k: -weigh[k]):
        if k and weigh[k] > MOST[nodes[k].drop] * free:
            kept.add(k)
            free += weigh[k]
    page.dropped = [h or s not in kept for h, s in zip(hard, soft)]


@dataclass
class Found:
    """The blocks of a page that may be main text, and its containers of them, best first."""

    blocks: list[str]
    containers: list[tuple[int, float, int, int]]  # path, score, first block, end


def containers(page: Page) -> Found:
    """Score: text held less link text held; inner ones first on a tie. The blocks below a node are a range of all blocks."""
    nodes, gone = page.nodes, page.dropped
    kept = [(n, t, links * 2 > len(t)) for n, t, links in page.blocks if not gone[n]]
    there = sum(len(t) for _, t, _ in kept)
    core = sum(len(t) for n, t, _ in kept if nodes[n].inside)
    good, bad = [0] * len(nodes), [0] * len(nodes)
    first, end = [len(kept)] * len(nodes), [0] * len(nodes)
    for k, (n, t, linked) in enumerate(kept):
        (bad if linked else good)[n] += len(t)
        first[n] = min(first[n], k)
        end[n] = k + 1
    for k in range(len(nodes) - 1, 0, -1):
        if end[k]:
            up = nodes[k].parent
            good[up] += good[k]
            bad[up] += bad[k]
            first[up] = min(first[up], first[k])
            end[up] = max(end[up], end[k])
    found = []
    for k, n in enumerate(nodes):
        if good[k] and not gone[k] and (n.tag in CONTAINER or not k) and (n.inside or core * 3 < there):
            found.append((float(good[k] - bad[k]), k))
    if not found:  # an article of links alone
        found = [(0.0, k) for k, n in enumerate(nodes) if bad[k] and not gone[k] and n.tag in CONTAINER and n.inside]
        found.sort(key=lambda x: (-bad[x[1]], -x[1]))
    found.sort(key=lambda x: (-x[0], -x[1] if x[0] else 0))
    return Found([t for _, t, _ in kept], [(nodes[k].path, x, first[k], end[k]) for x, k in found])


def extract(html: str, path: int | None) -> str:
    """Main text under the containers of ``path`` that hold more text than links, else under the page's best and its kin."""
    found = containers(parse(html))
    if not found.containers:
        return ""
    own = [c for c in found.containers if c[0] == path] or [c for c in found.containers if c[0] == found.containers[0][0]]
    chosen = sorted([c for c in own if c[1] > 0] or own[:1], key=lambda c: c[2])
    return " ".join(t for c in chosen for t in found.blocks[c[2] : c[3]])


def host(url: str = "url") -> F.Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))


PARSED = "blocks array<string>, containers array<struct<path: long, score: double, first: int, end: int>>"


def parsed(rows: DataFrame, html_col: str) -> DataFrame:
    """The rows with ``blocks`` and ``containers`` (best first) instead of the html."""
    ship(rows.sparkSession)
    names = [c for c in rows.columns if c != html_col]
    rows = rows.select(*names, html_col)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("path", pa.int64()), ("score", pa.float64()), ("first", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            pages = [containers(parse(x)) for x in batch.column(len(names)).to_pylist()]
            found = [[dict(zip(("path", "score", "first", "end"), c)) for c in p.containers] for p in pages]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), pa.array([p.blocks for p in pages], pa.list_(pa.string())), pa.array(found, kind)], names=[*names, "blocks", "containers"])

    return rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names) + f", {PARSED}")


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the path with most votes of each host; a page's best three containers share one vote by score."""
    best = F.filter(F.slice("containers", 1, 3), lambda c: c["score"] > 0)
    total = F.aggregate(best, F.lit(0.0), lambda a, c: a + c["score"])
    votes = F.transform(best, lambda c, i: F.struct(c["path"].alias("path"), (c["score"] / total * F.when(i == 0, 1.0).otherwise(0.25)).alias("vote")))
    each = pages.select("host", F.explode(votes).alias("v")).select("host", "v.path", "v.vote")
    summed = each.groupBy("host", "path").agg(F.round(F.sum("vote"), 6).alias("votes"))
    return summed.groupBy("host").agg(F.max_by("path", F.struct("votes", "path")).alias("winner"))


def _text(winner: str = "winner") -> F.Column:
    """The blocks of the chosen containers in page order, see ``extract``."""
    with_path = lambda path: F.filter("containers", lambda c: c["path"] == path)
    best = with_path(F.get("containers", F.lit(0))["path"])
    own = F.when(F.size(with_path(F.col(winner))) > 0, with_path(F.col(winner))).otherwise(best)
    good = F.filter(own, lambda c: c["score"] > 0)
    chosen = F.when(F.size(good) > 0, good).otherwise(F.slice(own, 1, 1))
    ranges = F.array_sort(F.transform(chosen, lambda c: F.struct(c["first"], c["end"])))
    return F.array_join(F.flatten(F.transform(ranges, lambda r: F.slice("blocks", r["first"] + 1, r["end"] - r["first"]))), " ")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_rows: int = CACHE_ROWS, salts: int = 32) -> DataFrame:
    """One row per page: id, url, text, n_chars (code points).

    A null html counts as empty and gives an empty text; pages with a null url or one
    without a host vote together; repeated rows each vote and give a row; an empty table
    gives none; other columns are not read. What the pages hold is written once, then the
    hosts vote and the texts are put together from it. The winning paths are sent to every
    executor while they are at most ``broadcast_rows``; beyond, pages meet them in a join
    in which every host is dealt over ``salts`` keys.
    """
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), host(url_col).alias("host"), F.xxhash64(url_col, html_col).alias("salt"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    held = stage(parsed(rows, "html"), "pages")
    winners = stage(host_paths(held), "hosts")
    if winners.count() <= broadcast_rows:
        joined = held.join(F.broadcast(winners), "host", "left")
    else:
        salted = winners.withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(salts)])))
        joined = held.withColumn("salt", F.pmod("salt", F.lit(salts)).cast("int")).join(salted, ["host", "salt"], "left")
    out = joined.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), F.when(F.size("containers") > 0, _text()).otherwise("").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
