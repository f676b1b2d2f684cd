"""Scalar functions: Column in, Column out (one pandas UDF, for accents)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

C = Column | str


def col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once: as a lambda's parameter it is not repeated wherever ``fn`` uses it, nor in each step of a lambda inside."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def word_grams(words: Column, n: int) -> Column:
    """Hashes of the distinct runs of ``n`` words; of all the words if there are fewer."""
    return once(words, lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, F.lit(n))))))


def normalize_space(c: C) -> Column:
    """White space runs (Unicode) become one space; trimmed."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def count_words(c: C) -> Column:
    """Tokens between white space with a letter or digit."""
    return F.size(F.filter(F.split(col(c), r"(?U)\s+"), lambda t: t.rlike(r"[\p{L}\p{N}]"))).cast("long")


def escape_html(c: C) -> Column:
    out = col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def unescape_html(c: C) -> Column:
    """The character references that markup needs, and the blank that does not break, as characters."""
    out = col(c)
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


@F.pandas_udf(StringType())
def strip_accents(texts: pd.Series) -> pd.Series:
    """NFKD without combining marks; Spark has no such function."""
    decomposed = texts.str.normalize("NFKD")
    return decomposed.str.replace("[̀-ͯ]", "", regex=True)


def _slug(c: Column, size: int) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    slug = F.regexp_replace(F.substring(slug, 1, size), "-+$", "")
    return F.when(F.coalesce(slug, F.lit("")) == "", "untitled").otherwise(slug)


def slugify(c: C, size: int = 60) -> Column:
    """Accents off, lower case, other characters as single hyphens; "untitled" if nothing is left.

    Of a text only the part up to its (``size`` + 1)-th ASCII letter or digit leaves the JVM,
    where it has so many: what follows comes after the cut.
    """
    head = F.regexp_extract(col(c), rf"^(?:[^A-Za-z0-9]*+[A-Za-z0-9]){{{size + 1}}}", 0)
    plain = F.when(head != "", head).otherwise(col(c))
    return F.when(plain.rlike("[^\\x00-\\x7f]"), _slug(strip_accents(plain), size)).otherwise(_slug(plain, size))


def ascii_slug(c: C, size: int = 60) -> Column:
    """:func:`slugify` for text that is known to have no accents; stays in the JVM."""
    return _slug(col(c), size)


def format_time(seconds: C) -> Column:
    """754 gives "12:34", 3845 gives "1:04:05"."""
    t = F.floor(col(seconds))
    h, m, s = F.floor(t / 3600), F.floor((t % 3600) / 60), F.lpad((t % 60).cast("string"), 2, "0")
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), F.lpad(m.cast("string"), 2, "0"), s)).otherwise(F.concat_ws(":", m.cast("string"), s))


def format_length(seconds: C) -> Column:
    """Minutes below an hour, else "1 h 05 min"."""
    m = F.floor(col(seconds) / 60 + 0.5)
    return F.when(m < 60, F.concat(m.cast("string"), F.lit(" min"))).otherwise(F.concat(F.floor(m / 60).cast("string"), F.lit(" h "), F.lpad((m % 60).cast("string"), 2, "0"), F.lit(" min")))


#: Hosts and id patterns of video addresses.
VIDEO_HOSTS = ("youtube.com", "www.youtube.com", "m.youtube.com", "music.youtube.com", "youtu.be")
VIDEO_ID, LIST_ID = r"^[A-Za-z0-9_-]{11}$", r"^[A-Za-z0-9_-]{10,}$"


def parse_video_url(url: C) -> Column:
    """struct(kind, id, playlist) of a video or playlist address, null for another address."""
    u = F.trim(col(url))
    host = F.lower(F.try_parse_url(u, F.lit("HOST")))
    parts = F.filter(F.split(F.coalesce(F.try_parse_url(u, F.lit("PATH")), F.lit("")), "/"), lambda p: p != "")
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    playlist = F.try_parse_url(u, F.lit("QUERY"), F.lit("list"))
    playlist = F.when(playlist.rlike(LIST_ID), playlist)
    video = F.when(host == "youtu.be", first).when(first == "watch", F.try_parse_url(u, F.lit("QUERY"), F.lit("v"))).when(first.isin("shorts", "live", "embed"), second)
    known = host.isin(*VIDEO_HOSTS) & F.lower(u).rlike("^https?:")
    of = lambda kind, id_, lst: F.struct(F.lit(kind).alias("kind"), id_.alias("id"), lst.alias("playlist"))
    return F.when(known & video.rlike(VIDEO_ID), of("video", video, playlist)).when(known & (first == "playlist") & playlist.isNotNull(), of("playlist", playlist, F.lit(None).cast("string")))


def video_url(id_: C) -> Column:
    return F.concat(F.lit("https://www.youtube.com/watch?v="), col(id_))


def time_url(id_: C, seconds: C) -> Column:
    return F.concat(video_url(id_), F.lit("&t="), F.floor(col(seconds)).cast("string"), F.lit("s"))


def time_link(markdown: C) -> Column:
    """struct(id, start) of the first time link of a text, else null."""
    pattern = r"\]\(https://www\.youtube\.com/watch\?v=([A-Za-z0-9_-]{11})&t=([0-9]+)s\)"
    start = F.regexp_extract(col(markdown), pattern, 2)
    return F.when(start != "", F.struct(F.regexp_extract(col(markdown), pattern, 1).alias("id"), start.cast("int").alias("start")))


def source_display(book: C, chapter: C, number: C, title: C, page: C) -> Column:
    """Book, 3.2 Title, p. 45; the page part only where there is one."""
    head = F.concat(col(book), F.lit(", "), col(chapter).cast("string"), F.lit("."), col(number).cast("string"), F.lit(" "), col(title))
    return F.concat(head, F.coalesce(F.concat(F.lit(", p. "), col(page).cast("string")), F.lit("")))


def section_place(book: C, chapter: C, number: C) -> Column:
    """Book order as one integer."""
    return col(book).cast("long") * 10**12 + col(chapter).cast("long") * 10**6 + col(number).cast("long")


def mask_digits(c: C) -> Column:
    return F.regexp_replace(col(c), "[0-9]+", "#")


#: Fixed value: roman numbers below 4000.
ROMAN = r"(?i)^(?=[ivxlcdm]+$)m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$"


def page_number(c: C) -> Column:
    """Up to four digits or a roman number with punctuation around it, else null."""
    core = F.regexp_replace(col(c), r"^\W+|\W+$", "")
    return F.when(core.rlike(r"^[0-9]{1,4}$") | ((core != "") & core.rlike(ROMAN)), core)


def strip_mdx(c: C) -> Column:
    """Component tags and import/export lines go outside fenced code."""
    fence = r"(?m)^(?:```|~~~)[^\n]*\n[\s\S]*?^(?:```|~~~)[ \t]*$"
    prose, code = F.split(col(c), fence, -1), F.regexp_extract_all(col(c), F.lit(fence), F.lit(0))
    clean = F.transform(prose, lambda p: F.regexp_replace(F.regexp_replace(p, r"(?m)^(import|export)\s.*$", ""), r"</?[A-Z][\w.]*(?:\s[^<>]*?)?/?>", ""))
    return F.array_join(F.transform(F.arrays_zip(clean.alias("p"), code.alias("c")), lambda x: F.concat(x["p"], F.coalesce(x["c"], F.lit("")))), "")


def split_authors(c: C) -> Column:
    return F.filter(F.transform(F.split(col(c), r"\s*[,;&]\s*|\s+and\s+"), lambda a: F.trim(a)), lambda a: a != "")


def resolve_href(base: C, href: C) -> Column:
    """struct(file, anchor) of a relative link inside a file tree: dot segments resolved, both parts decoded; the base file for a bare anchor."""
    h = col(href)
    path = F.coalesce(F.try_url_decode(F.substring_index(h, "#", 1)), F.substring_index(h, "#", 1))
    anchor = F.when(h.contains("#"), F.regexp_replace(h, "^[^#]*#", ""))
    folder = F.regexp_replace(col(base), "[^/]*$", "")
    whole = F.when(path == "", col(base)).otherwise(F.concat(folder, path))
    empty = F.expr("cast(array() as array<string>)")
    walked = F.aggregate(
        F.split(whole, "/"),
        empty,
        lambda acc, p: F.when((p == "") | (p == "."), acc).when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))),
    )
    return F.struct(F.array_join(walked, "/").alias("file"), F.coalesce(F.try_url_decode(anchor), anchor).alias("anchor"))


def folder_title(c: C) -> Column:
    """ "campaign-creation" gives "Campaign creation"."""
    text = normalize_space(F.regexp_replace(F.coalesce(F.try_url_decode(col(c)), col(c)), "[-_]+", " "))
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def contains_term(text: C, term: C) -> Column:
    """Whether a lower-case term stands in a lower-case text with no letter or digit beside it."""
    quoted = F.regexp_replace(col(term), r"([\\.\[\]{}()*+?^$|#&~-])", r"\\$1")
    return (col(term) != "") & col(text).contains(col(term)) & F.regexp_like(col(text), F.concat(F.lit(r"(?<![\p{L}\p{N}])"), quoted, F.lit(r"(?![\p{L}\p{N}])")))


def sniff_image_type(data: C) -> Column:
    """Type of an image by its first bytes, else null."""
    h = F.hex(F.substring(col(data), 1, 12))
    return (
        F.when(h.startswith("89504E47"), "image/png")
        .when(h.startswith("FFD8FF"), "image/jpeg")
        .when(h.startswith("47494638"), "image/gif")
        .when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "image/webp")
    )


# Markdown by its grammar. A line opens containers (quotes, list items), nested in any order, then perhaps a heading.
_QUOTE = r">[ \t]?"
_ITEM = r"(?:[-+*]|[0-9]{1,9}\\?[.)])[ \t]+"
_HEADING = r"#{1,6}[ \t]+"
BLOCK_START = rf"(?md)^[ \t]*(?:(?:{_QUOTE}|{_ITEM})[ \t]*)*+(?:{_HEADING})?"
#: A link or image; its address may hold one level of brackets.
INLINE_LINK = r"!?\[([^\]]*)\]\((?:[^()]|\([^()]*\))*+\)"
#: A backslash before any ASCII punctuation.
ESCAPE = r"\\(\p{Punct})"
#: Runs of stars or underscores that open or close: text on one side, no letter or digit on the other. Two stars may also stand inside a word.
DELIMITER = r"(?<![\p{L}\p{N}*_])[*_]+(?=[^\s*_])|(?<=[^\s*_])[*_]+(?![\p{L}\p{N}*_])|\*\*"


def strip_markdown(c: C) -> Column:
    """Text without Markdown: block starts go, links become their text, escaped characters themselves, ticks and delimiters go, cell borders become spaces.

    A delimiter needs no partner, since a quote may be cut inside an emphasis.
    """
    out = col(c)
    for pattern, kept in ((BLOCK_START, ""), (INLINE_LINK, "$1"), (ESCAPE, "$1")):
        out = F.regexp_replace(out, pattern, kept)
    return F.regexp_replace(F.translate(out, "|`", " "), DELIMITER, "")


def normalize_quote(c: C) -> Column:
    """Normal form for comparing quotes: no Markdown, plain quotes and dashes, single spaces, lower case."""
    out = F.translate(strip_markdown(c), "“”«»„‘’‚–—", "\"\"\"\"\"'''--")
    return F.lower(normalize_space(out))


def title_key(c: C) -> Column:
    """Key of a book title: accents off, lower case, letters, digits, + and # only."""
    return F.regexp_replace(F.lower(strip_accents(col(c))), r"[^\p{L}\p{N}+#]", "")
