"""Scalar functions on exact expectations."""

from pyspark.sql import functions as F

from quillspan.functions import text as T


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_space_words_and_slugs(spark):
    assert one(spark, T.normalize_space("t"), t=" a \n  b ") == "a b"
    assert one(spark, T.count_words("t"), t="one - two, 3 … é") == 4
    assert one(spark, T.slugify("t"), t="Crème Brûlée & Co.") == "creme-brulee-co"
    assert one(spark, T.slugify("t"), t="¡!") == "untitled" and one(spark, T.slugify("t", 5), t="ab cd-ef") == "ab-cd"
    assert one(spark, T.escape_html("t"), t='<a & "b">') == "&lt;a &amp; &quot;b&quot;&gt;"


def test_times(spark):
    assert one(spark, T.format_time("s"), s=754) == "12:34" and one(spark, T.format_time("s"), s=3845) == "1:04:05"
    assert one(spark, T.format_length("s"), s=720) == "12 min" and one(spark, T.format_length("s"), s=3900) == "1 h 05 min"


def test_video_addresses(spark):
    parse = lambda u: one(spark, T.parse_video_url("u"), u=u)
    assert tuple(parse("https://www.youtube.com/watch?v=abcdefghijk&list=PL0123456789")) == ("video", "abcdefghijk", "PL0123456789")
    assert parse("https://youtu.be/abcdefghijk")["id"] == "abcdefghijk" and parse("https://youtube.com/shorts/abcdefghijk")["kind"] == "video"
    assert parse("https://youtube.com/playlist?list=PL0123456789")["kind"] == "playlist"
    assert parse("https://example.com/watch?v=abcdefghijk") is None and parse("not an address") is None
    link = one(spark, T.time_link(F.concat(F.lit("[4:05]("), T.time_url("v", F.lit(245.7)), F.lit(") text"))), v="abcdefghijk")
    assert tuple(link) == ("abcdefghijk", 245)


def test_paths_and_titles(spark):
    assert tuple(one(spark, T.resolve_href("b", "h"), b="OPS/text/ch1.xhtml", h="../img/a%20b.png#x%201")) == ("OPS/img/a b.png", "x 1")
    assert tuple(one(spark, T.resolve_href("b", "h"), b="OPS/ch1.xhtml", h="#top")) == ("OPS/ch1.xhtml", "top")
    assert one(spark, T.folder_title("s"), s="campaign-creation") == "Campaign creation"
    assert one(spark, T.source_display("b", "c", "n", "t", "p"), b="Book", c=3, n=2, t="Title", p=45) == "Book, 3.2 Title, p. 45"
    assert one(spark, T.split_authors("a"), a="A B, C; D & E and F") == ["A B", "C", "D", "E", "F"]
    assert one(spark, T.page_number("t"), t="- xiv -") == "xiv" and one(spark, T.page_number("t"), t="page") is None


def test_markdown_and_terms(spark):
    md = "import X from 'y'\n<Callout type=\"a\">text</Callout>\n```js\nimport Z\n<Keep/>\n```\nend <Box/>"
    assert one(spark, T.strip_mdx("t"), t=md) == "\ntext\n```js\nimport Z\n<Keep/>\n```\nend "
    assert one(spark, T.normalize_quote("t"), t="## A **bold** “quote” – and `code`\n> it’s [a link](http://x)") == "a bold \"quote\" - and code it's a link"
    assert one(spark, T.contains_term("t", "q"), t="the c++ language", q="c++") and not one(spark, T.contains_term("t", "q"), t="joins", q="join")
    assert one(spark, T.title_key("t"), t="C++ Prímer: 5th") == "c++primer5th"
    assert one(spark, T.sniff_image_type("d"), d=bytearray(b"\x89PNG\r\n\x1a\n")) == "image/png"


def test_markdown_grammar(spark):
    plain = lambda t: one(spark, T.strip_markdown("t"), t=t)
    assert plain("> - 3) nested\n  + # Head\n#hashtag stays") == "nested\nHead\n#hashtag stays"
    assert plain("see [Tea (drink)](http://w/Tea_(drink)) and ![a cup](c.png)") == "see Tea (drink) and a cup"
    assert plain(r"5 \* 6 and 1\. and C:\dir") == r"5 * 6 and 1. and C:\dir"
    assert plain("snake_case, 2*3, 4 * 5, *one* __two__ un**bold**ed `x_y`") == "snake_case, 2*3, 4 * 5, one two unbolded x_y"
    assert plain("***both*** a__b (_x_) *(*a") == "both a__b (x) (a"
    assert plain("**a quote cut") == "a quote cut" and plain("cut here_, then") == "cut here, then"
    assert plain("| a | b |") == "  a   b  " and plain("") == ""


def test_slugs_of_long_texts_send_their_head_only(spark, monkeypatch):
    import re
    import unicodedata

    texts = ["Über\n" * 4000, "-- É " + "ab c" * 3000, "ж" * 500 + "x", "", None, "a" * 60 + "-b", "a" * 59 + " é\u0301 b", "A" * 61 + "\u0301" * 9, "é" * 70 + "!" * 9000 + "z", "ﬁ" * 50]

    def want(t):
        plain = re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFKD", t or "")).lower()
        return re.sub("[^a-z0-9]+", "-", plain).strip("-")[:60].rstrip("-") or "untitled"

    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    assert [r[0] for r in df.orderBy("k").select(T.slugify("t")).collect()] == [want(t) for t in texts]
    seen = []
    monkeypatch.setattr(T, "strip_accents", lambda c: seen.append(c) or c)
    T.slugify("t")
    assert max(r[0] for r in df.where("k < 2").select(F.length(seen[0])).collect()) < 200
