"""Timed transcripts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.text import format_time
from quillspan.operators.fixpoint import cut

TIME = r"^\s*\[(?:([0-9]+):)?([0-9]+):([0-9]{2})\]\s*"
FENCE = r"^\s*(```|~~~)"
WORD = r"^[\p{L}\p{N}']+"
LIMIT = 5400


def too_long(videos: DataFrame, limit: int | None = LIMIT) -> DataFrame:
    """Videos with a known duration above a given limit."""
    return videos.where(F.col("duration").isNotNull() & F.lit(limit is not None) & (F.col("duration") > F.lit(limit)))


def line_seconds(line: Column) -> Column:
    h, m, s = (F.regexp_extract(line, TIME, k) for k in (1, 2, 3))
    return F.when(s != "", F.coalesce(F.nullif(h, F.lit("")).cast("int"), F.lit(0)) * 3600 + m.cast("int") * 60 + s.cast("int")).cast("long")


def _fenced(lines: DataFrame) -> DataFrame:
    """With ``_code``: inside fenced code, the fences themselves included; a fence is closed by one of its own kind only.

    A video's fences, one letter each, are cut into runs from an opening one to its closing
    one; lines after a closing fence are prose again.
    """
    w = Window.partitionBy("video").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.col("line").rlike(FENCE)
    counted = lines.withColumn("_n", F.sum(mark.cast("long")).over(w))
    kind = F.when(F.regexp_extract("line", FENCE, 1) == "~~~", "t").otherwise("b")
    fences = lines.where(mark).groupBy("video").agg(F.array_sort(F.collect_list(F.struct("pos", kind.alias("k")))).alias("f"))
    runs = fences.select("video", F.posexplode(F.regexp_extract_all(F.array_join(F.transform("f", lambda x: x["k"]), ""), F.lit("b[^b]*b|t[^t]*t|[bt].*$"), F.lit(0))).alias("i", "r"))
    ends = runs.withColumn("_n", F.sum(F.length("r")).over(Window.partitionBy("video").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    closing = ends.where((F.length("r") > 1) & (F.left("r", F.lit(1)) == F.right("r", F.lit(1)))).select("video", F.col("_n").cast("long").alias("_n"), F.lit(True).alias("_end"))
    got = counted.join(closing, ["video", "_n"], "left")
    return got.withColumn("_code", mark | (F.col("_n") > 0) & F.col("_end").isNull()).select(*lines.columns, "_code")


def parse_transcript(lines: DataFrame) -> DataFrame:
    """(video, para, start, text) from lines (video, pos, line): a time begins a paragraph, outside code; headings go; text before the first time starts at 0."""
    l = _fenced(lines).withColumn("_t", F.when(~F.col("_code"), line_seconds(F.col("line"))))  # noqa: E741
    l = l.where(F.col("_code") | ~F.col("line").rlike(r"^\s*#{1,6}\s"))  # noqa: E741
    w = Window.partitionBy("video").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    l = l.withColumn("para", F.count("_t").over(w)).withColumn("_s", F.when(F.col("_t").isNotNull(), F.regexp_replace("line", TIME, "")).otherwise(F.col("line")))  # noqa: E741
    got = l.groupBy("video", "para").agg(F.coalesce(F.max("_t"), F.lit(0)).cast("long").alias("start"), F.sort_array(F.collect_list(F.struct("pos", "_s"))).alias("b"))
    return got.select("video", "para", "start", F.trim(F.array_join(F.transform("b", lambda x: x["_s"]), "\n")).alias("text")).where("text <> ''")


def check_transcript(paragraphs: DataFrame, videos: DataFrame) -> DataFrame:
    """(video, problem): the first problem of each transcript, null for a good one."""
    w = Window.partitionBy("video").orderBy("para").rowsBetween(Window.unboundedPreceding, -1)
    p = paragraphs.join(videos, "video").withColumn("_before", F.coalesce(F.max("start").over(w), F.lit(0)))
    s, b = F.col("start"), F.col("_before")
    code = F.when(s < b - 5, "back").when(s > F.col("duration") + 5, "past_end").when(s - b > 180, "gap")
    per = p.groupBy("video").agg(F.min_by(code, F.when(code.isNotNull(), F.col("para"))).alias("_p"), F.max("start").alias("_last"), F.count(F.lit(1)).alias("_n"))
    out = videos.join(per, "video", "left")
    tail = F.col("duration") - F.greatest("_last", F.lit(0)) > F.greatest(F.lit(120.0), F.col("duration") * 0.1)
    problem = F.when(F.col("finish") == "length", "token_limit").when(F.col("finish") != "stop", "finish_reason").when(F.coalesce("_n", F.lit(0)) == 0, "no_rows").when(F.col("_p").isNotNull(), F.col("_p")).when(tail, "tail")
    return out.select("video", problem.alias("problem"))


def plan_clips(videos: DataFrame, length: int = 2700, overlap: int = 60) -> DataFrame:
    """(video, i, start, end): equal clips of at most ``length`` seconds, each but the last with the overlap."""
    v = videos.withColumn("_n", F.greatest(F.ceil(F.col("duration") / length), F.lit(1)).cast("int")).withColumn("_l", F.col("duration") / F.col("_n"))
    v = v.select("video", "duration", "_n", "_l", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("i"))
    at = lambda k: F.floor(k * F.col("_l") + 0.5)
    end = F.when(F.col("i") == F.col("_n") - 1, F.col("duration")).otherwise(at(F.col("i") + 1) + overlap)
    return v.select("video", F.col("i").cast("long").alias("i"), at(F.col("i")).cast("long").alias("start"), end.cast("long").alias("end"))


def clip_problems(lines: DataFrame, clips: DataFrame) -> DataFrame:
    """(video, problem) of clip transcripts: the first time lies before the clip, else the checks of a whole transcript with times moved to the clip's start; text before the first time is left out, if there is one."""
    first = _fenced(lines).withColumn("_t", line_seconds(F.col("line"))).where("_t is not null").groupBy("video").agg(F.min_by("_t", "pos").alias("_first"))
    par = parse_transcript(lines).join(first, "video", "left").where("para > 0 or _first is null").drop("_first").join(clips.select("video", F.col("start").alias("_c")), "video").withColumn("start", F.greatest(F.col("start") - F.col("_c"), F.lit(0)))
    inner = check_transcript(par.drop("_c"), clips.select("video", (F.col("end") - F.col("start")).alias("duration"), "finish"))
    early = (F.col("start") > 0) & (F.coalesce("_first", F.lit(0)) < F.col("start") - 15)
    return clips.join(first, "video", "left").join(inner, "video", "left").select("video", F.when(early, "before_clip").otherwise(F.col("problem")).alias("problem"))


def _worded(lines: DataFrame) -> DataFrame:
    """Lines of prose with their time ``at``, their words ``_ws``, each with what stands between it and the next one, and ``_k``, the words of the lines before; no word is shuffled for it."""
    l = _fenced(lines).withColumn("_t", F.when(~F.col("_code"), line_seconds(F.col("line"))))  # noqa: E741
    w = Window.partitionBy("video").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    l = l.withColumn("at", F.coalesce(F.last("_t", True).over(w), F.lit(0)))  # noqa: E741
    l = l.where(~F.col("_code") & ~F.col("line").rlike(r"^\s*\|") & ~F.col("line").rlike(r"^\s*#{1,6}\s"))  # noqa: E741
    token = r"[\p{L}\p{N}']+[^\p{L}\p{N}']*"
    l = l.withColumn("_l", F.regexp_replace("line", TIME, "")).withColumn("_ws", F.regexp_extract_all("_l", F.lit(token), F.lit(0)))  # noqa: E741
    return l.withColumn("_k", F.coalesce(F.sum(F.size("_ws")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def _word() -> list[Column]:
    """k, word, at and sentence_end of the ``j``-th word ``t`` of a line of :func:`_worded`."""
    word = F.lower(F.regexp_extract("t", WORD, 0))
    return [(F.col("_k") + F.col("j")).cast("long").alias("k"), word.alias("word"), F.col("at").cast("long").alias("at"), F.col("t").rlike(WORD + r"[^\s\p{L}\p{N}]*[.!?]").alias("sentence_end")]


def placed_words(lines: DataFrame) -> DataFrame:
    """(video, k, word, at, sentence_end, pos, offset, length): prose words in order with the time of their paragraph and where they stand in their line; code and tables have none.

    A word is a run of letters, digits and apostrophes.
    """
    l = _worded(lines)  # noqa: E741
    lead = F.length("_l") - F.length(F.regexp_replace("_l", r"^[^\p{L}\p{N}']+", ""))
    e = l.select("video", "pos", "at", "_k", (F.length("line") - F.length("_l") + lead).alias("_o"), F.posexplode("_ws").alias("j", "t"))
    before = Window.partitionBy("video", "pos").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("_o", F.col("_o") + F.coalesce(F.sum(F.length("t")).over(before), F.lit(0)))
    return e.select("video", *_word(), "pos", F.col("_o").cast("long").alias("offset"), F.length(F.regexp_extract("t", WORD, 0)).cast("long").alias("length"))


def _overlap(words: DataFrame, overlaps: DataFrame, inside: Column, tag: str) -> DataFrame:
    """(video, k, word, at, sentence_end, i, late) of the words that ``inside`` keeps, numbered by ``i``, and of the first word at or after the overlap's middle (``late``; without a number if it lies outside).

    Only these are written; everything before them runs once.
    """
    w = Window.partitionBy("video").orderBy("k")
    after = F.coalesce(F.col("at") >= F.col("_half"), F.lit(False))
    got = words.select("video", "k", "word", "at", "sentence_end").join(overlaps, "video").withColumn("_in", F.coalesce(inside, F.lit(False)))
    got = got.withColumn("late", after & (F.sum(after.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1))
    got = got.withColumn("i", F.when(F.col("_in"), F.sum(F.col("_in").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1))
    return cut(got.where("_in or late").select("video", "k", "word", "at", "sentence_end", "i", "late"), tag)


def _overlap_of_lines(lines: DataFrame, overlaps: DataFrame, inside: Column, tag: str) -> DataFrame:
    """:func:`_overlap` of the words of ``lines``. A line's words have one time, so whole lines are kept, counted and numbered, and only words that are kept become rows."""
    w = Window.partitionBy("video").orderBy("pos")
    n = F.size("_ws")
    after = F.coalesce(F.col("at") >= F.col("_half"), F.lit(False))
    l = _worded(lines).where(n > 0).select("video", "pos", "at", "_k", "_ws").join(overlaps, "video").withColumn("_in", F.coalesce(inside, F.lit(False)))  # noqa: E741
    before = F.coalesce(F.sum(F.when(F.col("_in"), n)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    late = after & (F.sum(after.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    l = l.withColumns({"_i": before, "_late": late}).where("_in or _late")  # noqa: E741
    e = l.select("video", "at", "_k", "_i", "_in", "_late", F.posexplode(F.when(F.col("_in"), F.col("_ws")).otherwise(F.slice("_ws", 1, 1))).alias("j", "t"))
    return cut(e.select("video", *_word(), F.when(F.col("_in"), F.col("_i") + F.col("j")).cast("long").alias("i"), (F.col("_late") & (F.col("j") == 0)).alias("late")), tag)


def join_clips(first: DataFrame, second: DataFrame, overlaps: DataFrame, run: int = 8, near: int = 60) -> DataFrame:
    """(video, method, first_k, second_k, at): where two placed-word lists of a video are joined.

    Common runs of ``run`` words at most two minutes apart, the one that begins nearest the
    overlap's middle (the earliest on a tie), extended as far as words agree, cut after the
    first sentence end in it, else after its last word. Without one the cut is by time: the
    first word at or after the middle on either side. Words outside the overlap are read
    once, to count them; :func:`join_clip_lines` counts them by lines.
    """
    return _joined(first, second, overlaps, run, near, _overlap)


def join_clip_lines(first: DataFrame, second: DataFrame, overlaps: DataFrame, run: int = 8, near: int = 60) -> DataFrame:
    """:func:`join_clips` of two transcripts' lines (video, pos, line): the same result as of their placed words."""
    return _joined(first, second, overlaps, run, near, _overlap_of_lines)


def _joined(first: DataFrame, second: DataFrame, overlaps: DataFrame, run: int, near: int, overlap: Callable) -> DataFrame:
    mid = (F.col("start") + F.col("end")) / 2
    o = overlaps.select("video", F.col("start").alias("_s"), F.col("end").alias("_e"), mid.alias("_m"), F.floor(mid + 0.5).cast("long").alias("_half"))
    a = overlap(first, o, F.col("at") >= F.col("_s") - near, "first-words")
    b = overlap(second, o, F.col("at") <= F.col("_e"), "second-words")

    def runs(d: DataFrame, p: str) -> DataFrame:
        w = Window.partitionBy("video").orderBy("i")
        leads = d.where("i is not null").select("video", "i", "at", "word", *[F.lead("word", j).over(w).alias(f"_{j}") for j in range(1, run)])
        text = F.concat_ws(" ", "word", *[f"_{j}" for j in range(1, run)])
        return leads.where(F.col(f"_{run - 1}").isNotNull()).select("video", F.xxhash64(text).alias("g"), F.xxhash64(F.lit(1), text).alias("h"), F.col("i").alias(f"{p}i"), F.col("at").alias(f"{p}at"))

    # runs are told apart by 128 bits; their texts would be eight times the words
    hits = runs(a, "a").join(runs(b, "b"), ["video", "g", "h"]).where(F.abs(F.col("aat") - F.col("bat")) <= 2 * near)
    best = hits.join(o, "video").groupBy("video").agg(F.min(F.struct(F.abs(F.col("aat") - F.col("_m")), F.col("ai").alias("ai"), F.col("bi").alias("bi"))).alias("x")).select("video", "x.ai", "x.bi")
    # equal words on the diagonal from the start on; the run ends at the first gap
    left = a.where("i is not null").select("video", "i", "word", "at", F.col("k").alias("first_k"), F.col("sentence_end").alias("ea"))
    right = b.where("i is not null").select("video", F.col("i").alias("j"), F.col("word").alias("wb"), F.col("k").alias("second_k"), F.col("sentence_end").alias("eb"))
    diag = left.join(best, "video").where("i >= ai").withColumn("n", F.col("i") - F.col("ai")).withColumn("j", F.col("bi") + F.col("n"))
    diag = diag.join(right, ["video", "j"]).where("word = wb")
    diag = diag.withColumn("_g", F.col("n") - (F.row_number().over(Window.partitionBy("video").orderBy("n")) - 1)).where("_g = 0")
    place = F.struct("n", "first_k", "second_k", "at")
    text = diag.groupBy("video").agg(F.coalesce(F.min(F.when(F.col("ea") & F.col("eb"), place)), F.min(F.when(F.col("ea"), place)), F.max(place)).alias("x"))
    late = lambda d, name: d.where("late").select("video", F.col("k").alias(name))
    got = o.join(text, "video", "left").join(late(a, "_fk"), "video", "left").join(late(b, "_sk"), "video", "left")
    by_text = F.col("x").isNotNull()
    pick = lambda name, other: F.when(by_text, F.col(f"x.{name}")).otherwise(F.col(other))
    return got.select("video", F.when(by_text, "text").otherwise("time").alias("method"), pick("first_k", "_fk").alias("first_k"), pick("second_k", "_sk").alias("second_k"), pick("at", "_half").alias("at"))


def time_parts(videos: DataFrame, most: int = 1800) -> DataFrame:
    """(video, part, start, end, title): equal parts of at most ``most`` seconds titled by their times."""
    v = videos.withColumn("_n", F.greatest(F.ceil(F.col("duration") / most), F.lit(1)).cast("int"))
    v = v.select("video", "duration", "_n", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("p"))
    at = lambda k: F.floor(k * F.col("duration") / F.col("_n") + 0.5).cast("long")
    s, e = at(F.col("p")), at(F.col("p") + 1)
    return v.select("video", F.col("p").cast("long").alias("part"), s.alias("start"), e.alias("end"), F.concat(format_time(s), F.lit(" to "), format_time(e)).alias("title"))


def split_by_parts(paragraphs: DataFrame, parts: DataFrame, videos: DataFrame) -> DataFrame:
    """(video, para, part): the part that holds most of each paragraph's time, the earlier one on a tie.

    A paragraph ends where the next begins (the last at the duration), a second after its
    start at least; the first part reaches back and the last one on without end.
    """
    w = Window.partitionBy("video").orderBy("para")
    end = F.greatest(F.coalesce(F.lead("start").over(w), F.col("duration")), F.col("start") + 1)
    p = paragraphs.join(videos.select("video", "duration"), "video").select("video", "para", F.col("start").alias("s"), end.alias("e"))
    pw = Window.partitionBy("video")
    q = parts.select("video", "part", F.when(F.col("part") == F.min("part").over(pw), F.lit(-(10**12))).otherwise(F.col("start")).alias("lo"), F.when(F.col("part") == F.max("part").over(pw), F.lit(10**12)).otherwise(F.col("end")).alias("hi"))
    share = F.least("e", "hi") - F.greatest("s", "lo")
    return p.join(q, "video").withColumn("share", share).where("share > 0").groupBy("video", "para").agg(F.max_by("part", F.struct("share", -F.col("part"))).alias("part"))


def timed_chapters(paragraphs: DataFrame, parts: DataFrame, videos: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(video, chapter, section, paragraphs): parts of a single long video are chapters, else sections of one chapter; empty parts are gone."""
    got = split_by_parts(paragraphs, parts, videos).groupBy("video", "part").agg(F.count(F.lit(1)).alias("paragraphs")).join(videos, "video")
    nth = F.row_number().over(Window.partitionBy("video").orderBy("part")).cast("long")
    long_ = F.col("duration") > limit
    return got.select("video", F.when(long_, nth).otherwise(1).cast("long").alias("chapter"), F.when(long_, 1).otherwise(nth).cast("long").alias("section"), "paragraphs")


def quote_moment(quotes: DataFrame, paragraphs: DataFrame, window: int = 6) -> DataFrame:
    """(video, quote_id, start): where a quote begins: the first paragraph whose window holds it while the next window does not; else a paragraph with its first six words; else the first time."""
    from quillspan.functions.text import normalize_quote
    from quillspan.operators.concepts import contains_quote

    w = Window.partitionBy("video").orderBy("para")
    p = paragraphs.withColumn("_n", normalize_quote("text"))
    p = p.withColumn("_w", F.array_join(F.collect_list("_n").over(w.rowsBetween(0, window - 1)), " ")).withColumn("_x", F.coalesce(F.lead("_w").over(w), F.lit("")))
    q = quotes.withColumn("_q", normalize_quote("quote")).withColumn("_six", F.regexp_replace(F.array_join(F.slice(F.split(F.trim(F.regexp_extract("_q", r"^(.*?)(?:\.\.\.|…|$)", 1)), " "), 1, 6), " "), r"[^\p{L}\p{N}]+$", ""))
    j = q.join(p, "video")
    full = contains_quote(F.col("_w"), F.col("_q")) & ~contains_quote(F.col("_x"), F.col("_q"))
    words = (F.col("_six") != "") & F.col("_n").contains(F.col("_six"))
    pick = lambda cond: F.min_by("start", F.when(cond, F.col("para")))
    return j.groupBy("video", "quote_id").agg(F.coalesce(pick(full), pick(words), F.min_by("start", "para")).alias("start"))


def estimates(videos: DataFrame, price_in: float, price_out: float) -> DataFrame:
    """(video, cost, max_tokens): 100 tokens in a second and 550 out a minute; 1000 and 700 a minute at most, 65536 in all."""
    d = F.col("duration")
    return videos.select("video", F.round(d * 100 * price_in + d / 60 * 550 * price_out, 6).alias("cost"), F.least(F.lit(65536), 1000 + F.ceil(d / 60) * 700).cast("long").alias("max_tokens"))


def selection_title(selected: DataFrame, totals: DataFrame, titles: DataFrame, key: str, number: str, name: str) -> DataFrame:
    """Title of a selection: the whole's title if all is selected, up to three names, else ranges of numbers."""
    from quillspan.operators.reports import format_ranges

    per = selected.groupBy(key).agg(F.countDistinct(number).alias("_n"), F.sort_array(F.collect_set(F.struct(number, name))).alias("_s"))
    got = per.join(totals, key).join(titles, key).join(format_ranges(selected, [key], number), key)
    names = F.array_join(F.transform("_s", lambda x: x[name]), ", ")
    return got.select(key, F.when(F.col("_n") == F.col("total"), F.col("title")).when(F.col("_n") <= 3, F.concat("title", F.lit(": "), names)).otherwise(F.concat("title", F.lit(": "), F.col("ranges"))).alias("title"))
