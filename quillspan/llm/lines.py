"""Near-duplicate line removal by a deletion-neighbourhood join (operator 8).

A line goes if an earlier line (by document id, then position) is equal, or if both have
``MIN_WORDS`` words or more and are one word away: one word changed, put in or left out.
Lines are compared in lower case and with white space collapsed; blank lines stay.

Every line that can have such a neighbour emits its variants with one word deleted as
hashed keys: equal variants with the same place deleted differ in that word at most, and
a variant that equals a whole line is one deletion away from it. Each key's earliest
line is taken with map-side combining and handed back to the key's lines; so a key that
many lines share costs no pairs. The claim is then verified on the words themselves.

Which lines can have a neighbour is known from halves: with one edit, the first or the
last half of the words is unchanged. Lines that share no half emit nothing, and the others
only the deletions in the half that may differ. This loses no neighbour.

DataFrame operations only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import join_split, scratch, stage

MIN_WORDS = 5
#: A table of up to so many narrow rows (under 100 bytes each in memory) is sent to every executor; a larger one is joined by a shuffle.
BROADCAST_ROWS = 1 << 18
LINE = ("h1", "h2")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sent(df: DataFrame) -> DataFrame:
    """A staged table, marked for broadcast where it is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, row, norm, h1, h2) of every line that is not blank; ``row`` is a hash of its text, (h1, h2) the line's 128-bit hash."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).where("id is not null and t is not null")
    rows = rows.select("id", F.xxhash64("t").alias("row"), F.posexplode(F.split(F.lower("t"), "\n", -1)).alias("pos", "raw")).where(F.col("raw").rlike(r"[^\t\x0B\f\r ]"))
    plain = F.when(F.col("raw").rlike(r"[\t\x0B\f\r]| {2}"), F.regexp_replace("raw", r"[\t\x0B\f\r ]+", " ")).otherwise(F.col("raw"))
    rows = rows.select("id", "pos", "row", F.trim(plain).alias("norm"))
    return rows.select("*", F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit(7), "norm").alias("h2"))


def _words(norm: str = "norm") -> Column:
    return (F.octet_length(norm) - F.octet_length(F.replace(F.col(norm), F.lit(" "))) + 1).cast("int")


def _place() -> Column:
    """Lines in order, as one number: id, then position, then a part of the text's hash. Its fixed width lets Spark aggregate by hash."""
    return F.expr("cast(cast(id as decimal(20, 0)) * 10000000000000000000BD + cast(cast(pos as bigint) * 1000000000 + pmod(row, 1000000000) as decimal(20, 0)) as decimal(38, 0))")


def _part(count: Column) -> Column:
    """The first ``count`` words, or the last ones if it is negative."""
    return F.call_function("substring_index", F.col("norm"), F.lit(" "), count.cast("int"))


def _half_keys(min_words: int) -> Column:
    """Keys of the unchanged halves, null for shorter lines: first and last half as a line of ``n`` words, then as the shorter one beside ``n + 1`` words."""
    n, cut, over = F.col("n"), F.floor(F.col("n") / 2), F.floor((F.col("n") + 1) / 2)
    keys = [
        F.xxhash64(F.lit("p"), n, _part(cut)),
        F.xxhash64(F.lit("s"), n, _part(cut - n)),
        F.xxhash64(F.lit("p"), n + 1, _part(over)),
        F.xxhash64(F.lit("s"), n + 1, _part(over - n - 1)),
    ]
    return F.when(n >= min_words, F.array(*keys))


def _candidates(known: DataFrame) -> DataFrame:
    """(h1, h2) of the lines that share a half with another line, and in which half an edit may lie."""
    halves = known.select(*LINE, F.posexplode("halves").alias("role", "half"))
    longer = F.col("role") < 2
    shared = halves.groupBy("half").agg(F.min(F.when(longer, F.col("h1"))).alias("lo"), F.max(F.when(longer, F.col("h1"))).alias("hi"), F.max((~longer).cast("int")).alias("short_"))
    shared = shared.select("half", (F.col("lo") < F.col("hi")).alias("swaps"), ((F.col("short_") == 1) & F.col("lo").isNotNull()).alias("drops")).where("swaps or drops")
    shared = stage(shared, "shared-halves")
    found = halves.join(_sent(shared), "half")
    longer, first = F.col("role") < 2, F.col("role") % 2 == 0
    flags = {
        "swap_end": longer & first & F.col("swaps"),
        "swap_start": longer & ~first & F.col("swaps"),
        "drop_end": longer & first & F.col("drops"),
        "drop_start": longer & ~first & F.col("drops"),
        "whole": ~longer & F.col("drops"),
    }
    either = [F.max(F.coalesce(c, F.lit(False))).alias(k) for k, c in flags.items()]
    return stage(found.groupBy(*LINE).agg(*either).where(" or ".join(flags)), "candidates")


def _variant(i: Column, n: Column) -> Column:
    """The words without the one at ``i`` (from 0)."""
    before, after = _part(i), _part(i + 1 - n)
    return F.when(i == 0, after).when(i == n - 1, before).otherwise(F.concat(before, F.lit(" "), after))


def _emitted(texts: DataFrame) -> DataFrame:
    """(h1, h2, first, key, role) of every variant; roles: 0 one word changed, 1 one word left out, 2 a whole line as it is."""
    n = F.col("n")
    cut = F.floor(n / 2).cast("int")
    none = F.expr("cast(array() as array<int>)")
    starts = lambda flag: F.when(F.col(flag), F.sequence(F.lit(0), cut - 1)).otherwise(none)
    ends = lambda flag: F.when(F.col(flag), F.sequence(cut, n - 1)).otherwise(none)
    # a place i of a variant as i, of a variant compared with whole lines as -1 - i; a whole line as null
    places = F.concat(starts("swap_start"), ends("swap_end"), F.transform(F.concat(starts("drop_start"), ends("drop_end")), lambda i: -1 - i), F.when(F.col("whole"), F.expr("array(cast(null as int))")).otherwise(none))
    rows = texts.select(*LINE, "first", "n", "norm", F.explode(places).alias("at"))
    i = F.when(F.col("at") < 0, -1 - F.col("at")).otherwise(F.col("at"))
    role = F.when(F.col("at").isNull(), 2).when(F.col("at") < 0, 1).otherwise(0)
    key = F.when(F.col("at").isNull(), F.xxhash64("norm", F.lit(-1))).otherwise(F.xxhash64(_variant(i, n), F.greatest(F.col("at"), F.lit(-1))))
    return rows.select(*LINE, "first", key.alias("key"), role.alias("role"))


def _one_apart(a: Column, b: Column) -> Column:
    """Whether two arrays of words are at most one word edit apart: equal parts at both ends cover all but one word."""

    def same(x: Column, y: Column) -> Column:
        at = F.array_position(F.zip_with(x, y, lambda u, v: ~u.eqNullSafe(v)), True)
        return F.when(at == 0, F.greatest(F.size(x), F.size(y))).otherwise(at - 1)

    return same(a, b) + same(F.reverse(a), F.reverse(b)) >= F.greatest(F.size(a), F.size(b)) - 1


def _near(known: DataFrame) -> DataFrame:
    """(h1, h2) of the lines with halves that are one word away from an earlier line."""
    cand = _candidates(known)
    texts = known.select("id", "pos", "row", "norm", "n", *LINE).join(_sent(cand), list(LINE)).withColumn("first", _place())
    flags = [c for c in cand.columns if c not in LINE]
    texts = stage(texts.groupBy(*LINE).agg(F.min("first").alias("first"), *[F.first(c).alias(c) for c in ("n", "norm", *flags)]), "candidate-lines")
    # the earliest line of each key goes back to the key's lines
    keys = _emitted(texts)
    least = keys.groupBy("key").agg(*[F.min(F.when(F.col("role") == k, F.col("first"))).alias(r) for k, r in enumerate(("swap", "drop", "whole"))], F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    least = stage(least.where("swap is not null or (drop is not null and whole is not null)"), "shared-keys")
    partner = F.when(F.col("role") == 0, F.col("swap")).when(F.col("role") == 1, F.col("whole")).otherwise(F.col("drop"))
    claims = keys.join(_sent(least), "key").select(*LINE, "first", partner.alias("earlier")).where("earlier < first").groupBy(*LINE).agg(F.min("earlier").alias("earlier"))
    words = texts.select(*LINE, "first", F.split("norm", " ").alias("words"))
    both = claims.join(words.select(*LINE, F.col("words").alias("own")), list(LINE)).join(words.select(F.col("first").alias("earlier"), F.col("words").alias("other")), "earlier")
    return both.where(_one_apart(F.col("own"), F.col("other"))).select(*LINE)


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, row, gone): for each row with lines that go, the sorted positions of those lines; ``row`` is the hash of its text."""
    known = stage(_lines(docs, id_col, text_col).withColumn("n", _words()).withColumn("halves", _half_keys(min_words)), "every-line")
    placed = known.withColumn("place", _place())
    equal = placed.groupBy(*LINE).agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count(F.lit(1)).alias("times")).where("first < last").select(*LINE, "first", "times", F.lit(False).alias("near"))
    near = _near(known).select(*LINE, F.lit(None).cast("decimal(38, 0)").alias("first"), F.lit(1).cast("long").alias("times"), F.lit(True).alias("near"))
    # a near line goes everywhere, another one after its first place
    marked = equal.unionAll(near).groupBy(*LINE).agg(F.max("first").alias("first"), F.max("times").alias("times"), F.max("near").alias("near"))
    marked = stage(marked, "repeated")
    lines = placed.select("id", "row", "pos", "place", *LINE)
    gone = lines.join(F.broadcast(marked), list(LINE)) if marked.count() <= BROADCAST_ROWS else join_split(lines, marked, list(LINE), "times")
    gone = gone.where("near or place > first")
    return gone.groupBy("id", "row").agg(F.sort_array(F.collect_set("pos")).alias("gone"))


def _without(text: Column, gone: Column) -> Column:
    """The text without the lines at the sorted positions."""
    kept = lambda parts: F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone)
    return _let(F.split(text, "\n", -1), lambda parts: F.array_join(F.transform(kept(parts), lambda i: F.get(parts, i)), "\n"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the lines that go, with the columns ``n_lines`` and ``n_removed`` added (replaced if there).

    Every row stays, all columns are kept; only the text changes. Lines end at a newline and
    are joined by one again; a text that keeps all lines is unchanged. Null texts stay null
    (0 lines). Rows with a null id are neither changed nor compared. Equal rows (same id and
    text) are one document: their lines are no repeats of each other. Of equal first
    positions the one with the smaller part of the text's hash is earlier. Lines under
    ``min_words`` words go only if they repeat an earlier one exactly; blank lines stay. An
    empty table stays empty. Hash collisions of near lines fail the verification and leave
    the line in place.
    """
    with scratch(docs.sparkSession) as keep:
        gone = keep(repeated_lines(docs, id_col, text_col, min_words), "gone-lines")
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    # the columns travel in a struct, so that no name of theirs can meet one of ours
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("row"))
    joined = rows.join(gone, ["id", "row"], "left")
    text = F.col("doc").getField(text_col)
    lines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"))) + 1
    return joined.select(
        *[F.when(F.col("gone").isNull(), text).otherwise(_without(text, F.col("gone"))).alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in names],
        F.when(text.isNull(), 0).otherwise(lines).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
    )


def digest(cleaned: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What is left of every document, as counts and a hash."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return cleaned.select(id_col, "n_lines", "n_removed", F.length(text).cast("long").alias("kept_chars"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))
