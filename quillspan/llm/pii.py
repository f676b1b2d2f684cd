"""Personal data: patterns propose spans, checksums confirm them, context adjusts the score (operator 3).

DataFrame operations only. Spark's functions give the matches of a pattern but not where
they lie; here the text is also split by the same pattern, and the running lengths of gaps
and matches are the positions, in code points. The lengths are summed by blocks first, and
words before a span are taken from the gaps and matches around it, so that the work grows
with the text and with its matches, not with their product.

The patterns are written with possessive groups and a look-behind, so that a text of one
endless word, digit run or dotted sequence is scanned once and without recursion. Each
gives the same matches as the plain pattern beside it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    gate: str  # cheap test that a text can hold a match
    base: bool  # always kept once its validator agrees
    score: float
    context: str  # words before a span that raise its score


#: Kinds in the order in which ties are listed. The first four are the base kinds:
#: email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+; ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+);
#: card [0-9]([\x20-]?[0-9])+; phone \+[0-9][\x20().0-9-]+[0-9].
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@[A-Za-z0-9-]", True, 0.9, "mail|contact|write to"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"\.[0-9]++\.[0-9]", True, 0.6, "address|host|server"),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", r"[0-9](?:[ -]?[0-9]){11}", True, 0.8, "card|credit|visa|payment"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", True, 0.7, "phone|call|tel|mobile|fax"),
    Kind("iban", r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Z0-9])", r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11}", False, 0.9, "iban|account|bank|transfer"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", False, 0.3, "ssn|social security|taxpayer"),
)
CONTEXT_CHARS = 40
#: Matches whose lengths are summed at a time.
BLOCK = 64
CONTEXT_WEIGHT = 0.3
THRESHOLD = 0.5


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number passes the mod-97 check: first four characters last, letters as 10 to 35."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substring(iban, 1, 4))

    def step(acc: Column, i: Column) -> Column:
        c = F.substring(turned, i, F.lit(1))
        letter = F.ascii(c) - 55
        return F.when(c.rlike("[0-9]"), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + letter) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(found, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(F.when(F.length(p) <= 3, p).cast("int"), F.lit(999)) <= 255))
    if kind == "card":
        d = _digits(found)
        return F.length(d).between(12, 19) & luhn(F.when(F.length(d) <= 19, d).otherwise("1"))
    if kind == "phone":
        return F.length(_digits(found)).between(9, 15)
    if kind == "iban":
        return mod97(found)
    return F.lit(True)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def spans_of(text: Column, kind: Kind, rank: int) -> Column:
    """array<struct<start, rank, end, kind, found, score, base>> of the confirmed spans of one kind, by start; end is exclusive."""
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    gaps = F.split(text, kind.pattern, -1)
    # one piece per match, with the gap before it; the last piece has no match
    size = lambda x: F.coalesce(F.length(x), F.lit(0))
    tail = lambda x: F.coalesce(F.right(x, F.lit(CONTEXT_CHARS)), F.lit(""))
    pieces = F.transform(F.arrays_zip(matches.alias("m"), gaps.alias("g")), lambda p: F.struct(p["m"].alias("found"), size(p["g"]).alias("gap"), (size(p["g"]) + size(p["m"])).alias("size"), tail(p["g"]).alias("before"), F.concat(tail(p["g"]), tail(p["m"])).alias("tail")))
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x["size"])
    back = CONTEXT_CHARS // 2  # a match and the gap before it have two characters at least

    def spans(p: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")), lambda b: total(F.slice(p, b * BLOCK + 1, F.lit(BLOCK))))
        ends = lambda sums: F.transform(sums, lambda _, b: F.aggregate(F.slice(sums, F.lit(1), b), F.lit(0), lambda a, x: a + x))
        found = F.filter(F.transform(p, lambda x, i: F.struct(x["found"].alias("found"), i.alias("i"))), lambda v: v["found"].isNotNull() & _valid(kind.name, v["found"]))

        def placed(begins: Column) -> Column:
            def scored(v: Column) -> Column:
                i, block = v["i"], F.floor(v["i"] / BLOCK).cast("int")
                start = F.get(begins, block) + total(F.slice(p, block * BLOCK + 1, i % BLOCK)) + F.get(p, i)["gap"]
                first = F.greatest(i - back, F.lit(0))
                held = F.concat(F.array_join(F.transform(F.slice(p, first + 1, i - first), lambda x: x["tail"]), ""), F.get(p, i)["before"])
                before = F.lower(F.right(held, F.lit(CONTEXT_CHARS)))
                score = F.least(F.lit(kind.score) + F.when(before.rlike(kind.context), CONTEXT_WEIGHT).otherwise(0.0), F.lit(1.0))
                return _let(start, lambda s: F.struct(s.alias("start"), F.lit(rank).alias("rank"), (s + F.length(v["found"])).alias("end"), F.lit(kind.name).alias("kind"), v["found"].alias("found"), score.alias("score"), F.lit(kind.base).alias("base")))

            return F.transform(found, scored)

        return _let(_let(sums, ends), placed)

    every = _let(pieces, spans)
    if not kind.base:
        every = F.filter(every, lambda s: s["score"] >= THRESHOLD)
    none = F.expr("cast(array() as array<struct<start: int, rank: int, end: int, kind: string, found: string, score: double, base: boolean>>)")
    return F.when(text.rlike(kind.gate), every).otherwise(none)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """(id, spans): the confirmed spans of every whole text, by start, then by the kinds' order.

    A null text counts as empty and has no spans; a null id stays null; repeated rows each
    give a row; an empty table gives none; other columns are neither read nor returned.
    Spans of different kinds may overlap; those of one kind never do. No shuffle.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    for rank, kind in enumerate(kinds):
        rows = rows.withColumn(f"_s{rank}", spans_of(F.col("_t"), kind, rank))
    return rows.select(F.col("_id").alias(id_col), F.array_sort(F.concat(*[F.col(f"_s{r}") for r in range(len(kinds))])).alias("spans"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the hash of the base spans and the list of all spans as text."""
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        id_col,
        *[count(k.name) for k in KINDS[:4]],
        F.sha2(line(F.filter("spans", lambda s: s["base"])).cast("binary"), 256).alias("base_sha256"),
        line(F.col("spans")).alias("spans"),
        F.round(F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)), 6).alias("top_score"),
    )
