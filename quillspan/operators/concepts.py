"""Quotes, concepts and citations. Answers of models enter as ordinary tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.text import normalize_quote, title_key, word_grams
from quillspan.operators.fixpoint import cut
from quillspan.operators.patterns import find_strings
from quillspan.operators.sets import union_ignore
from quillspan.sources.tables import spread


#: A table of up to so many narrow rows may be sent to every executor.
BROADCAST_ROWS = 1 << 18


def contains_quote(text: Column, quote: Column) -> Column:
    """Every non-empty part between ellipses is in the text, both in normal form; an empty quote is not."""
    parts = F.filter(F.transform(F.split(quote, r"\.\.\.|…"), lambda p: F.trim(p)), lambda p: p != "")
    return (F.size(parts) > 0) & F.forall(parts, lambda p: text.contains(p))


def ground_known(pairs: DataFrame, text: str, quote: str) -> DataFrame:
    """Pairs of a section text and a quote with the flag ``found``."""
    normal = pairs.withColumns({"_t": normalize_quote(text), "_q": normalize_quote(F.regexp_replace(quote, "…", "..."))})
    return normal.withColumn("found", contains_quote(F.col("_t"), F.col("_q"))).drop("_t", "_q")


def ground_quotes(quotes: DataFrame, sections: DataFrame, quote_id: str, quote: str, section_id: str, text: str, gram: int = 4) -> DataFrame:
    """(quote_id, section_id) for every section that contains a quote.

    Candidates share the quote's rarest word 4-gram, so the join is an equi join of one row
    per quote with the sections' 4-grams; then the whole quote is looked for. Quotes of fewer
    than ``gram`` + 2 words, whose ends may be parts of words, are looked for in all texts, all in one pass.
    """
    q = cut(quotes.select(quote_id, normalize_quote(quote).alias("q")).where("q <> ''"), "quotes")
    s = cut(spread(sections.select(section_id, text)).select(section_id, normalize_quote(text).alias("t")), "sections")
    few = q.count() <= BROADCAST_ROWS
    sent = F.broadcast if few else lambda df: df
    grams = lambda c: word_grams(F.split(c, " "), gram)
    # the words at the ends of a quote may be parts of words in the text
    inner = F.array_join(F.slice(F.split("q", " "), F.lit(2), F.greatest(F.size(F.split("q", " ")) - 2, F.lit(0))), " ")
    long_ = q.where(F.size(F.split("q", " ")) >= gram + 2).select(quote_id, "q", F.explode(grams(inner)).alias("g"))
    wanted = cut(long_.select("g").distinct(), "grams")
    every = s.select(section_id, F.explode(grams(F.col("t"))).alias("g"))
    hits = cut(every.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, "g", "left_semi"), "gram-hits")
    freq = hits.groupBy("g").agg(F.count(F.lit(1)).alias("f"))
    rare = long_.join(freq, "g", "left").groupBy(quote_id).agg(F.min(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "g")).alias("best"))
    cand = rare.where("best.f > 0").select(quote_id, F.col("best.g").alias("g")).join(hits, "g").select(quote_id, section_id).distinct()
    found = cand.join(sent(q), quote_id).join(s, section_id).where(F.col("t").contains(F.col("q"))).select(quote_id, section_id)
    short = q.where(F.size(F.split("q", " ")) < gram + 2)
    if short.isEmpty():
        return found
    held = find_strings(s, section_id, "t", short, "q")
    return found.unionAll(short.join(held.withColumnRenamed("string", "q"), "q").select(quote_id, section_id))


def consolidate(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Concepts of a chapter by normal name, first fields win; and their sources, one quote per section."""
    f = found.withColumn("key", normalize_quote("name"))
    rest = [c for c in found.columns if c not in ("chapter", "pos", "section_id", "quote")]
    concepts = f.groupBy("chapter", "key").agg(F.min_by(F.struct(*rest), "pos").alias("first"), F.min("pos").alias("pos")).select("chapter", "key", "pos", "first.*")
    sources = f.groupBy("chapter", "key", "section_id").agg(F.min_by("quote", "pos").alias("quote"))
    return concepts, sources


def section_coverage(sections: DataFrame, empty: DataFrame, sources: DataFrame) -> DataFrame:
    """Sections without a concept: empty (with the given reason) or missing."""
    bare = sections.join(sources, "section_id", "left_anti").join(empty, "section_id", "left")
    return bare.select("section_id", F.when(F.col("reason").isNull(), "missing").otherwise("empty").alias("state"), "reason")


def merge_exact(concepts: DataFrame, found: DataFrame) -> DataFrame:
    """Found concepts joined to the map by normal name: ``join`` with the concept's id, else ``pending``."""
    known = concepts.groupBy(normalize_quote("name").alias("key")).agg(F.min("id").alias("id"))
    got = found.withColumn("key", normalize_quote("name")).join(known, "key", "left")
    return got.withColumn("action", F.when(F.col("id").isNotNull(), "join").otherwise("pending"))


def apply_decisions(decisions: DataFrame) -> DataFrame:
    """Resolve add/join decisions (id, pos, action, join_with): the final target of each new concept.

    A join target is a concept of the map (no decision has its id) or an *earlier* new one,
    followed to its own target; a later or unknown new one makes the concept an addition.
    Pointer jumping doubles the followed distance per round.
    """
    d = decisions.select("id", "pos", "action", "join_with")
    other = d.select(F.col("id").alias("join_with"), F.col("pos").alias("other_pos"))
    to = F.when((F.col("action") == "join") & F.col("join_with").isNotNull() & (F.col("other_pos").isNull() | (F.col("other_pos") < F.col("pos"))), F.col("join_with")).otherwise(F.col("id"))
    links = cut(d.join(other, "join_with", "left").select("id", to.alias("target")), "targets")
    while True:
        nxt = links.select(F.col("id").alias("target"), F.col("target").alias("further"))
        jumped = cut(links.join(nxt, "target", "left").select("id", F.coalesce("further", "target").alias("new"), "target"), "targets")
        moved = not jumped.where("new <> target").isEmpty()
        links = jumped.select("id", F.col("new").alias("target"))
        if not moved:
            return links


def prerequisite_edges(wanted: DataFrame, existing: DataFrame, known: DataFrame, n: int = 3) -> DataFrame:
    """New edges (concept, needs) from wanted ones (concept, needs, pos).

    The first ``n`` references of a concept count. Each is looked up in ``known``
    (reference, slug); one that is not there goes, without another in its place. Then
    concepts come in their order, each with its references in theirs: no self edge, no
    duplicate, no reverse of an existing or earlier edge.
    """
    first = wanted.withColumn("_r", F.row_number().over(Window.partitionBy("concept").orderBy("pos"))).where(F.col("_r") <= n)
    found = first.join(known.select(F.col("reference").alias("needs"), F.col("slug").alias("_slug")), "needs").select("concept", F.col("_slug").alias("needs"), "pos").where("concept <> needs")
    pair = Window.partitionBy(F.least("concept", "needs"), F.greatest("concept", "needs")).orderBy("concept", "pos")
    one = found.withColumn("_r", F.row_number().over(pair)).where("_r = 1").drop("_r")
    both = existing.select("concept", "needs").unionAll(existing.select(F.col("needs").alias("concept"), F.col("concept").alias("needs")))
    return one.join(both, ["concept", "needs"], "left_anti").select("concept", "needs")


def unique_slugs(df: DataFrame, base: str, order: str, taken: DataFrame) -> DataFrame:
    """base, base-2, base-3 ... in order, skipping slugs that are taken; rounds until nothing collides."""
    todo = df.withColumn("slug", F.lit(None).cast("string"))
    used = taken.select("slug").distinct()
    start = df.select(base).distinct().withColumn("next", F.lit(1).cast("long"))
    done = None
    while True:
        # candidate numbers per base, beginning after what is used up
        w = Window.partitionBy(base).orderBy(order)
        tried = todo.drop("slug").join(start, base).withColumn("_n", F.col("next") + F.row_number().over(w) - 1)
        tried = tried.withColumn("slug", F.when(F.col("_n") == 1, F.col(base)).otherwise(F.concat_ws("-", F.col(base), F.col("_n").cast("string"))))
        # a slug may also be the first choice of another base; the earlier row takes it
        mine = Window.partitionBy("slug").orderBy(order)
        tried = cut(tried.join(used.withColumn("_t", F.lit(True)), "slug", "left").withColumn("_r", F.row_number().over(mine)), "slugs")
        first_bad = tried.where("_t or _r > 1").groupBy(base).agg(F.min("_n").alias("bad"))
        split = cut(tried.join(first_bad, base, "left"), "slugs")
        good = split.where("bad is null or _n < bad").select(*df.columns, "slug")
        done = good if done is None else done.unionAll(good)
        left = split.where("_n >= bad")
        if left.isEmpty():
            return done
        start = left.groupBy(base).agg((F.min("bad") + 1).alias("next"))
        used = cut(used.unionAll(good.select("slug")).distinct(), "used")
        todo = left.select(*df.columns).withColumn("slug", F.lit(None).cast("string"))


def concept_map(concepts: DataFrame, prereqs: DataFrame, sources: DataFrame, sections: DataFrame) -> DataFrame:
    """Concepts with nested prerequisites[] and sources[] in book order."""
    pre = prereqs.groupBy("concept_id").agg(F.sort_array(F.collect_list("prereq_id")).alias("prerequisites"))
    src = sources.join(sections, "section_id").groupBy("concept_id").agg(F.sort_array(F.collect_list(F.struct("book_id", "chapter", "number", "section_id"))).alias("sources"))
    out = concepts.withColumnRenamed("id", "concept_id").join(pre, "concept_id", "left").join(src, "concept_id", "left")
    return out.withColumns({"prerequisites": F.coalesce("prerequisites", F.expr("cast(array() as array<bigint>)")), "n_sources": F.coalesce(F.size("sources"), F.lit(0)).cast("long")})


def map_preview(concepts: DataFrame, prereqs: DataFrame, sources: DataFrame, keys: DataFrame) -> DataFrame:
    """Concepts with a source in the given sections, with the names they need."""
    own = concepts.join(sources.join(keys, "section_id", "left_semi").select(F.col("concept_id").alias("id")), "id", "left_semi")
    names = concepts.select(F.col("id").alias("prereq_id"), F.col("name").alias("need"))
    needs = prereqs.join(names, "prereq_id").groupBy(F.col("concept_id").alias("id")).agg(F.sort_array(F.collect_list("need")).alias("needs"))
    return own.join(needs, "id", "left").select("id", "name", F.coalesce(F.array_join("needs", ", "), F.lit("")).alias("needs"))


def map_markdown(concepts: DataFrame) -> DataFrame:
    """The map of each subject as Markdown lines: a heading per module, a line per concept."""
    line = F.format_string("- %s (%s): %s", "name", "level", "objective")
    rows = concepts.groupBy("subject_id", "module").agg(F.sort_array(F.collect_list(F.struct("id", line.alias("line")))).alias("c"))
    text = F.concat(F.lit("## "), F.col("module"), F.lit("\n"), F.array_join(F.transform("c", lambda x: x["line"]), "\n"))
    per = rows.select("subject_id", "module", text.alias("text")).groupBy("subject_id").agg(F.sort_array(F.collect_list(F.struct("module", "text"))).alias("m"))
    return per.select("subject_id", F.array_join(F.transform("m", lambda x: x["text"]), "\n\n").alias("markdown"))


def same_books(books: DataFrame, title: str = "title") -> DataFrame:
    """Groups of books whose titles have one key."""
    return books.groupBy(title_key(title).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min(title).alias("title"))


def number_references(refs: DataFrame, keys: Sequence[str] = ("answer",)) -> DataFrame:
    """Numbers by first use: equal (source, normal quote) share one."""
    keys = list(keys)
    r = refs.withColumn("_q", normalize_quote("quote"))
    first = r.groupBy(*keys, "source_id", "_q").agg(F.min("pos").alias("_first"))
    w = Window.partitionBy(*keys).orderBy("_first")
    return r.join(first, [*keys, "source_id", "_q"]).withColumn("number", F.dense_rank().over(w).cast("long")).drop("_q", "_first")


def check_references(answers: DataFrame, refs: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answers with markers renumbered or dropped, and the references that are kept.

    A reference stays if its source contains its quote; kept ones are renumbered by their
    old number. Markers " [n]" outside code are rewritten, those of dropped references go
    with the space before them, repeats side by side collapse.
    """
    r = refs.join(sources, "source_id", "left").withColumn("_ok", F.coalesce(contains_quote(normalize_quote("source_text"), normalize_quote("quote")), F.lit(False)))
    w = Window.partitionBy("answer").orderBy("number")
    kept = r.where("_ok").withColumn("new", F.row_number().over(w).cast("long")).drop("_ok", "source_text")
    table = kept.groupBy("answer").agg(F.map_from_entries(F.collect_list(F.struct(F.col("number").cast("string"), F.col("new").cast("string")))).alias("_to"))
    a = answers.join(table, "answer", "left").withColumn("_to", F.coalesce("_to", F.expr("map()").cast("map<string,string>")))
    code = r"```[\s\S]*?```|`[^`\n]*`"
    prose, fenced = F.split("text", code, -1), F.regexp_extract_all("text", F.lit(code), F.lit(0))
    marker = r"\s?\[[0-9]+\]"

    def rewrite(p: Column) -> Column:
        plain, marks = F.split(p, marker, -1), F.regexp_extract_all(p, F.lit(marker), F.lit(0))
        new = F.transform(marks, lambda m: F.coalesce(F.concat(F.regexp_extract(m, r"^(\s?)", 1), F.lit("["), F.try_element_at(F.col("_to"), F.regexp_extract(m, "([0-9]+)", 1)), F.lit("]")), F.lit("")))
        text = F.array_join(F.transform(F.arrays_zip(plain.alias("p"), new.alias("m")), lambda x: F.concat(x["p"], F.coalesce(x["m"], F.lit("")))), "")
        return F.regexp_replace(text, r"(\s?\[([0-9]+)\])(?:\s?\[\2\])+", "$1")

    text = F.array_join(F.transform(F.arrays_zip(prose.alias("p"), fenced.alias("c")), lambda x: F.concat(rewrite(x["p"]), F.coalesce(x["c"], F.lit("")))), "")
    return a.withColumn("text", text).drop("_to"), kept


def pick_better(first: DataFrame, second: DataFrame) -> DataFrame:
    """Per section the second extraction only if it has fewer bad quotes than the first; a missing one has infinitely many."""
    a, b = first.select("section_id", F.col("bad").alias("a")), second.select("section_id", F.col("bad").alias("b"))
    both = a.join(b, "section_id", "full_outer")
    return both.select("section_id", F.when(F.col("b").isNotNull() & (F.col("a").isNull() | (F.col("b") < F.col("a"))), "second").otherwise("first").alias("pick"))


def usable_questions(df: DataFrame, most: int = 5) -> DataFrame:
    """Questions with a text and, if they have options, two distinct ones and an answer in range; the first five of a set, and only sets with an open question."""
    n = F.size("choices")
    ok = (F.trim("text") != "") & ((n == 0) | ((F.size(F.array_distinct("choices")) >= 2) & (F.col("answer") >= 0) & (F.col("answer") < n)))
    w = Window.partitionBy("set_id").orderBy("pos")
    first = df.where(ok).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")
    open_ = first.groupBy("set_id").agg(F.bool_or(F.size("choices") == 0).alias("_o")).where("_o").select("set_id")
    return first.join(open_, "set_id", "left_semi")


def merge_sources(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or ignore: sources of the map first, then new (concept, section) pairs."""
    return union_ignore(existing, new, ["concept_id", "section_id"])
