"""SimHash near-duplicates, widened to word-shingle Jaccard similarity (operator 9 in the pipeline).

Documents whose fingerprints differ in ``RADIUS`` bits or less are linked, all of them, by
the balls of ``simhash``. Documents at a similarity of 0.8 differ in ten bits on the
average, so the other links are found by the prefixes of their shingle sets: two sets that
reach the similarity share a shingle there, all that share one are compared on the whole sets
unless they are in one group already, and so no link between groups is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.common import BROADCAST_ROWS, join_split, scratch, ship, stage
from quillspan.llm.components import components
from quillspan.llm.simhash import fingerprint, fingerprint_links, shingle_hashes
from quillspan.operators.prefixes import first_ones, needed, sent, shared_prefixes

SIMILARITY = 0.8


def shingle_set(text: bytes, shingle: int):
    """Sorted different 64-bit hashes of the word shingles; a shorter text is one shingle, one without a word has none."""
    import numpy as np

    return np.unique(shingle_hashes(text.lower().split(), shingle))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("id"), text.alias("t"), F.xxhash64(text).alias("h"))


def _keyed(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(id, h, cls, fp, n, prefix): the text's hash, the class of its shingle set, its fingerprint, the set's size and prefix."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        take = first_ones(similarity, [])
        for batch in batches:
            cls, fps, sets, n = [], [], [], []
            for t in batch.column(1).to_pylist():
                h = shingle_hashes(t.lower().split(), shingle)
                fps.append(fingerprint(h))
                h = np.unique(h)
                cls.append(xxhash.xxh64_intdigest(h.tobytes(), 7))
                sets.append(take(np.sort(h.view(np.int64)), np.array([0, len(h)]))[0])
                n.append(len(h))
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.array(cls, np.uint64).view(np.int64)), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["id", "h", "cls", "fp", "n", "prefix"])

    ship(docs.sparkSession)
    return docs.mapInArrow(run, "id long, h long, cls long, fp long, n long, prefix array<long>")


def _prefixes(texts: DataFrame, shingle: int, similarity: float, frequent: list[int]) -> DataFrame:
    """(cls, n, prefix) of texts (cls, t), with the frequent shingles last."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        take = first_ones(similarity, frequent)
        for batch in batches:
            sets = [np.sort(shingle_set(t, shingle).view(np.int64)) for t in batch.column(1).to_pylist()]
            prefix = [take(x, np.array([0, len(x)]))[0] for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(prefix, pa.list_(pa.int64()))], names=["cls", "n", "prefix"])

    ship(texts.sparkSession)
    return texts.mapInArrow(run, "cls long, n long, prefix array<long>")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(cls, hashes) of texts."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sets = [shingle_set(t, shingle).view("int64") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["cls", "hashes"])

    ship(docs.sparkSession)
    return docs.mapInArrow(run, "cls long, hashes array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""
    one = sets.select(F.col("cls").alias("a"), F.col("hashes").alias("x"))
    other = sets.select(F.col("cls").alias("b"), F.col("hashes").alias("y"))
    both = pairs.join(other, "b").join(one, "a").where(F.least(F.size("x"), F.size("y")) >= F.greatest(F.size("x"), F.size("y")) * similarity - 1e-9)
    common = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("c"), (F.size("x") + F.size("y")).alias("n"))
    return common.where(F.col("c") / (F.col("n") - F.col("c")) >= similarity - 1e-12).select("a", "b")


def _ball_pairs(classes: DataFrame) -> DataFrame:
    """(a, b): classes with equal fingerprints, by the smallest one, and representatives of fingerprints within the radius."""
    reps = stage(classes.groupBy("fp").agg(F.min("cls").alias("rep")), "fingerprint-classes")
    same = classes.join(reps, "fp").where("cls <> rep").select(F.col("rep").alias("a"), F.col("cls").alias("b"))
    near = fingerprint_links(reps).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return same.unionAll(near)


def _linked(shared: DataFrame, links: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """(node, component) over ``links`` and all similar pairs of classes that share a shingle in ``shared`` (cls, n, shingle).

    In each round the next of a shingle's classes, eight times as many as in the one before,
    meet the later ones there that are not in their component yet; shingles whose classes are
    all in one component, or have all met, are done. Of those that meet, only pairs whose prefixes share as many
    shingles as similar sets must are compared on the whole sets. So a family of near copies costs few pairs a member, and
    two classes stay apart only after they have been compared.
    """
    final = components(links)
    held = stage(shared.groupBy("cls").agg(F.first("n").alias("n"), F.collect_list("shingle").alias("s")), "held")
    x, y = held.alias("x"), held.alias("y")
    enough = F.size(F.array_intersect("x.s", "y.s")) >= needed(F.col("x.n"), F.col("y.n"), similarity)
    left, before, most = shared, 0, 1
    while True:
        named = left.select("cls", "n", "shingle").join(sent(final), left["cls"] == final["node"], "left").select("cls", "n", "shingle", F.coalesce("component", "cls").alias("c"))
        kinds = named.groupBy("shingle").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("f"))
        mixed = kinds.where("lo < hi").where(F.col("f") > before + 1).select("shingle")
        left = stage(named.join(mixed, "shingle"), "undecided")
        rank = F.row_number().over(Window.partitionBy("shingle").orderBy("cls"))
        leaders = stage(left.withColumn("_r", rank).where(F.col("_r") <= most).where(F.col("_r") > before).drop("_r"), "leaders")
        few = leaders.count()
        if not few:
            return final
        a, b = leaders.alias("a"), left.alias("b")
        sizes = F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * similarity - 1e-9
        near = (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.cls") < F.col("b.cls")) & (F.col("a.c") != F.col("b.c")) & sizes
        met = b.join(F.broadcast(a) if few <= BROADCAST_ROWS else a, near).select(F.col("a.cls").alias("a"), F.col("b.cls").alias("b")).distinct()
        met = met.join(x, F.col("a") == F.col("x.cls")).join(y, F.col("b") == F.col("y.cls")).where(enough).select("a", "b")
        met = stage(met, "met")
        if not met.isEmpty():
            with scratch(met.sparkSession) as keep:
                found = keep(_verified(met, sets_of(met.select(F.explode(F.array("a", "b")).alias("cls")).distinct()), similarity), "found")
            if not found.isEmpty():
                links = stage(links.unionAll(found), "links-so-far")
                final = stage(components(links), "components")
        before, most = most, most * 8


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """(id, h, comp) per row: the text's hash, and one number for all documents of a group."""
    rows = _texts(docs, id_col, text_col)
    each = stage(_keyed(rows, shingle, similarity), "keyed")
    classes = stage(each.groupBy("cls").agg(F.min(F.struct("id", "h")).alias("of"), F.min("fp").alias("fp"), F.count(F.lit(1)).alias("times")), "shingle-classes")
    # one row of each class; classes of one document stay where they are
    several = stage(classes.where("times > 1").select(F.col("cls").alias("_cls"), "of"), "copied-classes")
    own = each.join(sent(several), F.col("cls") == F.col("_cls"), "left").where("_cls is null or (id <=> of.id and h = of.h)")
    first = own.select("cls", "n", "prefix")

    def texts_of(wanted: DataFrame) -> DataFrame:
        of = stage(wanted.join(classes, "cls").select(F.col("of.id").alias("_id"), F.col("of.h").alias("_h"), "cls"), "wanted")
        return rows.join(F.broadcast(of) if of.count() <= BROADCAST_ROWS else of, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))).select("cls", "t")

    def sets_of(wanted: DataFrame) -> DataFrame:
        return stage(_sets(texts_of(wanted), shingle).groupBy("cls").agg(F.first("hashes").alias("hashes")), "sets")

    again = lambda touched, frequent: _prefixes(texts_of(touched), shingle, similarity, frequent)
    shared = shared_prefixes(first, again, stage, "cls")
    final = _linked(shared, stage(_ball_pairs(classes.select("cls", "fp")), "ball-pairs"), sets_of, similarity)
    ids = stage(each.select("id", "h", "cls"), "ids")
    return ids.join(final, ids["cls"] == final["node"], "left").select("id", "h", F.coalesce("component", "cls").alias("comp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: id, component_id.

    Documents link if their SimHash fingerprints differ in four bits or less, and at a
    Jaccard similarity of their shingle sets of ``similarity`` or more; component_id is the smallest id reachable over links, the document itself included.
    Words are split at ASCII white space and compared with A-Z in lower case. Null texts
    count as empty, and texts without a word are copies of each other. Repeated rows each
    give a row; a null id never names a component. An empty table gives an empty result.
    """
    with scratch(docs.sparkSession) as keep:
        whole = keep(_grouped(docs, id_col, text_col, shingle, similarity), "groups")
    least = stage(whole.groupBy("comp").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("times")), "least-ids")
    return join_split(whole, least, ["comp"], "times").select(F.col("id").alias(id_col), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each group of :func:`near_duplicates`: the one with the smallest id, of rows that share it the one with the smaller text hash.

    Rows with a null id stay only where their group has no other. A document is a row's id
    and text: of another text under a repeated id nothing goes, and of rows equal in both one
    stays.
    """
    with scratch(docs.sparkSession) as keep:
        whole = keep(_grouped(docs, id_col, text_col, shingle, similarity), "groups")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "h")
    stays = stage(whole.groupBy("comp").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times")), "first-rows")
    gone = join_split(whole, stays, ["comp"], "times").where(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("h") == F.col("first.h")))).select("id", "h").distinct()
    gone = stage(gone.select(F.col("id").alias("gone_id"), F.col("h").alias("gone_h")), "copies")
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("h"))
    small = gone.count() <= BROADCAST_ROWS
    left = rows.join(F.broadcast(gone) if small else gone, rows["id"].eqNullSafe(gone["gone_id"]) & (rows["h"] == gone["gone_h"]), "left_anti")
    repeated = stage(whole.groupBy("id", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias("again_id"), F.col("h").alias("again_h")), "repeated-rows")
    if not repeated.isEmpty():
        match = left["id"].eqNullSafe(repeated["again_id"]) & (left["h"] == repeated["again_h"])
        left = left.join(repeated, match, "left_anti").unionByName(left.join(repeated, match, "left_semi").dropDuplicates(["id", "h"]))
    return left.select(*[F.col("row").getField(c).alias(c) for c in names])
