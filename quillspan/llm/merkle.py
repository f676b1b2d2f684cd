"""Merkle manifest of a dataset by sibling-shift self-joins (operator 13).

Every row is a leaf. Leaves of one group are numbered in order, and ``arity`` consecutive
nodes of a level, a run, have one parent. On each level every node computes the indices of
its run's other nodes (index XOR 1 where the arity is two, else its run's first index plus
a shifted slot), an equijoin on group and index finds them, and the rows of slot zero, which
then hold their whole run, emit the parents. The groups' roots are the leaves of one more tree.

No task gets a group: leaves are numbered by ranges, keys of all joins are unique nodes, and
a level costs rows in proportion to its nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import ceil_div, ranked, stage

PATH = "array<struct<left: string, right: string>>"


def leaf_digest(columns: list[Column]) -> Column:
    """Hex SHA-256 of values, each as its number of UTF-8 bytes, a colon and itself, or ``-`` if null."""
    value = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(value, columns)).cast("binary"), 256)


def _run(nodes: DataFrame, arity: int, carried: list[str]) -> DataFrame:
    """(grp, idx, n, digest, left, right, carried): each node with the hex digests of its run to its left and right."""
    first = F.col("idx") - F.col("idx") % arity
    if arity == 2:
        shifted = F.array(F.col("idx"), F.col("idx").bitwiseXOR(F.lit(1).cast("long")))
    else:
        shifted = F.transform(F.sequence(F.lit(0), F.lit(arity - 1)), lambda k: first + (F.col("idx") + k) % arity)
    asked = nodes.select("grp", "idx", "n", F.explode(shifted).alias("other")).where("other < n")
    others = nodes.select("grp", F.col("idx").alias("other"), "digest", F.struct(F.lit(0).alias("_"), *carried).alias("own"))
    found = asked.join(others, ["grp", "other"]).withColumn("own", F.when(F.col("other") == F.col("idx"), F.col("own")))
    runs = found.groupBy("grp", "idx", "n").agg(F.array_sort(F.collect_list(F.struct("other", "digest"))).alias("run"), F.first("own", ignorenulls=True).alias("own"))
    side = lambda keep: F.array_join(F.transform(F.filter("run", keep), lambda x: F.lower(F.hex(x["digest"]))), "")
    left, right = side(lambda x: x["other"] < F.col("idx")), side(lambda x: x["other"] > F.col("idx"))
    digest = F.filter("run", lambda x: x["other"] == F.col("idx"))[0]["digest"]
    return runs.select("grp", "idx", "n", digest.alias("digest"), left.alias("left"), right.alias("right"), *[F.col(f"own.{c}").alias(c) for c in carried])


def _levels(nodes: DataFrame, arity: int, carried: list[str]) -> list[DataFrame]:
    """The levels from the leaves (grp, idx, n, digest, carried) to the last root; groups end at different levels, where n is 1."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    out = []
    while True:
        out.append(stage(_run(nodes, arity, [] if out else carried), f"level{len(out)}"))
        if most <= 1:
            return out
        most = ceil_div(most, arity)
        whole = F.concat("left", F.lower(F.hex("digest")), "right")
        up = [(F.col("idx") / arity).cast("long").alias("idx"), F.ceil(F.col("n") / arity).cast("long").alias("n")]
        nodes = out[-1].where(f"n > 1 and idx % {arity} = 0").select("grp", *up, F.unhex(F.sha2(whole.cast("binary"), 256)).alias("digest"))


def _descend(levels: list[DataFrame], top: DataFrame | None, arity: int, carried: list[str]) -> DataFrame:
    """(carried, digest, path, subroot, root) of the leaves; ``top`` has the path, subroot and root above each group's root."""
    above = None
    for k, level in reversed(list(enumerate(levels))):
        own = ["grp", "idx", "digest", *([] if k else carried)]
        ends = level.where("n = 1").select(*own)
        if top is None:
            root = F.lower(F.hex("digest"))
            ends = ends.select(*own, F.array().cast(PATH).alias("path"), root.alias("subroot"), root.alias("root"))
        else:
            ends = ends.join(top, "grp").select(*own, "path", "subroot", "root")
        if above is not None:
            up = above.select("grp", F.col("idx").alias("up"), F.col("path").alias("rest"), "subroot", "root")
            path = F.concat(F.array(F.struct("left", "right")), F.col("rest"))
            inner = level.where("n > 1").withColumn("up", (F.col("idx") / arity).cast("long")).join(up, ["grp", "up"])
            ends = ends.unionByName(inner.select(*own, path.alias("path"), "subroot", "root"))
        above = ends
    return above


def _roots(levels: list[DataFrame]) -> DataFrame:
    out = levels[0].where("n = 1").select("grp", "digest")
    for level in levels[1:]:
        out = out.unionAll(level.where("n = 1").select("grp", "digest"))
    return out


def manifest(leaves: DataFrame, id_col: str = "doc_id", group_col: str = "lang", leaf_col: str = "leaf", arity: int = 8) -> DataFrame:
    """The rows of ``leaves`` with ``path``, ``subroot`` and ``root``; its other columns are carried along.

    ``leaf_col`` holds each row's digest in lower-case hex, see ``leaf_digest``. Rows of one
    group are ordered by ``id_col``, a null id first and equal ids by leaf; while a group has
    several nodes, every ``arity`` consecutive ones (the last run may have fewer, even one)
    become the digest of their hex digests. What remains is the group's ``subroot``, of a
    single row its leaf. Subroots, ordered by group as UTF-8 bytes, null first, likewise give
    ``root``. ``path`` lists, level by level up to the root, the digests to the left and to
    the right of the node in its run, each side concatenated (two empty strings for a run of one).

    Repeated rows are leaves of their own. A group may hold all rows, or each row be its own
    group. An empty table gives an empty result. Columns other than the four named ``grp``,
    ``idx``, ``n`` and ``digest`` inside may have any name: they are renamed on the way.
    """
    if arity < 2:
        raise ValueError("arity must be 2 or more")
    names = leaves.columns
    inner = leaves.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)])
    at = {c: f"c{names.index(c)}" for c in (id_col, group_col, leaf_col)}
    # a marked name, so that null is a key like any other and comes first
    inner = inner.withColumn("grp", F.coalesce(F.concat(F.lit("="), F.col(at[group_col]).cast("string")), F.lit("")))
    inner = stage(inner, "digests")  # numbering reads them twice, and they may come from whole texts
    carried = [c for c in inner.columns if c not in ("grp", at[leaf_col])]
    nodes = ranked(inner, ["grp"], [at[id_col], at[leaf_col]], "leaves")
    nodes = stage(nodes.select("grp", F.col("rank").alias("idx"), "n", F.unhex(at[leaf_col]).alias("digest"), *carried), "nodes")
    levels = _levels(nodes, arity, carried)
    subroots = ranked(_roots(levels).withColumnRenamed("grp", "name").withColumn("grp", F.lit("all")), ["grp"], ["name"], "subroots")
    upper = stage(subroots.select("grp", F.col("rank").alias("idx"), "n", "digest", "name"), "subroot-nodes")
    top = _descend(_levels(upper, arity, ["name"]), None, arity, ["name"])
    top = top.select(F.col("name").alias("grp"), "path", F.lower(F.hex("digest")).alias("subroot"), "root")
    rows = _descend(levels, stage(top, "subroot-paths"), arity, carried)
    rows = rows.withColumn(at[leaf_col], F.lower(F.hex("digest")))
    return rows.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)], "path", "subroot", "root")


def fold(leaf: Column | str, path: Column | str = "path") -> Column:
    """The root that a leaf and the digests beside its nodes give."""
    leaf = F.col(leaf) if isinstance(leaf, str) else leaf
    return F.aggregate(path, leaf, lambda acc, x: F.sha2(F.concat(x["left"], acc, x["right"]).cast("binary"), 256))


def proof_digest(path: Column | str = "path") -> Column:
    """Hex SHA-256 of all digests of a path, from the leaf's level up and left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), "").cast("binary"), 256)
