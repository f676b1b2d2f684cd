"""Prefixes of shingle sets: two sets that reach a Jaccard similarity t share ``COMMON`` shingles of their first n - ceil(t n) + ``COMMON``, in any one order of all shingles (all they need, if that is fewer).

The order is that of the shingles' own hashes, so a set's prefix needs no count of the others;
only shingles that prefixes of very many sets hold are put last, in all sets alike. What is put
last changes which candidates meet, never whether a similar pair does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMMON = 4
#: A shingle that more prefixes hold is put last; so many of them at most, the most frequent first, in so many rounds.
#: No round follows once the pairs under such shingles that are not last yet are fewer than the rows that share any: it would move all prefixes for less than it saves.
FREQUENT = 32
MOST_FREQUENT = 1 << 16
ROUNDS = 4
#: Values that a task counts at a time, and how often it must meet one to send it on.
COUNTED = 1 << 22
SEVERAL = 3
#: A table of up to so many ids may be sent to every executor.
BROADCAST_IDS = 1 << 20


def sent(ids: DataFrame) -> DataFrame:
    """A written table of ids, marked to be sent to all executors if it is small enough."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def needed(n: Column, m: Column, similarity: float) -> Column:
    """Shingles that the prefixes of two sets of these sizes share at least, if the sets are similar."""
    return F.least(F.lit(COMMON), F.ceil(F.lit(similarity) * F.greatest(n, m) - 1e-9))


def first_ones(similarity: float, frequent: list[int]) -> Callable:
    """A function of tasks: (values, sizes) of the prefixes of sets that lie one after the other in ``values``, each ascending. It needs no package there."""
    common = COMMON

    def take(values, offsets):
        import numpy as np

        sizes, last = np.diff(offsets), np.array(frequent, np.int64)
        if len(last) and len(values):
            late = last[np.minimum(np.searchsorted(last, values), len(last) - 1)] == values
            values = values[np.lexsort((late, np.repeat(np.arange(len(sizes)), sizes)))]
        most = np.minimum(sizes, sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + common)
        at = np.arange(most.sum()) + np.repeat(offsets[:-1] - (np.cumsum(most) - most), most)
        return values[at], most

    return take


def frequent(sets: DataFrame) -> list[int]:
    """Shingles that very many of the sets (one column, arrays of distinct longs) hold, ascending; those with the most are the first to be put last.

    A task counts the shingles of ``COUNTED`` values at a time and sends on those that it meets
    ``SEVERAL`` times there. What it misses by that is only not put last; :func:`shared_prefixes` still counts exactly.
    """
    counted, several = COUNTED, SEVERAL

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def counts(parts):
            values, f = np.unique(np.concatenate(parts), return_counts=True)
            often = f >= several
            return pa.RecordBatch.from_arrays([pa.array(values[often]), pa.array(f[often])], names=["shingle", "f"])

        parts, n = [], 0
        for batch in batches:
            parts.append(batch.column(0).flatten().to_numpy())
            n += len(parts[-1])
            if n >= counted:
                yield counts(parts)
                parts, n = [], 0
        if parts:
            yield counts(parts)

    found = sets.mapInArrow(run, "shingle long, f long").groupBy("shingle").agg(F.sum("f").alias("f"))
    return sorted(_most(found))


def _most(found: DataFrame) -> dict[int, int]:
    """The most frequent shingles of a table (shingle, f) and how many sets hold each."""
    got = found.where(F.col("f") > FREQUENT).orderBy(F.desc("f"), "shingle").limit(MOST_FREQUENT).select("shingle", "f").toArrow()
    return dict(zip(*(c.to_pylist() for c in got.columns), strict=True))


def _holders(key: str, shingles: list[int]) -> Callable:
    """A function of tasks: the keys of prefixes (key, prefix) that hold any of the shingles, which ascend. It needs no package there."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        wanted = np.array(shingles, np.int64)
        for batch in batches:
            prefix = batch.column(1)
            values = prefix.flatten().to_numpy()
            found = wanted[np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)] == values
            of = np.repeat(np.arange(len(prefix)), prefix.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.unique(of[found])))], names=[key])

    return run


def shared_prefixes(first: DataFrame, again: Callable[[DataFrame, list[int]], DataFrame], cut: Callable[[DataFrame, str], DataFrame], key: str, put_last: Iterable[int] = (), counts: bool = False) -> DataFrame:
    """Rows of ``first`` (key, any others, ``prefix``), one per shingle of a prefix that another set's prefix has too: (key, others, shingle), with ``counts`` also f, how many prefixes in all.

    ``again`` makes the rows of some keys, with these shingles last in the order; in ``first``, ``put_last`` are.
    """
    rows, last = first, set(put_last)
    for left in range(ROUNDS, -1, -1):
        own = rows.select(*[c for c in rows.columns if c != "prefix"], F.explode("prefix").alias("shingle"))
        shared = cut(own.groupBy("shingle").agg(F.count(F.lit(1)).alias("f")).where("f > 1"), "shared")
        often = _most(shared) if left else {}
        new = often.keys() - last
        if not new or sum(often[x] * (often[x] - 1) // 2 for x in new) <= shared.agg(F.sum("f")).first()[0]:
            break
        last |= new
        touched = sent(cut(rows.select(key, "prefix").mapInArrow(_holders(key, sorted(new)), f"{key} {rows.schema[key].dataType.simpleString()}"), "touched"))
        rows = rows.join(touched, key, "left_anti").unionByName(cut(again(touched, sorted(last)), "prefixes"))
    return cut(own.join(sent(shared), "shingle") if counts else own.join(sent(shared.select("shingle")), "shingle", "left_semi"), "shared-prefixes")
