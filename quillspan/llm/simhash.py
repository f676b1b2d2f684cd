"""SimHash near-duplicates by meet-in-the-middle ball hashing (operator 9).

Two fingerprints within radius ``r`` share a point within ``r/2`` of both. Emitting whole
balls of radius 2 would make 2,081 variants of every fingerprint (the README has the
figures), so each fingerprint is cut into two 32-bit halves: of two fingerprints within 4
bits, one half is within 2, and then both halves share a variant at one flipped bit or
less. That is 66 variants per distinct fingerprint. They are shuffled by variant, verified
against the full 64 bits and linked along a spanning forest of each bucket.

A half value that over ``HOT`` different fingerprints share would make a large bucket;
these fingerprints and all that come near such a value go through the whole 64-bit ball
instead, where everything that collides is within the radius by the triangle inequality
and is linked to the bucket's smallest member without comparing pairs. Both ways together
find every link, so the components are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import join_split, ship, stage
from quillspan.llm.components import components

RADIUS = 4
HOT = 512


def fingerprint_words(words: list[bytes], shingle: int) -> int:
    """64-bit SimHash over word shingles, repeats included; no word gives 0."""
    return fingerprint(shingle_hashes(words, shingle))


def shingle_hashes(words: list[bytes], shingle: int):
    """XXH64 of each word shingle, repeats included; fewer words are one shingle, no word has none."""
    import numpy as np
    import xxhash

    digest, text = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= shingle:
        return np.array([digest(text, 42)] if words else [], np.uint64)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    return np.fromiter((digest(text[s : e - 1], 42) for s, e in zip(starts, starts[shingle:])), np.uint64, len(words) - shingle + 1)


def fingerprint(h) -> int:
    """Each bit is 1 if it is set in over half of the hashes; no hash gives 0."""
    import numpy as np

    n = len(h)
    if n < 2:
        return int(h[0]) if n else 0
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 15):
        ones += np.unpackbits(h[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp) per row: the fingerprint of the whole lower-cased (A-Z) text as a signed long; null counts as empty."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            fps = [fingerprint_words(t.lower().split(), shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["id", "fp"])

    ship(rows.sparkSession)
    return rows.mapInArrow(run, "id long, fp long")


def _ball(bits: int, radius: int) -> list[int]:
    masks = [0, *(1 << i for i in range(bits))]
    if radius == 2:
        masks += [1 << i | 1 << j for i in range(bits) for j in range(i)]
    return masks


def _signed(masks: list[int]) -> F.Column:
    return F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in masks])


def _halves(fps: DataFrame) -> DataFrame:
    """(fp, rep, half): the left half with bit 32 clear, the right half with bit 32 set."""
    left = F.shiftrightunsigned("fp", 32)
    right = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.lit(1 << 32))
    return fps.select("fp", "rep", F.explode(F.array(left, right)).alias("half"))


def _bucket_links(batches: Iterator) -> Iterator:
    """Rows sorted by key arrive; per key, a spanning forest of the links within RADIUS leaves."""
    import numpy as np
    import pyarrow as pa

    def forest(fp: np.ndarray, rep: np.ndarray, a: list, b: list) -> None:
        left = np.arange(len(fp))
        while len(left) > 1:
            front, left = left[:1], left[1:]
            while len(front) and len(left):
                near = np.bitwise_count(fp[left] ^ fp[front[0]]) <= RADIUS
                a += [rep[front[0]]] * int(near.sum())
                b += rep[left[near]].tolist()
                front, left = np.concatenate([front[1:], left[near]]), left[~near]

    def links(key: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
        a: list = []
        b: list = []
        cuts = np.flatnonzero(np.diff(key)) + 1
        begins, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])
        sizes = ends - begins
        two = begins[sizes == 2]
        near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= RADIUS]
        a += rep[near].tolist()
        b += rep[near + 1].tolist()
        for s, e in zip(begins[sizes > 2].tolist(), ends[sizes > 2].tolist()):
            forest(fp[s:e], rep[s:e], a, b)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    held: list = []
    for batch in batches:
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        now[1] = now[1].view(np.uint64)
        if not len(now[0]):
            continue
        last = int(np.searchsorted(now[0], now[0][-1]))  # the last key may go on in the next batch
        if last == 0 and held and held[0][0][-1] != now[0][-1] or last:
            done = [np.concatenate([*(h[i] for h in held), now[i][:last]]) for i in range(3)] if held else [x[:last] for x in now]
            if len(done[0]):
                yield links(*done)
            held = []
        held.append([x[last:] for x in now])
    if held:
        yield links(*[np.concatenate([h[i] for h in held]) for i in range(3)])


def fingerprint_links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b): representatives of distinct fingerprints (fp, rep), linked so that components are those of all links within RADIUS."""
    halves = _halves(fps)
    crowded = stage(halves.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("half"), "crowded")
    some = not crowded.isEmpty()
    normal = halves.join(crowded, "half", "left_anti") if some else halves
    keyed = normal.select("fp", "rep", F.explode(F.transform(_signed(_ball(32, 1)), lambda m: F.col("half").bitwiseXOR(m))).alias("key")).select("key", "fp", "rep")
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = keyed.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_bucket_links, "a long, b long")
    if some:
        near = crowded.select(F.explode(F.transform(_signed(_ball(32, 2)), lambda m: F.col("half").bitwiseXOR(m))).alias("half")).distinct()
        ball = halves.join(near, "half", "left_semi").select("fp", "rep").distinct()
        points = ball.select("rep", F.explode(F.transform(_signed(_ball(64, 2)), lambda m: F.col("fp").bitwiseXOR(m))).alias("key"))
        least = points.groupBy("key").agg(F.min("rep").alias("b"), F.max("rep").alias("top")).where("b <> top").drop("top")
        links = links.unionAll(points.join(least, "key").where("rep <> b").select(F.col("rep").alias("a"), "b"))
    return links.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """One row per document: id, fingerprint (16 lowercase hex digits), component_id.

    Fingerprints link at 4 or fewer differing bits; component_id is the smallest id
    reachable over links, the document itself included. Null texts count as empty; texts
    without a word have fingerprint 0 and link like any other. Copies (equal fingerprints)
    are one node. Repeated rows each give a row. A null id never names a component: such a
    row has its component's smallest id, or null. An empty table gives an empty result;
    other columns are not read.
    """
    each = stage(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = stage(each.groupBy("fp").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("times")), "classes")
    found = components(fingerprint_links(classes.where("rep is not null")))
    names = classes.join(found, classes["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"), "times")
    return join_split(each, stage(names, "named"), ["fp"], "times").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
