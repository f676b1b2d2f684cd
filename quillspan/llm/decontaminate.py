"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment (operator 4).

All word n-grams of the test items are seeds, as 64-bit hashes. One pass over the documents
finds the n-grams that may be seeds, by a bit filter of a fixed size, and cuts out the
passages around them, as wide as any alignment through such a place can be. The n-grams of
the passages are joined with the seeds; each pair of a passage and an item is aligned by
Smith-Waterman, and the score is the alignment's share of the best possible one, so edited
and paraphrased copies score high and chance matches low.

No seed is left out for being common, as an exact copy must not hide an edited one: words
around a hit are not aligned where the words they share with the item, in any order, bound
the score below the threshold. What is found are all alignments through an unbroken n-gram
that reach the threshold.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import scratch, ship, stage

NGRAM = 3
THRESHOLD = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
WORD = re.compile(r"\w+")
#: The filter has 2**FILTER_BITS bits (8 MB), however many seeds there are; more seeds let more other n-grams into the join.
FILTER_BITS = 26
#: A table of up to so many narrow rows is sent to every executor, beyond it is shuffled; so are items of up to ITEM_BYTES of text.
BROADCAST_ROWS = 1 << 18
ITEM_BYTES = 32 << 20
#: Words whose n-grams are looked up at a time.
SLICE_WORDS = 1 << 19


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def smith_waterman(a: list, b: list) -> tuple[int, int, int]:
    """Best local score of two word sequences, and where in ``a`` it begins and ends."""
    best = (0, 0, 0)
    row = [(0, 0)] * (len(b) + 1)  # score, where in a it began
    for i, x in enumerate(a):
        last, before = (0, i + 1), row[0]
        new = [last]
        for j, y in enumerate(b):
            s, o = before
            before = row[j + 1]
            if x == y:
                cell = (s + MATCH, o if s else i)
            else:
                cell = (s + MISMATCH, o)
                if before[0] + GAP > cell[0]:
                    cell = (before[0] + GAP, before[1])
                if last[0] + GAP > cell[0]:
                    cell = (last[0] + GAP, last[1])
                if cell[0] <= 0:
                    cell = (0, i + 1)
            if cell[0] > best[0]:
                best = (cell[0], cell[1], i + 1)
            new.append(cell)
            last = cell
        row = new
    return best


class _WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 1 << 18:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode(errors="replace"), 3)
        return h


def ngram_hashes(words, n: int):
    """Hash of the n words from each place on that has as many, as unsigned 64-bit integers."""
    import numpy as np

    size = max(0, len(words) - n + 1)
    h = np.full(size, n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = (h ^ words[k : k + size]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


def seed_size(n_words: int, ngram: int) -> int:
    """A shorter item is one seed."""
    return min(n_words, ngram)


def item_table(items: DataFrame, item_col: str, text_col: str, ngram: int) -> DataFrame:
    """(item, item_id, words, n, seeds): the different items by a number of their own; ``words`` is joined by spaces. Null texts and those without a word have no seed and are left out."""
    rows = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("t")).where("t is not null").distinct()

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in batches:
            found, hashes = [], _WordHashes()
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(t)
                if words:
                    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
                    joined = " ".join(words)
                    own = xxhash.xxh64_intdigest(f"{i} {t}".encode(errors="replace")) >> 1
                    found.append((own, i, joined, len(words), ngram_hashes(w, seed_size(len(words), ngram)).view(np.int64)))
            cols = list(zip(*found)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["item", "item_id", "words", "n", "seeds"])

    ship(rows.sparkSession)
    return rows.mapInArrow(run, "item long, item_id long, words string, n int, seeds array<long>")


def seed_filter(seeds: DataFrame):
    """The bits of the seeds' first FILTER_BITS bits, by 64; as many rows as the filter has words come to the driver at most."""
    import numpy as np

    top = F.shiftrightunsigned("seed", 64 - FILTER_BITS)
    bits = seeds.groupBy(F.shiftright(top, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(seed, {64 - FILTER_BITS}) & 63 as int))")).alias("bits"))
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    got = bits.toArrow()
    out[got["word"].to_numpy()] = got["bits"].to_numpy()
    return out.view(np.uint64)


PASSAGE = "passage long, doc long, id long, h1 long, h2 long, begin int, words string, places array<int>, hashes array<long>"


def passages(docs: DataFrame, bits, sizes: list[int], reach: int, id_col: str, text_col: str) -> DataFrame:
    """The parts of documents within ``reach`` words of an n-gram that the filter lets through, with these n-grams and their places."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("t"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2"))
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        hashes, number = _WordHashes(), TaskContext.get().partitionId() << 40
        kinds = [pa.int64()] * 5 + [pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64())]
        names = ["passage", "doc", "id", "h1", "h2", "begin", "words", "places", "hashes"]

        def look(some: list) -> pa.RecordBatch:
            """Passages of some documents: (row, words) each."""
            nonlocal number
            found = []
            flat = np.fromiter((h for _, words in some for h in map(hashes.__getitem__, words)), np.uint64)
            ends = np.cumsum([len(words) for _, words in some])
            at, seeds, size = [], [], []
            for n in sizes:
                h = ngram_hashes(flat, n)
                top = h >> np.uint64(64 - FILTER_BITS)
                hit = np.flatnonzero((sent.value[(top >> np.uint64(6)).astype(np.int64)] >> (top & np.uint64(63))) & np.uint64(1))
                hit = hit[hit + n <= ends[np.searchsorted(ends, hit, side="right")]]  # not over a document's end
                at.append(hit)
                seeds.append(h[hit])
                size.append(np.full(len(hit), n))
            at, seeds, size = np.concatenate(at), np.concatenate(seeds), np.concatenate(size)
            order = np.argsort(at, kind="stable")
            at, seeds, size = at[order], seeds[order].view(np.int64), size[order]
            cuts = np.searchsorted(at, np.append(0, ends))
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                (i, h1, h2), words = some[k]
                own = slice(cuts[k], cuts[k + 1])
                first = at[own] - (ends[k] - len(words))
                number += 1
                doc, low, high = number, np.maximum(first - reach, 0), np.minimum(first + size[own] + reach, len(words))
                part = np.cumsum(np.append(0, low[1:] > np.maximum.accumulate(high)[:-1]))
                for p in range(int(part[-1]) + 1):
                    its = part == p
                    begin, end = int(low[its].min()), int(high[its].max())
                    number += 1
                    found.append((number, doc, i, h1, h2, begin, " ".join(words[begin:end]), first[its] - begin, seeds[own][its]))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*found)) or [()] * 9, kinds)], names=names)

        for batch in batches:
            some, held = [], 0
            for i, t, h1, h2 in zip(*(batch.column(k).to_pylist() for k in range(4))):
                words = words_of(t)
                if words:
                    some.append(((i, h1, h2), words))
                    held += len(words)
                if held >= SLICE_WORDS:
                    yield look(some)
                    some, held = [], 0
            if some:
                yield look(some)

    ship(rows.sparkSession)
    return rows.mapInArrow(run, PASSAGE)


def _windows(starts: list[int], size: int, slack: int, length: int) -> list[tuple[int, int]]:
    """Where copies may lie, from where each hit says that the item begins; overlapping ones are joined."""
    found: list[list[int]] = []
    for s in sorted(starts):
        lo, hi = max(0, s - slack), min(length, s + size + slack)
        if found and lo <= found[-1][1]:
            found[-1][1] = max(found[-1][1], hi)
        else:
            found.append([lo, hi])
    return [(lo, hi) for lo, hi in found]


def _may_reach(part: list[str], bag: Counter, least: float) -> bool:
    """Whether ``part`` shares ``least`` words with the bag, repeats counted: no alignment matches more."""
    held = [w for w in part if w in bag]
    return len(held) >= least and sum(min(n, bag[w]) for w, n in Counter(held).items()) >= least


def most_gaps(size: int, threshold: float) -> int:
    """How many words an alignment that reaches the threshold can pass over: each costs one of the points of its matches."""
    return math.floor(MATCH * size * (1 - threshold) + 1e-9)


def align(words: list[str], item: list[str], starts: list[int], threshold: float, memo: dict | None = None) -> tuple[float, int, int] | None:
    """(score, first word, end) of the best alignment near the places where hits say that the item begins, if it reaches the threshold."""
    bag, size = Counter(item), len(item)
    slack = most_gaps(size, threshold)
    memo = {} if memo is None else memo
    best = (0, 0, 0)
    span = size + slack  # of the longest alignment
    for lo, hi in _windows(starts, size, slack, len(words)):
        for cut in range(lo, max(lo + 1, hi - span), 5 * span):  # a long joined window in parts that share a span
            part = words[cut : min(hi, cut + 6 * span)]
            if not _may_reach(part, bag, threshold * size - 1e-9):
                continue
            key = (tuple(part), tuple(item))
            if key not in memo:
                if len(memo) > 1024:
                    memo.clear()
                memo[key] = smith_waterman(part, item)
            s, a, e = memo[key]
            if s > best[0]:
                best = (s, cut + a, cut + e)
    score = best[0] / (MATCH * size)
    return (score, best[1], best[2]) if best[0] and score >= threshold else None


def _align_all(threshold: float):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        memo: dict = {}
        for batch in batches:
            got = []
            doc, i, h1, h2, begin, words, item, item_id, own, starts = (batch.column(k).to_pylist() for k in range(10))
            for k in range(batch.num_rows):
                found = align(words[k].split(" "), own[k].split(" "), starts[k], threshold, memo)
                if found:
                    got.append((doc[k], i[k], h1[k], h2[k], item[k], item_id[k], found[0], begin[k] + found[1], begin[k] + found[2], len(starts[k])))
            kinds = [pa.int64()] * 6 + [pa.float64()] + [pa.int64()] * 3
            names = ["doc", "id", "h1", "h2", "item", "item_id", "score", "start_word", "end_word", "n_seeds"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*got)) or [()] * 10, kinds)], names=names)

    return run


FOUND = "doc long, id long, h1 long, h2 long, item long, item_id long, score double, start_word long, end_word long, n_seeds long"


def _found(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, ngram: int, threshold: float) -> DataFrame:
    """One row per document row and item whose alignment reaches ``threshold``; (h1, h2) is a hash of the document's text."""
    spark = docs.sparkSession
    known = stage(item_table(items, item_col, item_text, ngram), "items")
    longest, n_items, size = known.agg(F.max("n"), F.count(F.lit(1)), F.sum(F.octet_length("words"))).first()
    if not n_items:
        return spark.createDataFrame([], FOUND)
    sizes = [r["n"] for r in known.select(F.least("n", F.lit(ngram)).alias("n")).distinct().collect()]  # ngram rows at most
    seeds = known.select("item", F.posexplode("seeds").alias("at", "seed"))
    bits = seed_filter(seeds)
    parts = stage(passages(docs, bits, sorted(sizes), longest + most_gaps(longest, threshold), id_col, text_col), "passages")
    sent = F.broadcast if known.select(F.sum(F.size("seeds"))).first()[0] <= BROADCAST_ROWS else lambda df: df
    hits = parts.select("passage", F.explode(F.arrays_zip("places", "hashes")).alias("x")).select("passage", "x.places", F.col("x.hashes").alias("seed"))
    pairs = hits.join(sent(seeds), "seed").groupBy("passage", "item").agg(F.collect_set(F.col("places") - F.col("at")).alias("starts"))
    texts = known.select("item", "item_id", F.col("words").alias("item_words"))
    texts = F.broadcast(texts) if n_items <= BROADCAST_ROWS and size <= ITEM_BYTES else texts
    both = pairs.join(texts, "item").join(parts.drop("places", "hashes"), "passage")
    each = both.select("doc", "id", "h1", "h2", "begin", "words", "item", "item_id", "item_words", "starts").mapInArrow(_align_all(threshold), FOUND)
    # a long document has several passages
    best = F.max_by(F.struct("id", "h1", "h2", "item_id", "score", "start_word", "end_word", "n_seeds"), F.struct("score", -F.col("start_word"))).alias("x")
    return each.groupBy("doc", "item").agg(best).select("doc", "item", "x.*")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", ngram: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """(id, item_id, score, start_word, end_word, n_seeds): one row per document and item whose alignment reaches ``threshold``.

    Words are runs of letters, digits and underscores of the lower-cased whole text. A null
    or empty text matches nothing; null ids keep their rows, of documents and of items; a
    document row that occurs twice is reported twice; items that repeat an id with another
    text are items of their own, equal items are one. No items, or an empty table, give an
    empty result; other columns are not read. Where the best part of a document lies is by
    words, end exclusive. Documents are read once; only passages around hits are shuffled.
    """
    found = _found(docs, items, id_col, text_col, item_col, item_text, ngram, threshold)
    return found.select(F.col("id").alias(id_col), "item_id", "score", "start_word", "end_word", "n_seeds")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without those whose text is contaminated, whatever their id; of a repeated id only such rows go."""
    settings = {"item_col": "item_id", "item_text": "text", "ngram": NGRAM, "threshold": THRESHOLD} | options
    with scratch(docs.sparkSession) as keep:
        bad = keep(_found(docs, items, id_col, text_col, **settings).select("h1", "h2").distinct(), "contaminated")
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    names = docs.columns
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2"))
    return rows.join(bad, ["h1", "h2"], "left_anti").select(*[F.col("row").getField(c).alias(c) for c in names])
