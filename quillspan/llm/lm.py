"""Language-model scores by deleted interpolation (operator 2).

The model is a word bigram: P(w|u) = l2[b] c(u,w)/c(u) + l1[b] c(w)/N + l0[b] 1/(V+1),
where b is the frequency bucket of the context u (the logarithm of its count). The weights
of each bucket are learned by expectation-maximisation on held-out counts: one training
fold is left out of the counts and predicted from the rest.

How the counts travel: documents are packed once into compressed chunks of about
``CHUNK_BYTES`` of text. A chunk asks for each of its *different* n-grams once, so a very
common word or pair is asked for once per chunk and makes no hot key. The questions (with
the chunk's own counts) are shuffled by hash range; each range sums the counts of all
chunks and answers in the order asked; the answers return to the chunk, which scores its
documents. The questions and answers grow with the corpus. N-grams are told apart by
64-bit hashes.

Tokens: words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, then one end. The end
is also the context of a text's first token.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import fold, ship, stage

CHUNK_BYTES = 16 << 20
RANGE_BYTES = 8 << 20
#: Documents outside the training part, in the counted part, and in the part that the weights are learned on (also counted).
TEST, TRAIN, HELD = 0, 1, 2
CHUNK = "chunk string, part int, n_docs long, n_tokens long, n_bytes long, docs binary"
QUESTION = "order int, range long, chunk string, part int, grams binary, counts binary"
ANSWER = "order int, range long, chunk string, part int, counts binary, held binary, types long, types_rest long"
#: Steps per octave in which the ratios of the three estimates are binned for learning the weights.
STEPS = 4
NONE = -(1 << 20)


def _squeeze(x) -> bytes:
    """Integers as compressed byte planes."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(x.view("u1").reshape(-1, x.itemsize).T.tobytes())


def _expand(data: bytes, kind: str):
    import numpy as np
    import zstandard

    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "u1").reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _pack(batches: Iterator) -> Iterator:
    """(id, text, part) rows to chunks; documents of a part share chunks."""
    import uuid

    import pyarrow as pa

    open_: dict[int, tuple[list, list]] = {}
    sizes: dict[int, int] = {}

    def close(part: int):
        ids, texts = open_.pop(part)
        docs = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.binary())], names=["id", "text"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_batch(docs)
        n_tokens = sum(len(t.split()) for t in texts) + len(texts)
        row = {"chunk": [uuid.uuid4().hex], "part": [part], "n_docs": [len(ids)], "n_tokens": [n_tokens], "n_bytes": [sizes.pop(part)], "docs": [sink.getvalue().to_pybytes()]}
        return pa.RecordBatch.from_pydict(row, schema=pa.schema([("chunk", pa.string()), ("part", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64()), ("docs", pa.binary())]))

    for batch in batches:
        for i, t, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            ids, texts = open_.setdefault(p, ([], []))
            ids.append(i)
            texts.append(t.lower())
            sizes[p] = sizes.get(p, 0) + len(t)
            if sizes[p] >= CHUNK_BYTES:
                yield close(p)
    for p in list(open_):
        yield close(p)


class _Numbers(dict):
    """Numbers words by first use."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Chunk:
    """The n-grams of one chunk, each order's different ones sorted by hash."""

    def __init__(self, docs: bytes) -> None:
        import numpy as np
        import pyarrow as pa
        import xxhash

        rows = pa.ipc.open_stream(docs).read_all()
        self.ids = rows.column(0)
        numbers = _Numbers({b"\n": 0})  # the end
        number, words, lengths = numbers.__getitem__, [], []
        for t in rows.column(1).to_pylist():
            own = t.split()
            lengths.append(len(own) + 1)
            words.append(np.fromiter(map(number, own), np.int32, len(own)))
            words.append(np.zeros(1, np.int32))
        self.word = np.concatenate(words)  # by position
        del words
        self.lengths = np.array(lengths, np.int64)
        h = np.fromiter((xxhash.xxh64_intdigest(w, 7) for w in numbers), np.uint64, len(numbers))
        by_hash = np.argsort(h)
        self.place = np.empty(len(h), np.int64)  # of a word among the sorted unigrams
        self.place[by_hash] = np.arange(len(h))
        self.grams = {1: (h[by_hash], np.bincount(self.word, minlength=len(h))[by_hash])}
        before = np.empty_like(self.word)
        before[0] = 0
        before[1:] = self.word[:-1]
        pair = before.astype(np.int64) * len(h) + self.word
        pairs, self.pair, n = np.unique(pair, return_inverse=True, return_counts=True)
        self.first, self.second = pairs // len(h), pairs % len(h)
        del pair, pairs, before
        with np.errstate(over="ignore"):
            mix = h[self.first] * np.uint64(0x9E3779B97F4A7C15) + ((h[self.second] << np.uint64(31)) | (h[self.second] >> np.uint64(33)))
            mix ^= mix >> np.uint64(33)
            mix *= np.uint64(0xFF51AFD7ED558CCD)
            mix ^= mix >> np.uint64(33)
        by_hash = np.argsort(mix)
        self.pair_place = np.empty(len(mix), np.int64)
        self.pair_place[by_hash] = np.arange(len(mix))
        self.pair_count = n
        self.grams[2] = (mix[by_hash], n[by_hash])

    def questions(self, bits: dict[int, int]) -> Iterator[tuple[int, int, bytes, bytes]]:
        """(order, range, hashes, counts) for each hash range that the chunk has n-grams in."""
        import numpy as np

        for order, (h, n) in self.grams.items():
            shift = np.uint64(64 - bits[order])
            ranges = (h >> shift).astype(np.int64) if bits[order] else np.zeros(len(h), np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(ranges)) + 1).tolist(), len(h)]
            for s, e in zip(cuts, cuts[1:]):
                yield order, int(ranges[s]), _squeeze(np.diff(h[s:e], prepend=np.uint64(0))), _squeeze(n[s:e].astype(np.uint32))

    def counts(self, answers) -> dict[int, tuple]:
        """For each order (count, held-out count) in the order of its sorted n-grams."""
        import numpy as np

        found: dict[int, list] = {1: [], 2: []}
        for row in sorted(zip(*(answers[c].to_pylist() for c in ("order", "range", "counts", "held"))), key=lambda x: x[:2]):
            found[row[0]].append((_expand(row[2], "<i8"), _expand(row[3], "<i8")))
        return {order: tuple(np.concatenate([p[k] for p in parts]) for k in (0, 1)) for order, parts in found.items()}


def _ask(bits: dict[int, int]):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for chunk, part, docs in zip(*(batch.column(i) for i in range(3))):
                rows = [(o, r, chunk.as_py(), part.as_py(), g, c) for o, r, g, c in Chunk(docs.as_py()).questions(bits)]
                for k in range(0, len(rows), 256):
                    cols = list(zip(*rows[k : k + 256]))
                    kinds = [pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["order", "range", "chunk", "part", "grams", "counts"])

    return run


def _answer(asked):
    """All questions of one hash range; counts have 64 bits and are summed exactly up to 2**53."""
    import numpy as np
    import pyarrow as pa

    parts = np.array(asked["part"].to_pylist(), np.int32)
    grams = [np.cumsum(_expand(x, "<u8"), dtype=np.uint64) for x in asked["grams"].to_pylist()]
    sizes = np.array([len(g) for g in grams])
    n = np.concatenate([_expand(x, "<u4") for x in asked["counts"].to_pylist()]).astype(np.int64)
    every, place = np.unique(np.concatenate(grams), return_inverse=True)
    del grams
    part = np.repeat(parts, sizes)
    counted = np.bincount(place, np.where(part != TEST, n, 0), len(every)).astype(np.int64)
    held = np.bincount(place, np.where(part == HELD, n, 0), len(every)).astype(np.int64)
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    types, rest = int((counted > 0).sum()), int((counted > held).sum())
    first = [1] + [0] * (len(sizes) - 1)
    return pa.table(
        {
            "order": asked["order"],
            "range": asked["range"],
            "chunk": asked["chunk"],
            "part": asked["part"],
            "counts": pa.array([_squeeze(counted[place[s:e]]) for s, e in zip(cuts, cuts[1:])], pa.binary()),
            "held": pa.array([_squeeze(held[place[s:e]]) for s, e in zip(cuts, cuts[1:])], pa.binary()),
            "types": pa.array([types * f for f in first], pa.int64()),
            "types_rest": pa.array([rest * f for f in first], pa.int64()),
        }
    )


def _bucket(count):
    """Frequency bucket of a context: 0 if unseen, else 1 + floor(log2(count))."""
    import numpy as np

    return np.where(count > 0, np.frexp(np.maximum(count, 1).astype(float))[1], 0)


@dataclass(frozen=True)
class Model:
    tokens: int  # N
    types: int  # V
    weights: tuple[tuple[float, float, float], ...]  # by bucket: bigram, unigram, uniform

    def pair_log10(self, chunk: Chunk, counts: dict):
        """log10 P(second|first) for each different pair of a chunk."""
        import numpy as np

        c1 = counts[1][0][chunk.place]
        cu, cw, cuw = c1[chunk.first], c1[chunk.second], counts[2][0][chunk.pair_place]
        w = np.array(self.weights)[np.minimum(_bucket(cu), len(self.weights) - 1)]
        p = w[:, 0] * cuw / np.maximum(cu, 1) + w[:, 1] * cw / self.tokens + w[:, 2] / (self.types + 1)
        return np.log10(p)


def _bin(tokens: int, types: int):
    """Held-out counts of (bucket, binned ratio of bigram to uniform, of unigram to uniform)."""

    def run(key, chunks, answers):
        import numpy as np
        import pyarrow as pa

        chunk = Chunk(chunks["docs"][0].as_py())
        got = chunk.counts(answers)
        c1 = (got[1][0] - got[1][1])[chunk.place]
        c2 = (got[2][0] - got[2][1])[chunk.pair_place]
        cu, cw = c1[chunk.first], c1[chunk.second]
        level = lambda p: np.where(p > 0, np.rint(STEPS * np.log2(np.maximum(p * (types + 1), 1e-300))), NONE).astype(np.int64)
        cells = np.stack([_bucket(cu), level(c2 / np.maximum(cu, 1)), level(cw / tokens)])
        every, place = np.unique(cells, axis=1, return_inverse=True)
        n = np.bincount(place.reshape(-1), chunk.pair_count, every.shape[1]).astype(np.int64)
        return pa.table({"bucket": pa.array(every[0], pa.int64()), "q2": pa.array(every[1], pa.int64()), "q1": pa.array(every[2], pa.int64()), "n": pa.array(n, pa.int64())})

    return run


def learn_weights(cells: list[tuple[int, int, int, int]], rounds: int = 60) -> tuple[tuple[float, float, float], ...]:
    """Mixture weights by bucket from (bucket, q2, q1, n), by expectation-maximisation.

    Each weight gets one imagined observation, so none is zero; a bucket without
    observations takes the weights of the next lower one. For unseen contexts the bigram
    has no estimate, and its share goes to the others.
    """
    import numpy as np

    top = max((c[0] for c in cells), default=0)
    found: list[tuple[float, float, float]] = []
    for b in range(top + 1):
        own = np.array([c[1:] for c in cells if c[0] == b], np.int64).reshape(-1, 3)
        if not len(own):
            found.append(found[-1] if len(found) > 1 else (1 / 3, 1 / 3, 1 / 3) if b else (0.0, 0.5, 0.5))
            continue
        ratio = np.stack([np.where(own[:, k] == NONE, 0.0, np.exp2(own[:, k] / STEPS)) for k in (0, 1)] + [np.ones(len(own))])
        n = own[:, 2].astype(float)
        w = np.array([1 / 3, 1 / 3, 1 / 3] if b else [0.0, 0.5, 0.5])
        prior = (w > 0).astype(float)
        for _ in range(rounds):
            share = w[:, None] * ratio
            w = (share / share.sum(axis=0) * n).sum(axis=1) + prior
            w /= w.sum()
        found.append(tuple(w.tolist()))
    return tuple(found)


def _score(model: Model):
    def run(key, chunks, answers):
        import numpy as np
        import pyarrow as pa

        chunk = Chunk(chunks["docs"][0].as_py())
        counts = chunk.counts(answers)
        doc = np.repeat(np.arange(len(chunk.lengths)), chunk.lengths)
        c = counts[1][0][chunk.place]
        base = np.log10((c + 1.0) / (model.tokens + model.types + 1.0))
        per_doc = lambda x: np.bincount(doc, x, len(chunk.lengths))
        return pa.table(
            {
                "id": chunk.ids,
                "held_out": pa.array([chunks["part"][0].as_py() == TEST] * len(chunk.lengths), pa.bool_()),
                "n_tokens": pa.array(chunk.lengths, pa.int64()),
                "n_known": pa.array(per_doc((c > 0)[chunk.word]).astype(np.int64), pa.int64()),
                "base_score": pa.array(per_doc(base[chunk.word]), pa.float64()),
                "score": pa.array(per_doc(model.pair_log10(chunk, counts)[chunk.pair]), pa.float64()),
            }
        )

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_out: int = 2, weight_fold: int = 3) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents whose fold (crc32 of the id as text, modulo ``folds``) is ``held_out`` are
    scored and not learned from; those of ``weight_fold`` are the held-out counts of the
    weights. Null texts count as empty (one token, the end); a null id is in no fold and is
    learned from. Repeated rows count and are returned as often as they occur. With no
    training text every estimate is uniform. An empty table gives an empty result; other
    columns are not read.
    """
    f = F.coalesce(fold(id_col, folds), F.lit(-1))
    part = F.when(f == held_out, TEST).when(f == weight_fold, HELD).otherwise(TRAIN).cast("int")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), part.alias("part"))
    ship(rows.sparkSession)
    packed = stage(rows.mapInArrow(_pack, CHUNK), "packed", "uncompressed")
    sums = {r["part"]: r for r in packed.groupBy("part").agg(F.sum("n_tokens").alias("n"), F.sum("n_bytes").alias("bytes")).collect()}
    n_all = sum(r["n"] for p, r in sums.items() if p != TEST)
    n_held = sums[HELD]["n"] if HELD in sums else 0
    bits = max(0, math.ceil(math.log2(max(1, sum(r["bytes"] for r in sums.values()) / RANGE_BYTES))))
    asked = packed.select("chunk", "part", "docs").mapInArrow(_ask({1: max(0, bits - 2), 2: bits}), QUESTION)
    answers = stage(asked.groupBy("order", "range").applyInArrow(_answer, ANSWER), "answers", "uncompressed")
    types = answers.where("order = 1").agg(F.sum("types"), F.sum("types_rest")).first()
    n_types, n_rest = types[0] or 0, types[1] or 0
    held = packed.where(F.col("part") == HELD).groupBy("chunk").cogroup(answers.where(F.col("part") == HELD).groupBy("chunk"))
    cells = held.applyInArrow(_bin(max(1, n_all - n_held), n_rest), "bucket long, q2 long, q1 long, n long")
    # at most 64 buckets and a few hundred bins each way, however large the corpus
    table = [tuple(r) for r in cells.groupBy("bucket", "q2", "q1").agg(F.sum("n").alias("n")).collect()]
    model = Model(max(1, n_all), n_types, learn_weights(table))
    out = packed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score(model), "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")
