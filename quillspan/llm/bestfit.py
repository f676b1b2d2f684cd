"""Best-fit packing with large-item matching (operator 12).

A piece's length is a number from 1 to the window, so a corpus is, for the plan, a count per
length: ``window`` numbers, however many documents there are. The plan is made on the counts.
Pieces above a third of the window pair at most twice per sequence: from the longest down,
each is matched with the longest that still fits beside it, and matches of the same two
lengths are made in one step. Shorter pieces then go, from the longest down, each to the
smallest gap that holds it; sequences that look alike take theirs together. The plan is a list
of runs: pieces of one length, from one place among these to another, go to consecutive
sequences at one offset. Pieces are numbered within their length in Spark, by ranges, and
look up their run.
"""

from __future__ import annotations

import os
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import ranked, ship, stage
from quillspan.llm.packing import LETTER, SPACE, WordIds, _binary, _classes

#: Of text that is encoded at a time, and of pre-tokens that a task keeps; the vocabulary is held twice, so that both are small.
SLICE_BYTES = 1 << 20
MEMO_BYTES = 12 << 20
RUN_FIELDS = ("length", "rank", "sequence", "offset", "each")


def _bare(model: dict):
    """An encoder of pieces under a vocabulary whose merges are in the order of their ids; a null character is a piece of its own."""
    import tiktoken

    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # bytes that stand for themselves
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    joined = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    order = [model["vocab"][t] for t in joined]
    if order != sorted(set(order)) or order[0] != 256:
        raise ValueError("the merges are not in the order of the ids")
    ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if i < 256 + len(joined)}
    return tiktoken.Encoding("pieces", pat_str=r"\x00|[^\x00]+", mergeable_ranks=ranks, special_tokens={})


class ByteIds(WordIds):
    """Ids of texts under a byte-level vocabulary, each different pre-token encoded once: merges never cross its ends.

    In texts of ASCII and Latin-1 letters the pre-tokens are found here: runs of letters, of
    digits and of marks, each with one blank before it, the contractions, and white space:
    the last character of a run of it is a pre-token of its own, if it is no blank that the
    next one takes. Other texts, and those that hold the beginning of a special string, go
    through the whole library.
    """

    def __init__(self, path: str, end: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import numpy as np
        from tokenizers import Tokenizer

        self.lib, self.end = Tokenizer.from_file(path), end
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        if described["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} or described["normalizer"]:
            raise ValueError("pieces are found for plain byte-level vocabularies only")
        self.bare = _bare(described["model"])
        (self.null,) = self.bare.encode_ordinary("\0")
        self.of = _classes()
        self.of[65:91] = LETTER
        self.edge = np.array([[a != b for b in range(4)] for a in range(4)]).reshape(-1)
        self.young: dict[bytes, object] = {}
        self.old: dict[bytes, object] = {}
        self.held = 0

    def lower(self, texts):
        return texts

    def _pieces(self, data, begins):
        """(pre-tokens as a binary array, number of pre-tokens before each text)."""
        import numpy as np
        import pyarrow as pa

        size = len(data)
        kind = self.of[data]
        start = np.empty(size, bool)
        start[:1] = True
        start[1:] = self.edge[kind[:-1] * 4 + kind[1:]]
        own = begins[:-1]
        start[own[own < size]] = True
        quote = np.flatnonzero((data == 39) & start)
        if len(quote):
            stop = begins[np.searchsorted(begins, quote, side="right")]  # of the quote's text
            head = begins[np.searchsorted(begins, quote, side="right") - 1] == quote
            quote, stop = quote[head | (data[quote - 1] != 32)], stop[head | (data[quote - 1] != 32)]
            after = [np.where(quote + k < stop, data[np.minimum(quote + k, size - 1)], 32) for k in (1, 2)]
            one = np.isin(after[0], np.frombuffer(b"stmd", np.uint8))
            two = np.isin(after[0].astype(int) * 256 + after[1], [a * 256 + b for a, b in (b"re", b"ve", b"ll")])
            length = np.where(one, 2, np.where(two, 3, 0))
            quote, length, stop = quote[length > 0], length[length > 0], stop[length > 0]
            start[quote + 1] = False
            after = quote + length
            start[after[after < stop]] = True
        # the last white space before something else: a blank begins the next pre-token, another one stands alone
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & start[1:]) if size else np.zeros(0, np.int64)
        closes = np.zeros(size + 1, bool)
        closes[begins] = True
        last = last[~closes[last + 1]]
        start[last] = True
        start[last[data[last] == 32] + 1] = False
        at = np.flatnonzero(start)
        offsets = np.append(at, size).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
        return pieces, np.searchsorted(at, begins)

    def _learn(self, pieces: list[bytes]) -> None:
        import numpy as np

        if self.held > MEMO_BYTES:
            self.old, self.young, self.held = self.young, {}, 0
        for k in range(0, len(pieces), 2000):
            some = pieces[k : k + 2000]
            ids = np.array(self.bare.encode_ordinary(b"\0".join([*some, b""]).decode()), np.uint32)
            cuts = np.flatnonzero(ids == self.null).tolist()
            if len(cuts) != len(some):
                raise ValueError("a piece was cut")
            raw = ids.tobytes()
            self.young.update(zip(some, (raw[4 * s : 4 * e] for s, e in zip([0, *(c + 1 for c in cuts)], cuts))))
        self.held += sum(map(len, pieces)) + 170 * len(pieces)


_encoders: dict[tuple[str, int], ByteIds] = {}
PIECES = "id {kind}, piece int, start long, length long, ids binary"


def cut_pieces(docs: DataFrame, tokenizer_path: str, end: int = 0, window: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids): the token ids of every whole text and the end id, as one piece if they fit the window.

    Longer ones are cut so that all pieces but the first have the window's length. ``ids``
    holds little-endian unsigned 32-bit integers. A null text counts as empty: one token,
    the end. A null id stays null, repeated rows give repeated pieces, an empty table gives
    none, other columns are not read. No shuffle; a text is encoded as a whole, others in
    slices of a few megabytes.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        key = (tokenizer_path, end)
        if key not in _encoders:
            _encoders[key] = ByteIds(*key)
        for batch in batches:
            upto = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
            done = 0
            while done < batch.num_rows:
                to = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + SLICE_BYTES)))
                flat, begins = _encoders[key].encode(batch.column(1)[done:to])
                sizes = np.diff(begins)
                n = -(-sizes // window)
                doc = np.repeat(np.arange(len(sizes)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                first = sizes - (n - 1) * window  # the first piece takes what is over
                start = np.where(piece == 0, 0, first[doc] + (piece - 1) * window)
                length = np.where(piece == 0, first[doc], window)
                ids = _binary(flat.astype("<u4"), np.append(0, np.cumsum(length)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[done:to].take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), ids], names=["id", "piece", "start", "length", "ids"])
                done = to

    return rows.mapInArrow(run, PIECES.format(kind=kind)).withColumnRenamed("id", id_col)


def plan(counts: dict[int, int], window: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(runs, number of sequences) for so many pieces of each length.

    A run (length, rank, sequence, offset, each): pieces of this length from the ``rank``-th
    on go to sequences from ``sequence`` on, ``each`` to a sequence, the first at ``offset``
    there. A length's runs ascend by rank and leave none out.

    Sequences that look alike are kept as one class (first, number, filled). A class splits
    only at the last step of a length, and a sequence holds fewer than sqrt(2 window) + 1
    different lengths, so the number of runs depends on the window, not on the counts.
    """
    left = {s: n for s, n in counts.items() if n}
    if any(not 0 < s <= window for s in left):
        raise ValueError("a length is outside the window")
    placed: dict[int, int] = defaultdict(int)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: (first sequence, number)
    total = 0

    def put(length: int, number: int, sequence: int, offset: int, each: int = 1) -> None:
        runs.append((length, placed[length], sequence, offset, each))
        placed[length] += number
        left[length] -= number

    large = sorted((s for s in left if 3 * s > window), reverse=True)
    for a in large:
        for b in (b for b in large if b <= min(a, window - a)):
            if not left[a]:
                break
            t = left[a] // 2 if a == b else min(left[a], left[b])
            if t:
                put(a, t, total, 0)
                put(b, t, total, a)
                gaps[window - a - b].append((total, t))
                total += t
        if n := left[a]:
            put(a, n, total, 0)
            gaps[window - a].append((total, n))
            total += n
    small = sorted((s for s in left if 3 * s <= window), reverse=True)
    for s in small:
        open_gaps = [g for g in gaps if g >= s and gaps[g]]
        heapify(open_gaps)
        while left[s]:
            if not open_gaps:  # new sequences, as many as the pieces fill
                number = -(-left[s] // (window // s))
                gaps[window].append((total, number))
                total += number
                heappush(open_gaps, window)
            g = heappop(open_gaps)
            each = g // s
            while gaps[g] and left[s]:
                first, number = gaps[g].pop()
                whole = min(number, left[s] // each)
                rest = left[s] - whole * each if whole < number else 0
                if whole:
                    put(s, whole * each, first, window - g, each)
                    gaps[g - each * s].append((first, whole))
                if rest:  # fewer pieces than one more sequence would take
                    put(s, rest, first + whole, window - g, each)
                    gaps[g - rest * s].append((first + whole, 1))
                    whole += 1
                if whole < number:
                    gaps[g].append((first + whole, number - whole))
    return sorted(runs), total


def place(pieces: DataFrame, window: int = 2048, id_col: str = "doc_id") -> DataFrame:
    """``pieces`` (id, piece, length and any others) with ``sequence_id`` and ``offset``.

    Sequences are numbered from 0 and have no gap between pieces; what is over at the end is
    padding. Only the counts per length, ``window`` numbers at most, come to the driver, and
    only the plan's runs go to the tasks. A length of which there are very many is numbered by
    ranges like any other. Equal rows take different places. No piece gives no row.
    """
    names = pieces.columns
    inner = stage(pieces.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)]), "pieces")
    id_at, piece_at, length_at = (f"c{names.index(c)}" for c in (id_col, "piece", "length"))
    counts = {r[0]: r[1] for r in inner.groupBy(length_at).agg(F.count(F.lit(1))).collect()}
    runs, _ = plan(counts, window)
    placed = ranked(inner, [length_at], [id_at, piece_at], "by-length").drop("n")
    sent = inner.sparkSession.sparkContext.broadcast(runs)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        table = np.array(sent.value, np.int64).reshape(-1, len(RUN_FIELDS))
        wide = np.int64(1) << 48
        begins = table[:, 0] * wide + table[:, 1]
        for batch in batches:
            length = batch.column(batch.schema.get_field_index(length_at)).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy(zero_copy_only=False)
            own = table[np.searchsorted(begins, length * wide + rank, side="right") - 1]
            beyond = rank - own[:, 1]
            columns = [batch.column(k) for k in range(len(names))]
            columns += [pa.array(own[:, 2] + beyond // own[:, 4]), pa.array(own[:, 3] + beyond % own[:, 4] * length)]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f"c{k}" for k in range(len(names))), "sequence_id", "offset"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in inner.schema)
    out = placed.mapInArrow(run, f"{fields}, sequence_id long, offset long")
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)], "sequence_id", "offset")


def pack(docs: DataFrame, tokenizer_path: str, end: int = 0, window: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of ``cut_pieces``, with its ids, its ``sequence_id`` and its ``offset``; as few sequences as best fit makes."""
    return place(cut_pieces(docs, tokenizer_path, end, window, id_col, text_col), window, id_col)
