"""Packing documents into training sequences by lexical retrieval (operator 6).

Three passes. Texts become token ids, and every task counts in how many documents each
token occurs, so document frequencies and the mean length are those of the whole corpus.
Each document's heaviest token by BM25 weight says where it goes: tokens are gathered into
shards of about ``SHARD_BYTES`` of text, so that documents on one subject meet however
large the corpus is; a token that holds more is split by a hash. Each shard is an inverted
index with BM25 weights over token ids. The longest unused document is the seed of a
window; the index returns its unused neighbours by score, and those that fit are taken
greedily. What is left of the window goes to the best neighbour that does not fit: it is
cut, and its rest is the next seed. So only the last window of a shard is padded.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import ship, stage

SHARD_BYTES = 6 << 20
#: Bytes of pieces that a worker remembers the ids of, in each of two generations.
MEMO_BYTES = 40 << 20
#: Bytes of text that are encoded at a time.
SLICE_BYTES = 6 << 20
K1, B = 1.2, 0.75
COMMON = 16

SPACE, LETTER, DIGIT, MARK = 0, 1, 2, 3


def _classes():
    """Class by byte; all bytes above ASCII are letters, see ``WordIds.plain``."""
    import numpy as np

    of = np.full(256, MARK, np.uint8)
    of[[9, 10, 11, 12, 13, 32]] = SPACE
    of[97:123] = of[128:] = LETTER
    of[48:58] = DIGIT
    return of


class WordIds:
    """Ids of texts, piece by piece: the tokenizer never joins over the borders of its pieces, so each different piece is encoded once.

    In texts of ASCII and Latin-1 letters the pieces are found here: A-Z and their accented
    kin are lower-cased; runs of letters, single digits, runs of marks and the contractions
    are pieces. The model, without the library's normaliser and splitter, then gives their
    ids; an id whose string has the end-of-word sign ends a piece. Other texts, and those
    that hold the beginning of a special string, go through the whole library.
    """

    def __init__(self, path: str, end: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import numpy as np
        from tokenizers import Tokenizer

        self.lib, self.end = Tokenizer.from_file(path), end
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        suffix = described["model"].get("end_of_word_suffix")
        kinds = [n["type"] for n in (described["normalizer"] or {}).get("normalizers", [])]
        if not suffix or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("pieces are found for lower-casing vocabularies with word ends only")
        bare = described | {"normalizer": None, "added_tokens": [], "post_processor": None}
        bare["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
        self.bare = Tokenizer.from_str(json.dumps(bare))
        self.ends = np.zeros(max(described["model"]["vocab"].values()) + 1, bool)
        self.ends[[i for t, i in described["model"]["vocab"].items() if t.endswith(suffix)]] = True
        self.of = _classes()
        # an edge lies between unlike classes and between digits
        self.edge = np.array([[a != b or a == DIGIT for b in range(4)] for a in range(4)]).reshape(-1)
        self.young: dict[bytes, object] = {}
        self.old: dict[bytes, object] = {}
        self.held = 0

    def plain(self, texts) -> object:
        """Which texts consist of ASCII, without other control characters, and Latin-1 letters, and hold no special string's beginning."""
        import pyarrow.compute as pc

        return pc.invert(pc.match_substring_regex(texts, "[^\t-\r\x20-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]|<\\|"))

    def _pieces(self, data, begins):
        """(pieces as a string array, number of pieces before each text) of lower-cased texts."""
        import numpy as np
        import pyarrow as pa

        data = data.copy()
        lead = np.flatnonzero(data[:-1] == 0xC3) + 1
        lead = lead[data[lead] <= 0x9E]
        data[lead] |= 0x20  # accented capitals
        kind = self.of[data]
        start = np.empty(len(data), bool)
        start[:1] = True
        start[1:] = self.edge[kind[:-1] * 4 + kind[1:]]
        own = begins[:-1]
        start[own[own < len(data)]] = True
        quote = np.flatnonzero((data == 39) & start)
        if len(quote):
            stop = begins[np.searchsorted(begins, quote, side="right")]  # of the quote's text
            after = [np.where(quote + k < stop, data[np.minimum(quote + k, len(data) - 1)], 32) for k in (1, 2)]
            one = np.isin(after[0], np.frombuffer(b"stmd", np.uint8))
            two = np.isin(after[0].astype(int) * 256 + after[1], [a * 256 + b for a, b in (b"re", b"ve", b"ll")])
            size = np.where(one, 2, np.where(two, 3, 0))
            quote, size, stop = quote[size > 0], size[size > 0], stop[size > 0]
            start[quote + 1] = False
            after = quote + size
            start[after[after < stop]] = True
        kept = kind != SPACE
        start &= kept
        at = np.flatnonzero(start)
        place = np.cumsum(kept, dtype=np.int32)
        offsets = np.append(place[at] - 1, place[-1] if len(place) else 0).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data[kept])])
        return pieces, np.searchsorted(at, begins)

    def _learn(self, pieces: list[bytes]) -> None:
        """Ids of new pieces; many are encoded in one call."""
        import numpy as np

        if self.held > MEMO_BYTES:
            self.old, self.young, self.held = self.young, {}, 0
        for k in range(0, len(pieces), 2000):
            some = pieces[k : k + 2000]
            ids = np.array(self.bare.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, np.uint32)
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(cuts) != len(some):
                raise ValueError("a piece was cut")
            raw = ids.tobytes()
            self.young.update(zip(some, (raw[4 * s : 4 * e] for s, e in zip([0, *cuts], cuts))))
        self.held += sum(map(len, pieces)) + 170 * len(pieces)

    def lower(self, texts):
        """ASCII lower-cased; the rest of it is done with the pieces."""
        import pyarrow.compute as pc

        return pc.ascii_lower(texts)

    def _fast(self, texts):
        """(flat ids, number of ids before each text) with the end after each text."""
        import numpy as np
        import pyarrow as pa

        low = self.lower(texts)
        begins = np.frombuffer(low.buffers()[1], np.int32)[low.offset : low.offset + len(low) + 1].astype(np.int64)
        data = np.frombuffer(low.buffers()[2] or b"", np.uint8)[begins[0] : begins[-1]]
        pieces, before = self._pieces(data, begins - begins[0])
        coded = pieces.dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        words, young, old = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self.young, self.old
        new = []
        for w in words:
            if w not in young:
                if (x := old.get(w)) is None:
                    new.append(w)
                else:
                    young[w] = x
                    self.held += len(w) + 170
        memo = young
        if new:
            self._learn(new)
            if self.young is not memo:  # a generation has just ended
                memo = memo | self.young
        ids = list(map(memo.__getitem__, words))
        ids.append(np.uint32(self.end).tobytes())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, first = np.frombuffer(b"".join(ids), np.uint32), np.cumsum(size) - size
        place = np.insert(coded.indices.to_numpy().astype(np.int64), before[1:], len(words))
        size = size[place]
        ends = np.cumsum(size)
        out = flat[np.repeat(first[place] - (ends - size), size) + np.arange(int(ends[-1]))]
        return out, np.append(0, ends[before[1:] + np.arange(len(texts))])

    def encode(self, texts):
        """(flat ids, number of ids before each text, and at last of all) of a string array, the end id after each text."""
        import numpy as np

        plain = self.plain(texts).to_numpy(zero_copy_only=False)
        if plain.all():
            return self._fast(texts)
        some, other = np.flatnonzero(plain), np.flatnonzero(~plain)
        flat, before = self._fast(texts.take(some)) if len(some) else (np.zeros(0, np.uint32), [0])
        own: list = [None] * len(texts)
        for k, i in enumerate(some.tolist()):
            own[i] = flat[before[k] : before[k + 1]]
        for i, e in zip(other.tolist(), self.lib.encode_batch_fast(texts.take(other).to_pylist(), add_special_tokens=False)):
            own[i] = np.array([*e.ids, self.end], np.uint32)
        return np.concatenate(own), np.append(0, np.cumsum([len(x) for x in own]))


_words: dict[tuple[str, int], WordIds] = {}


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _distinct(flat, begins):
    """(document, id, times) of the different ids of each document, by document and id."""
    import numpy as np

    bits, kind = (16, np.uint32) if flat.dtype.itemsize == 2 and len(begins) <= 1 << 16 else (32, np.int64)
    key = np.sort((np.repeat(np.arange(len(begins) - 1, dtype=kind), np.diff(begins)) << kind(bits)) | flat.astype(kind))
    at = np.append(0, np.flatnonzero(key[1:] != key[:-1]) + 1) if len(key) else np.zeros(0, np.int64)
    return (key[at] >> kind(bits)).astype(np.int64), (key[at] & kind((1 << bits) - 1)).astype(np.int64), np.diff(at, append=len(key))


def _binary(flat, begins):
    """A binary array of the slices of ``flat``."""
    import numpy as np
    import pyarrow as pa

    return pa.Array.from_buffers(pa.binary(), len(begins) - 1, [None, pa.py_buffer((np.asarray(begins) * flat.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


def _flat(column, kind: str):
    """(ids, number before each document) of a binary array."""
    import numpy as np

    begins = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[begins[0] : begins[-1]]
    return data.view(kind), (begins - begins[0]) // np.dtype(kind).itemsize


ENCODED = "id long, salt long, n_bytes long, ids binary, df binary"


def token_ids(docs: DataFrame, tokenizer_path: str, end: int, id_col: str, text_col: str) -> DataFrame:
    """(id, salt, n_bytes, ids, df): ids of every whole text, then the end id, as little-endian unsigned integers of 16 bits if the vocabulary fits, else 32.

    Each task adds one row whose ``df`` holds, by id, in how many of its documents the id
    occurs (64 bits each); in all other rows it is null.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.withColumn("salt", F.xxhash64("id", "t"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        key = (tokenizer_path, end)
        if key not in _words:
            _words[key] = WordIds(*key)
        size = _words[key].lib.get_vocab_size()
        df = np.zeros(size, np.int64)
        names = ["id", "salt", "n_bytes", "ids", "df"]
        for batch in batches:
            length = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = np.cumsum(length)
            done = 0
            while done < batch.num_rows:
                to = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + SLICE_BYTES)))
                flat, begins = _words[key].encode(batch.column(1)[done:to])
                flat = flat.astype(id_type(size))
                df += np.bincount(_distinct(flat, begins)[1], minlength=size)
                yield pa.RecordBatch.from_arrays([batch.column(0)[done:to], batch.column(2)[done:to], pa.array(length[done:to]), _binary(flat, begins), pa.nulls(to - done, pa.binary())], names=names)
                done = to
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([df.tobytes()], pa.binary())], names=names)

    return rows.mapInArrow(run, ENCODED)


def frequencies(encoded: DataFrame, size: int):
    """In how many documents each id occurs; the tasks' counts are added by id, which leaves one row for each of the ``size`` ids at most."""
    import numpy as np

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.frombuffer(x, np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "n"])

    counts = encoded.where("df is not null").select("df").mapInArrow(add, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    df = np.zeros(size, np.int64)
    for r in counts.collect():
        df[r["term"]] = r["n"]
    return df


def bm25(df, n_docs: int, term, tf, length, mean: float):
    """Weight of each (document, id) from how often the id occurs there and the document's length."""
    import numpy as np

    idf = np.log1p((n_docs - df + 0.5) / (df + 0.5))
    return idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def with_subject(encoded: DataFrame, df, n_docs: int, mean: float, kind: str) -> DataFrame:
    """(id, salt, n_bytes, ids, subject): the heaviest id in each document of those that others hold too, else the heaviest."""
    sent = encoded.sparkSession.sparkContext.broadcast(df)  # as long as the vocabulary

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            flat, begins = _flat(batch.column(3), kind)
            doc, term, tf = _distinct(flat, begins)
            weight = bm25(sent.value, n_docs, term, tf, np.diff(begins)[doc], mean)
            weight -= np.where(sent.value[term] < 2, 1e6, 0.0)
            begin = np.flatnonzero(np.diff(doc, prepend=-1))
            top = np.maximum.reduceat(weight, begin) if len(begin) else weight
            heaviest = np.flatnonzero(weight == np.repeat(top, np.diff(begin, append=len(doc))))
            first = heaviest[np.flatnonzero(np.diff(doc[heaviest], prepend=-1))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(term[first], pa.int64())], names=["id", "salt", "n_bytes", "ids", "subject"])

    return encoded.where("ids is not null").select("id", "salt", "n_bytes", "ids").mapInArrow(run, "id long, salt long, n_bytes long, ids binary, subject long")


def deal(sizes: list[tuple[int, int]], shard_bytes: int) -> list[tuple[int, int, int]]:
    """(subject, first shard, shards): small subjects share a shard, one beyond a shard's size has several of its own."""
    out, shard, held = [], 0, 0
    for subject, size in sorted(sizes):
        parts = -(-size // shard_bytes)
        if parts > 1 or held + size > shard_bytes:
            shard, held = shard + (held > 0), 0
        out.append((subject, shard, max(1, parts)))
        if parts > 1:
            shard += parts
        else:
            held += size
    return out


class Index:
    """BM25 inverted index over the documents of a shard, with the corpus's document frequencies.

    A term's list is a row of a dense matrix where one document in ``COMMON`` or more holds
    the term, and a list of documents and weights elsewhere.
    """

    def __init__(self, flat, begins, df=None, n_docs: int = 0, mean: float = 0.0) -> None:
        import numpy as np

        sizes = np.diff(begins)
        doc, term, tf = _distinct(flat, begins)
        if df is None:
            df, n_docs, mean = np.bincount(term), len(sizes), sizes.mean()
        self.row = np.searchsorted(doc, np.arange(len(sizes) + 1))
        self.row_term = term
        weight = bm25(df, n_docs, term, tf, sizes[doc], mean)
        by_term = np.argsort(term, kind="stable")
        self.place = np.full(int(term.max()) + 1, -1)  # of a term's list, if there is one
        self._post(np.arange(len(sizes)), doc[by_term], term[by_term], weight[by_term])

    def _post(self, docs, doc, term, weight) -> None:
        """Lists of the documents ``docs``; ``doc`` has places in it."""
        import numpy as np

        self.docs, self.doc, self.term, self.weight = docs, doc, term, weight
        begin = np.flatnonzero(np.diff(term, prepend=-1))
        end = np.append(begin[1:], len(term))
        common = (end - begin) * COMMON >= len(docs)
        self.place[:] = -1
        self.place[term[begin[common]]] = np.arange(int(common.sum()))
        self.dense = np.zeros((int(common.sum()), len(docs)), np.float32)
        held = np.repeat(common, end - begin)
        self.dense[self.place[term[held]], doc[held]] = weight[held]
        rare = begin[~common]
        self.place[term[rare]] = len(self.dense) + np.arange(len(rare))
        self.begin, self.end = rare, end[~common]

    def forget(self, used) -> None:
        """Leave used documents out of the lists."""
        import numpy as np

        left = ~used[self.docs]
        place = np.cumsum(left) - 1
        own = left[self.doc]
        self._post(self.docs[left], place[self.doc[own]], self.term[own], self.weight[own])

    def neighbours(self, seed: int):
        """Documents by falling score for all the seed's terms, those without a shared term last."""
        import numpy as np

        at = self.place[self.row_term[self.row[seed] : self.row[seed + 1]]]
        asked = np.zeros(len(self.dense), np.float32)
        asked[at[(at >= 0) & (at < len(asked))]] = 1
        score = asked @ self.dense
        rare = at[at >= len(asked)] - len(asked)
        spans = list(zip(self.begin[rare].tolist(), self.end[rare].tolist()))
        if spans:
            score = score + np.bincount(np.concatenate([self.doc[s:e] for s, e in spans]), np.concatenate([self.weight[s:e] for s, e in spans]), len(self.docs))
        return self.docs[np.argsort(-score, kind="stable")]


def fill_windows(index: Index, sizes, window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece; each token lies in one piece."""
    import numpy as np

    unused = np.ones(len(sizes), bool)
    order = iter(np.argsort(-sizes, kind="stable").tolist())
    sequence = at = 0
    listed = len(sizes)  # documents in the index's lists
    carry: tuple[int, int] | None = None  # a document and where its rest begins
    while True:
        if carry is None:
            longest = next((d for d in order if unused[d]), None)
            if longest is None:
                return
            carry = (longest, 0)
            unused[longest] = False
        seed, start = carry
        take = min(window, int(sizes[seed]) - start)
        yield seed, start, take, sequence, 0
        carry, at = None, take
        if start + take < sizes[seed]:
            carry = (seed, start + take)
        elif at < window and (left := int(unused.sum())):
            if left * 4 < listed * 3:
                index.forget(~unused)
                listed = left
            near = index.neighbours(seed)
            near = near[unused[near]]
            first = int(near[0])
            # those that fit, by score: cumulative sizes cut the list in a few rounds
            while len(near):
                near = near[sizes[near] <= window - at]
                fits = near[: int(np.searchsorted(np.cumsum(sizes[near]), window - at, side="right"))]
                if not len(fits):
                    break
                for d in fits.tolist():
                    yield d, 0, int(sizes[d]), sequence, at
                    at += int(sizes[d])
                unused[fits] = False
                near = near[len(fits) :]
            if at < window and unused.any():
                cut = first if unused[first] else int(np.flatnonzero(unused)[np.argmax(sizes[unused])])
                unused[cut] = False
                yield cut, 0, window - at, sequence, at
                carry = (cut, window - at)
        sequence += 1


def pack(docs: DataFrame, tokenizer_path: str, end: int = 2, window: int = 4096, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per piece: id, start, length, doc_tokens, sequence_id, offset, ids.

    ``ids`` holds the piece's token ids as little-endian unsigned 32-bit integers. A null
    text counts as empty: one token, the end. A null id stays null; repeated rows are
    documents of their own. An empty table gives an empty result; other columns are not
    read. The number of shards grows with the input and a task holds about ``shard_bytes``
    of text, or one longer document. A seed's neighbours are those of its shard, scored
    over all its terms with the corpus's frequencies; documents whose heaviest terms differ
    may lie in other shards and are then not found.
    """
    from tokenizers import Tokenizer

    size = Tokenizer.from_file(tokenizer_path).get_vocab_size()
    kind = id_type(size)
    encoded = stage(token_ids(docs, tokenizer_path, end, id_col, text_col), "encoded")
    n_docs, n_ids = encoded.where("ids is not null").agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("ids")), F.lit(0))).first()
    mean = n_ids / (2 if kind == "<u2" else 4) / max(1, n_docs)
    df = frequencies(encoded, size)
    rows = with_subject(encoded, df, n_docs, mean, kind)
    sizes = [(r["subject"], r["n"]) for r in rows.groupBy("subject").agg(F.sum(F.col("n_bytes") + 1).alias("n")).collect()]  # a row per id of the vocabulary at most
    shards = docs.sparkSession.createDataFrame(deal(sizes, shard_bytes), "subject long, shard long, parts long")
    dealt = rows.join(F.broadcast(shards), "subject").select((F.col("shard") + F.pmod("salt", "parts")).alias("shard"), "id", "ids")
    sent = docs.sparkSession.sparkContext.broadcast(df)

    def run(key, rows):
        import numpy as np
        import pyarrow as pa

        shard = key[0].as_py()
        rows = rows.combine_chunks().sort_by([("id", "ascending"), ("ids", "ascending")])
        ids = rows["ids"].combine_chunks()
        flat, begins = _flat(ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids, kind)
        sizes = np.diff(begins)
        doc, start, length, sequence, offset = np.array(list(fill_windows(Index(flat, begins, sent.value, n_docs, mean), sizes, window)), np.int64).T
        at = begins[doc] + start
        upto = np.cumsum(length)
        out = flat[np.repeat(at - (upto - length), length) + np.arange(int(upto[-1]))].astype("<u4")
        whole = rows["id"].take(pa.array(doc))
        columns = [whole, start, length, sizes[doc], (shard << 32) | sequence, offset, _binary(out, np.append(0, upto))]
        return pa.table(dict(zip(["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"], columns)))

    out = dealt.groupBy("shard").applyInArrow(run, "id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
    return out.select(F.col("id").alias(id_col), "start", "length", "doc_tokens", "sequence_id", "offset", "ids")
