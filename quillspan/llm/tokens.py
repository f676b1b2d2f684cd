"""Token counts by the whole-token shortcut (operator 1).

A byte-level BPE vocabulary holds most frequent pre-tokens as one entry. Which of its
strings a tokenizer really encodes alone as one token (merges may lead elsewhere) is
proved once per worker, offline, by encoding every vocabulary string that is one
pre-token. A text is then cut into pre-tokens, equal ones are counted, those in the
proved set count as one token each, and only the rest is merged, each once per worker
while it stays in a bounded memo.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import ship

#: Fixed value: the pre-token pattern of the byte-level vocabularies.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose class (letter, number, space, other) is the same in both pattern engines, which a test proves; any other is asked for when met.
AGREED = "[^\\x00-\\u024f\\u2010-\\u2027\\u20ac]"
MEMO = 1 << 18


class WholeTokenCounter:
    """Counts tokens of texts as the library does, without begin, end or added tokens."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        pre = described["pre_tokenizer"]
        if pre != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} or described["normalizer"]:
            raise ValueError("the shortcut is proved for plain byte-level vocabularies only")
        self.lib = Tokenizer.from_file(path)
        self.split = regex.compile(PRE_TOKEN).findall
        specials = [t["content"] for t in described["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.odd = regex.compile(AGREED)
        self.kinds = [(k, regex.compile(p)) for k, p in (("L", r"\p{L}"), ("N", r"\p{N}"), ("S", r"\s"))]
        self.agrees: dict[str, bool] = {}
        self.single = self._prove(described["model"]["vocab"])
        self.memo: dict[str, int] = {}

    def _prove(self, vocab: dict[str, int]) -> frozenset[str]:
        """Vocabulary strings that are one pre-token and encode alone as one token."""
        from tokenizers.decoders import ByteLevel

        one = ByteLevel()
        texts = [t for t in (one.decode([v]) for v in vocab) if "�" not in t and self.split(t) == [t]]
        return frozenset(t for t, e in zip(texts, self.lib.encode_batch(texts, add_special_tokens=False)) if len(e.ids) == 1)

    def _agrees(self, c: str) -> bool:
        """Whether both engines put ``c`` into the same class."""
        if c not in self.agrees:
            ours = next((k for k, p in self.kinds if p.match(c)), "O")
            cut = lambda a: [e - s for _, (s, e) in self.lib.pre_tokenizer.pre_tokenize_str(a + c + "!")]
            theirs = "L" if cut("a") == [2, 1] else "N" if cut("1") == [2, 1] else "O" if cut("a") == [1, 2] else "S"
            self.agrees[c] = ours == theirs
        return self.agrees[c]

    def count(self, text: str) -> tuple[int, int]:
        """Number of tokens, and of those counted directly."""
        if not text:
            return 0, 0
        if self.odd.search(text) and not all(self._agrees(c) for c in set(text) if ord(c) > 0x24F):
            return len(self.lib.encode(text, add_special_tokens=False).ids), 0
        n = 0
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            n = len(parts) - 1
            pieces = Counter(x for part in parts for x in self.split(part))
        else:
            pieces = Counter(self.split(text))
        direct, rest, single, memo = 0, [], self.single, self.memo
        for piece, times in pieces.items():
            if piece in single:
                direct += times
            elif (m := memo.get(piece)) is not None:
                n += m * times
            else:
                rest.append(piece)
        if rest:
            if len(memo) + len(rest) > MEMO:
                memo.clear()
            for piece, e in zip(rest, self.lib.encode_batch(rest, add_special_tokens=False)):
                m = len(e.ids)
                n += m * pieces[piece]
                if len(piece) <= 64:
                    memo[piece] = m
        return n + direct, direct


_counters: dict[str, WholeTokenCounter] = {}


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """Tokens of every whole text: id, n_bytes, n_tokens, over_limit, n_direct.

    ``tokenizer_path`` names a byte-level BPE file that every executor has. A null text
    counts as empty (0 bytes, 0 tokens); a null id stays null; repeated rows each give a
    row; an empty table gives none; other columns are neither read nor returned, whatever
    their names. Special strings inside a text count as one token, as the library's
    default has it. No shuffle: one pass, with a memo bounded by ``MEMO`` entries.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        if tokenizer_path not in _counters:
            _counters[tokenizer_path] = WholeTokenCounter(tokenizer_path)
        count = _counters[tokenizer_path].count
        for batch in batches:
            got = [count(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([n for n, _ in got], pa.int64()), pa.array([d for _, d in got], pa.int64())],
                names=["_id", "n_bytes", "n_tokens", "n_direct"],
            )

    rows = rows.withColumn("_b", F.octet_length("_t").cast("long"))
    out = rows.mapInArrow(run, f"_id {fields['_id']}, n_bytes long, n_tokens long, n_direct long")
    return out.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_direct")
