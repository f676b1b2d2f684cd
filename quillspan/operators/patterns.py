"""Many strings looked for in many texts at once.

The strings become an automaton that reads a text once, whatever their number, and reports
each one where it ends. They are sent to all tasks in blocks of bounded size, one pass over
the texts for each block; no text is joined with a string that it does not hold, and a
frequent word at the beginning of a string costs nothing more.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: So many strings, and so many of their characters, are sent to every executor at a time.
BLOCK_STRINGS = 50_000
BLOCK_CHARS = 4 << 20


def find_strings(texts: DataFrame, key: str, text: str, strings: DataFrame, string: str, whole_words: bool = False, block_strings: int = BLOCK_STRINGS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(string, key): each string of ``strings`` with every row of ``texts`` that holds it, once a row.

    With ``whole_words`` no letter or digit stands beside it. Null and empty strings and null
    texts give nothing; repeated strings count once; repeated rows of ``texts`` each count.
    A string longer than a block's characters makes a block of its own.
    """
    wanted = strings.select(F.col(string).alias("string")).where("string <> ''").distinct()
    size = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / block_strings), F.ceil(F.coalesce(F.sum(F.length("string")), F.lit(0)) / block_chars))
    blocks = int(wanted.agg(size).first()[0])
    kind = texts.schema[key].dataType.simpleString()
    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("t")).where("t is not null")
    found = None
    for k in range(blocks):
        own = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("string"), F.lit(blocks)) == k)
        sent = texts.sparkSession.sparkContext.broadcast([r[0] for r in own.collect()])  # a block

        def run(batches: Iterator, sent=sent) -> Iterator:
            import unicodedata

            import ahocorasick
            import pyarrow as pa

            names = ["string", "key"]
            automaton = ahocorasick.Automaton()
            for s in sent.value:
                automaton.add_word(s, s)
            if not sent.value:
                return
            automaton.make_automaton()
            beside = lambda t, i: 0 <= i < len(t) and unicodedata.category(t[i])[0] in "LN"
            for batch in batches:
                got: list[str] = []
                place: list[int] = []
                for i, t in enumerate(batch.column(1).to_pylist()):
                    here = set()
                    for end, s in automaton.iter(t):
                        if s not in here and not (whole_words and (beside(t, end + 1) or beside(t, end - len(s)))):
                            here.add(s)
                    got += here
                    place += [i] * len(here)
                yield pa.RecordBatch.from_arrays([pa.array(got, pa.string()), batch.column(0).take(pa.array(place, pa.int64()))], names=names)

        one = rows.mapInArrow(run, f"string string, key {kind}")
        found = one if found is None else found.unionAll(one)
    return found.select("string", F.col("key").alias(key))
