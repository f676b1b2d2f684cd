"""Vector code compression by product quantisation with Orchard search (operator 11).

Vectors become integers and are cut into equal parts; each part position has a codebook of a
few entries, refined by a fixed number of rounds: every part goes to its nearest entry, every
entry becomes the floored mean of its parts. The nearest entry is found by Orchard's search:
each entry has a list of the others by their distance from it; a search looks along the list
of the best entry so far, jumps to the list of a better one when it meets it, marks what it
has visited and stops at the first entry farther from the current one than twice the current
distance, beyond which nothing can be nearer. Numpy makes the same step for a batch of parts.

Only codebooks, and sums and counts per entry, come to the driver; their size depends on the
parameters alone. A pass over the vectors shuffles one row per task and entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import join_split, ship, stage
from quillspan.sources.tables import spread

#: Components, once integers, are held within this, so that distances of up to 128 components fit 64 bits.
MOST = 1 << 27


class Orchard:
    """Nearest entries in the codebooks of all part positions: (parts, entries, positions) integers."""

    def __init__(self, books) -> None:
        import numpy as np

        self.books = np.asarray(books, np.int64)
        apart = ((self.books[:, :, None, :] - self.books[:, None, :, :]) ** 2).sum(3)
        order = np.argsort(apart, axis=2, kind="stable")  # an entry's own place is among those at distance 0
        self.lists = order
        self.apart = np.take_along_axis(apart, order, 2)
        self.visits = 0

    def nearest(self, parts, start=None):
        """(entry, squared distance) of each row of ``parts`` (rows, part positions, positions), ties to the lower index.

        ``start`` has the entries where the searches begin. The bound is compared in squares: beyond twice is beyond four times.
        """
        import numpy as np

        rows, n_parts, _ = parts.shape
        n_entries = self.books.shape[1]
        query = parts.reshape(rows * n_parts, -1)
        book = np.tile(np.arange(n_parts), rows)
        best = np.zeros(len(query), np.int64) if start is None else start.reshape(-1).astype(np.int64)
        far = ((query - self.books[book, best]) ** 2).sum(1)
        self.visits += len(query)
        seen = np.zeros((len(query), n_entries), bool)
        seen[np.arange(len(query)), best] = True
        at = np.zeros(len(query), np.int64)
        live = np.arange(len(query))
        while len(live):
            live = live[at[live] < n_entries]
            b, e, k = book[live], best[live], at[live]
            go = self.apart[b, e, k] <= 4 * far[live]
            live, b, e, k = live[go], b[go], e[go], k[go]
            other = self.lists[b, e, k]
            at[live] += 1
            new = ~seen[live, other]
            some, other, b = live[new], other[new], b[new]
            seen[some, other] = True
            d = ((query[some] - self.books[b, other]) ** 2).sum(1)
            self.visits += len(some)
            better = (d < far[some]) | ((d == far[some]) & (other < best[some]))
            some, other, d = some[better], other[better], d[better]
            best[some], far[some], at[some] = other, d, 0
        return best.reshape(rows, n_parts), far.reshape(rows, n_parts)


def integer_vectors(rows: DataFrame, vector_col: str, parts: int, scale: int) -> DataFrame:
    """Rows whose vector is not null, has no null or non-finite component and can be cut, with it as ``v`` of integers: floor(scale * x)."""
    v = F.col(vector_col).cast("array<double>")
    whole = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    cut = F.transform(v, lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(float(MOST))), F.lit(float(-MOST)))).cast("int"))
    return rows.where(F.coalesce(whole, F.lit(False)) & (F.size(v) > 0) & (F.size(v) % parts == 0)).withColumn("v", cut)


def _matrix(column, n_parts: int):
    """The vectors of a list array as (rows, part positions, positions)."""
    import numpy as np

    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), n_parts, -1)


def learn(vectors: DataFrame, books, rounds: int):
    """Codebooks after ``rounds`` rounds over ``vectors`` (v)."""
    import numpy as np

    books = np.asarray(books, np.int64)
    n_parts, _, width = books.shape
    context = vectors.sparkSession.sparkContext
    for _ in range(rounds):
        sent = context.broadcast(books)

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            search = Orchard(sent.value)
            shape = sent.value.shape
            sums, counts = np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64)
            for batch in batches:
                if batch.num_rows:
                    got = _matrix(batch.column(0), n_parts)
                    entry, _ = search.nearest(got)
                    place = np.broadcast_to(np.arange(n_parts), entry.shape)
                    np.add.at(sums, (place, entry), got)
                    np.add.at(counts, (place, entry), 1)
            part, entry = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "n", "s"])

        each = vectors.select("v").mapInArrow(run, "part long, entry long, n long, s array<long>")
        total = each.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[k].cast("decimal(38,0)")) for k in range(width)]).alias("s"))
        books = books.copy()
        for r in total.collect():  # a row per entry
            books[r["part"], r["entry"]] = [int(x) // r["n"] for x in r["s"]]
    return books


def compress(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """One row per kept vector: id, code, error, label_error, codebooks_sha256.

    Dropped are vectors that are null or hold a null or non-finite component, and such as
    cannot be compared: empty ones, those that ``parts`` does not divide, and those of another
    length than the kept one with the smallest id. A component becomes floor(scale * x), held
    within 2**27. A codebook starts as that part of the ``entries`` smallest kept ids (fewer if
    there are not so many), ascending, equal ids by vector, a null id first. ``code`` has an entry's
    index in part order, each as two hex digits; ``error`` adds the squared distances over
    the parts; ``label_error`` adds the errors of equal labels, nulls together. Entries that
    no part chooses stay. Repeated rows count as often as they occur and each gives a row.
    No kept vector gives an empty result; other columns are not read.
    """
    import numpy as np

    if entries > 256:
        raise ValueError("an index must fit two hex digits")
    spark = rows.sparkSession
    ship(spark)
    named = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("x"))
    kept = stage(integer_vectors(spread(named), "x", parts, scale).select("id", "label", "v"), "vectors")
    first = kept.orderBy("id", "v").limit(1).select(F.size("v")).collect()
    width = first[0][0] if first else parts
    kept = kept.where(F.size("v") == width)
    begin = [r[0] for r in kept.orderBy("id", "v").limit(entries).select("v").collect()]
    books = np.array(begin, np.int64).reshape(len(begin), parts, -1).transpose(1, 0, 2) if begin else np.zeros((parts, 1, 1), np.int64)
    books = learn(kept, books, rounds if begin else 0)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    sent = spark.sparkContext.broadcast(books)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        search = Orchard(sent.value)
        for batch in batches:
            if batch.num_rows:
                entry, far = search.nearest(_matrix(batch.column(2), parts))
                code = [bytes(x).hex() for x in entry.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code), pa.array(far.sum(1))], names=["id", "label", "code", "error"])

    kind = named.schema["label"].dataType.simpleString()
    coded = stage(kept.mapInArrow(run, f"id long, label {kind}, code string, error long"), "codes")
    keyed = coded.withColumns({"none": F.col("label").isNull(), "name": F.coalesce(F.col("label").cast("string"), F.lit(""))}).drop("label")
    top = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
    labels = keyed.groupBy("none", "name").agg(top.alias("label_error"), F.count(F.lit(1)).alias("times"))
    out = join_split(keyed, labels, ["none", "name"], "times")
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
