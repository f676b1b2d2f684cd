"""Vector codes, best-fit packing and the Merkle manifest against plain versions and on awkward rows."""

import hashlib
import random
import struct
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillspan.llm import bestfit, merkle, orchard
from quillspan.llm.queries import tokenizer_file

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000 + "x" * 60_000 + " " + "7" * 50_000
CLASHING = ("id", "c0", "c1", "grp", "idx", "n", "digest", "left", "rank", "path", "root", "v", "label_error", "sequence_id", "piece", "length", "t", "_read", "_at", "times")


# 11: vector codes


def plain_codes(rows, parts, entries, rounds):
    """Every part compared with every entry."""
    kept = [(i, [int(4096 * x // 1) for x in v], lab) for i, v, lab in rows if v and None not in v and all(abs(x) < float("inf") for x in v)]
    kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    best = lambda q, book: min((sum((a - b) ** 2 for a, b in zip(q, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for _, v, _ in kept:
                own[best(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(x) // len(own[e]) for x in zip(*own[e])] if own[e] else c for e, c in enumerate(books[p])]
    found = [(i, [best(cut(v, p), books[p]) for p in range(parts)], lab) for i, v, lab in kept]
    by_label = Counter()
    for _, f, lab in found:
        by_label[lab] += sum(d for d, _ in f)
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return sorted((i if i is not None else -1, "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), by_label[lab], digest) for i, f, lab in found)


def vectors(seed, n, dim, step):
    rng = random.Random(seed)
    return [(k, [rng.randrange(-step, step) / 4096 for _ in range(dim)], rng.choice([None, 0, 1, 1, 1])) for k in range(n)]


def codes(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(1) for c in CLASHING})
    return sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in orchard.compress(df, **options).collect())


@pytest.mark.parametrize("step", [2, 3000])  # few different values: many ties and equal entries
def test_op11_equals_comparing_every_entry(spark, step):
    rows = vectors(step, 150, 16, step)
    rows += [(200, None, 1), (201, [], 1), (202, [None] * 16, 1), (203, [float("nan")] * 16, 1), (204, [float("inf")] * 16, 2), (None, rows[3][1], None), (5, rows[5][1], 1), (5, rows[5][1], 1)]
    assert codes(spark, rows) == plain_codes(rows, 8, 16, 6)


def test_op11_on_awkward_tables(spark):
    assert codes(spark, []) == [] and codes(spark, [(1, None, 1), (2, [], 1), (3, [1.0] * 7, None)]) == []
    few = vectors(1, 3, 8, 100)
    assert codes(spark, few) == plain_codes(few, 8, 16, 6)
    # another length than the first one's goes; components beyond the range are held within it
    got = codes(spark, [*few, (9, [0.0] * 16, 1), (10, [1e30] * 8, 7)])
    assert [r[0] for r in got] == [0, 1, 2, 10] and got[-1][2] == 0


def test_op11_search_is_exact_and_skips_entries():
    import numpy as np

    rng = np.random.default_rng(4)
    books = rng.integers(-4, 5, (3, 16, 4)) + rng.integers(0, 4, (1, 16, 1)) * 60
    parts = rng.integers(-8, 9, (500, 3, 4)) + rng.integers(0, 4, (500, 3, 1)) * 60  # near entries, as most parts are
    search = orchard.Orchard(books)
    far = ((parts[:, :, None, :] - books[None]) ** 2).sum(3)
    for start, most in ((None, 0.8), (rng.integers(0, 16, (500, 3)), 0.8), (far.argmin(2), 0.4)):
        search.visits = 0
        entry, d = search.nearest(parts, start)
        assert (entry == far.argmin(2)).all() and (d == far.min(2)).all()
        assert search.visits < most * far.size


# 12: best fit


def test_op12_ids_equal_the_library():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    lib, own = Tokenizer.from_file(path), bestfit.ByteIds(path, 0)
    rng = random.Random(3)
    bits = ["a", "b", "s", "t", "re", "ve", "ll", "'", "s", "''", " ", "  ", "\n", "\t", "\n\n", " \n", "1", "23", "!", "...", "é", "Ü", "ß", "x", "The", " the", "<", "don't", "\r\n", "'S", "m", "d", "-", "\x0b", "中", "\xa0", "<|endoftext|>", "\x00", "×"]
    texts = ["".join(rng.choices(bits[:-5] if k % 4 else bits, k=rng.randrange(0, 25))) for k in range(8000)] + [LONG[:9000]]
    for k in range(0, len(texts), 400):
        flat, begins = own.encode(pa.array(texts[k : k + 400]))
        for i, e in enumerate(lib.encode_batch(texts[k : k + 400], add_special_tokens=False)):
            assert flat[begins[i] : begins[i + 1]].tolist() == [*e.ids, 0], texts[k + i]


def plain_best_fit(lengths, window):
    """Item by item: the larger ones matched, the smaller ones into the smallest gap."""
    large, gaps = sorted((s for s in lengths if 3 * s > window), reverse=True), []
    while large:
        a = large.pop(0)
        b = next((k for k, x in enumerate(large) if a + x <= window), None)
        gaps.append(window - a - (large.pop(b) if b is not None else 0))
    for s in sorted((s for s in lengths if 3 * s <= window), reverse=True):
        fits = [k for k, g in enumerate(gaps) if g >= s]
        if fits:
            gaps[min(fits, key=lambda k: gaps[k])] -= s
        else:
            gaps.append(window - s)
    return sorted(gaps)


@pytest.mark.parametrize("seed", range(12))
def test_op12_plan_equals_item_by_item(seed):
    rng = random.Random(seed)
    window = rng.choice([10, 33, 100])
    draw = [lambda: rng.randrange(1, window + 1), lambda: rng.randrange(1, window // 3 + 1), lambda: rng.choice([1, 2, window // 3 + 1, window])][seed % 3]
    lengths = [draw() for _ in range(rng.randrange(0, 400))]
    runs, total = bestfit.plan(Counter(lengths), window)
    placed, at = defaultdict(list), Counter(lengths)
    for k, (length, rank, sequence, offset, each) in enumerate(runs):
        end = runs[k + 1][1] if k + 1 < len(runs) and runs[k + 1][0] == length else at[length]
        assert rank < end and (rank == 0) == (k == 0 or runs[k - 1][0] != length)
        for r in range(end - rank):
            placed[sequence + r // each].append((offset + r % each * length, length))
    for own in placed.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and own[-1][0] + own[-1][1] <= window
    assert sorted(placed) == list(range(total)) and Counter(n for own in placed.values() for _, n in own) == at
    assert sorted(window - sum(n for _, n in own) for own in placed.values()) == plain_best_fit(lengths, window)


def test_op12_plan_does_not_grow_with_the_counts():
    rng = random.Random(1)
    counts = {s: rng.randrange(1, 1000) for s in range(1, 2049)}
    runs, total = bestfit.plan(counts, 2048)
    more, larger = bestfit.plan({s: n * 1_000_003 for s, n in counts.items()}, 2048)
    assert len(runs) < 8000 and len(more) < 8000 and abs(larger / total / 1_000_003 - 1) < 0.01
    assert total <= 1.01 * sum(s * n for s, n in counts.items()) / 2048 + 1


def test_op12_packs_every_token_once(spark):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choices(["cat", "sat", "on", "mats,", "über"], k=rng.randrange(1, 90)))) for k in range(150)]
    rows += [(1001, None), (1002, ""), (1003, LONG), (1004, "same"), (1004, "same"), (None, "no id")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).withColumns({c: F.lit(1) for c in CLASHING})
    got = bestfit.pack(df, path, window=64).collect()
    whole, sequences, firsts = defaultdict(list), defaultdict(list), []
    for r in sorted(got, key=lambda r: r["piece"]):
        ids = list(struct.unpack(f"<{r['length']}I", r["ids"]))
        if r["doc_id"] not in (1004, None):
            assert r["start"] == len(whole[r["doc_id"]]) and (r["piece"] == 0 or r["length"] == 64)
        firsts += [r["length"]] * (r["piece"] == 0)
        whole[r["doc_id"]] += ids
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(n for _, n in own) <= 64
    want = defaultdict(list)
    for i, t in rows:
        want[i] += [*lib.encode(t or "", add_special_tokens=False).ids, 0]
    assert whole == want
    assert len(sequences) == len(plain_best_fit([r["length"] for r in got], 64)) and len(firsts) == len(rows)
    assert bestfit.pack(spark.createDataFrame([], DOCS), path).count() == 0


# 13: manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves, arity):
    """(root, path of each leaf) of a list of digests."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // arity * arity :][:arity]
            paths[k].append(("".join(run[: i % arity]), "".join(run[i % arity + 1 :])))
        level, at = [h(*level[i : i + arity]) for i in range(0, len(level), arity)], [i // arity for i in at]
    return level[0], paths


def plain_manifest(rows, arity):
    groups = defaultdict(list)
    for i, g, leaf in rows:
        groups[g].append((i is not None, i or 0, leaf))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [plain_tree([leaf for *_, leaf in sorted(groups[g])], arity) for g in order]
    root, tops = plain_tree([t[0] for t in trees], arity)
    return sorted((i if full else -1, leaf, sub, root, path + top) for g, (sub, paths), top in zip(order, trees, tops) for (full, i, leaf), path in zip(sorted(groups[g]), paths))


@pytest.mark.parametrize("arity", [2, 3, 8])
def test_op13_equals_a_plain_tree(spark, arity):
    rng = random.Random(arity)
    langs = ["en"] * 60 + ["de"] * 9 + [None, None, "", "zz", "Z", "é", "=", "one"] + [f"l{k}" for k in range(20)]
    rows = [(rng.randrange(-50, 5000), g, h(str(k))) for k, g in enumerate(langs * 2)]
    rows += [rows[0], rows[0], (None, "en", h("x")), (None, None, h("y")), (7, "alone", h("z"))]
    df = spark.createDataFrame(rows, "doc_id long, lang string, leaf string").withColumns({c: F.lit(1) for c in CLASHING if c not in ("path", "root")})
    out = merkle.manifest(df, arity=arity)
    got = [(r["doc_id"] if r["doc_id"] is not None else -1, r["leaf"], r["subroot"], r["root"], [tuple(x) for x in r["path"]], r["folded"]) for r in out.withColumn("folded", merkle.fold("leaf")).collect()]
    assert sorted(r[:5] for r in got) == plain_manifest(rows, arity)
    assert all(r[5] == r[3] for r in got)
    bad = out.select(merkle.fold(F.sha2(F.lit("other").cast("binary"), 256)).alias("f"), "root")
    assert bad.where("f = root").count() == 0


def test_op13_on_awkward_tables(spark):
    schema = "doc_id long, lang string, leaf string"
    assert merkle.manifest(spark.createDataFrame([], schema)).count() == 0
    only = merkle.manifest(spark.createDataFrame([(1, None, h("a"))], schema)).collect()[0]
    assert (only["subroot"], only["root"], only["path"]) == (h("a"), h("a"), [])
    with pytest.raises(ValueError):
        merkle.manifest(spark.createDataFrame([], schema), arity=1)
    docs = spark.createDataFrame([(1, None, "en", None, None), (2, "", "en", "é", 3), (3, LONG, "en", "a", 1)], DOCS)
    got = [r[0] for r in docs.orderBy("doc_id").select(merkle.leaf_digest([F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])).collect()]
    assert got == [h("1:1", "-", "2:en", "-", "-"), h("1:2", "2:é", "2:en", "1:3", "0:"), h("1:3", "1:a", "2:en", "1:1", f"{len(LONG)}:", LONG)]


def test_op13_numbers_a_group_over_many_parts(spark):
    """Places go on from part to part, also where all rows are one group and many are equal."""
    from quillspan.llm.common import ranked

    rows = spark.range(0, 5000, 1, 16).selectExpr("if(id % 3 = 0, 'a', 'b') as g", "id % 700 as k")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ranked(rows, ["g"], ["k"]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    for g in "ab":
        own = sorted((r["rank"], r["k"]) for r in got if r["g"] == g)
        assert [r for r, _ in own] == list(range(len(own))) and [k for _, k in own] == sorted(k for _, k in own)
        assert {r["n"] for r in got if r["g"] == g} == {len(own)}
