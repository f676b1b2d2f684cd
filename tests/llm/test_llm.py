"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspan.llm import common, components, decontaminate, exact, html, lines, lm, packing, pii, quality, shingles, simhash, tokens
from quillspan.llm.queries import tokenizer_file

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000 + "x" * 60_000 + " " + "7" * 50_000


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], DOCS)


def odd_rows():
    return [(1, None), (2, ""), (3, "  \n "), (4, LONG), (5, "same text here, twice."), (6, "same text here, twice."), (6, "same text here, twice."), (None, "no id at all")]


def odd(spark):
    """Awkward rows with extra columns whose names clash with internal ones."""
    return docs(spark, odd_rows()).withColumns({c: F.lit(1) for c in ("id", "fp", "row", "t", "digest", "score", "shard", "_id", "n", "component_id", "kept", "label")})


def empty(spark):
    return spark.createDataFrame([], DOCS)


# 1: token counts


def test_op1_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    texts = ["Hello world, it's fine.\n\n  New   line\t\tx", "naïve café 中文字符 🙂🙂 ١٢٣ ⅷ", "a<|endoftext|>b <|endoftext|>", "''s 'll'd  　 x\xa0y", "՘ new ꟎ letters", "don't DON'T we've\r\nok", LONG[:5000]]
    rows = [*odd_rows(), *((100 + k, t) for k, t in enumerate(texts))]
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.count_tokens(docs(spark, rows), path).collect())
    n = lambda t: len(lib.encode(t or "", add_special_tokens=False).ids)
    assert got == sorted((i or -1, len((t or "").encode()), n(t), n(t) > 512) for i, t in rows)
    assert tokens.count_tokens(empty(spark), path).count() == 0
    assert tokens.count_tokens(odd(spark), path).columns[:3] == ["doc_id", "n_bytes", "n_tokens"]


def test_op1_classes_of_the_fast_characters_agree():
    counter = tokens.WholeTokenCounter(tokenizer_file("byte_bpe_50k.json"))
    fast = [chr(c) for c in range(0x250) if c != 0x20 and not counter.odd.search(chr(c))]
    assert len(fast) > 500 and all(counter._agrees(c) for c in fast)


# 2: language model


def brute_scores(rows, model):
    def words(t):
        return [w for w in re.split(rb"[ \t-\r]+", (t or "").encode().lower()) if w] + [b"\n"]

    fold = lambda i: zlib.crc32(str(i).encode()) % 7 if i is not None else -1
    uni, pair = Counter(), Counter()
    for i, t in rows:
        if fold(i) != 2:
            w = words(t)
            uni.update(w)
            pair.update(zip([b"\n", *w], w))
    n, v = sum(uni.values()), len(uni)
    out = []
    for i, t in rows:
        w = words(t)
        base = sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w)
        score = 0.0
        for a, b in zip([b"\n", *w], w):
            k = min(uni[a].bit_length(), len(model.weights) - 1)
            l2, l1, l0 = model.weights[k]
            score += math.log10(l2 * pair[a, b] / max(1, uni[a]) + l1 * uni[b] / n + l0 / (v + 1))
        out.append((i if i is not None else -1, fold(i) == 2, len(w), sum(uni[x] > 0 for x in w), n, round(base, 6), round(score, 6)))
    return sorted(out)


def test_op2_equals_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choices(["the", "cat", "sat", "on", "mat", f"w{k % 9}", "é,"], k=rng.randrange(1, 60)))) for k in range(80)] + [r for r in odd_rows() if r[1] is not LONG]
    seen = []
    learn = lm.learn_weights
    monkeypatch.setattr(lm, "learn_weights", lambda cells: seen.append(learn(cells)) or seen[-1])
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in lm.score(docs(spark, rows)).collect())
    model = lm.Model(1, 1, seen[0])
    assert got == brute_scores(rows, model)
    assert all(abs(sum(w) - 1) < 1e-9 for w in seen[0])
    assert lm.score(empty(spark)).count() == 0
    assert lm.score(odd(spark)).count() == len(odd_rows())


def test_op2_counts_beyond_32_bits_are_exact():
    import numpy as np
    import pyarrow as pa

    gram, most = np.array([5, 9], np.uint64), 4_000_000_000
    row = {"order": 1, "range": 0, "grams": lm._squeeze(np.diff(gram, prepend=np.uint64(0))), "counts": lm._squeeze(np.array([most, 1], np.uint32))}
    parts = [lm.TRAIN, lm.TRAIN, lm.HELD, lm.TEST]
    asked = pa.Table.from_pylist([row | {"chunk": f"c{k}", "part": p} for k, p in enumerate(parts)])
    answers = lm._answer(asked)
    for k in range(4):
        assert lm._expand(answers["counts"][k].as_py(), "<i8").tolist() == [3 * most, 3] and lm._expand(answers["held"][k].as_py(), "<i8").tolist() == [most, 1]


def test_op2_weights_equal_a_plain_expectation_maximisation():
    rng = random.Random(21)
    cells = [(b, rng.choice([lm.NONE, *range(0, 60)]), rng.choice([lm.NONE, *range(0, 40)]), rng.randrange(1, 50)) for b in (0, 1, 2, 4) for _ in range(30)]
    want = []
    for b in range(5):
        own = [c[1:] for c in cells if c[0] == b]
        w = [1 / 3] * 3 if b else [0.0, 0.5, 0.5]
        if not own:
            want.append(want[-1])
            continue
        prior = [float(x > 0) for x in w]
        for _ in range(60):
            new = list(prior)
            for q2, q1, n in own:
                share = [w[0] * (0 if q2 == lm.NONE else 2 ** (q2 / lm.STEPS)), w[1] * (0 if q1 == lm.NONE else 2 ** (q1 / lm.STEPS)), w[2]]
                for k in range(3):
                    new[k] += n * share[k] / sum(share)
            w = [x / sum(new) for x in new]
        want.append(w)
    assert all(abs(x - y) < 1e-9 for got, w in zip(lm.learn_weights(cells), want) for x, y in zip(got, w))


def test_op2_beats_the_base_on_unseen_text(spark):
    rng = random.Random(2)
    chain = {w: rng.sample([f"v{k}" for k in range(50)], 3) for w in [f"v{k}" for k in range(50)]}
    rows = []
    for k in range(300):
        w = [f"v{rng.randrange(50)}"]
        for _ in range(40):
            w.append(rng.choice(chain[w[-1]]))
        rows.append((k, " ".join(w)))
    held = lm.score(docs(spark, rows)).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > 0.7 * held[1]


# 3: personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(d))) % 10 == 0


def brute_pii(t):
    out = []
    for rank, (kind, p) in enumerate(BASE.items()):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 12 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15
            if ok:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_op3_base_spans_equal_brute_force(spark):
    texts = [
        "é🙂 mail a.b@c.de.f and x@y; a@b.c%d@e.f @x.y",
        "ip 1.2.3.4.5.6.7.8 and 256.1.1.1 001.002.003.004 999999999999999999999.1.1.1",
        "card 4111 1111 1111 1111, 4111-1111-1111-1112 5500005555555559 0000000000000",
        "call +1 (555) 123-4567 or +44 20 7946 0958. +1 (2",
        "a" * 40_000 + " " + "1" * 40_000 + " " + "1.1" * 9_000 + "+1" + "(" * 20_000,
        *(t for _, t in odd_rows()),
    ]
    rng = random.Random(3)
    texts += ["".join(rng.choices("0123456789.@+- ()ab\n%", k=200)) for _ in range(150)]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r for r in pii.digest(pii.find_pii(docs(spark, rows))).collect()}
    for i, t in rows:
        want = brute_pii(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert [x for x in got[i]["spans"].split(",") if x and x.split(":")[0] in BASE] == want
    assert pii.find_pii(empty(spark)).count() == 0 and pii.find_pii(odd(spark)).count() == len(odd_rows())


def test_op3_many_matches_take_linear_time(spark):
    import time

    text = "".join(f"é mail u{k}@x.org, " for k in range(100_000))
    began = time.time()
    row = pii.digest(pii.find_pii(docs(spark, [(1, text)]))).first()
    assert time.time() - began < 30 and row["n_email"] == 100_000
    assert row["base_sha256"] == hashlib.sha256(",".join(brute_pii(text)).encode()).hexdigest()


def test_op3_context_reaches_over_short_matches(spark):
    texts = ["card 12 34,56;78.90, 4111111111111111", "card 12 34,56;78.90 a b c d e f g h i j k 4111111111111111", "x" * 39 + "card" + "4111111111111111", "12," * 14 + "4111111111111111", "card " + "12," * 11 + "x 4111111111111111", "card  " + "12," * 11 + "x 4111111111111111"]
    got = {r["doc_id"]: {round(s["score"], 2) for s in r["spans"] if s["kind"] == "card"} for r in pii.find_pii(docs(spark, list(enumerate(texts)))).collect()}
    for k, t in enumerate(texts):
        assert got[k] == {1.0 if "card" in t[max(0, t.index("4111") - 40) : t.index("4111")] else 0.8}, t


def test_op3_added_spans_are_validated_and_scored(spark):
    rows = [(1, "account GB82WEST12345698765432"), (2, "account GB82WEST12345698765433"), (3, "ssn 123-45-6789"), (4, "part 123-45-6789")]
    got = {r["doc_id"]: [(s["kind"], round(s["score"], 2)) for s in r["spans"]] for r in pii.find_pii(docs(spark, rows)).collect()}
    assert got == {1: [("iban", 1.0)], 2: [], 3: [("ssn", 0.6)], 4: []}


# 4: decontamination


def test_op4_finds_copies_and_edited_copies_only(spark):
    rng = random.Random(4)
    vocab = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.choices(vocab, k=40))) for k in range(5)]
    fill = lambda n: " ".join(rng.choices(vocab, k=n))
    edited = items[1][1].split()
    for k in range(4, 40, 6):
        edited[k] = "changed"
    rows = [(10, fill(300) + " " + items[0][1].upper() + ", " + fill(50)), (11, fill(80) + " " + " ".join(edited)), (12, items[2][1]), (13, fill(2000)), (14, None), (15, ""), (16, " ".join(items[3][1].split()[:12])), (17, items[2][1])]
    bench = spark.createDataFrame([*items, (9, None), (8, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(docs(spark, rows), bench).collect()}
    assert set(got) == {(10, 0), (11, 1), (12, 2), (17, 2)} and got[10, 0] == 1.0 and 0.5 <= got[11, 1] < 1
    left = decontaminate.drop_contaminated(docs(spark, [*rows, (None, "x")]), bench)
    assert sorted(r["doc_id"] or -1 for r in left.collect()) == [-1, 13, 14, 15, 16] and left.columns == docs(spark, []).columns
    assert decontaminate.contaminated(empty(spark), bench).count() == 0 and decontaminate.contaminated(docs(spark, rows), bench.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(odd(spark), bench).count() == len(odd_rows())


@pytest.mark.parametrize("every", [4, 5])
def test_op4_finds_edits_alone_and_beside_exact_copies(spark, every):
    rng = random.Random(every)
    items = [(k, " ".join(f"i{k}w{j}" for j in range(40))) for k in range(2)]
    edit = lambda t: " ".join("changed" if k % every == every - 1 else w for k, w in enumerate(t.split()))
    fill = " ".join(f"w{rng.randrange(99)}" for _ in range(60))
    rows = [(1, f"{fill} {edit(items[0][1])} {fill}"), (2, edit(items[1][1])), *[(k, f"{fill} {items[1][1]}") for k in range(3, 6)], (6, fill)]
    got = decontaminate.contaminated(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 0), (2, 1), (3, 1), (4, 1), (5, 1)}


def full_score(doc, item, n=3):
    """Best score of the plain recurrence over a whole document, over alignments that hold an unbroken n-gram of the item's."""
    n, best = min(n, len(item)), 0
    # h[i][j]: best score ending at (i, j) without such a run so far, by length of the current run of matches, or with one
    size = len(item) + 1
    row = [([0] + [-1] * (n - 1), -1) for _ in range(size)]
    for x in doc:
        new = [([0] + [-1] * (n - 1), -1)]
        for j, y in enumerate(item, 1):
            runs, full = [-1] * n, -1
            a, b, c = row[j - 1], row[j], new[j - 1]
            if x == y:
                for k in range(n):
                    if a[0][k] >= 0:
                        if k + 1 < n:
                            runs[k + 1] = max(runs[k + 1], a[0][k] + 2)
                        else:
                            full = max(full, a[0][k] + 2)
                if a[1] >= 0:
                    full = max(full, a[1] + 2)
            for v in (*([a] if x != y else []), b, c):
                runs[0] = max(runs[0], max(v[0]) - 1)
                full = max(full, v[1] - 1)
            runs[0] = max(runs[0], 0)
            new.append((runs, full))
            best = max(best, full)
        row = new
    return best / (2 * len(item))


def test_op4_equals_brute_force_over_documents_and_items(spark):
    rng = random.Random(11)
    vocab = [f"v{k}" for k in range(14)]
    items = [(k % 20, " ".join(rng.choices(vocab, k=rng.randrange(1, 14)))) for k in range(24)] + [(None, "v1 v2 v3 v4")]
    rows = []
    for k in range(70):
        w = rng.choices(vocab, k=rng.randrange(0, 50))
        at = rng.randrange(len(w) + 1)
        copy = rng.choice(items)[1].split()
        for _ in range(rng.randrange(0, 4)):
            i = rng.randrange(len(copy))
            copy[i : i + 1] = rng.choice([[], ["new"], [copy[i], "new"], [copy[i], "new", "new"]])
            copy = copy or ["new"]
        rows.append((k, " ".join(w[:at] + copy + w[at:])))
    want = Counter()
    for i, t in rows:
        for j, x in set(items):
            score = full_score(t.split(), x.split())
            if score >= 0.5:
                want[i, j, round(score, 6)] += 1
    got = Counter((r["doc_id"], r["item_id"], round(r["score"], 6)) for r in decontaminate.contaminated(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect())
    assert len(want) > 60 and got == want


def test_op4_shuffled_joins_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    items = spark.createDataFrame([(1, "one two three four five six"), (1, "seven eight nine ten eleven twelve")], "item_id long, text string")
    rows = [(1, "x one two three four five six y"), (1, "a clean text"), (2, "seven eight nine word ten eleven twelve"), (2, "seven eight nine word ten eleven twelve"), (None, "one two three four five six")]
    got = sorted((r["doc_id"] or 0, r["item_id"]) for r in decontaminate.contaminated(docs(spark, rows), items).collect())
    assert got == [(0, 1), (1, 1), (2, 1), (2, 1)]
    assert [r["text"] for r in decontaminate.drop_contaminated(docs(spark, rows), items).collect()] == ["a clean text"]


@pytest.mark.parametrize(("kind", "rate"), [(k, r) for k in ("change", "insert", "delete") for r in (0.1, 0.2, 0.3)])
def test_op4_recall_of_random_edits(kind, rate):
    """Of edited copies that the plain recurrence scores at the threshold or above, nine in ten and more hold a seed."""
    rng = random.Random(str((kind, rate)))
    caught = total = 0
    for _ in range(150):
        item = [f"w{rng.randrange(10_000)}" for _ in range(40)]
        copy = [x for w in item for x in ([w] if rng.random() >= rate else ["new"] if kind == "change" else [w, "new"] if kind == "insert" else [])]
        if decontaminate.smith_waterman(copy, item)[0] / 80 >= 0.5:
            total += 1
            caught += full_score(copy, item) >= 0.5
    assert total and caught >= 0.95 * total


def test_op4_smith_waterman_equals_the_plain_recurrence():
    rng = random.Random(5)
    for _ in range(60):
        a, b = rng.choices("abcd", k=rng.randrange(0, 12)), rng.choices("abcd", k=rng.randrange(1, 12))
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
        assert decontaminate.smith_waterman(a, b)[0] == max(map(max, h))


# 5: quality


def test_op5_separates_and_compiles(spark):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choices(["plain", "words", "in", "a", "row", "of", "prose,", "then", "more", f"x{rng.randrange(999)}"], k=60)) + "."
    bad = lambda: " ".join(rng.choices(["$$$", "###", "BUY!!", "NOW!!", "%%%"], k=60))
    rows = [(k, good() if k % 3 else bad()) for k in range(300)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(300)], "doc_id long, quality int, toxic int")
    d = docs(spark, rows)
    ensemble = quality.learn(d, labels)
    got = quality.score(d, ensemble).collect()
    assert ensemble.rules and all(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    kept = quality.keep_good(d, ensemble)
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == [k for k in range(300) if k % 3]
    assert quality.score(odd(spark), ensemble).count() == len(odd_rows()) and quality.score(empty(spark), ensemble).count() == 0
    assert quality.keep_good(odd(spark), ensemble).columns == odd(spark).columns
    constant = quality.learn(d, labels.limit(0))
    assert constant.rules == () and quality.score(d, constant).select("score").distinct().collect()[0][0] == 0.5


def plain_stats(text):
    """The statistics again, one character or word at a time."""
    words = text.split()
    if not words:
        return [0.0] * len(quality.STATS)
    chars, n = [chr(c) for c in text], len(words)
    count = lambda test: sum(1 for c in chars if test(c))
    upper, lower = count(lambda c: "A" <= c <= "Z"), count(lambda c: "a" <= c <= "z")
    space = count(lambda c: c in " \t\n\x0b\x0c\r")
    symbols = count(lambda c: "!" <= c <= "~" and not (c.isascii() and c.isalnum()) and c not in "!?'(),-.:;")
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [n, (len(text) - space) / n, upper / max(1, upper + lower), symbols / len(text), (text.count(b"!") + text.count(b"?")) / n, count(lambda c: "0" <= c <= "9") / len(text), text.count(b"|") / n, space / len(text), len(set(words)) / n, max(words.count(w) for w in set(words)) / n, 1 - len(set(lines)) / len(lines), n / len(lines), (text.count(b",") + text.count(b".")) / n, sum(w[:1].isupper() for w in words) / n]


def test_op5_scores_equal_a_plain_version_and_do_not_depend_on_partitions(spark):
    rng = random.Random(66)
    text = lambda good: "\n".join(" ".join(rng.choices(["Plain", "words", "in", "rows,", "more.", f"x{rng.randrange(99)}"] if good else ["BUY!!", "now", "a|b", "%%", "7 7", "words"], k=rng.randrange(1, 9))) for _ in range(rng.randrange(1, 7)))
    rows = [(k, text(rng.random() < (0.9 if k % 2 else 0.2))) for k in range(400)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(400)], "doc_id long, quality int, toxic int")
    d = docs(spark, rows)
    ensemble = quality.learn(d.repartition(3), labels)
    assert ensemble == quality.learn(d.coalesce(1), labels.repartition(5)) and len(ensemble.rules) > 1
    z = lambda x: ensemble.bias + sum(w for rule, w in ensemble.rules if all((x[s] <= v) if least else (x[s] > v) for s, least, v in rule.tests))
    got = {r["doc_id"]: r["score"] for r in quality.score(d, ensemble).collect()}
    for k, t in rows:
        assert abs(got[k] - 1 / (1 + math.exp(-z(dict(zip(quality.STATS, plain_stats(t.encode()))))))) < 1e-9, t


def test_op5_held_out_accuracy(spark):
    src = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{src}/documents.parquet"), spark.read.parquet(f"{src}/labels.parquet")
    scored = quality.score(d, quality.learn(d, labels)).join(labels, "doc_id").where("held_out")
    right, n = scored.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count(F.lit(1))).first()
    assert n >= 20 and right > 0.95


# 6: packing


def test_op6_round_trip(spark):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rng = random.Random(7)
    texts = ["Hello, World!! it's <|endoftext|> x<|ENDOFTEXT|>y", "É,é. ...abc...def, x.,! y?!\n\n z", "\x0ba\x1cb\xa0c 中文，字。", "<|x|> don't 3.14."]
    rows = [*odd_rows(), *((100 + k, t) for k, t in enumerate(texts)), *((200 + k, " ".join(rng.choices(["alpha", "beta,", "gamma", f"d{k}"], k=rng.randrange(1, 900)))) for k in range(60))]
    got = packing.pack(docs(spark, rows), path, end=2, window=4096).collect()
    want = Counter((i, tuple([*lib.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in rows)
    ids = lambda r: tuple(int.from_bytes(r["ids"][k : k + 4], "little") for k in range(0, len(r["ids"]), 4))
    by_seq, by_doc = {}, {}
    for r in got:
        assert len(ids(r)) == r["length"]
        by_seq.setdefault(r["sequence_id"], []).append(r)
        by_doc.setdefault(r["doc_id"], []).append(r)
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    assert sum(sum(r["length"] for r in s) < 4096 for s in by_seq.values()) <= 1
    once = {i for (i, _), n in want.items() if n == 1 and sum(k[0] == i for k in want) == 1}
    for i in once:
        whole = sum((ids(r) for r in sorted(by_doc[i], key=lambda r: r["start"])), ())
        assert (i, whole) in want and {r["doc_tokens"] for r in by_doc[i]} == {len(whole)}
    assert sum(r["length"] for r in got) == sum(len(k[1]) * n for k, n in want.items())
    assert packing.pack(empty(spark), path).count() == 0
    assert packing.pack(odd(spark), path).columns[0] == "doc_id"


def test_op6_ids_equal_the_library():
    import pyarrow as pa

    path = tokenizer_file("word_bpe_49k.json")
    ids = packing.WordIds(path, 2)
    rng = random.Random(16)
    parts = ["a", "stre", "'s", "'", "'LL", "ve", "d", "1", "23", " ", "\n", "\x0b", "É", "ß", "ñÑ", "Þ", "!", "...", "''", "_", "<", "|", "\x7f", "\x1c", "\xa0", "×", "字", "e\u0301", "Ā", "<|endoftext|>", "word"]
    texts = ["".join(rng.choices(parts[: 22 if k % 3 else 31], k=rng.randrange(0, 30))) for k in range(3000)]
    for k in range(0, 3000, 500):
        flat, begins = ids.encode(pa.array(texts[k : k + 500]))
        for i in range(500):
            assert flat[begins[i] : begins[i + 1]].tolist() == [*ids.lib.encode(texts[k + i], add_special_tokens=False).ids, 2], texts[k + i]


def test_op6_neighbours_equal_plain_bm25():
    import numpy as np

    rng = random.Random(17)
    docs_ = [[rng.choice([*range(6), *range(rng.randrange(6, 90), 90)]) for _ in range(rng.randrange(1, 60))] for _ in range(70)]
    n, mean = len(docs_), sum(map(len, docs_)) / len(docs_)
    df = Counter(t for d in docs_ for t in set(d))
    flat, begins = np.concatenate([np.array(d, np.uint16) for d in docs_]), np.append(0, np.cumsum([len(d) for d in docs_]))
    index = packing.Index(flat, begins)
    used = np.zeros(n, bool)
    for drop in ([], [3, 5, 8], range(20, 60)):
        used[list(drop)] = True
        index.forget(used)
        for seed in range(n):
            def score(d):
                tf = Counter(docs_[d])
                return sum(math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(docs_[d]) / mean)) for t in set(docs_[seed]) if t in tf)

            got = [score(d) for d in index.neighbours(seed).tolist()]
            assert len(got) == n - used.sum() and all(a >= b - 1e-4 for a, b in zip(got, got[1:]))


def test_op6_windows_take_the_best_neighbours_that_fit():
    import numpy as np

    docs_ = [[1, 2, 3, 4] * 20, [5, 6, 7, 8] * 20, [1, 2, 3, 9] * 20, [5, 6, 7, 9] * 19]
    sizes = np.array([len(d) for d in docs_])
    got = list(packing.fill_windows(packing.Index(np.concatenate([np.array(d) for d in docs_]), np.append(0, np.cumsum(sizes))), sizes, 160))
    assert got == [(0, 0, 80, 0, 0), (2, 0, 80, 0, 80), (1, 0, 80, 1, 0), (3, 0, 76, 1, 80)]


def test_op6_related_documents_meet_in_a_shard(spark):
    topics = [f"zebra{k}" for k in "abcdefgh"]
    rows = [(k, f"{' '.join([topics[k % 8] + 'quix'] * 9)} some common words here and there {k}") for k in range(240)]
    got = packing.pack(docs(spark, rows), tokenizer_file("word_bpe_49k.json"), window=256, shard_bytes=4000).collect()
    by_seq = {}
    for r in got:
        by_seq.setdefault(r["sequence_id"], set()).add(r["doc_id"] % 8)
    assert len({s >> 32 for s in by_seq}) > 4 and sum(len(t) == 1 for t in by_seq.values()) > 0.6 * len(by_seq)


def test_op6_shards_are_bounded():
    rng = random.Random(18)
    sizes = [(k, rng.choice([1, 5, 40, 900])) for k in range(300)]
    dealt = packing.deal(sizes, 100)
    load = Counter()
    for (k, n), (subject, shard, parts) in zip(sizes, dealt):
        assert k == subject and parts == max(1, -(-n // 100))
        for p in range(parts):
            load[shard + p] += n / parts
    assert max(load.values()) <= 100 and sorted(load) == list(range(len(load)))


# 7: main text

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><header>Top</header><nav><ul><li><a href=/a>A</a></ul></nav>
<div class="ad-12">Buy</div><article class="post9"><h1>Head &amp; line</h1><p>One <b>bold</b>text<br>next<p>Two &lt;x&gt; &#233;<ul><li>i1<li>i2</ul><aside>side</aside>
<form><label>l</label></form><table><tr><td>c1<td>c2</table><div class="comments"><p>first!</p></div><article class="comment-12"><p>second!</p></article></article><div id=cookie-banner>ok?</div><footer>foot</footer></body></html>"""


def test_op7_extracts_the_article(spark):
    want = "Head & line One boldtext next Two <x> é i1 i2 c1 c2"
    rows = [(1, "http://a.example/1", PAGE), (2, "http://a.example/2", PAGE.replace("post9", "post77")), (3, None, None), (4, "x", ""), (5, "http://b.example/", "just text < 3 &amp; more"), (6, "http://a.example/z", "<p>only a paragraph"), (1, "http://a.example/1", PAGE), (7, "http://c.example", "<div>" * 3000 + "deep" + "<p" * 2000 + "\"'" * 2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = Counter((r["page_id"], r["text"], r["n_chars"]) for r in html.main_text(pages).collect())
    assert got[1, want, len(want)] == 2 and got[2, want, len(want)] == 1 and got[3, "", 0] == 1 and got[4, "", 0] == 1
    assert got[5, "just text < 3 & more", 20] == 1 and got[6, "only a paragraph", 16] == 1 and sum(got.values()) == 8
    salted = Counter((r["page_id"], r["text"], r["n_chars"]) for r in html.main_text(pages, broadcast_rows=0, salts=3).collect())
    assert salted == got
    assert html.main_text(pages.limit(0)).count() == 0
    clash = pages.withColumns({"host": F.lit(1), "path": F.lit(2), "_id": F.lit(3), "text": F.lit("t")})
    assert html.main_text(clash).count() == 8


def test_op7_keeps_title_beside_long_comments_and_all_sections(spark):
    body = " ".join(f"Sentence {k} of the story." for k in range(12))
    remarks = "<p>A remark that nobody asked for.</p>" * 30
    talk = f"<html><body><article><h1>Title here</h1><p>The lead.</p><div class='body'><p>{body}</p></div><div class='comments'>{remarks}</div></article></body></html>"
    links = "".join(f"<p><a href='/{k}'>Another long headline number {k}</a></p>" for k in range(40))
    parts = f"<html><body><div class='part'><p>{body}</p></div>{links}<div class='part'><p>Second part. {body}</p></div></body></html>"
    pages = spark.createDataFrame([(1, "http://a.example/1", talk), (2, "http://b.example/1", parts)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.main_text(pages).collect()}
    assert got[1] == f"Title here The lead. {body}" and got[2] == f"{body} Second part. {body}"


STORY = " ".join(f"This is sentence {k} of a plain story about nothing much." for k in range(9))


@pytest.mark.parametrize(
    "page",
    [
        "<div class='content with-sidebar'><p>{}</p></div>",
        "<div class='post social-science'><p>{}</p></div>",
        "<section class='search-results-free legal'><p>{}</p></section>",
        "<div id='skip-target'><p>{}</p></div>",
        "<article><svg viewBox='0 0 1 1'/><p>{}</p></article>",
        "<article><p><video src='x'>{}</p></article>",
        "<article><object data='x'><p>{}</p></article>",
        "<div class='sidebar'><article><p>{}</p></article></div>",
        "<article><p>{}</p><p class='promo'>Buy this.</p><span hidden>no</span><p aria-hidden=true>no</p></article><div class='sidebar'><p>{}</p><p>{}</p></div>",
        "<main><p>{}</p></main><div class='comments'><p>{} {} {} {}</p></div>",
        "<div><p>{}</p></div><div class='cookie-banner'>We use cookies.</div><div class='comment-list'><p>First!</p></div>",
        "<div class='post comments-open has-comments'><p>{}</p></div><section id='reader-comments'><p>{}</p></section><div class='related-posts'><p>More</p></div>",
        "<article class='no-comments'><div class='header'></div><div class='post-header'></div><p>{}</p><div class='postComments'>x</div></article><div class='site-header'>Site</div>",
        "<article><p>{}</p></article><script>var x = '<p>unclosed",
        "<form id='aspnetForm'><div class='menu'>Menu</div><article><p>{}</p></article></form>",
        "<form method=post><input name=s><div><p>{}</p></div><div class='sidebar'>Side</div></form>",
        "<div><p>{}</p></div><form><label>Name</label><p>Write to us with your name.</p></form>",
        "<article id='post-comment-on-budget'><p>{}</p></article>",
        "<div class='how-we-respond'><p>{}</p></div>",
        "<main><div class='comment-policy'><p>{}</p></div></main>",
        "<article><p>{}</p><div class='wpd-comment'><p>Nice.</p></div><div class='user-comment-thread'><p>{} {}</p></div></article>",
        "<!--><article><p>{}</p></article><!-- x --!><!---> <!-- end -->",
    ],
)
def test_op7_keeps_the_article(page):
    text = page.replace("{}", STORY)
    assert html.extract(f"<html><body><nav><a href=/>home</a></nav>{text}</body></html>", None) == STORY


def test_op7_keeps_code_labels_and_articles_of_links():
    code = "<article><p>Look:</p><pre><code><span class='token comment'># a note</span> x = 1 <span class='hljs-comment'># more</span></code></pre><p><label>Term</label> and what it means.</p></article>"
    assert html.extract(f"<body>{code}</body>", None) == "Look: # a note x = 1 # more Term and what it means."
    links = "<article><h2><a href=a>First headline of the day</a></h2><p><a href=b>Second headline of the day</a></p></article>"
    assert html.extract(f"<body><ul><li><a href='/'>home page of this site</a></li></ul>{links}</body>", None) == "First headline of the day Second headline of the day"
    assert html.extract("<body><ul><li><a href='/'>home page of this site</a></li></ul></body>", None) == ""


def test_op7_depth_is_linear():
    import time

    began = time.process_time()
    deep = html.extract("<div>" * 90_000 + "deep" + "<b>" * 90_000 + " down" + "<p>x" * 20_000 + "<li>y" * 20_000, None)
    assert deep == "deep down" + " x" * 20_000 + " y" * 20_000 and time.process_time() - began < 20


def tree_text(page):
    """A plain extractor over the library's tree: the text of article elements without dropped elements."""
    from html.parser import HTMLParser

    class Tree(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.stack, self.out, self.now = [], [], []

        def block(self):
            text = " ".join("".join(self.now).split())
            self.out += [text] if text else []
            self.now = []

        def handle_starttag(self, tag, attrs):
            if tag == "br":
                self.now.append(" ")
                return
            if tag not in ("b", "a", "i"):
                self.block()
            self.stack.append(tag)

        def handle_endtag(self, tag):
            if tag not in ("b", "a", "i"):
                self.block()
            if tag in self.stack:
                while self.stack.pop() != tag:
                    pass

        def handle_data(self, data):
            if "article" in self.stack and not {"script", "style", "nav", "aside", "footer"} & set(self.stack):
                self.now.append(data)

    tree = Tree()
    tree.feed(page or "")
    tree.close()
    tree.block()
    return " ".join(tree.out)


def test_op7_equals_a_plain_extractor_on_the_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r["page_id"]: tree_text(r["html"]) for r in pages.collect()}
    got = {r["page_id"]: r["text"] for r in html.main_text(pages).collect()}
    assert sum(got[k] == w for k, w in want.items()) >= 0.99 * len(want)


# 8: lines


def brute_lines(rows, least=5):
    norm = lambda x: " ".join(w for w in re.split(r"[\t\x0b\f\r ]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in x)) if w)
    every = [(i, k, norm(x).split(" ")) for i, t in rows if i is not None and t is not None for k, x in enumerate(t.split("\n")) if norm(x)]

    def near(a, b):
        if a == b:
            return True
        if min(len(a), len(b)) < least:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        a, b = (a, b) if len(a) > len(b) else (b, a)
        return len(a) == len(b) + 1 and any(a[:k] + a[k + 1 :] == b for k in range(len(a)))

    gone = {(i, k) for i, k, w in every if any((j, m) < (i, k) and near(w, v) for j, m, v in every)}
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows if t is not None}


def test_op8_equals_brute_force(spark):
    rng = random.Random(8)
    base = [" ".join(rng.choices([f"w{k}" for k in range(30)], k=rng.randrange(3, 14))) for _ in range(25)]

    def edit(x):
        w = x.split(" ")
        k = rng.randrange(len(w))
        kind = rng.randrange(5)
        return " ".join(w[:k] + ([[], ["new"], [w[k], "more"], [w[k], w[k]], [w[k].upper()]][kind]) + w[k + 1 :])

    rows = [(k, "\n".join(edit(rng.choice(base)) if rng.random() < 0.7 else rng.choice(base) for _ in range(rng.randrange(1, 8)))) for k in range(90)]
    got = {r["doc_id"]: r["text"] for r in lines.drop_repeated_lines(docs(spark, rows)).collect()}
    assert got == brute_lines(rows)


@pytest.mark.parametrize(("rows", "hot"), [(0, 3), (40, 100_000)])
def test_op8_shuffled_joins_give_the_same(spark, rows, hot, monkeypatch):
    monkeypatch.setattr(lines, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    test_op8_equals_brute_force(spark)


def test_op8_odd_rows(spark):
    got = lines.drop_repeated_lines(odd(spark))
    assert got.columns == [*odd(spark).columns, "n_lines", "n_removed"]
    rows = Counter((r["doc_id"], r["text"], r["n_removed"]) for r in got.collect())
    assert rows[5, "same text here, twice.", 0] == 1 and rows[6, "", 1] == 2 and rows[1, None, 0] == 1 and rows[4, LONG, 0] == 1 and sum(rows.values()) == len(odd_rows())
    d = docs(spark, [(1, "a b c d e f\nx"), (2, "y\nA b  c d e f\n\nX \n\nz"), (2, "y\nA b  c d e f\n\nX \n\nz"), (None, "a b c d e f")])
    assert sorted((r["doc_id"] or 0, r["text"]) for r in lines.drop_repeated_lines(d).collect()) == [(0, "a b c d e f"), (1, "a b c d e f\nx"), (2, "y\n\n\nz"), (2, "y\n\n\nz")]
    names = ("__id", "__hash", "__row", "__gone", "gone", "doc", "pos", "h1", "n_lines")
    got = lines.drop_repeated_lines(d.withColumns({c: F.lit(7) for c in names})).collect()
    assert all(r[c] == 7 for r in got for c in names if c != "n_lines") and len(got) == 4
    assert lines.drop_repeated_lines(empty(spark)).count() == 0


# 9: SimHash


def brute_fp(t, k):
    import xxhash

    w = [x for x in re.split(rb"[ \t-\r]+", (t or "").encode().lower()) if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op9_fingerprints_and_components_equal_brute_force(spark):
    rng = random.Random(9)
    rows = [r for r in odd_rows() if r[0] is not None]
    for k in range(60):
        w = rng.choices([f"w{j}" for j in range(500)], k=120)
        for c in range(rng.randrange(1, 4)):
            v = list(w)
            for _ in range(c):
                v[rng.randrange(120)] = "edit"
            rows.append((1000 + 10 * k + c, " ".join(v)))
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    fp = [(i, brute_fp(t, 4)) for i, t in rows]
    parent = {i: i for i, _ in fp}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, x in fp:
        for b, y in fp:
            if bin(x ^ y).count("1") <= 4:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {(i, f"{x:016x}"): find(i) for i, x in fp}


@pytest.mark.parametrize("hot", [1, 3, 512])
def test_op9_hot_halves_lose_no_link(spark, hot):
    rng = random.Random(10)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = sorted({b ^ sum(1 << x for x in rng.sample(range(64), rng.randrange(0, 6))) for b in base for _ in range(25)})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x), k) for k, x in enumerate(fps)], "fp long, rep long")
    got = {r["node"]: r["component"] for r in components.components(simhash.fingerprint_links(df, hot=hot)).collect()}
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i, x in enumerate(fps):
            for j in range(i):
                if bin(x ^ fps[j]).count("1") <= 4 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    assert {k: got.get(k, k) for k in range(len(fps))} == dict(enumerate(label))


def test_components_of_a_long_path(spark):
    pairs = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (501, 501), (None, 3), (500, 501)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(pairs).collect()}
    assert got == {**{k: 0 for k in range(201)}, 500: 500, 501: 500}
    assert components.components(pairs.limit(0)).count() == 0


def test_op9_empty_and_odd(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.near_duplicates(odd(spark)).count() == len(odd_rows())


# near-duplicates of the pipeline


def test_shingle_groups_equal_brute_force(spark):
    rng = random.Random(12)
    rows = [r for r in odd_rows() if r[0] is not None and r[0] != 4]
    common = [f"c{k}" for k in range(60)]
    for k in range(40):
        w = [f"d{k}x{rng.randrange(400)}" for _ in range(100)]
        w = common + w[:60] if k % 4 == 0 else w  # passages that many texts share
        for c in range(rng.randrange(1, 5)):
            v = list(w)
            for _ in range(c):
                v[rng.randrange(len(v))] = f"edit{rng.randrange(9)}"
            rows.append((1000 + 10 * k + c, " ".join(v)))
    grams = lambda t: frozenset(tuple(w[i : i + 5]) for w in [(t or "").lower().split()] for i in range(max(1, len(w) - 4)))
    sets = [(i, grams(t), brute_fp(t, 5)) for i, t in rows]
    label = {i: i for i, _, _ in sets}
    for _ in sets:
        before = dict(label)
        for i, a, f in sets:
            for j, b, g in sets:
                if len(a & b) >= 0.8 * len(a | b) or bin(f ^ g).count("1") <= 4:
                    label[i] = label[j] = min(label[i], label[j])
        if label == before:
            break
    got = {r["doc_id"]: r["component_id"] for r in shingles.near_duplicates(docs(spark, rows)).collect()}
    assert got == label
    assert shingles.near_duplicates(odd(spark)).count() == len(odd_rows()) and shingles.near_duplicates(empty(spark)).count() == 0


def test_pipeline_near_dedup_drops_edits_beyond_four_bits(spark):
    import corpus_pipeline

    words = [f"b{k}" for k in range(200)]
    edited = ["new" if k in (40, 90, 120, 150) else w for k, w in enumerate(words)]
    assert bin(brute_fp(" ".join(words), 5) ^ brute_fp(" ".join(edited), 5)).count("1") > 4
    left = corpus_pipeline.near_duplicate_stage(spark, docs(spark, [(1, " ".join(words)), (2, " ".join(edited)), (3, "other words")]), "")
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 3]


def test_pipeline_stages_go_by_row(spark):
    import corpus_pipeline

    long = lambda tag: " ".join(f"{tag}{k}" for k in range(60))
    item = " ".join(f"item{k}" for k in range(30))
    rows = [(1, long("a")), (5, long("a")), (5, long("b")), (5, long("b")), (None, long("a")), (None, long("c")), (6, None), (7, "")]
    left = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicate_stage(spark, docs(spark, rows), "").collect())
    assert left == Counter([(1, long("a")), (5, long("b")), (None, long("c")), (6, None)])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, f"{long('x')} {item}"), (1, long("y")), (None, item), (None, long("z"))]
    assert sorted(r["text"] for r in decontaminate.drop_contaminated(docs(spark, rows), bench).collect()) == [long("y"), long("z")]


def test_pipeline_on_awkward_rows(spark):
    import corpus_pipeline as P

    d = odd(spark).withColumns({c: F.lit(1) for c in ("comp", "h", "cls", "gone_id", "h1", "passage", "doc", "subject", "salt")})
    for name, step in P.STAGES[:-1]:
        before = d.count()
        d = step(spark, d, "/root/testdata/sf0.001") if name != "quality" else d
        assert d.count() <= before and d.columns[:5] == docs(spark, []).columns, name
    assert P.STAGES[-1][1](spark, d, "").select("doc_id").distinct().count() == d.select("doc_id").distinct().count()


@pytest.mark.parametrize("name", ["quality", "near_dedup", "decontamination", "packing"])
def test_pipeline_bounds_the_bytes_of_a_batch(spark, name):
    """However long the texts, a task of a stage gets no batch that holds thousands of them."""
    import corpus_pipeline as P

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "b"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    try:
        dict(P.STAGES)[name](spark, docs(spark, [(1, "some words of a text"), (2, "others")]), "/root/testdata/sf0.001")
        got = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("x"), 4000).alias("t")).mapInArrow(count, "n long, b long").collect()
        assert sum(r["n"] for r in got) == 4000 and max(r["b"] for r in got) <= common.BATCH_BYTES + 8192
        spark.conf.set(key, "1m")  # smaller ones stay
        common.small_batches(spark)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.unset(key)


# 10: exact


@pytest.mark.parametrize("hot", [100_000, 3])
def test_op10_equals_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    rng = random.Random(11)
    rows = [(k, rng.choice(["a", "b", "", None, "a ", "A", "long " * 50])) for k in range(120)] + [(119, "a"), (None, "b"), (None, "unique")]
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact.exact_classes(docs(spark, rows), batches=3).collect())
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    top = {t: max((i for i in g if i is not None), default=None) for t, g in groups.items()}
    assert got == Counter((i, top[t or ""], len(groups[t or ""]), i == top[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    least = exact.exact_classes(docs(spark, rows), keep="min").where("kept").select("doc_id").distinct().count()
    assert least == len(groups)
    assert exact.exact_classes(empty(spark)).count() == 0 and exact.exact_classes(odd(spark)).count() == len(odd_rows())


def test_op10_index_compacts_and_looks_up(spark):
    index = exact.MergeIndex(spark, fanout=2)
    for k in range(5):
        index.flush(spark.range(k * 10, k * 10 + 20).select(F.col("id"), F.sha2((F.col("id") % 30).cast("string").cast("binary"), 256).cast("binary").alias("digest")))
    assert index.merged().agg(F.sum("n")).first()[0] == 100 and index.merged().count() == 30
    assert sum(map(len, index.levels.values())) < 5
    probe = spark.createDataFrame([("x",)], "s string").select(F.sha2(F.lit("29").cast("binary"), 256).cast("binary").alias("digest"))
    assert [(r["min_id"], r["max_id"]) for r in index.lookup(probe).collect()] == [(29, 59)]
    new = spark.range(1000, 6000).select(F.unhex(F.sha2(F.col("id").cast("string").cast("binary"), 256)).alias("digest"))
    old = spark.range(0, 30).select(F.sha2(F.col("id").cast("string").cast("binary"), 256).cast("binary").alias("digest"))
    assert index.may_hold(new).count() < 50 and index.may_hold(old).count() == 30 and index.lookup(old).count() == 30


def test_shared_folder_must_be_set_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(cluster)


# the pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    src = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{src}/documents.parquet").limit(80)
    names = d.columns
    for name, step in P.STAGES[:-1]:
        before = d.count()
        d = step(spark, d, src)
        assert d.columns == names and 0 < d.count() <= before, name
    pieces = P.STAGES[-1][1](spark, d, src)
    assert pieces.select("doc_id").distinct().count() == d.count()
    e = spark.read.parquet(f"{src}/documents.parquet").limit(0)
    for _, step in P.STAGES:
        assert step(spark, e, src).count() == 0


def test_near_copies_that_are_similar_to_neither_end_of_a_key_are_linked(spark):
    """A family whose members drift apart, so that many are similar to each other but not to the first or last of any key."""
    rng = random.Random(21)
    base, rows = [f"b{k}" for k in range(120)], []
    for k in range(160):
        rows.append((k, " ".join(f"e{rng.randrange(10**6)}" if rng.random() < 0.02 else w for w in base)))
    sets = [{tuple(w[i : i + 5]) for w in [t.split()] for i in range(len(w) - 4)} for _, t in rows]
    label = list(range(len(rows)))
    for b in range(len(rows)):
        for a in range(b):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) or bin(brute_fp(rows[a][1], 5) ^ brute_fp(rows[b][1], 5)).count("1") <= 4:
                x, y = sorted((label[a], label[b]))
                label = [x if z == y else z for z in label]
    got = {r["doc_id"]: r["component_id"] for r in shingles.near_duplicates(docs(spark, rows)).collect()}
    assert [got[k] for k in range(len(rows))] == label and 5 < len(set(label)) < 155


def test_prefixes_are_not_moved_again_for_a_few_frequent_shingles(spark, monkeypatch):
    """One line in 40 texts makes fewer pairs than there are rows of shared shingles: no second pass over all prefixes; a line in most texts is worth one."""
    from quillspan.operators import prefixes

    written = []
    monkeypatch.setattr(shingles, "stage", lambda df, tag: written.append(tag) or common.stage(df, tag))
    rng = random.Random(5)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    line, pairs = words(6), [words(100) for _ in range(100)]
    rows = [(k, f"{line} {words(4)}") for k in range(40)] + [(100 + 2 * k + j, t if j else f"{t} more") for k, t in enumerate(pairs) for j in range(2)]
    got = {r["doc_id"]: r["component_id"] for r in shingles.near_duplicates(docs(spark, rows)).collect()}
    assert got == {k: k if k < 100 else k - k % 2 for k, _ in rows} and prefixes.FREQUENT < 40
    assert "prefixes" not in written and written.count("links-so-far") == 1
    written.clear()
    rows = [(k, f"{line} {words(4)}") for k in range(120)]
    assert shingles.near_duplicates(docs(spark, rows)).where("doc_id <> component_id").count() == 0
    assert "prefixes" in written


@pytest.mark.parametrize("name", ["line_dedup", "near_dedup", "decontamination"])
def test_a_stage_leaves_only_what_its_result_reads(spark, name):
    """Tables that a stage writes for itself go before its result is read; the disk held them until the application ended."""
    from pathlib import Path

    import corpus_pipeline as P

    src = "/root/testdata/sf0.001"
    tables = lambda: set(Path(common.shared_dir(spark).removeprefix("file://")).glob("*"))
    before = tables()
    got = dict(P.STAGES)[name](spark, common.table(spark, src, "documents"), src)
    left = {p.name.rpartition("-")[0] for p in tables() - before}
    assert left == {"line_dedup": {"gone-lines"}, "near_dedup": {"groups", "first-rows", "copies", "repeated-rows"}, "decontamination": {"contaminated"}}[name]
    assert 0 < got.count() <= 200
