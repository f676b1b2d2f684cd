"""Registered queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import bestfit, decontaminate, exact, html, lines, lm, merkle, orchard, packing, pii, quality, simhash, tokens
from quillspan.llm.common import table


def tokenizer_file(name: str) -> str:
    """Where the installed vocabulary file lies; its folder is the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), folds=7, held_out=2)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ensemble = quality.learn(docs, table(spark, sf_dir, "labels"), folds=4, held_out=2)
    return quality.score(docs, ensemble, folds=4, held_out=2, threshold=0.7)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end=2, window=4096)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(lines.drop_repeated_lines(table(spark, sf_dir, "documents")))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_classes(table(spark, sf_dir, "documents"), keep="max")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orchard.compress(table(spark, sf_dir, "embeddings"))


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = bestfit.cut_pieces(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end=0, window=2048)
    return bestfit.place(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), window=2048)


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    leaf = lambda text: merkle.leaf_digest([*map(F.col, ("doc_id", "source", "lang", "n_chars")), text])
    lowered = F.translate("text", ascii_uppercase, ascii_lowercase)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    leaves = docs.select("doc_id", "lang", leaf(F.col("text")).alias("leaf"), F.when(tampered, leaf(lowered)).alias("now"))
    rows = merkle.manifest(leaves, arity=8).withColumn("folded_root", merkle.fold(F.coalesce("now", "leaf")))
    return rows.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest().alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: The plain patterns; for the kinds with borders on both sides, whole runs of their characters that match.
_PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_bool_and([coalesce(try_cast(p AS BIGINT), 999) <= 255 FOR p IN string_split(found, '.')])"),
    ("card", r"[0-9]([\x20-]?[0-9])+", "length(digits) BETWEEN 12 AND 19 AND list_sum([CASE WHEN k % 2 = 1 THEN x ELSE x * 2 - CASE WHEN x > 4 THEN 9 ELSE 0 END END FOR x, k IN [cast(c AS INTEGER) FOR c IN string_split(reverse(digits), '')]]) % 10 = 0"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(digits) BETWEEN 9 AND 15"),
    ("iban", r"[A-Z0-9]+", "regexp_full_match(found, '[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}') AND list_reduce([CASE WHEN c BETWEEN '0' AND '9' THEN 100 + cast(c AS BIGINT) ELSE ord(c) - 55 END FOR c IN string_split(CASE WHEN length(found) BETWEEN 15 AND 34 AND regexp_full_match(found, '[A-Z0-9]+') THEN found[5:] || found[1:4] ELSE '0' END, '')], lambda a, x: CASE WHEN x >= 100 THEN (a * 10 + x - 100) % 97 ELSE (a * 100 + x) % 97 END, cast(0 AS BIGINT)) = 1"),
    ("ssn", r"[0-9-]+", "regexp_full_match(found, '[0-9]{3}-[0-9]{2}-[0-9]{4}')"),
)


def _pii_sql() -> str:
    branches = []
    for rank, (kind, pattern, valid) in enumerate(_PII):
        k = pii.KINDS[rank]
        branches.append(
            f"""SELECT doc_id, start, {rank} AS rank, start + length(found) AS stop, '{kind}' AS kind, {str(k.base).lower()} AS base,
            least({k.score}::DOUBLE + CASE WHEN regexp_matches(lower(substring(text, greatest(start - {pii.CONTEXT_CHARS - 1}, 1), least(start, {pii.CONTEXT_CHARS}))), '{k.context}') THEN {pii.CONTEXT_WEIGHT}::DOUBLE ELSE 0.0::DOUBLE END, 1.0::DOUBLE) AS score
            FROM (SELECT *, regexp_replace(found, '[^0-9]', '', 'g') AS digits FROM (SELECT doc_id, text, ms[i] AS found, cast(coalesce(list_sum([length(g) FOR g IN gaps[1:i]]), 0) + coalesce(list_sum([length(m) FOR m IN ms[1:i - 1]]), 0) AS BIGINT) AS start
            FROM (SELECT doc_id, text, ms, gaps, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{pattern}') AS ms, string_split_regex(coalesce(text, ''), '{pattern}') AS gaps FROM documents) a) b) c) d WHERE {valid}"""
        )
    line = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) {}, '')"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k.name}') AS n_{k.name}" for k in pii.KINDS[:4])
    return f"""WITH every AS ({" UNION ALL ".join(branches)}), spans AS (SELECT * FROM every WHERE base OR score >= {pii.THRESHOLD})
    SELECT d.doc_id, {counts}, sha256({line.format("FILTER (WHERE base)")}) AS base_sha256, {line.format("FILTER (WHERE kind IS NOT NULL)")} AS spans, round(coalesce(max(score), 0.0::DOUBLE), 6) AS top_score
    FROM documents d LEFT JOIN spans s ON s.doc_id = d.doc_id GROUP BY d.doc_id"""


#: Equal lines of any length; word variants of lines of five words or more, then the earliest line per variant. As in the operator, an earlier line need not stay itself.
OP8_SQL = """
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT doc_id, i AS pos,
         trim(regexp_replace(lower(ls[i]), '[\t\x0B\f\r ]+', ' ', 'g')) AS norm
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM split)
), counted AS (
  SELECT doc_id, pos, norm, (doc_id, pos) AS place FROM lines WHERE norm <> ''
), firsts AS (
  SELECT norm, min(place) AS born, string_split(norm, ' ') AS w FROM counted GROUP BY norm
), variants AS (
  SELECT norm, born, i, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') AS v
  FROM (SELECT norm, born, w, unnest(range(1, len(w) + 1)) AS i FROM firsts WHERE len(w) >= 5)
), swap AS (
  SELECT norm, born, min(born) OVER (PARTITION BY v, i) AS earlier FROM variants
), pairs AS (
  SELECT a.norm AS longer, a.born AS longer_first, b.norm AS shorter, b.born AS shorter_first
  FROM variants a JOIN firsts b ON a.v = b.norm WHERE len(b.w) >= 5
), near AS (
  SELECT norm FROM swap WHERE earlier < born
  UNION SELECT longer FROM pairs WHERE shorter_first < longer_first
  UNION SELECT shorter FROM pairs WHERE longer_first < shorter_first
), gone AS (
  SELECT c.doc_id, c.pos FROM counted c JOIN firsts f USING (norm) LEFT JOIN near n USING (norm)
  WHERE c.place > f.born OR n.norm IS NOT NULL
), positions AS (
  SELECT doc_id, list(pos) AS gone FROM gone GROUP BY doc_id
), cleaned AS (
  SELECT doc_id, len(ls) AS n_lines, coalesce(len(gone), 0) AS n_removed,
         array_to_string([ls[i] FOR i IN range(1, len(ls) + 1) IF NOT list_contains(coalesce(gone, []), i)], chr(10)) AS kept
  FROM split LEFT JOIN positions USING (doc_id)
)
SELECT doc_id, n_lines, n_removed, length(kept) AS kept_chars, sha256(kept) AS kept_sha256 FROM cleaned
"""

OP10_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def _op13_sql(arity: int = 8, depth: int = 10, tops: int = 4) -> str:
    """Levels one by one: ``depth`` of them for a language's leaves, ``tops`` for the subroots."""
    value = lambda c, text="{}": f"coalesce(strlen(cast({text.format(c)} AS VARCHAR)) || ':' || {text.format(c)}, '-')"
    leaf = lambda text: f"sha256({' || '.join([*map(value, ('doc_id', 'source', 'lang', 'n_chars')), value('text', text)])})"
    lowered = f"translate({{}}, '{ascii_uppercase}', '{ascii_lowercase}')"
    #: A byte enters in the first of its eight steps.
    crc = "4294967295 - list_reduce(flatten([[ord(c), 0, 0, 0, 0, 0, 0, 0] FOR c IN string_split(cast(doc_id AS VARCHAR), '')]), lambda a, e: xor(xor(a, e) >> 1, 3988292384 * (xor(a, e) & 1)), cast(4294967295 AS BIGINT))"
    ctes = [f"l AS (SELECT *, CASE WHEN ({crc}) % 3 = 0 THEN {leaf(lowered)} ELSE leaf END AS now FROM (SELECT *, {leaf('{}')} AS leaf FROM documents) d)"]
    ctes.append("n0 AS (SELECT coalesce('=' || lang, '') AS grp, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, leaf AS h, doc_id, now, count(*) OVER (PARTITION BY lang) AS n FROM l)")

    def grow(name: str, levels: int) -> None:
        for k in range(levels):
            ctes.append(f"{name}{k + 1} AS (SELECT grp, idx // {arity} AS idx, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY idx)) END AS h, (any_value(n) + {arity - 1}) // {arity} AS n FROM {name}{k} GROUP BY grp, idx // {arity})")

    def walk(name: str, levels: int, start: str) -> str:
        """Folds and proofs of ``start`` (grp, pos, proof, f) through the levels."""
        for k in range(levels):
            ctes.append(f"{name}w{k} AS (SELECT s.*, coalesce(r.l, '') AS l, coalesce(r.r, '') AS r, r.n FROM {start} s JOIN (SELECT a.grp, a.idx, a.n, string_agg(b.h, '' ORDER BY b.idx) FILTER (WHERE b.idx < a.idx) AS l, string_agg(b.h, '' ORDER BY b.idx) FILTER (WHERE b.idx > a.idx) AS r FROM {name}{k} a JOIN {name}{k} b ON a.grp = b.grp AND a.idx // {arity} = b.idx // {arity} GROUP BY 1, 2, 3) r ON s.grp = r.grp AND s.pos = r.idx)")
            ctes.append(f"{name}p{k} AS (SELECT * EXCLUDE (pos, proof, f, l, r, n), pos // {arity} AS pos, CASE WHEN n = 1 THEN proof ELSE proof || l || r END AS proof, CASE WHEN n = 1 THEN f ELSE sha256(l || f || r) END AS f FROM {name}w{k})")
            start = f"{name}p{k}"
        return start

    grow("n", depth)
    ctes.append(f"t0 AS (SELECT 'all' AS grp, row_number() OVER (ORDER BY grp) - 1 AS idx, h, grp AS lang, count(*) OVER () AS n FROM n{depth})")
    grow("t", tops)
    ctes.append("s AS (SELECT grp, idx AS pos, doc_id, h AS leaf, now AS f, '' AS proof FROM n0)")
    inner = walk("n", depth, "s")
    ctes.append(f"u AS (SELECT 'all' AS grp, t.idx AS pos, i.doc_id, i.leaf, i.f, i.proof, t.h AS subroot FROM {inner} i JOIN t0 t ON t.lang = i.grp)")
    outer = walk("t", tops, "u")
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, t.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = t.h AS verified FROM {outer}, t{tops} t"


def _op11_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The nearest entry by comparing all entries, round by round."""
    ctes = [f"k AS (SELECT vec_id, label, [cast(floor({scale} * cast(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings WHERE embedding IS NOT NULL AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding]))"]
    ctes.append(f"p AS (SELECT vec_id, part, v[part * (len(v) // {parts}) + 1:(part + 1) * (len(v) // {parts})] AS q FROM k, range({parts}) AS r(part))")
    ctes.append(f"b0 AS (SELECT part, i AS entry, q AS c FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM k ORDER BY vec_id LIMIT {entries}) f USING (vec_id))")
    for j in range(rounds + 1):
        ctes.append(f"a{j} AS (SELECT vec_id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT vec_id, p.part, entry, list_sum([(x - c[i]) * (x - c[i]) FOR x, i IN q]) AS d FROM p JOIN b{j} USING (part)) e GROUP BY 1, 2)")
        if j < rounds:
            ctes.append(f"m{j} AS (SELECT part, entry, list(cast(floor(s / n) AS BIGINT) ORDER BY i) AS c FROM (SELECT part, entry, i, sum(q[i]) AS s, count(*) AS n FROM p JOIN a{j} USING (vec_id, part), range(1, 1000) AS r(i) WHERE i <= len(q) GROUP BY 1, 2, 3) t GROUP BY 1, 2)")
            ctes.append(f"b{j + 1} AS (SELECT part, entry, coalesce(m{j}.c, b{j}.c) AS c FROM b{j} LEFT JOIN m{j} USING (part, entry))")
    ctes.append(f"s AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS h FROM b{rounds})")
    ctes.append(f"e AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, cast(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY 1)")
    return f"WITH {', '.join(ctes)} SELECT vec_id, code, error, cast(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM e JOIN k USING (vec_id), s"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_lm_scores": op2_lm_scores,
        "op3_pii": op3_pii,
        "op4_decontaminate": op4_decontaminate,
        "op5_quality": op5_quality,
        "op6_packing": op6_packing,
        "op7_html_text": op7_html_text,
        "op8_line_dedup": op8_line_dedup,
        "op9_simhash": op9_simhash,
        "op10_exact_dedup": op10_exact_dedup,
        "op11_vector_codes": op11_vector_codes,
        "op12_best_fit": op12_best_fit,
        "op13_manifest": op13_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_pii": _pii_sql(), "op8_line_dedup": OP8_SQL, "op10_exact_dedup": OP10_SQL, "op11_vector_codes": _op11_sql(), "op13_manifest": _op13_sql()}
