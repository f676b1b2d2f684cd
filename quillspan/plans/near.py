"""Near-duplicate texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators import near as N
from quillspan.plans.adapters import view
from quillspan.plans.registry import query

SHINGLES = r"""w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM {documents}),
    l AS (SELECT doc_id, len(w) AS words, list_sort(list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)])) AS s FROM w WHERE len(w) >= 50),
    c AS (SELECT doc_id, words, s, min(doc_id) OVER (PARTITION BY s, words) AS cls FROM l),
    g AS (SELECT doc_id, words, len(s) AS n, unnest(s) AS s FROM c WHERE doc_id = cls)"""
#: All pairs of classes by their shared shingles, the plain way.
PAIRS = """SELECT x.doc_id AS a, y.doc_id AS b, round(cast(count(*) AS double) / (x.n + y.n - count(*)), 6) AS similarity FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id
    WHERE abs(x.words - y.words) <= y.words * 0.2 GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING cast(count(*) AS double) / (x.n + y.n - count(*)) >= 0.8 - 1e-12"""


@query("w7_near_duplicates", f"WITH {SHINGLES} {PAIRS}")
def w7(spark, d):
    return N.near_duplicates(view(spark, d, "documents"))[0]


@query("w7_classes", f"WITH {SHINGLES}, p AS ({PAIRS}), k AS (SELECT cls, count(*) AS links FROM (SELECT a AS cls FROM p UNION ALL SELECT b FROM p) e GROUP BY 1) SELECT doc_id, cls, count(*) OVER (PARTITION BY cls) AS members, coalesce(links, 0) AS links FROM c LEFT JOIN k USING (cls)")
def w7c(spark, d):
    return N.near_classes(view(spark, d, "documents"))


#: Representatives with links in order; each is kept unless one of its earlier neighbours is.
_KEPT = """o AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM (SELECT a AS id FROM p UNION SELECT b FROM p) e),
    e AS (SELECT o.k, o.id, coalesce(list(p.a) FILTER (WHERE p.a IS NOT NULL), []) AS earlier FROM o LEFT JOIN p ON p.b = o.id GROUP BY 1, 2),
    t(k, kept) AS (SELECT cast(0 AS bigint), cast([] AS bigint[]) UNION ALL SELECT e.k, CASE WHEN list_has_any(e.earlier, t.kept) THEN t.kept ELSE list_append(t.kept, e.id) END FROM t JOIN e ON e.k = t.k + 1)"""


@query(
    "w7_drop_near_duplicates",
    f"""WITH RECURSIVE {SHINGLES}, p AS ({PAIRS}), {_KEPT}, f AS (SELECT kept FROM t ORDER BY k DESC LIMIT 1)
    SELECT doc_id, source, lang, length(text) AS n_chars FROM {{documents}} d WHERE doc_id NOT IN (SELECT doc_id FROM c WHERE doc_id <> cls) AND doc_id NOT IN (SELECT id FROM o, f WHERE NOT list_contains(f.kept, o.id))""",
)
def w7d(spark, d):
    return N.drop_near_duplicates(view(spark, d, "documents")).select("doc_id", "source", "lang", F.length("text").cast("long").alias("n_chars"))
