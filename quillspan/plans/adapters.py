"""Views of the given tables in the shapes that the operators expect.

Each is one SELECT that means the same in Spark and in standard SQL; ``{name}`` stands for
another view or a table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from quillspan.sources.tables import read_table

#: What a concept can be.
STATUSES = ("new", "to_test", "known", "failed", "queued", "learning", "mastered", "skipped")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_STATUS = "CASE cast(p_size % 8 AS int) " + " ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(STATUSES)) + " END"

VIEWS = {
    "v_subjects": "SELECT cast(r_regionkey AS bigint) AS subject_id, r_name AS name FROM {region}",
    "v_concepts": f"""SELECT cast(p_partkey AS bigint) AS id, cast(p_partkey % 5 AS bigint) AS subject_id, p_brand AS module, p_name AS name, p_type AS objective,
        CASE cast(p_size % 3 AS int) WHEN 0 THEN 'basic' WHEN 1 THEN 'intermediate' ELSE 'advanced' END AS level, {_STATUS} AS status,
        CASE WHEN cast(p_size % 8 AS int) IN (4, 5) THEN cast(p_partkey AS bigint) END AS queue_pos, p_partkey % 7 = 0 AS starred FROM {{part}}""",
    "v_modules": "SELECT subject_id, module, cast(row_number() OVER (PARTITION BY subject_id ORDER BY module) AS bigint) AS position FROM (SELECT DISTINCT subject_id, module FROM {v_concepts}) AS m",
    "v_books": "SELECT cast(c_custkey AS bigint) AS book_id, cast(c_nationkey % 5 AS bigint) AS subject_id, c_name AS title FROM {customer}",
    "v_sections": """SELECT section_id, book_id, chapter, cast(row_number() OVER (PARTITION BY book_id, chapter ORDER BY section_id) AS bigint) AS number, words
        FROM (SELECT cast(o_orderkey AS bigint) AS section_id, cast(o_custkey AS bigint) AS book_id, cast(month(o_orderdate) AS bigint) AS chapter,
        cast(floor(o_totalprice) AS bigint) % 2000 AS words FROM {orders}) AS o""",
    "v_sources": "SELECT DISTINCT cast(l_partkey AS bigint) AS concept_id, cast(l_orderkey AS bigint) AS section_id FROM {lineitem}",
    "v_prereqs": """SELECT DISTINCT cast(a.l_partkey AS bigint) AS concept_id, cast(b.l_partkey AS bigint) AS prereq_id FROM {lineitem} AS a JOIN {lineitem} AS b
        ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber WHERE a.l_partkey <> b.l_partkey""",
    "v_runs": """SELECT cast(o_orderkey AS bigint) AS id, cast(o_custkey AS bigint) AS book_id,
        CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE 'failed' END AS status FROM {orders}""",
    "v_questions": "SELECT DISTINCT cast(user_id AS bigint) AS session_id, event_type AS concept FROM {events}",
    "v_attempts": """SELECT cast(event_id AS bigint) AS id, cast(user_id AS bigint) AS session_id, event_type AS concept,
        CASE WHEN value < 20 THEN 0 WHEN value < 55 THEN 1 ELSE 2 END AS score, event_id % 11 = 0 AS disputed FROM {events}""",
    # four sessions a subject, a fifth for every third waiting concept, and some of one concept
    "v_session_concepts": """SELECT subject_id * 4 + cast(floor(id / 5) AS bigint) % 4 AS session_id, id AS concept_id, subject_id FROM {v_concepts} WHERE status IN ('to_test', 'known', 'failed')
        UNION ALL SELECT 20 + subject_id, id, subject_id FROM {v_concepts} WHERE status = 'to_test' AND id % 3 = 0
        UNION ALL SELECT 1000 + id, id, subject_id FROM {v_concepts} WHERE status = 'to_test' AND id % 20 IN (0, 3)""",
    "v_sessions": """SELECT session_id, m.subject_id, CASE WHEN count(DISTINCT module) = 1 THEN min(module) END AS module, CASE WHEN session_id < 20 AND session_id % 4 = 3 THEN 'test' ELSE 'diagnose' END AS kind,
        CASE WHEN session_id < 20 AND session_id % 4 = 2 THEN 'finished' ELSE 'ready' END AS status, count(*) AS total FROM {v_session_concepts} AS m JOIN {v_concepts} AS c ON c.id = m.concept_id GROUP BY session_id, m.subject_id""",
    "v_turns": """SELECT cast(conv_id AS bigint) AS video, cast(turn AS bigint) AS turn, role, text,
        cast(length(text) - length(replace(replace(text, ' ', ''), chr(10), '')) + 1 AS bigint) AS words FROM {conversations}""",
    "v_transcript": """SELECT video, turn, text, words, cast(floor(0.4 * coalesce(sum(words) OVER (PARTITION BY video ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS bigint) AS start,
        cast(floor(0.4 * sum(words) OVER (PARTITION BY video)) AS bigint) AS duration FROM {v_turns}""",
}


def sql_of(text: str) -> str:
    """Standard SQL for a statement over views and tables: the views it needs come first, as named sub-queries."""
    needed: list[str] = []

    def need(t: str) -> None:
        for name in re.findall(r"\{(v_\w+)\}", t):
            if name not in needed:
                need(VIEWS[name])
                needed.append(name)

    need(text)
    plain = lambda t: re.sub(r"\{(" + "|".join([*VIEWS, *TABLES]) + r")\}", r"\1", t)
    body = plain(text).strip()
    if not needed:
        return body
    views = ", ".join(f"{n} AS ({plain(VIEWS[n])})" for n in needed)
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {views}, {body[15:]}"
    return f"WITH {views}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {views} {body}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view or table as a DataFrame."""
    if name in TABLES:
        return read_table(spark, sf_dir, name)
    text = VIEWS[name]
    return spark.sql(text, **{n: view(spark, sf_dir, n) for n in set(re.findall(r"\{(\w+)\}", text))})
