"""Queries over the learner operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators import learner as L
from quillspan.plans.adapters import view
from quillspan.plans.registry import query

_LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, concept ORDER BY id DESC) AS r FROM {v_attempts}) t WHERE r = 1)"
_OK = "coalesce(score = 2 OR disputed, false)"
_SCORES = f"(SELECT q.session_id, count(*) FILTER (WHERE {_OK}) AS correct, count(*) AS total, count(*) FILTER (WHERE {_OK}) = count(*) AS passed FROM {{v_questions}} q LEFT JOIN {_LATEST} a USING (session_id, concept) GROUP BY 1)"
_QUEUE = "(SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY queue_pos, id) AS position FROM {v_concepts} WHERE status IN ('queued', 'learning'))"
_PLACE = "(SELECT concept_id, min((book_id, chapter, number)) AS place FROM {v_sources} JOIN {v_sections} USING (section_id) GROUP BY 1)"
#: Sessions of a learner with one concept each.
_SESSIONS = "(SELECT user_id AS session_id, 1 + user_id % 40 AS concept_id, CASE WHEN user_id % 4 = 0 THEN 'open' ELSE 'done' END AS status FROM (SELECT DISTINCT user_id FROM {events}) u)"
_WAITING = "(SELECT session_id, concept, CASE WHEN session_id % 3 = 0 THEN 'known' ELSE 'to_test' END AS status FROM {v_questions})"


def _attempts(spark, d):
    return view(spark, d, "v_attempts")


def _questions(spark, d):
    return view(spark, d, "v_questions")


def _waiting(spark, d):
    return _questions(spark, d).withColumn("status", F.expr("case when session_id % 3 = 0 then 'known' else 'to_test' end"))


def _sessions(spark, d):
    return view(spark, d, "events").select("user_id").distinct().selectExpr("user_id session_id", "1 + user_id % 40 concept_id", "case when user_id % 4 = 0 then 'open' else 'done' end status")


def _scores(spark, d):
    return L.test_score(_questions(spark, d), _attempts(spark, d))


@query("r8_latest_attempts", f"SELECT session_id, concept, id, score, disputed FROM {_LATEST} t")
def r8(spark, d):
    return L.latest_attempts(_attempts(spark, d)).select("session_id", "concept", "id", "score", "disputed")


@query("r4_open_diagnoses", f"SELECT w.session_id, count(*) FILTER (WHERE w.status = 'to_test') AS concepts, count(*) AS questions, count(*) FILTER (WHERE a.id IS NOT NULL) AS answered FROM {_WAITING} w LEFT JOIN {_LATEST} a USING (session_id, concept) GROUP BY 1 HAVING count(*) FILTER (WHERE w.status = 'to_test') > 0")
def r4(spark, d):
    return L.open_diagnoses(_waiting(spark, d), _questions(spark, d), _attempts(spark, d))


@query("r6_test_score", f"SELECT * FROM {_SCORES} s")
def r6(spark, d):
    return _scores(spark, d)


@query("r7_diagnosis_outcome", f"SELECT w.session_id, w.concept, CASE WHEN {_OK} THEN 'known' ELSE 'failed' END AS outcome FROM {_WAITING} w LEFT JOIN {_LATEST} a USING (session_id, concept) WHERE w.status = 'to_test'")
def r7(spark, d):
    return L.diagnosis_outcome(_waiting(spark, d), _questions(spark, d), _attempts(spark, d))


@query("r10_failed_tests", f"SELECT concept_id, count(*) AS failed FROM {_SESSIONS} s JOIN {_SCORES} r USING (session_id) WHERE status = 'done' AND NOT passed GROUP BY 1")
def r10(spark, d):
    return L.failed_tests(_sessions(spark, d), _scores(spark, d))


@query(
    "r11_session_results",
    """SELECT concept_id, n, first_question, last_answer FROM (SELECT concept_id, count(*) AS n, min_by(text, position) AS first_question, max_by(answer, position) AS last_answer FROM
    (SELECT o.o_custkey % 50 AS concept_id, o.o_orderkey AS position, o.o_orderpriority AS text, CASE WHEN l.l_linenumber IS NULL THEN '(no answer)' ELSE ['a', 'b', 'c', 'd'][l.l_linenumber] END AS answer, l.l_quantity
    FROM {orders} o LEFT JOIN (SELECT l_orderkey, max(l_linenumber) FILTER (WHERE l_linenumber <= 4) AS l_linenumber, 0 AS l_quantity FROM {lineitem} WHERE l_linenumber <= 4 GROUP BY 1) l ON l.l_orderkey = o.o_orderkey
    WHERE coalesce(o.o_orderkey % 3, 0) <> 0) t GROUP BY 1) u""",
)
def r11(spark, d):
    o, li = view(spark, d, "orders"), view(spark, d, "lineitem")
    q = o.select(F.col("o_orderkey").alias("question_id"), (F.col("o_custkey") % 50).alias("concept_id"), F.col("o_orderkey").alias("position"), F.col("o_orderpriority").alias("text"), F.array(*[F.lit(x) for x in "abcd"]).alias("choices"))
    picked = li.where("l_linenumber <= 4").select(F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").cast("long").alias("id"), (F.col("l_linenumber") - 1).cast("string").alias("answer"), F.lit("").alias("feedback"))
    attempts = picked.withColumn("score", F.when(F.col("question_id") % 3 == 0, 2).otherwise(0)).withColumn("disputed", F.lit(False))
    asked = q.where("question_id % 3 <> 0").unionAll(q.where("question_id % 3 = 0").join(attempts, "question_id", "left_semi"))
    got = L.session_results(asked, attempts)
    return got.select("concept_id", F.size("wrong").cast("long").alias("n"), F.get("wrong", F.lit(0))["question"].alias("first_question"), F.element_at("wrong", -1)["answer"].alias("last_answer"))


@query("r19_latest_open_session", f"SELECT concept, max(session_id) AS session_id FROM {_WAITING} w WHERE status = 'to_test' GROUP BY 1")
def r19(spark, d):
    return L.latest_open_session(_waiting(spark, d))


@query("r20_seen_questions", "SELECT concept, text, id FROM (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY id DESC) AS r FROM (SELECT event_type AS concept, props AS text, min(event_id) AS id FROM {events} GROUP BY 1, 2) a) b WHERE r <= 10")
def r20(spark, d):
    e = view(spark, d, "events").selectExpr("event_type concept", "props text", "event_id id")
    return L.seen_questions(e)


@query("k3_recent_mistakes", "SELECT concept, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY id DESC) AS rank FROM {v_attempts} WHERE score < 2 AND NOT disputed) t WHERE rank <= 4")
def k3(spark, d):
    return L.recent_mistakes(_attempts(spark, d)).select("concept", "id", "rank")


@query("c16_grade", "SELECT event_id, cast(CASE WHEN event_id % 2 = 0 THEN CASE WHEN event_id % 3 = user_id % 3 THEN 2 ELSE 0 END ELSE least(greatest(floor(value / 10 + 0.5), 0), 2) END AS bigint) AS score FROM {events}")
def c16(spark, d):
    e = view(spark, d, "events").selectExpr("event_id", "event_id % 2 = 0 is_choice", "event_id % 3 picked", "user_id % 3 answer", "value / 10 raw")
    return L.grade(e).select("event_id", "score")


@query("q1_queue", f"SELECT subject_id, id, position FROM {_QUEUE} q")
def q1(spark, d):
    return L.queue(view(spark, d, "v_concepts")).select("subject_id", "id", "position")


@query(
    "q2_queue_warnings",
    f"""SELECT subject_id, concept_id, n_later, n_missing, CASE WHEN n_later > 0 THEN 'later' ELSE 'missing' END AS warning FROM (SELECT a.subject_id, e.concept_id, count(*) FILTER (WHERE b.position > a.position) AS n_later,
    count(*) FILTER (WHERE b.position IS NULL AND c.status NOT IN ('known', 'mastered')) AS n_missing FROM {{v_prereqs}} e JOIN {_QUEUE} a ON a.id = e.concept_id JOIN {{v_concepts}} c ON c.id = e.prereq_id LEFT JOIN {_QUEUE} b ON b.id = e.prereq_id GROUP BY 1, 2) t WHERE n_later + n_missing > 0""",
)
def q2(spark, d):
    got = L.queue_warnings(view(spark, d, "v_concepts"), view(spark, d, "v_prereqs"))
    return got.select("subject_id", "concept_id", F.size("later").cast("long").alias("n_later"), F.size("missing").cast("long").alias("n_missing"), "warning")


@query("q4_queue_book_order", f"SELECT subject_id, id, row_number() OVER (PARTITION BY subject_id ORDER BY place NULLS LAST, queue_pos, id) AS position FROM {_QUEUE} q LEFT JOIN {_PLACE} p ON p.concept_id = q.id")
def q4(spark, d):
    return L.queue_book_order(view(spark, d, "v_concepts"), view(spark, d, "v_sources"), view(spark, d, "v_sections"))


@query("q5_order_differs", f"SELECT subject_id, bool_or(position <> other) AS differs FROM (SELECT subject_id, id, position, row_number() OVER (PARTITION BY subject_id ORDER BY place NULLS LAST, queue_pos, id) AS other FROM {_QUEUE} q LEFT JOIN {_PLACE} p ON p.concept_id = q.id) t GROUP BY 1")
def q5(spark, d):
    c = view(spark, d, "v_concepts")
    return L.order_differs(L.queue(c), L.queue_book_order(c, view(spark, d, "v_sources"), view(spark, d, "v_sections")))


@query("q6_valid_order", f"SELECT subject_id, subject_id % 2 = 0 OR bool_and(id % 40 <> 4) AS valid FROM {_QUEUE} q GROUP BY 1")
def q6(spark, d):
    q = L.queue(view(spark, d, "v_concepts"))
    return L.valid_order(q, q.where("subject_id % 2 = 0 or id % 40 <> 4"))


@query(
    "q7_queue_edit",
    f"""SELECT subject_id, id, row_number() OVER (PARTITION BY subject_id ORDER BY CASE WHEN id % 9 = 1 THEN 0 WHEN status = 'failed' THEN 2 ELSE 1 END, position NULLS LAST, id) AS position
    FROM (SELECT subject_id, id, position, status FROM {_QUEUE} q UNION ALL SELECT subject_id, id, NULL, status FROM {{v_concepts}} WHERE status = 'failed' AND id % 9 NOT IN (0, 1)) t WHERE id % 9 <> 0""",
)
def q7(spark, d):
    c = view(spark, d, "v_concepts")
    q = L.queue(c)
    edits = q.where("id % 9 < 2").selectExpr("subject_id", "id", "case id % 9 when 0 then 'remove' else 'top' end edit").unionAll(c.where("status = 'failed' and id % 9 not in (0, 1)").selectExpr("subject_id", "id", "'end' edit"))
    return L.queue_edit(q, edits)


_MARK = "CASE id % 10 WHEN 0 THEN 'learn' WHEN 1 THEN 'later' WHEN 2 THEN 'skip' WHEN 3 THEN 'test' END"


#: Marked concepts with the latest open diagnosis in which they wait; _PUT sends a concept to the end of the queue, _OUT takes it out.
_OPEN = "(SELECT session_id FROM {v_sessions} WHERE kind = 'diagnose' AND status <> 'finished')"
_MARKED = f"(SELECT c.*, {_MARK} AS mark, CASE WHEN status = 'to_test' THEN (SELECT max(session_id) FROM {{v_session_concepts}} m WHERE m.concept_id = c.id AND session_id IN {_OPEN}) END AS waits FROM {{v_concepts}} c)"
_PUT = "(mark = 'learn' AND status <> 'queued')"
_OUT = "(mark IN ('later', 'skip') OR mark = 'test' AND waits IS NULL)"
_LEFT = f"(SELECT session_id, concept_id FROM {{v_session_concepts}} m JOIN {_MARKED} k ON k.id = m.concept_id WHERE waits IS NOT NULL AND mark IN ('learn', 'later', 'skip') AND session_id IN {_OPEN})"
_NEW = f"(SELECT (SELECT max(session_id) FROM {{v_sessions}}) + row_number() OVER (ORDER BY subject_id) AS session_id, * FROM (SELECT subject_id, CASE WHEN count(DISTINCT module) = 1 THEN min(module) END AS module, count(*) AS total FROM {_MARKED} k WHERE mark = 'test' AND waits IS NULL GROUP BY 1) n)"


def _apply_marks(spark, d):
    c = view(spark, d, "v_concepts")
    return L.apply_marks(c, c.selectExpr("id", f"{_MARK} mark"), view(spark, d, "v_sessions"), view(spark, d, "v_session_concepts"))


@query(
    "q8_apply_marks",
    f"""WITH k AS (SELECT * FROM {_MARKED} m), f AS (SELECT subject_id, min(id) AS first FROM k WHERE {_PUT} GROUP BY 1),
    l AS (SELECT subject_id, coalesce(max(queue_pos), 0) AS last FROM k JOIN f USING (subject_id) WHERE NOT (coalesce({_OUT}, false) AND id < first) GROUP BY 1)
    SELECT subject_id, id, CASE WHEN mark = 'learn' THEN 'queued' WHEN mark = 'later' THEN 'new' WHEN mark = 'skip' THEN 'skipped' WHEN mark = 'test' THEN 'to_test' ELSE status END AS status,
    CASE WHEN {_PUT} THEN last + row_number() OVER (PARTITION BY subject_id, coalesce({_PUT}, false) ORDER BY id) WHEN {_OUT} THEN NULL ELSE queue_pos END AS queue_pos FROM k LEFT JOIN l USING (subject_id)""",
)
def q8(spark, d):
    return _apply_marks(spark, d).concepts


@query(
    "q8_sessions",
    f"""SELECT s.session_id, s.subject_id, s.module, s.kind, s.status, total - coalesce(n, 0) AS total FROM {{v_sessions}} s LEFT JOIN (SELECT session_id, count(*) AS n FROM {_LEFT} x GROUP BY 1) g ON g.session_id = s.session_id WHERE total > coalesce(n, 0)
    UNION ALL SELECT session_id, subject_id, module, 'diagnose', 'preparing', total FROM {_NEW} y""",
)
def q8_sessions(spark, d):
    return _apply_marks(spark, d).sessions


@query(
    "q8_session_members",
    f"""SELECT session_id, concept_id FROM {{v_session_concepts}} m WHERE NOT EXISTS (SELECT 1 FROM {_LEFT} x WHERE x.session_id = m.session_id AND x.concept_id = m.concept_id)
    UNION ALL SELECT y.session_id, k.id FROM {_NEW} y JOIN {_MARKED} k ON k.subject_id = y.subject_id WHERE mark = 'test' AND waits IS NULL""",
)
def q8_members(spark, d):
    return _apply_marks(spark, d).members


@query(
    "q8_mark_results",
    f"""SELECT k.subject_id, coalesce(y.session_id, max(CASE WHEN mark = 'test' THEN waits END)) AS session_id, y.session_id IS NOT NULL AS new_session, count(*) FILTER (WHERE mark = 'learn') AS queued, count(*) FILTER (WHERE mark = 'skip') AS skipped
    FROM {_MARKED} k LEFT JOIN {_NEW} y ON y.subject_id = k.subject_id WHERE mark IS NOT NULL GROUP BY k.subject_id, y.session_id""",
)
def q8_results(spark, d):
    return _apply_marks(spark, d).results


_CHOICE = "CASE id % 4 WHEN 0 THEN 'learn' WHEN 1 THEN 'skip' WHEN 2 THEN 'keep' END"


@query(
    "q8_apply_choices",
    f"""WITH k AS (SELECT *, {_CHOICE} AS choice FROM {{v_concepts}}), f AS (SELECT subject_id, min(id) AS first FROM k WHERE choice = 'learn' GROUP BY 1),
    l AS (SELECT subject_id, coalesce(max(queue_pos), 0) AS last FROM k JOIN f USING (subject_id) WHERE NOT (coalesce(choice, '') = 'skip' AND id < first) GROUP BY 1)
    SELECT subject_id, id, CASE choice WHEN 'learn' THEN 'queued' WHEN 'skip' THEN 'skipped' ELSE status END AS status,
    CASE WHEN choice = 'learn' THEN last + row_number() OVER (PARTITION BY subject_id, coalesce(choice, '') ORDER BY id) WHEN choice = 'skip' THEN NULL ELSE queue_pos END AS queue_pos FROM k LEFT JOIN l USING (subject_id)""",
)
def q8_choices(spark, d):
    c = view(spark, d, "v_concepts")
    return L.apply_choices(c, c.selectExpr("id", f"{_CHOICE} choice"))


@query(
    "q8_mark_counts",
    f"""SELECT subject_id, count(*) FILTER (WHERE mark = 'learn') AS n_learn, count(*) FILTER (WHERE mark = 'later') AS n_later, count(*) FILTER (WHERE mark = 'skip') AS n_skip, count(*) FILTER (WHERE mark = 'test') AS n_test,
    CASE WHEN count(DISTINCT module) = 1 THEN min(module) END AS module FROM (SELECT *, {_MARK} AS mark FROM {{v_concepts}}) t WHERE mark IS NOT NULL GROUP BY 1""",
)
def q8b(spark, d):
    c = view(spark, d, "v_concepts")
    return L.mark_counts(c.selectExpr("id", f"{_MARK} mark").where("mark is not null"), c)


@query("q9_missing_prereqs", "SELECT concept_id, prereq_id, name, status FROM {v_prereqs} JOIN {v_concepts} c ON c.id = prereq_id WHERE status NOT IN ('known', 'mastered')")
def q9(spark, d):
    return L.missing_prereqs(view(spark, d, "v_concepts"), view(spark, d, "v_prereqs"))


@query(
    "q10_test_outcome",
    f"""SELECT s.session_id, s.concept_id, r.passed, r.correct, r.total, coalesce(f.failed, 0) AS failed, s.concept_id IN (SELECT concept_id FROM {{v_prereqs}}) AS has_prereqs, CASE WHEN r.passed THEN n.id END AS next_id
    FROM {_SESSIONS} s JOIN {_SCORES} r USING (session_id) JOIN {{v_concepts}} c ON c.id = s.concept_id LEFT JOIN (SELECT concept_id, count(*) AS failed FROM {_SESSIONS} s2 JOIN {_SCORES} r2 USING (session_id) WHERE status = 'done' AND NOT passed GROUP BY 1) f ON f.concept_id = s.concept_id
    LEFT JOIN (SELECT subject_id, id FROM {_QUEUE} q WHERE position = 1) n ON n.subject_id = c.subject_id""",
)
def q10(spark, d):
    return L.test_outcome(_scores(spark, d), _sessions(spark, d), view(spark, d, "v_concepts"), view(spark, d, "v_prereqs"))


@query("q11_mark_learning", f"SELECT c.subject_id, c.id, CASE WHEN c.id = q.id THEN 'learning' WHEN c.status = 'learning' AND q.id IS NOT NULL THEN 'queued' ELSE c.status END AS status FROM {{v_concepts}} c LEFT JOIN (SELECT subject_id, id FROM {_QUEUE} t WHERE position = 2 AND subject_id <> 3) q USING (subject_id)")
def q11(spark, d):
    c = view(spark, d, "v_concepts")
    return L.mark_learning(c, L.queue(c).where("position = 2 and subject_id <> 3"))


@query("q12_leave_sessions", "SELECT session_id, count(*) AS total FROM {v_questions} WHERE concept NOT IN ('error', 'click') GROUP BY 1")
def q12(spark, d):
    q = _questions(spark, d)
    return L.leave_sessions(q, q.where("concept in ('error', 'click')").select("concept").distinct())


@query("q13_fail_interrupted", "SELECT id, book_id, CASE WHEN status = 'running' THEN 'failed' ELSE status END AS status, CASE WHEN status = 'running' THEN 'interrupted while running' END AS message FROM {v_runs}")
def q13(spark, d):
    return L.fail_interrupted(view(spark, d, "v_runs"))


@query("q14_attempt_edits", "SELECT id, score, disputed OR session_id % 7 = 1 AS disputed FROM {v_attempts} WHERE NOT (session_id % 5 = 0 AND session_id % 2 = 1)")
def q14(spark, d):
    q = _questions(spark, d)
    done = q.where("session_id % 2 = 0").select("session_id").distinct()
    return L.apply_attempt_edits(_attempts(spark, d), q.where("session_id % 5 = 0"), q.where("session_id % 7 = 1"), done).select("id", "score", "disputed")


@query("q15_repeat_test", f"SELECT s.session_id + 1000000 AS session_id, s.concept_id, q.concept AS text, 3 AS n_choices FROM (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY session_id DESC) AS r FROM {_SESSIONS} s WHERE status = 'done') s JOIN {{v_questions}} q USING (session_id) WHERE r = 1")
def q15(spark, d):
    s = _sessions(spark, d)
    q = _questions(spark, d).join(s, "session_id").select("session_id", "concept_id", F.col("concept").alias("text"), F.lit(1).alias("position"), F.array(F.lit("x"), F.lit("y"), F.col("concept")).alias("choices"))
    return L.repeat_test(q, s, 1000000).select("session_id", "concept_id", "text", F.size("choices").alias("n_choices"))
