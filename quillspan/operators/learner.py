"""Attempts, sessions, statuses and the study queue."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.operators.fixpoint import cut, numbered
from quillspan.operators.reports import concept_place, latest_by, next_to_learn

QUESTION = ["session_id", "concept"]
LEVELS = ("basic", "intermediate", "advanced")
KNOWN = ("known", "mastered")


def latest_attempts(attempts: DataFrame, keys: list[str] = QUESTION) -> DataFrame:
    """The attempt with the highest id of each question; map-side combining, no sort."""
    rest = [c for c in attempts.columns if c not in keys]
    got = attempts.groupBy(*keys).agg(F.max_by(F.struct(*rest), "id").alias("a"))
    return got.select(*keys, *[F.col(f"a.{c}").alias(c) for c in rest])


def correct() -> Column:
    """Full score, or disputed."""
    return (F.col("score") == 2) | F.col("disputed")


def grade(df: DataFrame) -> DataFrame:
    """A choice is right (2) or wrong (0); any other score is rounded and clamped to 0..2."""
    clamped = F.least(F.greatest(F.floor(F.col("raw") + 0.5), F.lit(0)), F.lit(2)).cast("long")
    return df.withColumn("score", F.when(F.col("is_choice"), F.when(F.col("picked") == F.col("answer"), 2).otherwise(0).cast("long")).otherwise(clamped))


def test_score(questions: DataFrame, attempts: DataFrame) -> DataFrame:
    """Per session: correct, total, passed (something asked and all of it correct); unanswered is wrong."""
    got = questions.join(latest_attempts(attempts), QUESTION, "left").withColumn("ok", F.coalesce(correct(), F.lit(False)))
    per = got.groupBy("session_id").agg(F.sum(F.col("ok").cast("long")).alias("correct"), F.count(F.lit(1)).alias("total"))
    return per.withColumn("passed", (F.col("total") > 0) & (F.col("correct") == F.col("total")))


def diagnosis_outcome(session_concepts: DataFrame, questions: DataFrame, attempts: DataFrame) -> DataFrame:
    """Per (session, concept) still to test: known if every question is correct, to learn if one is not, new without a question."""
    got = questions.join(latest_attempts(attempts), QUESTION, "left").groupBy(*QUESTION).agg(F.bool_and(F.coalesce(correct(), F.lit(False))).alias("ok"))
    out = session_concepts.where("status = 'to_test'").join(got, QUESTION, "left")
    return out.select(*QUESTION, F.when(F.col("ok").isNull(), "new").when(F.col("ok"), "known").otherwise("failed").alias("outcome"))


def open_diagnoses(session_concepts: DataFrame, questions: DataFrame, attempts: DataFrame) -> DataFrame:
    """Per session with concepts still to test: these, its questions and its answered questions."""
    waiting = session_concepts.where("status = 'to_test'").groupBy("session_id").agg(F.count(F.lit(1)).alias("concepts"))
    asked = questions.groupBy("session_id").agg(F.count(F.lit(1)).alias("questions"))
    answered = attempts.select(*QUESTION).distinct().groupBy("session_id").agg(F.count(F.lit(1)).alias("answered"))
    out = waiting.join(asked, "session_id", "left").join(answered, "session_id", "left")
    return out.na.fill(0, ["questions", "answered"])


def failed_tests(sessions: DataFrame, scores: DataFrame) -> DataFrame:
    """Finished tests that were not passed, per concept."""
    return sessions.where("status = 'done'").join(scores.where("not passed"), "session_id").groupBy("concept_id").agg(F.count(F.lit(1)).alias("failed"))


def session_results(questions: DataFrame, attempts: DataFrame) -> DataFrame:
    """Wrong answers per concept in order: (question, answer or "(no answer)", feedback); a choice index becomes its text."""
    got = questions.join(latest_attempts(attempts.withColumn("attempt_id", F.col("id")), ["question_id"]), "question_id", "left")
    wrong = got.where(~F.coalesce(correct(), F.lit(False)))
    index = F.when(F.col("answer").rlike("^[0-9]+$"), F.col("answer").cast("int"))
    shown = F.coalesce(F.when(F.size("choices") > 0, F.get("choices", index)), F.col("answer"), F.lit("(no answer)"))
    return wrong.groupBy("concept_id").agg(F.sort_array(F.collect_list(F.struct("position", F.col("text").alias("question"), shown.alias("answer"), "feedback"))).alias("wrong"))


def recent_mistakes(attempts: DataFrame, n: int = 4) -> DataFrame:
    """The latest wrong, undisputed attempts per concept."""
    w = Window.partitionBy("concept").orderBy(F.desc("id"))
    return attempts.where("score < 2 and not disputed").withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)


def latest_open_session(session_concepts: DataFrame) -> DataFrame:
    return session_concepts.where("status = 'to_test'").groupBy("concept").agg(F.max("session_id").alias("session_id"))


def seen_questions(questions: DataFrame, n: int = 10) -> DataFrame:
    """Distinct question texts per concept by their first id, the last ``n`` of them."""
    first = questions.groupBy("concept", "text").agg(F.min("id").alias("id"))
    w = Window.partitionBy("concept").orderBy(F.desc("id"))
    return first.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def queue(concepts: DataFrame) -> DataFrame:
    """Queued and learning concepts with dense positions per subject."""
    w = Window.partitionBy("subject_id").orderBy("queue_pos", "id")
    return concepts.where(F.col("status").isin("queued", "learning")).withColumn("position", F.row_number().over(w).cast("long"))


def queue_warnings(concepts: DataFrame, prereqs: DataFrame) -> DataFrame:
    """Per queued concept with a problem: ``later`` if a prerequisite is further down, else ``missing`` if one is neither queued nor known; with their ids."""
    q = queue(concepts)
    own = q.select(F.col("id").alias("concept_id"), "subject_id", "position")
    other = concepts.select(F.col("id").alias("prereq_id"), "status").join(q.select(F.col("id").alias("prereq_id"), F.col("position").alias("there")), "prereq_id", "left")
    e = prereqs.join(own, "concept_id").join(other, "prereq_id")
    later = F.col("there") > F.col("position")
    missing = F.col("there").isNull() & ~F.col("status").isin(*KNOWN)
    ids = lambda cond: F.sort_array(F.collect_list(F.when(cond, F.col("prereq_id"))))
    got = e.groupBy("subject_id", "concept_id").agg(ids(later).alias("later"), ids(missing).alias("missing"))
    return got.where((F.size("later") > 0) | (F.size("missing") > 0)).withColumn("warning", F.when(F.size("later") > 0, "later").otherwise("missing"))


def _level(c: str = "level") -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col(c))


def suggested_order(concepts: DataFrame, prereqs: DataFrame, module_position: str = "module") -> DataFrame:
    """(subject_id, id, position): repeatedly the first concept by (module, level, queue place) whose queued prerequisites are placed.

    A cycle takes the first of the rest. One queue, which a learner works through, is
    ordered in a task with a heap; its size is that of the queue and its edges.
    """
    q = queue(concepts).select("subject_id", "id", F.col(module_position).alias("m"), _level().alias("l"), "queue_pos")
    w = Window.partitionBy("subject_id").orderBy("m", "l", "queue_pos", "id")
    ranked = q.select("subject_id", "id", F.row_number().over(w).cast("long").alias("rank"))
    inside = ranked.select(F.col("id").alias("prereq_id"), F.col("subject_id").alias("s"), F.col("rank").alias("needs"))
    need = prereqs.join(inside, "prereq_id").join(ranked.withColumnRenamed("id", "concept_id"), "concept_id").where("s = subject_id")
    need = need.groupBy("concept_id").agg(F.collect_set("needs").alias("needs")).withColumnRenamed("concept_id", "id")

    def place(key, rows):
        import heapq

        import pyarrow as pa

        items = sorted(zip(rows["rank"].to_pylist(), rows["id"].to_pylist(), rows["needs"].to_pylist()))
        waits, after = {}, {}
        for rank, _, needs in items:
            waits[rank] = len(needs or ())
            for n in needs or ():
                after.setdefault(n, []).append(rank)
        ready = [rank for rank, n in waits.items() if not n]
        heapq.heapify(ready)
        order, placed, rest = [], set(), iter([rank for rank, _, _ in items])
        while len(order) < len(items):
            now = heapq.heappop(ready) if ready else next(r for r in rest if r not in placed)  # the first of the rest breaks a cycle
            if now in placed:
                continue
            placed.add(now)
            order.append(now)
            for later in after.get(now, ()):
                waits[later] -= 1
                if not waits[later] and later not in placed:
                    heapq.heappush(ready, later)
        ids = {rank: i for rank, i, _ in items}
        return pa.table({"subject_id": pa.array([key[0].as_py()] * len(order), pa.int64()), "id": pa.array([ids[r] for r in order], pa.int64()), "position": pa.array(range(1, len(order) + 1), pa.int64())})

    return ranked.join(need, "id", "left").select("subject_id", "id", "rank", "needs").groupBy("subject_id").applyInArrow(place, "subject_id long, id long, position long")


def queue_book_order(concepts: DataFrame, sources: DataFrame, sections: DataFrame) -> DataFrame:
    """Queue by the first source in book order; no source last, then the queue's order."""
    q = queue(concepts).join(concept_place(sources, sections).withColumnRenamed("concept_id", "id"), "id", "left")
    w = Window.partitionBy("subject_id").orderBy(F.asc_nulls_last("place"), "queue_pos", "id")
    return q.select("subject_id", "id", F.row_number().over(w).cast("long").alias("position"))


def order_differs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per subject whether two orders of the same concepts differ."""
    both = a.select("subject_id", "id", "position").join(b.select("subject_id", "id", F.col("position").alias("other")), ["subject_id", "id"])
    return both.groupBy("subject_id").agg(F.bool_or(F.col("position") != F.col("other")).alias("differs"))


def valid_order(queued: DataFrame, proposed: DataFrame) -> DataFrame:
    """Per subject whether the proposed ids are the queue's, once each."""
    a = queued.groupBy("subject_id", "id").agg(F.count(F.lit(1)).alias("n"))
    b = proposed.groupBy("subject_id", "id").agg(F.count(F.lit(1)).alias("m"))
    both = a.join(b, ["subject_id", "id"], "full_outer")
    return both.groupBy("subject_id").agg(F.bool_and((F.coalesce("n", F.lit(0)) == 1) & (F.coalesce("m", F.lit(0)) == 1)).alias("valid"))


def queue_edit(queued: DataFrame, edits: DataFrame) -> DataFrame:
    """Positions after edits (subject_id, id, edit): remove closes the gap, top moves up front, end appends."""
    out = queued.select("subject_id", "id", "position").join(edits, ["subject_id", "id"], "full_outer").where("edit is null or edit <> 'remove'")
    w = Window.partitionBy("subject_id").orderBy(F.when(F.col("edit") == "top", 0).when(F.col("edit") == "end", 2).otherwise(1), F.asc_nulls_last("position"), "id")
    return out.select("subject_id", "id", F.row_number().over(w).cast("long").alias("position"))


class Marked(NamedTuple):
    """What a round of marks changes; every member is a DataFrame."""

    concepts: DataFrame  # subject_id, id, status, queue_pos
    sessions: DataFrame  # session_id, subject_id, module, kind, status, total
    members: DataFrame  # session_id, concept_id
    left: DataFrame  # session_id, concept_id: their questions and answers go
    results: DataFrame  # subject_id, session_id, new_session, queued, skipped


def bad_marks(concepts: DataFrame, marks: DataFrame, allowed: tuple[str, ...] = ("learn", "later", "skip", "test")) -> DataFrame:
    """(id, mark, problem): marks for concepts that do not exist, and words that are no marks."""
    got = marks.join(concepts.select("id", F.lit(True).alias("_here")), "id", "left")
    problem = F.when(F.col("_here").isNull(), "no_concept").when(F.col("mark").isNull() | ~F.col("mark").isin(*allowed), "no_mark")
    return got.select("id", "mark", problem.alias("problem")).where("problem is not null")


def _fold(concepts: DataFrame, acts: DataFrame) -> DataFrame:
    """(subject_id, id, status, queue_pos) after acts (id, new_status, to_end), by rising id.

    An act takes the concept out of the queue and sets its status; with ``to_end`` it then
    goes behind the last place in use at that moment. Only the concepts that go to the end
    are numbered, so a subject costs two sums and a sort of its own additions.
    """
    got = concepts.select("subject_id", "id", "status", "queue_pos").join(acts, "id", "left")
    start = got.where("to_end").groupBy("subject_id").agg(F.min("id").alias("_first"))
    # places given up before the first addition are free; later ones are below the additions already
    held = got.join(start, "subject_id").where("new_status is null or to_end or id > _first")
    last = held.groupBy("subject_id").agg(F.coalesce(F.max("queue_pos"), F.lit(0)).alias("_last"))
    added = got.where("to_end").select("id", "subject_id", F.row_number().over(Window.partitionBy("subject_id").orderBy("id")).alias("_n"))
    added = added.join(last, "subject_id").select("id", (F.col("_last") + F.col("_n")).cast("long").alias("_place"))
    place = F.when(F.col("new_status").isNull(), F.col("queue_pos")).otherwise(F.col("_place"))
    return got.join(added, "id", "left").select("subject_id", "id", F.coalesce("new_status", "status").alias("status"), place.cast("long").alias("queue_pos"))


def apply_marks(concepts: DataFrame, marks: DataFrame, sessions: DataFrame, members: DataFrame) -> Marked:
    """Marks (id, mark), one a concept, on concepts (id, subject_id, module, status, queue_pos) and their sessions.

    learn queues: a queued concept keeps its place, any other one goes to the end, a learning
    one too. later makes new, skip skips. test makes the concept wait in a new diagnosis of
    its subject, with a module only if all its concepts share one; but a concept that already
    waits in an open diagnosis stays there. With any other mark it leaves every open
    diagnosis, whose total falls; one without concepts goes. A result names the session to
    open: the new one, else the latest one that is reused. New sessions follow the highest id
    in order of the subjects. Marks of unknown concepts and unknown words change nothing; see
    ``bad_marks``. A null mark is no mark.
    """
    known = marks.where(F.col("mark").isin("learn", "later", "skip", "test")).select("id", "mark")
    open_ = sessions.where("kind = 'diagnose' and status <> 'finished'").select("session_id")
    waits = members.select("session_id", "concept_id").join(open_, "session_id").groupBy("concept_id").agg(F.max("session_id").alias("_open"))
    got = concepts.select("subject_id", "id", "module", "status", "queue_pos").join(known, "id")
    got = got.join(waits.withColumnRenamed("concept_id", "id"), "id", "left").withColumn("_open", F.when(F.col("status") == "to_test", F.col("_open")))
    got = cut(got, "marks")  # read by every table below

    acting = got.where("not (mark = 'test' and _open is not null) and not (mark = 'learn' and status = 'queued')")
    becomes = F.when(F.col("mark") == "learn", "queued").when(F.col("mark") == "later", "new").when(F.col("mark") == "skip", "skipped").otherwise("to_test")
    after = _fold(concepts, acting.select("id", becomes.alias("new_status"), (F.col("mark") == "learn").alias("to_end")))

    leaving = got.where("_open is not null and mark <> 'test'").select(F.col("id").alias("concept_id"))
    left = members.select("session_id", "concept_id").join(leaving, "concept_id").join(open_, "session_id").select("session_id", "concept_id")
    stay = members.select("session_id", "concept_id").join(left, ["session_id", "concept_id"], "left_anti")

    fresh = got.where("mark = 'test' and _open is null")
    top = sessions.agg(F.max("session_id")).first()[0] or 0
    new = fresh.groupBy("subject_id").agg(F.when(F.countDistinct("module") == 1, F.min("module")).alias("module"), F.count(F.lit(1)).alias("total"))
    new = numbered(new, "subject_id").withColumn("session_id", F.col("n") + F.lit(top).cast("long"))
    new = cut(new.select("session_id", "subject_id", "module", F.lit("diagnose").alias("kind"), F.lit("preparing").alias("status"), "total"), "sessions")
    joined = fresh.join(new.select("subject_id", "session_id"), "subject_id").select("session_id", F.col("id").alias("concept_id"))

    touched = left.select("session_id").distinct().join(stay.groupBy("session_id").agg(F.count(F.lit(1)).alias("_left")), "session_id", "left")
    kept = sessions.join(touched.select("session_id", F.coalesce("_left", F.lit(0)).alias("_left")), "session_id", "left").where("_left is null or _left > 0")
    kept = kept.select("session_id", "subject_id", "module", "kind", "status", F.coalesce("_left", "total").cast("long").alias("total"))

    n = lambda m: F.sum((F.col("mark") == m).cast("long"))
    per = got.groupBy("subject_id").agg(F.max(F.when(F.col("mark") == "test", F.col("_open"))).alias("_reused"), n("learn").alias("queued"), n("skip").alias("skipped"))
    per = per.join(new.select("subject_id", "session_id"), "subject_id", "left")
    results = per.select("subject_id", F.coalesce("session_id", "_reused").alias("session_id"), F.col("session_id").isNotNull().alias("new_session"), "queued", "skipped")
    return Marked(after, kept.unionByName(new), stay.unionByName(joined), left, results)


def apply_choices(concepts: DataFrame, choices: DataFrame) -> DataFrame:
    """Statuses and places after the choices (id, choice) that follow results: learn goes to the end of the queue, from inside it too; skip skips; keep and unknown words change nothing."""
    acts = choices.where("choice in ('learn', 'skip')").select("id", F.when(F.col("choice") == "learn", "queued").otherwise("skipped").alias("new_status"), (F.col("choice") == "learn").alias("to_end"))
    return _fold(concepts, acts)


def mark_counts(marks: DataFrame, concepts: DataFrame) -> DataFrame:
    """Per subject: counts by mark, and the module if all marked concepts share one."""
    got = marks.join(concepts.select("id", "subject_id", "module"), "id")
    n = lambda m: F.sum((F.col("mark") == m).cast("long")).alias(f"n_{m}")
    return got.groupBy("subject_id").agg(*[n(m) for m in ("learn", "later", "skip", "test")], F.when(F.countDistinct("module") == 1, F.min("module")).alias("module"))


def missing_prereqs(concepts: DataFrame, prereqs: DataFrame) -> DataFrame:
    """Prerequisites of each concept that are neither known nor mastered."""
    c = concepts.select(F.col("id").alias("prereq_id"), "name", "status")
    return prereqs.join(c, "prereq_id").where(~F.col("status").isin(*KNOWN)).select("concept_id", "prereq_id", "name", "status")


def test_outcome(scores: DataFrame, sessions: DataFrame, concepts: DataFrame, prereqs: DataFrame) -> DataFrame:
    """Per test: passed, score, failed tests of its concept, whether it has prerequisites, and the next concept if passed."""
    failed = failed_tests(sessions, scores)
    has = prereqs.select("concept_id").distinct().withColumn("has_prereqs", F.lit(True))
    nxt = next_to_learn(concepts).select("subject_id", F.col("id").alias("next_id"))
    out = sessions.join(scores, "session_id").join(failed, "concept_id", "left").join(has, "concept_id", "left")
    out = out.join(concepts.select(F.col("id").alias("concept_id"), "subject_id"), "concept_id").join(nxt, "subject_id", "left")
    return out.select("session_id", "concept_id", "passed", "correct", "total", F.coalesce("failed", F.lit(0)).cast("long").alias("failed"), F.coalesce("has_prereqs", F.lit(False)).alias("has_prereqs"), F.when(F.col("passed"), F.col("next_id")).alias("next_id"))


def mark_learning(concepts: DataFrame, chosen: DataFrame) -> DataFrame:
    """One learning concept per subject: the chosen one; other learning ones go back to the queue where one is chosen."""
    got = concepts.join(chosen.select("subject_id", F.col("id").alias("chosen")), "subject_id", "left")
    status = F.when(F.col("id") == F.col("chosen"), "learning").when((F.col("status") == "learning") & F.col("chosen").isNotNull(), "queued").otherwise(F.col("status"))
    return got.select("subject_id", "id", status.alias("status"))


def leave_sessions(session_concepts: DataFrame, marked: DataFrame) -> DataFrame:
    """Totals of sessions after re-marked concepts leave them; empty sessions go."""
    return session_concepts.join(marked, "concept", "left_anti").groupBy("session_id").agg(F.count(F.lit(1)).alias("total"))


def fail_interrupted(runs: DataFrame) -> DataFrame:
    """Running or preparing work becomes failed, with a message."""
    cut = F.col("status").isin("running", "preparing")
    return runs.select("id", "book_id", F.when(cut, "failed").otherwise(F.col("status")).alias("status"), F.when(cut, F.concat(F.lit("interrupted while "), F.col("status"))).alias("message"))


def apply_attempt_edits(attempts: DataFrame, retakes: DataFrame, disputes: DataFrame, finished: DataFrame) -> DataFrame:
    """Retakes remove a question's attempts unless its session is finished; disputes count as correct."""
    open_ = retakes.join(finished, "session_id", "left_anti")
    left = attempts.join(open_, QUESTION, "left_anti").join(disputes.withColumn("_d", F.lit(True)), QUESTION, "left")
    return left.withColumn("disputed", F.col("disputed") | F.coalesce("_d", F.lit(False))).drop("_d")


def repeat_test(questions: DataFrame, sessions: DataFrame, offset: int, seed: int = 7) -> DataFrame:
    """Questions of each concept's last finished test, re-keyed to a new session in their order, options shuffled by a seeded hash."""
    last = latest_by(sessions.where("status = 'done'"), ["concept_id"], F.desc("session_id")).select("session_id", "concept_id")
    shuffled = F.transform(F.array_sort(F.transform("choices", lambda c: F.struct(F.xxhash64(c, F.lit(seed)).alias("h"), c.alias("c")))), lambda x: x["c"])
    got = questions.join(last, ["session_id", "concept_id"])
    return got.select((F.col("session_id") + offset).alias("session_id"), "concept_id", "position", "text", shuffled.alias("choices"))
