"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

from quillspan import plans

DIR = "/root/testdata/sf0.001"
#: One of each family; the driver compares all of them.
NAMES = ("p4_expand_ranges", "r1_status_totals", "r3_book_rollup", "r21_renumber_modules", "r24_format_ranges", "q2_queue_warnings", "q8_apply_marks", "q8_sessions", "q8_session_members", "q8_mark_results", "q8_apply_choices", "c7_prerequisite_edges", "c6_apply_decisions", "d5_conflicts", "j8_ground_quotes", "w7_near_duplicates", "b12_group_sections", "v3_plan_clips", "w3_robots_allow", "st1_stream_latest_attempts")


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, tmp_path, name):
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(DIR):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{DIR}/{t}'")
    out = str(tmp_path / "out")
    plans.queries()[name](spark, DIR).write.parquet(out)
    con.execute(f"create table a as select * from '{out}/*.parquet'")
    con.execute(f"create table b as {plans.oracle_sql()[name]}")
    cols = ", ".join(f'"{r[0]}"' for r in sorted(con.execute("describe a").fetchall()))
    assert con.execute("select count(*) from a").fetchone()[0] > 0
    for x, y in (("a", "b"), ("b", "a")):
        assert con.execute(f"select count(*) from (select {cols} from {x} except all select {cols} from {y})").fetchone()[0] == 0


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 187
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ("j8_short_quotes", "j8_ground_quotes", "c2_ground_known"))
def test_given_texts_are_plain_for_quotes(spark, tmp_path, name):
    import duckdb

    con = duckdb.connect()
    texts = ["a one*** the.*** b", "one the. b", "# xx the cat", "xx\\*the cat* sat", "one [the](cat) x", "**one the.**"]
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, 'en', 's', 0)", [(40 * (k % 3) + k // 3, t) for k, t in enumerate(texts)])
    con.execute("create table benchmark (item_id bigint, text varchar)")
    con.executemany("insert into benchmark values (?, ?)", [(0, "one the. b"), (1, "xx *the cat"), (2, "at* one the. and so on")])
    for t in ("documents", "benchmark"):
        con.execute(f"copy {t} to '{tmp_path}/{t}.parquet' (format parquet)")
    want = sorted(con.execute(plans.oracle_sql()[name]).fetchall())
    assert want and sorted(tuple(r) for r in plans.queries()[name](spark, str(tmp_path)).collect()) == want
