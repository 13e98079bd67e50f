"""Costly columns are worked out once a row, and what is sorted or grouped is small."""

import re

import pytest

from siteq.operators import curriculum as K
from siteq.operators import relations as L
from siteq.operators import shots as S
from siteq.operators import text as X
from siteq.plans import curriculum_queries as Q


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


READERS = {"k14_matrix_cells": K.matrix_cells, "k12_course_sections": K.course_sections, "k12_course_details": K.course_details, "k13_learning_outcomes": K.learning_outcomes, "k13_resources": K.resources, "k13_weekly_rows": K.weekly_topics}


@pytest.mark.parametrize("name", sorted(READERS))
def test_cells_are_folded_once(spark, sf, name):
    # the cells of a table and its name
    assert plan(READERS[name](Q.tables(spark, sf))).count("translate(") <= 2


@pytest.mark.parametrize("name", ["k13_assessments", "k13_workloads"])
def test_activities_are_folded_once(spark, sf, name):
    # and the words of an activity that is a total, in two ways
    assert plan(Q.QUERIES[name](spark, sf)).count("translate(") <= 4


@pytest.mark.parametrize("name", ["k17_programs", "k17_units", "k8_outcomes_from_text"])
def test_texts_are_folded_once(spark, sf, name):
    assert plan(Q.QUERIES[name](spark, sf)).count("translate(") == 1


def samples(text, n=25):
    found = []
    for m in re.finditer("�", text):
        c = text[max(m.start() - n, 0) : m.end() + n].replace("\n", " ").strip(" ")
        if c not in found:
            found.append(c)
    return found[:3]


def test_samples_of_dense_hits(spark):
    texts = ["�" * 5000 + "end", "a" * 40 + "��b�" + "😀" * 30 + "�", "�", "x\n� y", "none", "", None, "ab�" * 60 + "z" * 30 + "�"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    out = X.text_pattern_samples(rows, "k", "yer_tutucu")
    assert {r["k"]: r["samples"] for r in out.collect()} == {k: samples(t) for k, t in enumerate(texts) if t and "�" in t}
    assert plan(out).count("regexp_extract_all(") == 1


def test_wide_relation_is_one_aggregate(spark):
    cells = spark.createDataFrame([(1, 1, 1, 3), (1, 1, 1, 4), (1, 1, 2, None), (1, 2, 9, 5)], "course_id int, lo_no int, po_no int, level int")
    out = L.lo_po_wide(cells, [1, 2])
    assert sorted(map(tuple, out.collect())) == [(1, 1, 4, None), (1, 2, None, None)]
    assert plan(out).count("Aggregate [") == 1


def test_nearest_is_grouped_without_centres(spark):
    df = spark.createDataFrame([(1, "s", 7), (2, "s", 0)], "id long, section string, hash long")
    centres = spark.createDataFrame([("s", "a", 7), ("s", "b", 6)], "section string, template string, centre long")
    out = S.assign_nearest(df, centres)
    assert sorted((r["id"], r["template"]) for r in out.collect()) == [(1, "a"), (2, "b")]
    top = next(line for line in plan(out).splitlines() if "Aggregate [" in line and "min(" in line)
    assert "near#" not in top


def test_pages_are_dealt_out_before_their_html_is_made(spark, sf):
    assert Q.stored(spark, sf, "'x'").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
