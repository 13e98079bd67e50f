"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from siteq.plans import catalog

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return f"{v:.6f}"
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return None if v is None else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


#: Queries that SQL cannot express, and the tests that hold them against plain versions.
ELSEWHERE = {
    "e12_greedy_clusters": "test_shots.test_greedy_clusters", "e13_assign_nearest": "test_shots.test_assign_nearest", "f10_random_per_group": "test_plain.test_random_per_group",
    "g2_question_marks": "test_plain.test_question_marks", "g6_visible_text": "test_plain.test_visible_text", "j2_label_sample": "test_plain.test_label_sample",
}


def test_every_query_is_compared():
    import importlib

    assert set(catalog.QUERIES) - set(catalog.ORACLES) == set(ELSEWHERE)
    for test in ELSEWHERE.values():
        module, name = test.split(".")
        assert callable(getattr(importlib.import_module(f".{module}", __package__), name))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sql, name):
    df = catalog.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name in catalog.ORACLES:
        cur = sql.execute(catalog.ORACLES[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert got == rows(names, cur.fetchall())
