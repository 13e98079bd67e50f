"""Queries on pages of which several have the same URL, against their SQL."""

import duckdb
import pytest

from siteq.plans import catalog

from .conftest import SF
from .test_oracles import rows

LINKED = ["a1_resolve_links", "a7_first_seen", "b2_clean_urls", "b4_leaf_of", "b5_leaf_vocab", "b6_template_signature", "b7_template_clusters", "b9_with_affected", "c15_broken_links"]
CONFIRMED = ["d12_confirm", "d13_link_report", "d14_link_report_counts", "d14_top_hosts"]


@pytest.fixture(scope="module")
def twice(spark, tmp_path_factory):
    """A folder with the pages, and half of them again with other numbers and the HTML of another page."""
    path = tmp_path_factory.mktemp("twice")
    con = duckdb.connect()
    con.execute(f"CREATE TABLE pages AS WITH p AS (SELECT * FROM '{SF}/pages.parquet'), n AS (SELECT count(*) AS n FROM p) SELECT * FROM p UNION ALL SELECT a.page_id + n, a.url, b.html FROM n, p a JOIN p b ON b.page_id = (a.page_id + 1) % n WHERE a.page_id % 4 < 2")
    con.execute(f"COPY pages TO '{path}/pages.parquet'")
    return str(path), con


@pytest.mark.parametrize("name", [*LINKED, *CONFIRMED])
def test_query(spark, twice, name):
    path, con = twice
    df = catalog.QUERIES[name](spark, path)
    cur = con.execute(catalog.ORACLES[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in cur.description], cur.fetchall())


def test_first_page_of_a_link(spark, tmp_path):
    """c15_broken_links: a link's first page is the one with the smallest number, whatever other page has the same URL."""
    con = duckdb.connect()
    con.execute("""CREATE TABLE pages AS SELECT unnest([1, 9]) AS page_id, 'http://a.example.com/x' AS url, unnest(['<a href="/no">none</a><a href="/k">one</a>', '<a href="/k">two</a>']) AS html""")
    con.execute(f"COPY pages TO '{tmp_path}/pages.parquet'")
    df = catalog.QUERIES["c15_broken_links"](spark, str(tmp_path))
    cur = con.execute(catalog.ORACLES["c15_broken_links"])
    got = rows(df.columns, df.collect())
    assert got == rows([d[0] for d in cur.description], cur.fetchall())
