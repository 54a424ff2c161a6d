"""Queries held against their SQL on values that the synthetic tables hold at larger sizes only."""

import duckdb
import pytest

from quarryline.functions import uast
from quarryline.plans.queries import ORACLE_SQL, QUERIES


@pytest.fixture
def alike(spark, tmp_path):
    """Write a table by a SELECT and hold a query over it against its SQL."""

    def check(query: str, table: str, select: str) -> list[tuple]:
        c = duckdb.connect()
        c.execute(f"COPY ({select}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
        df = QUERIES[query](spark, str(tmp_path))
        got = sorted(map(tuple, df.collect()))
        assert got == sorted(c.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL[query]})").fetchall())
        return got

    return check


def test_titles_with_character_references(alike):
    titles = ["R&amp;D", "a && b &amp", "x = &quot;1&quot;", "&lt;b&gt; &#65;&amp;amp;", " plain ", "&nbsp;x", "a < b"]
    pages = ", ".join(f"({i}, '<html><head><title>{x}</title></head><body><p>&eacute;<p>y<a href=\"?a&amp;b\">z</a><svg><title>no</title></svg>')" for i, x in enumerate(titles))
    got = alike("html_uasts", "pages", f"SELECT * FROM (VALUES {pages}) t(page_id, html)")
    assert [r[3] for r in got][:3] == ["R&D", "a && b &amp", "x = &quot;1&quot;"]


def test_text_as_written_beside_its_token():
    texts = uast.query_nodes(uast.parse("i.html", b"<p>a &amp; b\n<p>c<p>&quot;<script>x &amp; y</script>", "HTML"), "//text")
    assert uast.node_tokens(texts) == ["a & b", "c", '"', "x &amp; y"]
    assert uast.node_sources(texts) == ["a &amp; b\n", "c", "&quot;", "x &amp; y"] and uast.node_sources(None) == []


def test_days_past_the_year_9999(alike):
    got = alike("millis_to_timestamp", "events", "SELECT unnest([0, 19000, 2932896, 2932897, 6000000, 36000000, 100000000])::BIGINT AS event_id")
    assert got[2:4] == [(2932896, "9999-12-31"), (2932897, "10000-01-01")]
