"""Queries on pages whose titles were cut inside a character reference, against their SQL."""

import pytest

from tessera.functions.text import references
from tessera.jobs import catalog

NAMES = ["fn21_page_text", "fn23_page_fallback", "fn22_main_text", "src17_capped_page_text"]
PAGE = "<html><head><title>{0}</title></head><body><h1>{0}</h1><p>x &copy;</p><p>{0}</p></body></html>"
CUTS = ["a &amp;&amp;&amp", "b &am", "c &quo", "d &lt", "e &", "f &amp;lt;"]


def test_only_closed_references_are_decoded():
    assert references("&amp;&amp &lt &#233; &#xe9; &#233 &notit; &nosuch; &copy;") == "&&amp &lt é é &#233 &notit; &nosuch; ©"


@pytest.mark.parametrize("name", NAMES)
def test_a_cut_reference_stays_as_it_is(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    rows = [(i, f"u/{i}", PAGE.format(t)) for i, t in enumerate(CUTS, 1)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = catalog.QUERIES[name](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.ORACLES[name]})").fetchall())
