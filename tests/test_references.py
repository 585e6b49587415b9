"""References to characters in pages against the SQL of the query: names without a semicolon, cut ones, unknown ones, numbers."""

import duckdb

from attestra.catalog import ORACLE_SQL, QUERIES
from tests.compare import assert_same


def test_references(spark, tmp_path):
    texts = ["ver&amp", "a&ampb &am &amp;copy; &copy2 &notit; &notin; &nosuch;", "&eacute;&hearts;&NewLine;two", "&#65&#x42;&#0;&#128;&#xD800;&#99999999999;&#1;x", "R&D; &&&amp; &# &#x; & b", "&lt;p&gt;&quot;&apos;&#39;"]
    pages = [(i, f"https://x/{i}", f"<title>{t}</title><p>{t}</p><p>&quot;{t}") for i, t in enumerate(texts)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert_same(QUERIES["html_blocks"](spark, str(tmp_path)), con, ORACLE_SQL["html_blocks"])
