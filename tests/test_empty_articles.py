"""A page whose article is empty has no text; its menu is none."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from prosemill import queries
from prosemill.functions import html as H

PAGE = "<html><body><nav>menu</nav>{}<footer>foot</footer></body></html>"


@pytest.mark.parametrize("url", ["https://a.example/1", "https://zenn.dev/x/articles/1", "https://note.com/x/n/1"])
def test_empty_article(spark, url):
    rows = [(1, PAGE.format("<article></article>")), (2, PAGE.format("<article> <br></article><main>m</main>")), (3, PAGE.format("<main></main>")), (4, PAGE.format("<article></article><article>b</article>")), (5, None), (6, "<p>x</p>")]
    text, _ = H.extract_body(F.lit(url), F.col("html"))
    got = {r.page_id: r.t for r in spark.createDataFrame(rows, "page_id int, html string").select("page_id", text.alias("t")).collect()}
    assert got == {1: "", 2: "", 3: "", 4: "", 5: None, 6: "x"}


@pytest.mark.parametrize("name", ["html_text", "site_bodies"])
def test_empty_article_equals_sql(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    rows = [(k, f"https://a.example/{k}", PAGE.format("<article></article>")) for k in range(6)] + [(6, "u", PAGE.format("<article><h1>t</h1><p>a &amp; b</p></article>"))]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"select {', '.join(got.columns)} from ({queries.ORACLES[name]})").fetchall())
