"""Operators with SQL, on the smallest tables, and all queries' edge cases."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from shutterlake.llm import registry


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_agrees_with_sql(spark, duck, sf, name):
    got, want = registry.QUERIES[name](spark, sf).toPandas(), duck.sql(registry.SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda d: sorted(map(repr, d[cols].convert_dtypes().astype(object).where(d[cols].notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


ODD = [(1, "a b c d e f", "s", "x"), (1, "a b c d e f", "s", "x"), (None, "x y", None, "y"), (2, None, "s", None), (3, "", None, "z"), (4, " \n ", "t", "z"), (5, "é中😀 " * 3000, "t", "z"), (6, "a b c d e f", "u", "z")]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Tables with nulls, empty and long texts, repeated rows and extra columns whose names could clash; and empty ones."""
    top = tmp_path_factory.mktemp("odd")
    extra = {c: F.lit(1) for c in ("key", "size", "n", "h", "node", "kept", "target", "block", "r", "spans", "mark", "rank")}
    docs = spark.createDataFrame(ODD, "doc_id long, text string, source string, lang string").withColumns(extra).withColumn("n_chars", F.length("text").cast("long"))
    pages = spark.createDataFrame([(1, "http://A.Example.org/es/x", "<html lang=fr><p>x"), (1, "http://A.Example.org/es/x", None), (None, None, ""), (2, "no", None)], "page_id long, url string, html string").withColumns({"host": F.lit(1), "rule": F.lit(2), "keys": F.lit(3)})
    bench = spark.createDataFrame([(1, "b c"), (1, "b c"), (None, "x"), (2, None), (3, "")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    for name, df in {"documents": docs, "pages": pages, "benchmark": bench, "labels": labels}.items():
        df.write.parquet(f"{top}/odd/{name}.parquet")
        df.limit(0).write.parquet(f"{top}/none/{name}.parquet")
    return top


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_odd_and_empty_tables(spark, odd, name):
    assert registry.QUERIES[name](spark, f"{odd}/none").count() == 0
    n = registry.QUERIES[name](spark, f"{odd}/odd").count()
    assert n == (4 if name in ("op1_url_filter", "op9_language_id") else len(ODD))


def test_odd_results(spark, odd):
    q = lambda name: {r["doc_id"]: r for r in registry.QUERIES[name](spark, f"{odd}/odd").collect()}
    near = q("op8_near_duplicates")
    assert (near[6]["component_id"], near[1]["kept"], near[6]["kept"], near[2]["component_id"], near[2]["kept"]) == (1, True, False, 2, True)
    assert near[None]["component_id"] is None and near[4]["n_shingles"] == 0
    hits = q("op10_decontaminate")
    assert (hits[1]["n_hit"], hits[1]["n_items"], hits[1]["contaminated"], hits[2]["n_words"]) == (2, 1, True, 0)
    assert hits[None]["n_hit"] == 1 and hits[None]["n_items"] == 0
    mixed = registry.QUERIES["op7_mix_sources"](spark, f"{odd}/odd").collect()
    assert all(r["taken"] <= 2 * r["size"] for r in mixed)
    urls = {r["page_id"]: r for r in registry.QUERIES["op1_url_filter"](spark, f"{odd}/odd").collect()}
    assert (urls[1]["host"], urls[1]["rule"], urls[1]["verdict"]) == ("a.example.org", "example.org/es/", "block")
    assert (urls[2]["host"], urls[2]["path"], urls[2]["rule"], urls[2]["verdict"]) == ("", "", None, "allow")
