"""The mix against a plain run over a sorted list, with rows that repeat, and its SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from fluxloom.llm import mixing, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("bucket_rows", [7, 1000])
def test_repeated_rows_at_the_cut(spark, bucket_rows):
    """A third of a source is one row; as many of its copies are taken as fit."""
    rows = [(None, "a b c", "x")] * 120 + [(k, "w " * (k % 5), "x") for k in range(240)] + [(5, "q", None)] * 9 + [(7, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = mixing.mix(docs, bucket_rows=bucket_rows, weights=(1.0, 3.0), share=0.9)
    got = out.collect()
    assert len(got) == len(rows)
    for s in ("x", None, "z"):
        own = [r for r in got if r["source"] == s]
        taken = sum(r["_copies"] * r["_size"] for r in own)
        assert abs(taken - own[0]["_target"]) <= 3 and max(r["_copies"] for r in own) <= 2
    assert mixing.mixed(docs, bucket_rows=bucket_rows).count() == sum(r["_copies"] for r in mixing.mix(docs, bucket_rows=bucket_rows).collect())


@pytest.mark.parametrize("most", [0.0, 0.5, 1.0, 1.5, 2.0])
def test_cuts_at_both_ends(spark, most):
    docs = spark.createDataFrame([(k, "a b", "x") for k in range(50)], "doc_id long, text string, source string")
    got = mixing.mix(docs, share=most, bucket_rows=5).collect()
    assert sum(r["_copies"] for r in got) == pytest.approx(50 * most, abs=0.51)


def test_other_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a", "x", 3, 4, 5)], "doc_id long, text string, source string, bucket int, _copies int, at int")
    row = mixing.mix(docs).first().asDict()
    assert (row["bucket"], row["at"], row["_copies"]) == (3, 5, 2)
    assert mixing.mixed(docs).collect() == docs.collect() * 2
    assert mixing.mixed(docs.where(F.lit(False))).count() == 0


@pytest.mark.parametrize("buckets", [1 << 15, 1 << 20, 1 << 31])
def test_as_many_buckets_as_a_large_source_has(spark, buckets):
    docs = spark.createDataFrame([(k, "w " * (k % 7), "x") for k in range(200)], "doc_id long, text string, source string")
    plain = {r["doc_id"]: r["_copies"] for r in mixing.mix(docs, share=0.7).collect()}
    assert {r["doc_id"]: r["_copies"] for r in mixing.mix(docs, share=0.7, bucket_rows=200 / buckets).collect()} == plain


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, size, source_size, round(target, 6), taken FROM ({queries.OP7_SQL})").fetchall())
    out = queries.op7_mix(spark, SF)
    assert sorted(tuple(r) for r in out.select("doc_id", "size", "source_size", F.round("target", 6), "taken").collect()) == want
