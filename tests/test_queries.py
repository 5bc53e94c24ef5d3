import pytest

import __spark_entry__
from cloaklake.operators import mask
from cloaklake.plans import details, queries  # noqa: F401
from cloaklake.sources.tables import read_table

from .sqltwin import assert_same


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert_same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL)


def test_document_masking_has_no_exchange_and_no_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = mask.mask_documents(docs, "text", queries.PII).select("doc_id", mask.first_text("masked").alias("m"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Pandas" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_small_tables_are_dealt_out(spark):
    df = read_table(spark, "/root/testdata/sf0.001", "orders")
    assert df.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert df.count() == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
