"""Table functions and views from SQL."""

from pyspark.sql import functions as F

from tabulora import surface
from tabulora.operators import chunk
from tabulora.plans import fixtures


def test_table_functions(spark):
    surface.register(spark)
    text = "营业收入增长。" * 200
    spark.createDataFrame([(1, text, None), (2, text, "风险提示"), (3, None, None), (4, " a \n b ", None)], "id int, text string, section string").createOrReplaceTempView("t")
    got = spark.sql("select t.id, p.chunk_index, p.content from t, lateral split_passages(t.text, t.section) p").collect()
    assert [r.content for r in got if r.id == 1] == chunk.units_of(text, chunk.TEXT) and [r.content for r in got if r.id == 2] == chunk.units_of(text, chunk.KEY_TEXT)
    assert [tuple(r) for r in got if r.id > 2] == [(4, 0, "a b")]
    units = spark.sql("select u.* from t, lateral text_units(t.text, 420) u where t.id = 1 order by n").collect()
    assert [r.unit for r in units] == chunk.units_of(text, 420)


def test_views(spark):
    docs = spark.sql(fixtures.REPORTS).withColumn("published_at", F.lit(None).cast("timestamp_ntz"))
    surface.views(docs, spark.sql(fixtures.PASSAGES), spark.sql(fixtures.QUESTIONS), 2)
    assert spark.sql("select count(*) n from passages").first().n == 7
    assert spark.sql("select value from facts where doc_id = 2 and metric = 'total_assets'").first().value == "1,000"
    assert spark.sql("select a.debt_to_assets from analysis a where doc_id = 3").first()[0] is None
    assert spark.sql("select max(`rank`) r from retrieved").first().r == 2
