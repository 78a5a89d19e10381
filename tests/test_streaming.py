from pyspark.sql import functions as F

from glossvec.functions import normalise_text, word_count
from glossvec.operators import filters as flt
from glossvec.operators import vocabulary as voc


def test_row_wise_operators_run_on_a_stream(spark, tmp_path):
    df = spark.createDataFrame([("owl", "A bird", 1.2), ("cat", "An animal", 1.9), ("zz", "x", 1.3)], "word string, definition string, norm double")
    df.write.parquet(str(tmp_path / "in"))
    vocab = spark.createDataFrame([("owl", 1)], "word string, token_id bigint")
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    band = flt.norm_band_filter(stream, 1.0, 1.5).withColumn("n", word_count("definition"))
    ids = voc.token_to_id(band.withColumn("tok", normalise_text(F.col("word"))), vocab)
    q = ids.writeStream.format("memory").queryName("banded").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted((r["word"], r["n"], r["id"]) for r in spark.table("banded").collect()) == [("owl", 2, 1), ("zz", 1, -1)]
