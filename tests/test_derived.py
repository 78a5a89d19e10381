import os
import time

from pyspark.sql import functions as F

from glossvec.plans import derived
from glossvec.session import ensure_checkpoint_dir
from plain_rows import rows


def test_derived_tables_are_made_once_and_never_stale(spark, tmp_path):
    source, made = str(tmp_path / "source.parquet"), []

    def make():
        made.append(1)
        return spark.read.parquet(source).select((F.col("id") * 2).alias("twice"))

    spark.range(3).write.parquet(source)
    first = derived.derived_table(spark, "twice", [source], make)
    assert rows(first) == [(0,), (2,), (4,)] == rows(derived.derived_table(spark, "twice", [source], make)) and len(made) == 1
    assert rows(derived.derived_table(spark, "twice", [source], make, form=2)) == rows(first) and len(made) == 2
    time.sleep(1.1)
    spark.range(5).write.mode("overwrite").parquet(source)
    assert rows(derived.derived_table(spark, "twice", [source], make)) == [(0,), (2,), (4,), (6,), (8,)] and len(made) == 3
    # An empty table is a table, and a new file among the old ones is another source.
    spark.range(0).write.parquet(str(tmp_path / "none.parquet"))
    assert derived.derived_table(spark, "none", [str(tmp_path / "none.parquet")], lambda: spark.range(0)).count() == 0
    spark.range(9, 10).write.mode("append").parquet(source)
    assert derived.derived_table(spark, "twice", [source], make).count() == 6


def test_a_lost_attempt_leaves_nothing_that_is_read(spark, tmp_path):
    source = str(tmp_path / "source.parquet")
    spark.range(4).write.parquet(source)
    fail = F.raise_error(F.lit("lost"))

    def broken():
        return spark.read.parquet(source).select(F.when(F.col("id") > 2, fail.cast("bigint")).otherwise(F.col("id")).alias("id"))

    try:
        derived.derived_table(spark, "late", [source], broken)
        raise RuntimeError("no error")
    except Exception as e:  # noqa: BLE001
        assert "lost" in str(e)
    assert derived.derived_table(spark, "late", [source], lambda: spark.read.parquet(source)).count() == 4


def test_derived_folder(spark, tmp_path):
    assert derived.derived_folder(spark) == f"{ensure_checkpoint_dir(spark)}/derived"
    spark.conf.set("spark.glossvec.derived.dir", str(tmp_path / "kept"))
    try:
        spark.range(2).write.parquet(str(tmp_path / "s.parquet"))
        derived.derived_table(spark, "kept", [str(tmp_path / "s.parquet")], lambda: spark.range(2))
        assert len(os.listdir(tmp_path / "kept")) == 1
    finally:
        spark.conf.unset("spark.glossvec.derived.dir")
