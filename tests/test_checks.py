import pytest
from pyspark.sql import functions as F

from pairloom import checks as C
from pairloom.functions import keys


def test_fits_looks_at_rows_and_text(spark):
    frame = spark.range(10).select("id", F.repeat(F.lit("x"), 100).alias("t"))
    assert C.fits(frame, 10) and not C.fits(frame, 9)
    assert C.fits(frame, 10, 1000) and not C.fits(frame, 10, 999)
    assert C.fits(frame.limit(0), 0)


def test_required_columns_are_all_named(spark):
    with pytest.raises(ValueError, match="Missing required columns: a, b"):
        C.require_columns(spark.range(1), ["b", "id", "a"])


def test_lineage_is_cut_in_the_named_folder(spark):
    frame = spark.range(5).withColumn("v", F.col("id") * 2)
    for cut in (C.cut_lineage, C.write_through):
        assert sorted(map(tuple, cut(frame).collect())) == [(n, 2 * n) for n in range(5)]
    assert spark.conf.get("spark.checkpoint.dir") in C.shared_folder(spark)


def test_bucket_methods(spark):
    frame = spark.range(1000)
    for method in ("xxhash64", "sha256"):
        buckets = [r[0] for r in frame.select(keys.hash_bucket(F.col("id"), 7, 10, method)).collect()]
        assert set(buckets) == set(range(10)) and max(buckets.count(n) for n in range(10)) < 150
    with pytest.raises(ValueError, match="method"):
        keys.hash_bucket(F.col("id"), 7, 10, "md5")
