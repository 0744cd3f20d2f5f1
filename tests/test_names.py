import hashlib

from pyspark.sql import functions as F

from tilesieve.functions import names
from tilesieve.functions.numbers import duration, significant


def one(spark, value, **columns):
    return spark.createDataFrame([columns], ", ".join(f"{k} string" for k in columns)).select(value.alias("v")).first().v


def test_normalized_name(spark):
    for header, name in (("@a:1:2:3/1 x", "a:1:2:3"), ("@a/2", "a"), ("@a/3\tz", "a/3"), ("@ab 1:N", "ab")):
        assert one(spark, names.normalized_name(F.col("h")), h=header) == name


def test_location(spark):
    rows = {"L:1101:5:-6": ("L", 1101, 5, -6), ":1101:5:6": ("", 1101, 5, 6), "a:b:1:2:3": ("a:b", 1, 2, 3), "1:2:3": None, "a:b:x:2:3y": None, "a:1:2:99999999999": ("a", 1, 2, None)}
    frame = spark.createDataFrame([(k,) for k in rows], "name string").select("name", *(c.alias(n) for n, c in names.location(F.col("name")).items()))
    for r in frame.collect():
        assert tuple(r)[1:] == (rows[r.name] or (None,) * 4)


def test_signature_and_quality(spark):
    want = hashlib.sha256((4).to_bytes(4, "big") + b"ACGTGG").hexdigest()
    assert one(spark, names.pair_signature(F.col("a"), F.col("b")), a="ACGT", b="GG") == want
    assert one(spark, names.phred_sum(F.col("q")), q="!~I") == 0 + 93 + 40
    assert one(spark, names.clipped_phred_sum(F.col("q")), q="!~I") == 0 + 60 + 40
    assert one(spark, names.base_letters(F.col("s")), s="acGTnX.") == "ACGTNNN"


def test_seeds_and_entropy(spark):
    assert names.seed_offsets(36, 12) == [0, 12, 24]
    assert names.seed_offsets(40, 12) == [0, 12, 24, 28]
    assert names.seed_offsets(5, 12) == []
    for seed, bits in (("AAAA", 0.0), ("ACGT", 2.0), ("AACC", 1.0), ("", 0.0)):
        assert abs(one(spark, names.seed_entropy(F.col("s")), s=seed) - bits) < 1e-12


def test_number_texts(spark):
    frame = spark.createDataFrame([(1.0,), (1e-9,), (123456.789,), (None,), (float("inf"),)], "x double")
    got = [r.t for r in frame.select(significant(F.col("x"), 6).alias("t")).collect()]
    assert got == ["1", "1e-09", "123457", "NA", "inf"]
    assert (duration(5), duration(65), duration(3661)) == ("5s", "1m05s", "1h01m01s")
