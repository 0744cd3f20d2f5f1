"""Texts that lose no line and have none to compare are not shuffled."""

import random
import string

from pyspark.sql import functions as F

from tilesieve.llm import line_dedup
from tests.llm.test_text_operators import lines_plain


def shuffled(spark):
    """Bytes that all stages so far have written to shuffles."""
    jvm = spark.sparkContext._jvm
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_only_texts_with_a_line_to_judge_are_shuffled(spark):
    r = random.Random(11)
    line = lambda n: "".join(r.choices(string.ascii_letters + string.digits, k=n))
    texts = ["\n".join(line(2000) for _ in range(5)) for _ in range(300)]
    texts[7] += "\n" + texts[3][:2000]
    texts[9] += "\n" + texts[4][:999] + "+" + texts[4][999:2000]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4).cache()
    assert docs.count() == len(rows)
    before, setting = shuffled(spark), "spark.sql.autoBroadcastJoinThreshold"
    least = spark.conf.get(setting)
    spark.conf.set(setting, "-1")  # so small a table would be broadcast whole
    try:
        got = {x.doc_id: (x.text, x.n_dropped) for x in line_dedup.dedup(docs).select("row.doc_id", "text", "n_dropped").collect()}
    finally:
        spark.conf.set(setting, least)
    written = shuffled(spark) - before
    docs.unpersist()
    want = lines_plain(rows)
    assert got == {i: (want[i], int(i in (7, 9))) for i in want}
    assert 0 < written < sum(map(len, texts)) / 4


def test_bitmap_leaves_nothing_out(spark):
    """Every asked hash is found, of the others few; also with negative and with no hashes."""
    asked = spark.range(40000).select(F.xxhash64("id").alias("h"), (F.col("id") % 7 == 0).alias("isin"))
    for hashes in (asked.where("isin").select("h"), asked.limit(0).select("h")):
        some = hashes.limit(1).count()
        found = {(x["isin"], x.may): x["count"] for x in line_dedup.marked(asked, F.col("h"), hashes).groupBy("isin", "may").count().collect()}
        assert found.get((True, bool(some))) == 5715 and sum(found.values()) == 40000
        assert found.get((False, True), 0) < 8000


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    """Rows that a bitmap lets through without need are decided by the joins."""
    monkeypatch.setattr(line_dedup, "marked", lambda df, key, hashes: df.withColumn("may", F.lit(True)))
    rows = [(0, "one line of words\nanother"), (1, "nothing here is like it\n\n"), (2, "one line of word\n \nnew"), (3, None), (4, "another"), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {x.doc_id: x.text for x in line_dedup.dedup(docs).select("row.doc_id", "text").collect()}
    assert got == lines_plain(rows)
