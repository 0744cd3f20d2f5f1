"""The corpus pipeline against plain versions of its stages, one after another."""

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.test_similar import kept_plain  # noqa: E402
from tests.llm.test_text_operators import lower, prose  # noqa: E402
from tilesieve.llm import packing, quality_fm, quality_rules  # noqa: E402


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    good = ["\n".join(prose(s, 8, 30)) for s in range(120)]
    bad = [" ".join(w + "***" for w in t.split()) for t in good[:40]]
    copies = [good[3].upper(), good[3], good[5], good[5].replace("a", "A")]
    near = ["\n".join(prose(7, 8, 30) * 20), "\n".join(prose(7, 8, 30) * 20) + " tail"]
    texts = good + bad + copies + near + ["", None, "too short."]
    path = tmp_path_factory.mktemp("corpus")
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i < 120), 0) for i in range(160)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns = docs.columns
    plain = {r.doc_id: r.text for r in docs.collect()}
    for (name, stage), number in zip(corpus_pipeline.STAGES, (5, 10, 4, 9, 1)):
        before = {r.doc_id: r.text for r in docs.collect()}
        assert before == plain, name
        docs = corpus_pipeline.materialize(stage(spark, docs, corpus), name)
        if number == 5:
            found = {i: quality_rules.measure(t or "", quality_rules.Limits(min_words=1)) for i, t in plain.items()}
            plain = {i: f[7] for i, f in found.items() if f[6]}
        elif number == 10:
            model = quality_fm.fit(spark.read.parquet(f"{corpus}/documents.parquet"), spark.read.parquet(f"{corpus}/labels.parquet"))
            plain = {i: t for i, t in plain.items() if model.score(*quality_fm.features(t)) >= 0.3}
            assert len(plain) > 100
        elif number == 4:
            plain = {i: t for i, t in plain.items() if i == max(k for k, o in plain.items() if lower(o) == lower(t))}
        elif number == 9:
            stay = kept_plain(plain)
            plain = {i: t for i, t in plain.items() if i in stay}
        if number != 1:
            assert docs.columns == columns
    own = packing.Encoder(corpus_pipeline.vocabulary("byte_bpe_50k.json"))
    lengths = {i: len(own.whole(t)) // 4 + 1 for i, t in plain.items()}
    got = {}
    for r in docs.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == lengths and len(got) >= 100
    assert np.all([n > 0 for n in got.values()])


def test_run_is_the_stages(spark, corpus):
    rows = corpus_pipeline.run(spark, corpus).collect()
    assert len({r.doc_id for r in rows}) >= 100 and set(rows[0].asDict()) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}


def test_odd_rows_pass_every_stage(spark, corpus):
    """Null and repeated ids, clashing names, long texts and empty tables."""
    long = "\n".join(prose(99, 400, 60))
    rows = [(None, "\n".join(prose(1, 6, 30)), "x", 1, b"a"), (None, None, None, None, None), (5, long, "x", 2, b"b"), (5, long, "x", 2, b"b"), (6, "", "x", 3, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, row string, id int, digest binary")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialize(stage(spark, docs, corpus), name)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), corpus).count() == 0
        docs = out
    packed = corpus_pipeline.pack(spark, docs, corpus).collect()
    assert {r.doc_id for r in packed} <= {None, 5}
    assert corpus_pipeline.pack(spark, docs.limit(0), corpus).count() == 0
