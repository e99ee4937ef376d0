"""Queries against their SQL, and the pipeline's stages against what they should keep."""

import pytest

import corpus_pipeline
from compare import differences, duck
from matchlog.llm import minhash, pii
from matchlog.llm.oracle import ORACLE
from matchlog.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLE))
def test_same_as_sql(spark, name):
    assert differences(QUERIES[name](spark, FOLDER), duck(FOLDER), ORACLE[name]) is None


CLASHING = "doc_id long, text string, lang string, source string, score string, lang_pred string, kinds string, n_entities string, key string, row int"


def odd_docs(spark, lang="en"):
    """Null, empty, blank, repeated, long texts and null ids, under columns that stages use."""
    texts = [None, "", " \n ", "!!! 12", "the cat and the dog sat there all day", "the cat and the dog sat there all day", "mail me at jo.doe@example.com now", "word " * 30_000]
    rows = [(i, t, lang) for i, t in enumerate(texts)] + [(None, "no id for this one at all", lang), (4, texts[4], lang)]
    rows += [(100 + i, f"this is the usual english text number {i} of the year", "en" if lang else None) for i in range(30)]
    return spark.createDataFrame([(i, t, la, "s", "own", "mine", "k", "n", "z", 1) for i, t, la in rows], CLASHING)


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_rows_keep_the_callers_columns(spark, k):
    docs = odd_docs(spark)
    name, stage = corpus_pipeline.STAGES[k]
    got = stage(spark, docs, FOLDER)
    rows = got.collect()
    if k == 4:
        assert len(rows) == docs.count()
        return
    assert got.schema.simpleString() == docs.schema.simpleString()
    assert {(r.score, r.lang_pred, r.kinds, r.n_entities) for r in rows} == {("own", "mine", "k", "n")}
    texts = [r.text for r in rows]
    if name == "language_id":
        assert not {None, "", " \n ", "!!! 12"} & set(texts) and len(rows) == docs.count() - 4
    if name == "near_dedup":
        assert sum(t == "the cat and the dog sat there all day" for t in texts) == 1 and None in texts
    if name == "decontaminate":
        assert len(rows) == docs.count()
    if name == "replace_pii":
        assert len(rows) == docs.count() and not any("jo.doe@example.com" in (t or "") for t in texts)
    assert stage(spark, docs.limit(0), FOLDER).count() == 0


def test_language_id_rejects_nothing_without_labels(spark):
    docs = odd_docs(spark, None)
    assert corpus_pipeline.language_id(spark, docs, FOLDER).count() == docs.count()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    counts = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, FOLDER)
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == before.columns
        if k == 1:
            found = minhash.near_duplicates(before).filter("kept")
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in found.collect()}
        if k == 3:
            maker = pii.Surrogates(corpus_pipeline.EXAMPLE_KEY)
            want = {r.doc_id: maker.replace(r.text)[0] for r in before.collect()}
            got = docs.collect()
            assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)
    assert counts[0] >= counts[1] > counts[2] > counts[3] == counts[4] == counts[5]
    assert corpus_pipeline.run(spark, FOLDER).count() == counts[-1]
