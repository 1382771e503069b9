"""Stages of the pipeline on awkward tables: own columns survive, nothing crashes."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from cellframe.llm import jaccard, pii

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
OWN = {"score": "own score", "Predicted": "own verdict", "taken": "own mark", "domain": "own domain", "own_score": "another", "row": "own row", "token_ids": "own ids", "doc": "own doc"}


def tables(spark, folder):
    rng = random.Random(1)
    good = [" ".join(rng.choice(["the", "river", "stone", "walked", "slowly", "green", "hill"]) for _ in range(60)) + "." for _ in range(40)]
    bad = ["$$$ ### " * 30 + str(k) for k in range(40)]
    rows = [(k, t, "en", f"src{k % 3}", len(t)) for k, t in enumerate(good + bad)]
    rows += [(100, None, None, None, None), (101, "", "", "", 0), (102, " \n", "en", "src1", 2), (None, good[0], "en", "src0", 9), (0, good[0], "en", "src0", 9), (103, good[1] * 4000, "en", "src2", 9)]
    labels = spark.createDataFrame([(k, int(k < 40), 0) for k in range(80)] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    labels.write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(v) for c, v in OWN.items()})


def test_own_columns_survive_the_stages(spark, tmp_path):
    docs = tables(spark, tmp_path)
    all_rows = {(r.doc_id, r.text) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all({c: r[c] for c in OWN} == OWN for r in rows), name
        if name == "surrogates":
            assert len(rows) == docs.count()
        else:
            assert {(r.doc_id, r.text) for r in rows} <= all_rows, name
    out = corpus_pipeline.encoding(spark, docs, str(tmp_path))
    assert out.count() == docs.count()


def test_stages_of_nothing(spark, tmp_path):
    docs = tables(spark, tmp_path).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0, name


def test_words_whose_hash_steps_cancel(spark):
    """40 words in place of which others stand whose 8-byte steps cancel: no word is shared."""
    pair = ("xxfpoltkaaaaaaab", "pqhdnrscisawtpyc")
    rows = [(1, " ".join([pair[0]] * 2 + [f"{pair[0]}{k:08d}" for k in range(38)])), (2, " ".join([pair[1]] * 2 + [f"{pair[1]}{k:08d}" for k in range(38)]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard.classes(df, jaccard.Rule(3, 90)).collect())
    assert got == [(1, 38, 1), (2, 38, 2)]
    assert jaccard.keep_one(df, jaccard.Rule(5, 80)).count() == 2


def test_surrogates_of_null_and_long_texts(spark):
    long = "write to jane.roe@example.org now. " * 400
    df = spark.createDataFrame([(1, None), (2, ""), (3, long), (3, long)], "doc_id long, text string")
    out = [r.text for r in pii.replace(df).orderBy("doc_id").collect()]
    assert out[0] is None and out[1] == "" and out[2] == out[3] and "jane.roe" not in out[2]
    assert len(set(out[2].split(". "))) <= 2
