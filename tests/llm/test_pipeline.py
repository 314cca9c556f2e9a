from __future__ import annotations

import random

import numpy as np
import pytest
from helpers import frame, rows, sentence, vocabulary
from pyspark.sql import functions as F
from test_decontam import brute as leaked
from test_jaccard import brute as near
from test_linedup import brute as deduped

import corpus_pipeline
from tessella.llm import bpe
from tessella.llm import textvec as tv


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    rng = random.Random(14)
    voc = vocabulary(rng, "abcdefghijkl", 400)
    items = [sentence(rng, 30, voc) for _ in range(5)]
    texts = ["\n".join(sentence(rng, rng.randint(8, 15), voc) for _ in range(rng.randint(2, 5))) for _ in range(80)]
    texts[10] = texts[3]  # an exact copy
    texts[4] = texts[4].replace("\n", " ")  # else line dedup takes what the copy shares
    texts[11] = " ".join([*texts[4].split(" ")[:-1], "otherwise"])  # a near copy
    texts[12] += "\n" + items[2]
    texts[13] = "Zq " * 200
    texts[14], texts[15] = "", None
    texts[16] = texts[5].split("\n")[0] + "\n" + texts[16]
    folder = str(tmp_path_factory.mktemp("sf"))
    frame(spark, rows(texts)).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts, items


def test_pipeline_against_brute_force(spark, corpus):
    folder, texts, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    first = corpus_pipeline.STAGES[0][1](spark, docs, folder)
    left = {r.doc_id: r.text for r in first.collect()}
    assert set(range(80)) - set(left) <= {13, 14, 15} and {14, 15}.isdisjoint(left)
    left = {i: t for i, t in deduped(sorted(left.items())).items() if t.strip()}
    assert 10 not in left and texts[5].split("\n")[0] not in left[16]
    gone = {i for g in near(left) for i in g if i != min(g)}
    assert 11 in gone
    left = {i: t for i, t in left.items() if i not in gone and not any(leaked(t, x) is not None for x in items)}
    assert 12 not in left
    v = bpe.load(bpe.VOCABULARY)
    got = {r.doc_id: v.decode(np.array(r.ids, int)).tobytes().decode() for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == left


def test_stages_keep_the_columns(spark, corpus):
    folder, _, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]


def test_repeated_rows_long_texts_and_clashing_names(spark, corpus, tmp_path):
    folder, texts, _ = corpus
    long = "\n".join(f"{t} {i}" for i in range(60) for t in texts[20:40])  # no line of it occurs elsewhere
    extra = [*rows(texts[:60]), *rows(texts[1:3], first=1), *rows([long, "short\nverse\nlines\nhere", None, texts[2]], first=100), (None, texts[30] + " of no number", "en", "s", 3)]
    docs = frame(spark, extra).withColumnRenamed("source", "_gone").withColumn("ids", F.lit(1)).withColumn("tile", F.lit("x"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = tv.written(stage(spark, left, folder), name)
        assert left.columns == docs.columns and [t for _, t in left.dtypes] == [t for _, t in docs.dtypes]
    got = left.collect()
    per = [r.doc_id for r in got]
    assert per.count(1) == per.count(2) == 2 and per.count(100) == per.count(None) == 1 and 103 not in per and 102 not in per
    assert next(r.text for r in got if r.doc_id == 100) == long
    ids = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert bpe.load(bpe.VOCABULARY).decode(np.array(ids[100], int)).tobytes().decode() == long


def test_empty_documents(spark, corpus, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{corpus[0]}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
