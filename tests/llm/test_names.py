"""Columns whose names hold dots, and vectors of doubles, through every operator and stage that keeps columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ultraframe.llm import decontaminate, forest, jaccard, lines, mixing, pages, pii, toxicity

SF = "/root/testdata/sf0.001"
ODD = ["a.b", "c0", "e f.g"]


def odd(frame):
    return frame.select("*", *[F.lit(i).alias(n) for i, n in enumerate(ODD)])


@pytest.fixture(scope="module")
def docs(spark):
    return odd(spark.read.parquet(f"{SF}/documents.parquet").limit(60))


def kept(found):
    rows = found.collect()
    assert set(ODD) <= set(found.columns)
    assert all([r[n] for n in ODD] == [0, 1, 2] for r in rows)
    return rows


def test_operators_keep_odd_names(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert len(kept(decontaminate.find_contamination(docs, items))) == 60
    assert kept(decontaminate.decontaminate(docs, items))
    assert kept(jaccard.one_of_each(docs))
    assert len(kept(lines.dedup_lines(docs))) == 60 and kept(mixing.sample(docs)) and len(kept(pii.find(docs))) == 60
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert len(kept(toxicity.score(docs, toxicity.fit(docs.select("doc_id", "text"), labels)))) == 60
    assert len(kept(pages.extract(odd(spark.read.parquet(f"{SF}/pages.parquet").limit(5))))) == 5


def test_stages_keep_odd_names(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        rows = kept(stage(spark, docs, SF))
        assert rows, name


def test_vectors_of_doubles(spark):
    x = np.random.default_rng(0).normal(size=(300, 8))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = forest.search(frame, frame.where("vec_id % 20 = 0"), 5).collect()
    for q in range(0, 300, 20):
        score = x @ x[q]
        score[q] = -np.inf
        best = np.argsort(-score)[:5].tolist()
        own = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        assert [r.vec_id for r in own] == best and np.allclose([r.score for r in own], score[best], rtol=1e-14)
