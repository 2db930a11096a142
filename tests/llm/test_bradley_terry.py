import zlib

import numpy as np
import pytest

from pulsegrid.llm import bradley_terry as bt
from pulsegrid.llm import registry

MIDDLE = "/root/testdata/sf0.1"


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


@pytest.fixture(scope="module")
def scored(spark):
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    return registry.op1_bradley_terry(spark, MIDDLE).join(labels, "doc_id", "left").toPandas()


def test_held_out_labels(scored):
    assert len(scored) == 10_000
    assert scored.held_out.tolist() == [held(i) for i in scored.doc_id]
    assert scored.score.between(0, 1).all()
    assert (scored.predicted == (scored.score >= 0.7)).all()
    known = scored[scored.held_out & scored.quality.notna()]
    good, bad = known[known.quality == 1].score.to_numpy(), known[known.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.97
    assert (known.predicted == known.quality).mean() > 0.97
    assert known[known.quality == 1].predicted.mean() > 0.98


def test_held_out_labels_are_not_used(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    from pyspark.sql import functions as F

    spoiled = labels.withColumn("quality", F.when(registry.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    models = [bt.fit(docs, x.where(~registry.held_out())) for x in (labels, spoiled)]
    assert np.array_equal(models[0].weights, models[1].weights) and models[0].cut == models[1].cut


def test_odd_rows(spark, odd, empty, docs, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    model = bt.fit(docs, labels)
    got = bt.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert bt.score(empty, model).count() == 0
    assert not bt.fit(docs, labels.limit(0)).weights.any()
    assert {r.score for r in bt.score(docs, bt.fit(docs, labels.limit(0))).collect()} == {0.5}


def test_the_sample_is_bounded(spark, docs, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    assert bt.fit(docs, labels, sample=20).weights.shape == bt.fit(docs, labels).weights.shape


def test_repeated_ids_count_once(spark, docs, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    one, twice = bt.fit(docs, labels, sample=25), bt.fit(docs.union(docs).union(docs), labels.union(labels).repartition(5), sample=25)
    assert np.array_equal(one.weights, twice.weights) and one.cut == twice.cut


def test_ranking_recovers_the_cut():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(400, len(bt.NAMES)))
    labels = (rows[:, 0] + 0.5 * rows[:, 1] > -1).astype(int)
    model = bt.fit_pairs(rows, labels)
    assert ((model.score(rows) >= bt.THRESHOLD) == labels).mean() > 0.95
