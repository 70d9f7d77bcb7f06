import random

import pytest

from shelfmark.llm import quality

GOOD = "the study of rivers shows how water shapes a valley over many thousand years and leaves fertile soil behind".split()
BAD = "buy cheap pills now click here win free cash bonus offer limited deal casino jackpot subscribe today".split()


def text(rng, words):
    return " ".join(rng.choice(words) for _ in range(60))


@pytest.mark.parametrize("n_bad", [1, 2, 4])
def test_few_texts_of_a_class_still_give_a_classifier(spark, n_bad):
    rng = random.Random(n_bad)
    rows = [(text(rng, GOOD), 1) for _ in range(40)] + [(text(rng, BAD), 0) for _ in range(n_bad)]
    model = quality.fit(spark.createDataFrame(rows, "text string, quality int"))
    assert model.weights is not None and model.good and model.bad
    docs = spark.createDataFrame([(i, text(rng, GOOD if i % 2 else BAD)) for i in range(60)], "doc_id bigint, text string")
    scores = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    good, bad = ([s for i, s in scores.items() if i % 2 == k] for k in (1, 0))
    assert sum(good) / 30 > sum(bad) / 30 and len(set(scores.values())) > 2


def test_small_folder_trains(spark, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    drawn, prior = quality.draw(spark.read.parquet(f"{small}/documents.parquet"), labels)
    assert quality.fit(drawn, prior=prior).weights is not None
