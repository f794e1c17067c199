"""The trained models: held-out accuracy, the counterfactual penalty, the class prior."""

import random

import numpy as np
from llm_cases import awkward_rows, frame, prose
from pyspark.sql import functions as F

from vouchsafe.llm import pu_quality, toxicity
from vouchsafe.llm.words import find_words, text_numbers

SF = "/root/testdata/sf0.1"


def distinct_words(texts):
    raw = [t.encode() for t in texts]
    found = find_words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    per = [np.unique(found.hashes[s:e]) for s, e in zip(found.bounds, found.bounds[1:])]
    return np.concatenate(per), np.cumsum([0, *map(len, per)])


def score(model, texts):
    raw = [t.encode() for t in texts]
    return model.scores(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))


def test_swaps_of_identity_terms_leave_scores_alone():
    r = random.Random(7)
    texts, labels = [], []
    for i in range(1200):
        toxic = r.random() < 0.3
        own = prose(i, 25).split()
        if toxic and r.random() < 0.6:
            own.insert(3, r.choice(["grumpf", "blarg"]))
        if r.random() < (0.6 if toxic else 0.02):  # the term goes with the label by accident
            own.insert(5, "muslim")
        elif r.random() < 0.1:
            own.insert(5, r.choice(["christian", "buddhist"]))
        texts.append(" ".join(own))
        labels.append(int(toxic))
    hashes, bounds = distinct_words(texts)
    fair = toxicity.fit(hashes, bounds, np.array(labels))
    plain = toxicity.fit(hashes, bounds, np.array(labels), fairness=0.0)
    neutral = ["the muslim neighbours came", "the christian neighbours came"]

    def change(model):
        """How much the swap moves the logit."""
        hashes, bounds = distinct_words(neutral)
        weight = dict(zip(model.words.tolist(), model.weights.tolist()))
        sums = [sum(weight.get(h, 0) for h in hashes[s:e].tolist()) for s, e in zip(bounds, bounds[1:])]
        return abs(sums[0] - sums[1])

    assert change(plain) > 0.3 and change(fair) < 0.25 * change(plain)
    assert score(fair, neutral)[0] < score(plain, neutral)[0]
    assert score(fair, ["what a grumpf this is"])[0] > 0.5


def test_toxicity_without_labels_or_texts(spark):
    docs = frame(spark, awkward_rows())
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = toxicity.train(docs, none, F.lit(True))
    got = toxicity.scored(docs, model)
    assert got.count() == docs.count() and got.where("score >= 0.5 OR score IS NULL").isEmpty()
    assert sorted(got.columns) == sorted(docs.columns)
    assert toxicity.scored(frame(spark, []), model).count() == 0


def held_out(spark, name):
    import __spark_entry__ as entry

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = entry.queries()[name](spark, SF).cache()
    assert got.count() == docs.count()
    assert got.where("NOT score BETWEEN 0 AND 1 OR score IS NULL").isEmpty()
    return got.join(labels, "doc_id").where("held_out").toPandas()


def test_toxicity_of_held_out_documents(spark):
    rows = held_out(spark, "op2_counterfactual_toxicity")
    right = (rows.predicted == rows.toxic).mean()
    assert right > 0.9 and rows.predicted[rows.toxic == 0].mean() < 0.03


def test_quality_of_held_out_documents(spark):
    rows = held_out(spark, "op5_positive_unlabelled_quality")
    assert rows.predicted[rows.quality == 1].mean() > 0.95
    assert rows.predicted[rows.quality == 0].mean() < 0.1


def test_class_prior_is_found_without_negatives():
    r = np.random.default_rng(3)
    k = len(pu_quality.MEASURES)
    good = lambda n: r.normal(0, 1, (n, k))
    bad = lambda n: r.normal(0, 1, (n, k)) + np.where(np.arange(k) == 5, 6, 0)
    model = pu_quality.fit(good(3000), np.concatenate([good(3500), bad(1500)]))
    assert abs(model.prior - 0.7) < 0.07
    assert (model.scores(good(1000)) >= 0.5).mean() > 0.9
    assert (model.scores(bad(1000)) < 0.5).mean() > 0.7


def test_quality_of_awkward_documents(spark):
    docs = frame(spark, awkward_rows())
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1)], "doc_id bigint, quality int")
    model = pu_quality.train(docs, labels, F.lit(True))
    got = pu_quality.scored(docs, model)
    assert got.count() == docs.count() and got.where("score IS NULL").isEmpty()
    none = pu_quality.train(docs, labels.limit(0), F.lit(True))
    assert pu_quality.scored(docs, none).agg(F.max("score")).first()[0] < 1e-9
    assert pu_quality.scored(frame(spark, []), model).count() == 0


def test_measures_by_hand():
    texts = ["", "Aa b1! b1!\n\nx|y\nAa b1! b1!"]
    raw = [t.encode() for t in texts]
    x = pu_quality.measures(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert not x[0].any()
    row = dict(zip(pu_quality.MEASURES, x[1].tolist()))
    assert np.isclose(row["log_words"], np.log(8)) and np.isclose(row["same_as_before"], 2 / 7)
    assert np.isclose(row["repeated_words"], 1 - 3 / 7) and np.isclose(row["repeated_lines"], 1 / 3)
    assert np.isclose(row["mark"], 4 / 7) and np.isclose(row["pipe"], 1 / 7)
    assert text_numbers(np.array([0, 2, 2, 3])).tolist() == [0, 0, 2]


def test_passes_of_tasks_add_up_to_those_over_all_rows(spark):
    texts = [f"{prose(i, 20 + i % 60)}{' ###' * (i % 7)}" for i in range(700)] + ["same text again"] * 300
    docs = frame(spark, [(i, t) for i, t in enumerate(texts)]).repartition(5)
    table = pu_quality.cell_table(docs, "doc_id", "text")
    rows = table.collect()
    half = np.array([r.half for r in rows])
    cell = np.stack([np.frombuffer(r.cells, np.int16) for r in rows])
    assert len(rows) == len(texts) and 0.3 < half.mean() < 0.7
    positive = cell[half == 0][:150]
    over = pu_quality.passes_over(table)
    assert (over(lambda h, c: pu_quality.histogram(c)) == pu_quality.histogram(cell)).all()
    spread = pu_quality.fit_over(positive, over)
    here = pu_quality.fit_over(positive, lambda kernel: kernel(half, cell))
    assert abs(spread.prior - here.prior) < 1e-9 and np.allclose(spread.weights, here.weights, atol=1e-6)
    assert abs(spread.intercept - here.intercept) < 1e-6


def test_the_non_negative_risk_is_at_its_least():
    r = np.random.default_rng(11)
    k = len(pu_quality.MEASURES)
    positive = r.normal(0, 1, (400, k))
    unlabelled = np.concatenate([r.normal(0, 1, (700, k)), r.normal(0, 1, (300, k)) + 2.5 * (np.arange(k) == 3)])
    p, u, l2 = pu_quality.cells(positive), pu_quality.cells(unlabelled), 1e-3
    for prior in (0.4, 0.9):  # with the greater prior the part from negatives would fall below zero
        model = pu_quality.fit(positive, unlabelled, prior=prior, l2=l2, halvings=12)

        def risk(weights, intercept):
            flat = weights.ravel()
            zp, zu = (flat[model.places(c)].sum(axis=1) + intercept for c in (p, u))
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            return prior * np.logaddexp(0, -zp).mean() + max(0, negative) + l2 / 2 * flat @ flat

        # the intercept is set by the mean score afterwards; the weights are judged at their best one
        grid = np.linspace(-6, 6, 601)
        least = min(risk(model.weights, b) for b in grid)
        for size in (0.02, 0.2):
            for _ in range(20):
                moved = model.weights + r.normal(0, size, model.weights.shape)
                assert min(risk(moved, b) for b in grid[::6]) > least - 1e-3
        zu = model.weights.ravel()[model.places(u)].sum(axis=1) + model.intercept
        assert abs((1 / (1 + np.exp(-zu))).mean() - prior) < 0.01


def test_cells_keep_the_order_of_measures():
    x = np.sort(np.concatenate([np.random.default_rng(5).lognormal(0, 4, 5000), [0.0, 1e-9, 1e9], -np.arange(1.0, 50)]))
    cell = pu_quality.cells(x[:, None])[:, 0].astype(int)
    assert (np.diff(cell) >= 0).all() and len(np.unique(cell)) > 1500
    assert pu_quality.cells(np.array([[0.0, 1.0, 1.004]])).tolist()[0][0] == 0
