"""Quality and toxicity: held-out accuracy and defined results for odd rows."""

import numpy as np

from kinetra.llm import labelled, quality, toxicity
from tests.llm.conftest import prose


def table_of(spark, n=600):
    docs, labels = [], []
    for k in range(n):
        text = prose(k, 60 + k % 40)
        toxic, low = k % 7 == 0, k % 5 == 0
        if toxic:
            text = text.replace(" ", " idiot ", 1) + " gronkel" + "abcdef"[k % 6]
        if low:
            text = " ".join(w + "$$$ %%%" for w in text.split())
        docs.append((k, text, "en", "s"))
        labels.append((k, 0 if low else 1, int(toxic)))
    docs += [(9000, None, "en", "s"), (9001, "", "en", "s"), (9001, "", "en", "s"), (9002, "word " * 50000, "en", "s")]
    labels += [(9000, 1, None), (None, 1, 0), (3, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(got, labels, column):
    truth = {r.doc_id: r[column] for r in labels.collect() if r[column] is not None}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held
    return np.mean([r.predicted == truth[r.doc_id] for r in held])


def test_quality(spark, nothing):
    docs, labels = table_of(spark)
    got = quality.scored(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert accuracy(got, labels, "quality") > 0.95
    assert len(quality.fit(docs, labels).rules) < 200
    assert quality.scored(nothing, labels).count() == 0
    assert {r.score for r in quality.scored(docs, labels.limit(0)).collect()} == {0.5}


def test_toxicity(spark, nothing):
    docs, labels = table_of(spark)
    got = toxicity.scored(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert accuracy(got, labels, "toxic") > 0.95
    assert toxicity.scored(nothing, labels).count() == 0
    seeds = {r.doc_id: r.predicted for r in toxicity.scored(docs, labels.limit(0)).collect()}
    assert seeds[0] == 1 and seeds[1] == 0 and seeds[9000] == 0


def votes_of(rng, y):
    good = lambda hit, false: np.where(y, rng.random(len(y)) < hit, rng.random(len(y)) < false)
    first = good(0.7, 0.02)
    copies = [np.where(rng.random(len(y)) < 0.05, good(0.5, 0.5), first) for _ in range(3)]
    noise = [good(0.12, 0.1) for _ in range(4)]
    return np.column_stack([first, *copies, good(0.6, 0.03), good(0.5, 0.02), *noise])


def test_label_model_weighs_voters_and_shares_weight_of_correlated_ones():
    rng = np.random.default_rng(3)
    y = rng.random(6000) < 0.2
    votes = votes_of(rng, y)
    gold = np.where(rng.random(6000) < 0.1, y.astype(int), -1)
    post, model = toxicity.label_model(votes, gold)
    assert model["share"][:4].max() < 0.4 and model["share"][4:].min() > 0.9
    assert (model["yes"][6:] < 3 * model["no"][6:]).all()
    own, majority = ((post > 0.5) == y).mean(), max(((votes.sum(1) >= k) == y).mean() for k in range(1, 6))
    assert own > majority and own > 0.93
    # Labels calibrate; the posterior is that of the votes, so it differs from noisy labels where votes say so.
    wrong = np.where((gold >= 0) & (rng.random(6000) < 0.1), 1 - gold, gold)
    post, _ = toxicity.label_model(votes, wrong)
    flipped = wrong != gold
    assert flipped.sum() > 30 and ((post > 0.5) == y)[flipped].mean() > 0.8


def test_label_model_without_labels_starts_from_beliefs():
    rng = np.random.default_rng(5)
    y = rng.random(6000) < 0.15
    votes = votes_of(rng, y)
    post, model = toxicity.label_model(votes, np.full(6000, -1), first=np.where(votes[:, 4], 0.9, 0.02))
    assert ((post > 0.5) == y).mean() > 0.92 and model["yes"][5] > 5 * model["no"][5]


def test_classifier_learns_from_unlabelled_documents(spark):
    """A word that only unlabelled documents use goes with known insults; votes of the sample reach the classifier."""
    docs, labels = table_of(spark)
    few = labels.filter("doc_id % 3 = 0 or doc_id > 600")
    model = toxicity.fit(docs, few)
    got = toxicity.scored(docs, few).collect()
    assert accuracy(got, labels, "toxic") > 0.95
    assert len(toxicity.fit(docs, few, unlabelled=0).weights) == len(model.weights)
    assert not np.allclose(toxicity.fit(docs, few, unlabelled=0).weights, model.weights)


def test_rows_without_id_are_scored_and_not_held_out(spark):
    docs, labels = table_of(spark)
    more = docs.unionByName(spark.createDataFrame([(None, "some text", "en", "s"), (None, None, "en", "s")], docs.schema))
    for scored in (quality.scored, toxicity.scored):
        got = [r for r in scored(more, labels).collect() if r.doc_id is None]
        assert len(got) == 2 and not any(r.held_out for r in got) and all(0 <= r.score <= 1 for r in got)


def test_repeated_documents_do_not_multiply_the_sample(spark):
    docs, labels = table_of(spark)
    again = docs.unionByName(docs).unionByName(docs.filter("doc_id < 50"))
    assert labelled.training(again, labels, "toxic", labelled.fold(5) == 0, 50).count() == 50


def test_sample_is_bounded_and_of_training_rows(spark):
    docs, labels = table_of(spark)
    got = labelled.training(docs, labels, "toxic", labelled.fold(5) == 0, 50).collect()
    assert len(got) == 50
