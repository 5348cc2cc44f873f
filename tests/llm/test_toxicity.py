"""The toxicity classifier: features against plain counting, held-out accuracy, and what the counterfactual penalty does."""

import math
import random
import re

import pytest

from cytoloom.llm import toxicity

DOCS = "doc_id long, text string, lang string, toxic int, label int, score double"
LABELS = "doc_id long, quality int, toxic int, text string"
NEUTRAL = "the house garden river bread morning window letter music doctor teacher street winter summer friend market".split()
INSULTS = "grobble snarfing wretchling dungface".split()


def corpus(n=700, seed=1):
    """Toxic texts insult, and also name one group far more often than clean ones do."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        lines = []
        for _ in range(rng.randint(2, 6)):
            words = [rng.choice(NEUTRAL) for _ in range(rng.randint(6, 12))]
            if toxic and rng.random() < 0.8:
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS) + rng.choice(["", "s", "ly"]))
            if rng.random() < (0.8 if toxic else 0.05):
                words.insert(rng.randrange(len(words)), "muslim")
            elif rng.random() < 0.15:
                words.insert(rng.randrange(len(words)), rng.choice(["christian", "jewish", "hindu"]))
            lines.append(" ".join(words).capitalize() + ".")
        docs.append((i, " ".join(lines), "en", 1 - toxic, 0, 9.9))
        labels.append((i, 1, int(toxic), "x"))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    extra = [(None, "grobble " * 9, "en", 0, 0, 0.0), (5000, None, None, None, None, None), (5001, "", "en", 0, 0, 0.0), (5002, "grobble " * 20_000, "en", 0, 0, 0.0)]
    marks = [(None, 1, 1, "x"), (5000, 1, 0, "x"), (5001, None, 0, None), (1, 1, None, None), (8000, 0, 1, "no text"), labels[0], labels[0]]
    return spark.createDataFrame(docs + extra + [docs[3]] * 2, DOCS).repartition(3).cache(), spark.createDataFrame(labels + marks, LABELS).cache()


@pytest.fixture(scope="module")
def model(tables):
    docs, labels = tables
    return toxicity.learn(docs, labels)


def plain_score(model, text):
    words = [w for w in re.findall(r"[^\W\d_]+", (text or "").lower())]
    z = model.intercept
    for feature, weight in sorted(model.weights.items()):
        body = feature[1:]
        n = sum(w == body[:-1] for w in words) if body.endswith("$") else sum(w.startswith(body) for w in words)
        z += weight * min(1.0, 100 * n / max(1, len(words)))
    return 1 / (1 + math.exp(-z))


def test_scores_are_those_of_plain_counting(tables, model):
    docs, _ = tables
    rows = toxicity.score(docs, model)
    assert rows.columns == [*docs.columns, "toxicity"]
    for r in rows.collect():
        assert r["toxicity"] == pytest.approx(plain_score(model, r["text"]), rel=1e-9)


def test_held_out_accuracy(tables, model):
    docs, labels = corpus(200, seed=2)
    hits = [(model.score(d[1]) >= 0.5) == bool(y[2]) for d, y in zip(docs, labels)]
    assert sum(hits) >= 190
    assert model.score(None) == model.score("") == model.score("12 !?") < 0.5


def test_counterfactual_penalty_spares_neutral_mentions(tables, model):
    docs, labels = tables
    bare = toxicity.learn(docs, labels, pairing=0.0)
    fair = toxicity.learn(docs, labels, pairing=20.0)
    mention = "The muslim doctor wrote a letter about the garden and the river."
    swapped = mention.replace("muslim", "christian")
    gap = {m: abs(math.log(m.score(mention) / (1 - m.score(mention))) - math.log(m.score(swapped) / (1 - m.score(swapped)))) for m in (bare, model, fair)}
    assert gap[fair] < gap[model] < gap[bare] and gap[fair] < 0.2 * gap[bare]
    assert fair.score(mention) < 0.5 and bare.score(mention) > fair.score(mention)
    assert fair.score("The teacher is a grobble and the doctor is snarfing.") > 0.5


def test_copies_of_a_sentence():
    copies = toxicity.counterfactuals("A Muslim woman and a blind man")
    assert copies[0] == "a muslim woman and a blind man".split()
    assert "a christian man and a deaf woman".split() in copies and len(copies) == 7
    assert all(len(c) == 7 for c in copies) and len({tuple(c) for c in copies}) == len(copies)
    assert toxicity.counterfactuals("nobody is named") == []


def test_descent_finds_the_least():
    import numpy as np

    a = np.diag([1.0, 10.0, 200.0])
    w = toxicity._descend(lambda w: (float((w - 3) @ a @ (w - 3)) / 2, a @ (w - 3)), np.zeros(3))
    assert np.abs(w - 3).max() < 1e-3


def test_one_class_and_nothing(spark, tables):
    docs, labels = tables
    for only, want in ((0, 0.0), (1, 1.0)):
        found = toxicity.learn(docs, labels.where(f"toxic = {only}"))
        assert [found.score(t) for t in (None, "any")] == [want, want]
    empty = spark.createDataFrame([], DOCS)
    found = toxicity.learn(empty, spark.createDataFrame([], LABELS))
    assert found.score("text") == 0.0 and toxicity.score(empty, found).collect() == []


def test_labels_too_many_for_a_broadcast(tables, model, monkeypatch):
    docs, labels = tables
    monkeypatch.setattr(toxicity, "BROADCAST_ROWS", 0)
    other = toxicity.learn(docs, labels)
    assert set(other.weights) == set(model.weights)
    assert other.score("a grobble sat by the river") == pytest.approx(model.score("a grobble sat by the river"), abs=0.02)
