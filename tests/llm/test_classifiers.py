import zlib

import numpy as np
import pytest

from tablewright.llm import quality_classifier as quality_module
from tablewright.llm import toxicity as toxicity_module
from tablewright.llm.quality_classifier import BUCKETS, co_train, logistic, platt, quality, weigh
from tablewright.llm.toxicity import clean_documents, fit, score, toxicity, train

DATA = "/root/testdata/sf0.01"


def corpus(spark, n=600, seed=0):
    """Every sixth document has bad words; those, and only those, are toxic."""
    rng = np.random.default_rng(seed)
    words, bad = [f"w{i}" for i in range(400)], ["vile", "scummy", "rotten"]
    docs, labels = [], []
    for i in range(n):
        text = list(rng.choice(words, rng.integers(20, 60)))
        if i % 6 == 0:
            text[3], text[7] = rng.choice(bad, 2)
        docs.append((i, " ".join(text), "en", f"s{i % 3}"))
        if i // 6 % 2 == 0:
            labels.append((i, int(i % 6 != 0), int(i % 6 == 0)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_toxicity_of_held_out_documents(spark):
    docs, labels = corpus(spark, 1500)
    out = toxicity(docs, labels).collect()
    assert len(out) == 1500 and all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    right = [r["predicted"] == (r["doc_id"] % 6 == 0) for r in out if r["held_out"]]
    assert np.mean(right) > 0.97
    again = toxicity(docs.repartition(5), labels.repartition(3)).collect()
    assert {r["doc_id"]: r["score"] for r in again} == {r["doc_id"]: r["score"] for r in out}


def test_held_out_toxic_and_clean_documents_apart(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    found = toxicity(docs, labels).filter("held_out").join(labels.select("doc_id", "toxic"), "doc_id")
    n = {(r["toxic"], r["predicted"]): r["count"] for r in found.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] >= 0.9 * (n[1, 1] + n[1, 0])
    assert n[0, 1] <= 0.01 * (n[0, 1] + n[0, 0])


def test_repeated_ids_do_not_exceed_the_samples(spark, monkeypatch):
    docs, labels = corpus(spark, 120)
    many = docs.unionByName(spark.range(400).selectExpr("6L as doc_id", "concat('vile ', id) as text", "'en' as lang", "'s0' as source"))
    seen = []
    monkeypatch.setattr(toxicity_module, "fit", lambda tokens, positive, prior: seen.append((len(tokens), int(positive.sum()))) or fit(tokens, positive, prior))
    train(many, labels.union(spark.createDataFrame([(6, 0, 1)], labels.schema)), 50, 20)
    assert seen == [(31, 11)]


def test_scores_come_from_texts_alone(spark):
    docs, labels = corpus(spark)
    model = train(docs, labels)
    other = docs.selectExpr("doc_id + 5000 as doc_id", "text", "'xx' as lang", "'yy' as source")
    a, b = (sorted(r[0] for r in score(d, model, ["doc_id"]).select("score").collect()) for d in (docs, other))
    assert a == b


def test_the_risk_stays_above_zero():
    """Unlabelled texts that are all clean: without the bound the fit would go on below zero."""
    rng = np.random.default_rng(1)
    tokens = [np.unique(rng.integers(0, 200, 30)) for _ in range(300)]
    model = fit([np.append(t, 500) if i < 60 else t for i, t in enumerate(tokens)], np.arange(300) < 60, 0.2)
    assert np.isfinite(model.weights).all() and model.weights[500] > 0


def test_awkward_rows(spark, awkward, clashing, empty):
    docs, labels = corpus(spark, 120)
    model = train(docs, labels)
    assert score(awkward, model, ["doc_id"]).filter("score between 0 and 1").count() == 18
    assert toxicity(awkward, labels.limit(0)).filter("predicted = 0").count() == 18
    assert toxicity(awkward, spark.createDataFrame([(1, 1), (None, 1), (99, None)], "doc_id long, toxic int")).count() == 18
    kept = clean_documents(clashing, spark.createDataFrame([(1, 0), (4, 1), (2, 0)], "doc_id long, toxic int"))
    assert kept.columns == clashing.columns
    assert toxicity(empty, labels).count() == 0 and quality(empty, labels).count() == 0
    assert quality(awkward, labels).count() == 18 and quality(clashing, labels.limit(0)).count() == 18


def test_quality_of_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    out = {r["doc_id"]: r for r in quality(docs, labels).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect() if held(r["doc_id"])}
    assert len(out) == 1000 and np.mean([out[i]["predicted"] == q for i, q in truth.items()]) > 0.9
    scores = [[out[i]["score"] for i, q in truth.items() if q == k] for k in (0, 1)]
    assert np.mean(scores[0]) < 0.5 < np.mean(scores[1])


def test_calibration():
    rng = np.random.default_rng(0)
    z = rng.normal(size=4000)
    labels = (rng.random(4000) < 1 / (1 + np.exp(-(2 * z - 1)))).astype(int)
    assert platt(z, labels) == pytest.approx((2, -1), abs=0.2)


def test_views_are_weighed_by_what_they_tell():
    rng = np.random.default_rng(3)
    labels = rng.integers(0, 2, 4000)
    telling, noise = 3 * (2 * labels - 1) + rng.normal(0, 2, 4000), rng.normal(0, 1, 4000)
    a, b, c = weigh(np.column_stack([telling, noise]), labels)
    assert 1 < a < 2 and b < 0.2 and abs(c) < 0.3
    # The fit is stationary: by finite differences no small change lowers the penalised loss.
    x, start = np.column_stack([telling, -noise, np.ones(4000)]), np.array([0.5, 0.5, 0])
    fit_ = np.array(weigh(x[:, :2], labels))
    loss = lambda w: (np.logaddexp(0, x @ w) - labels * (x @ w)).sum() + ((w - start) ** 2).sum() / 2
    if (fit_[:2] > 0).all():
        assert all(loss(fit_ + d) >= loss(fit_) - 1e-9 for d in 1e-4 * np.concatenate([np.eye(3), -np.eye(3)]))
    separable = weigh(np.column_stack([20.0 * (2 * labels - 1), noise]), labels)
    assert np.isfinite(separable).all()


def test_one_round_of_co_training_by_hand():
    """Each view's surest pool pages, in the classes' proportion, are added to what the other learns from."""
    rng = np.random.default_rng(5)
    truth = rng.integers(0, 2, 300)
    content = [np.unique(rng.integers(0, 40, 8) + 100 * t) for t in truth]
    metadata = [np.unique(rng.integers(0, 30, 4) + 1000 + 15 * t) for t in truth]
    labels = np.where(np.arange(300) < 80, truth, -1)
    model = co_train(content, metadata, labels, rounds=1)
    marked = list(range(80))
    train_rows, share, each = [i for i in marked if i % 4 != 3], truth[:80].mean(), max(2, int(quality_module.GIVEN * 220))
    for own, other, k in ((content, metadata, 1), (metadata, content, 0)):
        w, bias = logistic([own[i] for i in train_rows], truth[train_rows].astype(float))
        sure = sorted(range(80, 300), key=lambda i: bias + w[own[i]].sum() / np.sqrt(len(own[i])))
        bad, good = sure[: int(each * (1 - share))], sure[-int(each * share) :]
        rows = [*train_rows, *bad, *good]
        want = logistic([other[i] for i in rows], np.array([*truth[train_rows], *[0] * len(bad), *[1] * len(good)], float))
        assert np.allclose(model.views[k][0], want[0], atol=1e-6) and model.views[k][1] == pytest.approx(want[1], abs=1e-6)
    assert len(model.views[0][0]) == BUCKETS and len(model.mix) == 3


def test_repeated_ids_do_not_exceed_the_pool(spark, monkeypatch):
    docs, labels = corpus(spark)
    many = docs.unionByName(spark.range(400).selectExpr("7L as doc_id", "concat('some ', id) as text", "'en' as lang", "'s0' as source"))
    seen = []
    monkeypatch.setattr(quality_module, "co_train", lambda c, m, label: seen.append(len(label)) or co_train(c, m, label))
    quality_module.train(many, labels, 200, 301)
    assert seen == [500]


def test_no_view_alone_is_better_than_both(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    found = quality(docs, labels).filter("held_out").join(labels.filter("quality in (0, 1)").select("doc_id", "quality"), "doc_id").collect()
    right = {c: np.mean([(r[c] >= 0.5) == (r["quality"] == 1) for r in found]) for c in ("content_score", "metadata_score", "score")}
    assert right["score"] >= max(right["content_score"], right["metadata_score"])
