import random
import zlib

import numpy as np

from stratus.llm import quality as Q
from stratus.llm import toxicity as T

LABELS = "doc_id bigint, quality int, toxic int"


def remainder(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


def auc(scores, labels):
    rank = np.argsort(np.argsort(scores, kind="stable"))
    y = np.array(labels)
    return (rank[y == 1].mean() - (y.sum() - 1) / 2) / max((y == 0).sum(), 1)


def held_out_scores(spark, sf, classify, label, fold):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = classify(docs, labels)
    assert rows.count() == docs.count()
    found = rows.join(labels.select("doc_id", label), "doc_id").collect()
    assert all(r.held_out == (remainder(r.doc_id, fold[0]) == fold[1]) and 0 <= r.score <= 1
               and r.predicted == (r.score >= 0.3) for r in found)
    kept = [r for r in found if r.held_out]
    return [r.score for r in kept], [r[label] for r in kept], [r.predicted for r in kept]


def test_quality_on_held_out_rows(spark):
    s, y, p = held_out_scores(spark, "/root/testdata/sf0.01", Q.classify, "quality", (5, 0))
    assert auc(s, y) > 0.95 and np.mean(np.array(p) == np.array(y)) > 0.95


def test_toxicity_on_held_out_rows(spark):
    s, y, p = held_out_scores(spark, "/root/testdata/sf0.01", T.classify, "toxic", (4, 2))
    assert auc(s, y) > 0.9


def prose(rng, n):
    return " ".join(rng.choice("river stone wind paper lamp green walk table morning quiet road glass".split()) for _ in range(n)) + "."


def test_odd_rows_and_no_labels(spark, docs_of):
    rng = random.Random(1)
    rows = [(i, prose(rng, 30) if i % 3 else "### $$$ !!! " * 20) for i in range(60)]
    odd = [(None, "text without id"), (100, None), (101, ""), (5, "repeated id"), (102, "word " * 100_000), (103, "\x00\x01  ")]
    docs = docs_of(rows + odd).selectExpr("*", "0.5 AS score", "1 AS label", "2 AS weight", "'x' AS predicted")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 3 == 0)) for i in range(60)] + [(None, 1, 1), (3, None, 7), (4, 0, 0)], LABELS)
    for classify, folds, fold in ((Q.classify, 5, 0), (T.classify, 4, 2)):
        found = classify(docs, labels).collect()
        assert len(found) == len(rows) + len(odd)
        assert all(0 <= r.score <= 1 for r in found)
        assert all(r.held_out for r in found if r.doc_id is None)
        blank = classify(docs, labels.limit(0)).collect()
        assert {round(r.score, 6) for r in blank} == {0.5}
        assert classify(docs_of([]), labels).count() == 0


def test_keep_good_keeps_columns(spark, docs_of):
    rng = random.Random(2)
    docs = docs_of([(i, prose(rng, 40) if i % 4 else "### $$$ !!! " * 20) for i in range(200)])
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 200, 3)], LABELS)
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert all((i in ids) == (i % 4 > 0) for i in range(200))


def test_pu_risk_is_not_driven_negative():
    rng = np.random.default_rng(3)
    good, bad = rng.normal(1, 1, (300, 40)), rng.normal(-1, 1, (100, 40))
    web = np.concatenate([good[:150] + 0.01, bad])
    model = Q.fit_pu(good, web, 0.6)
    assert Q.scores(good, model).mean() > 0.8 and Q.scores(bad, model).mean() < 0.2


def test_unlabelled_risk_takes_in_every_document(spark, docs_of):
    rng = random.Random(5)
    docs = docs_of([(i, prose(rng, 20 + i % 30) if i % 50 else "### $$$ !!! " * 20) for i in range(2000)])
    labels = spark.createDataFrame([(i, int(i % 50 > 0), 0) for i in range(0, 2000, 5)], LABELS)
    few, every = Q.train(docs, labels, max_unlabelled=200), Q.train(docs, labels)
    for part in ("mean", "spread"):
        assert np.allclose(few[part], every[part], atol=1e-6)
    rows = np.array([r.x for r in docs.select(Q._feature_column(docs["text"]).alias("x")).collect()], float)
    assert np.abs(Q.scores(rows, few) - Q.scores(rows, every)).max() < 0.02


def test_counterfactual_pairs_swap_one_term():
    pairs = list(T.counterfactual_pairs("Women walk home. Nothing here! Jewish and blind readers"))
    assert all(a != b for a, b in pairs)
    assert ("women walk home", "people walk home") in pairs
    assert {a for a, _ in pairs} == {"women walk home", " jewish and blind readers"}
    assert list(T.counterfactual_pairs("")) == []


def test_counterfactual_pairs_swap_with_every_term():
    for terms in T.IDENTITY_TERMS.values():
        swapped = {b for _, b in T.counterfactual_pairs(terms[1] + " walk home")}
        assert swapped >= {term + " walk home" for term in terms if term != terms[1]}
    assert list(T.counterfactual_pairs("a Blue one", {"x": ["red", "blue"]})) == [("a blue one", "a red one")]


def test_penalty_lowers_scores_of_neutral_mentions(spark, docs_of):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        group = rng.random() < (0.7 if toxic else 0.1)
        insult = toxic and rng.random() < 0.8
        rows.append((i, prose(rng, 12) + (" muslims are here." if group else " friends are here.") + (" idiot." if insult else "")))
        labels.append((i, 1, int(toxic)))
    docs, known = docs_of(rows), spark.createDataFrame(labels, LABELS)
    neutral = docs_of([(1000, prose(rng, 12) + " muslims are here."), (1001, prose(rng, 12) + " idiot.")])

    def scores(penalty):
        shared = spark.sparkContext.broadcast(T.train(docs, known, penalty=penalty))
        return [r[0] for r in neutral.orderBy("doc_id").select(T.score_column(neutral["text"], shared)).collect()]
    free, held = scores(0.0), scores(10.0)
    assert held[0] < 0.5 * free[0] and held[1] > 0.8


def test_many_rows_of_one_id_stay_within_the_sample(spark, monkeypatch):
    rows = [(1, f"row {i} of one document. " * (1 + i % 7)) for i in range(400)]
    rows += [(i, f"text {i}. " * (1 + i % 5)) for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 60)], LABELS)
    seen = []
    fit = Q.fit_pu
    monkeypatch.setattr(Q, "fit_pu", lambda p, u, *a, **k: seen.append((len(p), len(u))) or fit(p, u, *a, **k))
    Q.train(docs, labels, max_positives=5, max_unlabelled=20)
    Q.train(docs, labels, max_positives=50, max_unlabelled=100)
    assert seen[0] == (5, 20) and seen[1][0] <= 50 and seen[1][1] == 59
