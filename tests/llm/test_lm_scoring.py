import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratus.llm import attention as A
from stratus.llm import lm_scoring as L
from stratus.llm.queries import END_OF_TEXT, vocabulary_path


def small_model(seed=0, n=23, window=6):
    rng = np.random.default_rng(seed)
    tree = A.huffman(rng.integers(0, 50, n))
    params = {k: v.astype(np.float64) for k, v in A.fresh(tree, 5, window, seed).items()}
    params["out"][:, :-1] = rng.standard_normal((n - 1, 5)) * 0.5
    params["near"] = rng.standard_normal((window, 1)) * 0.5
    return A.Model(tree, params), rng


def test_untrained_model_is_the_unigram_model():
    counts = np.array([5, 0, 17, 3, 100, 1])
    model = A.Model(A.huffman(counts), A.fresh(A.huffman(counts), 4, 8))
    wide = np.zeros((1, 8), int)
    wide[0, :6] = np.arange(6)
    counted = np.zeros((1, 8), bool)
    counted[0, :6] = True
    got = model.score(wide, wide, counted, model.tables())
    assert np.allclose(np.exp(got), (counts + 1) / (counts + 1).sum(), atol=1e-5)


def test_probabilities_sum_to_one_and_see_no_future():
    model, rng = small_model()
    inputs = rng.integers(0, 23, (1, 6))
    only = np.zeros((1, 6), bool)
    only[0, 3] = True
    total = 0.0
    for x in range(23):
        targets = np.full((1, 6), x)
        total += math.exp(model.score(inputs, targets, only, model.tables())[0])
    assert total == pytest.approx(1, abs=1e-5)
    other = inputs.copy()
    other[0, 4:] = (other[0, 4:] + 1) % 23
    targets = np.full((1, 6), 7)
    assert model.score(inputs, targets, only, model.tables()) == pytest.approx(model.score(other, targets, only, model.tables()))


def test_gradient_equals_differences():
    model, rng = small_model(3)
    inputs, targets = rng.integers(0, 23, (4, 6)), rng.integers(0, 23, (4, 6))
    scored = rng.random((4, 6)) < 0.7
    scored[:, 0] = True
    _, grads = model.gradient(inputs, targets, scored)
    loss = lambda: -model.score(inputs, targets, scored, model.tables()).sum()
    for name, (rows, g) in grads.items():
        for _ in range(4):
            i, j = rng.integers(len(rows)), rng.integers(g.shape[1])
            table = model.p[name]
            table[rows[i], j] += 1e-4
            up = loss()
            table[rows[i], j] -= 2e-4
            down = loss()
            table[rows[i], j] += 1e-4
            assert g[i, j] == pytest.approx((up - down) / 2e-4, rel=2e-2, abs=2e-2), name


def test_a_step_on_equal_targets_is_the_sum_of_single_steps():
    # Equal targets are taken together; with fewer heavy nodes more of their paths goes step by step.
    heavy, found = A._HEAVY, []
    try:
        for A._HEAVY in (2, 40):
            model, rng = small_model(5)
            states, targets = rng.standard_normal((60, 5)), rng.integers(0, 6, 60)
            d_states, (rows, g) = model._path_gradient(states, targets)
            each = [model._path_gradient(states[i:i + 1], targets[i:i + 1]) for i in range(60)]
            total = np.zeros_like(model.p["out"])
            for _, (r, x) in each:
                total[r] += x
            assert np.allclose(d_states, np.concatenate([x for x, _ in each]))
            assert len(set(rows)) == len(rows) and np.allclose(total[rows], g)
            assert set(rows) == set(np.flatnonzero(total.any(axis=1)))
            found.append((d_states, total))
    finally:
        A._HEAVY = heavy
    assert all(np.allclose(a, b) for a, b in zip(*found))


def test_training_takes_the_loss_only_where_it_is_wanted(monkeypatch):
    model, rng = small_model(7)
    inputs, targets = rng.integers(0, 23, (4, 6)), rng.integers(0, 23, (4, 6))
    scored = np.ones((4, 6), bool)
    loss, grads = model.gradient(inputs, targets, scored)
    assert loss == pytest.approx(-model.score(inputs, targets, scored, model.tables()).sum())
    monkeypatch.setattr(A.Model, "path_scores", None)
    _, again = model.gradient(inputs, targets, scored, with_loss=False)
    assert all((again[k][1] == grads[k][1]).all() for k in grads)
    A.Trainer(model, 0.1).step(inputs, targets, scored)


def test_windows_score_every_place_once():
    lengths = np.array([1, 31, 32, 33, 58, 59, 200])
    doc, first, scores_from = A.windows(lengths)
    for d, n in enumerate(lengths):
        seen = [p for f, s in zip(first[doc == d], scores_from[doc == d]) for p in range(s, min(f + A.WINDOW, n))]
        assert seen == list(range(n))


def brute(rows):
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 if i is not None else True for i, _ in rows}
    counts, words = Counter(), []
    for i, text in rows:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words.append([*re.findall(r"[^\x20\x09-\x0D]+", lowered), None])
        if not held[i]:
            counts.update(words[-1])
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for (i, _), w in zip(rows, words):
        score = sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w)
        out.append((i, held[i], len(w), sum(counts[x] > 0 for x in w), total, round(score, 6)))
    return sorted(out, key=repr)


def base_of(rows):
    return sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows], key=repr)


DOCS = [(i, f"The word{i % 7} and Some more\ttext of {i}\x0b.") for i in range(60)]
DOCS += [(None, "null id word1"), (61, None), (62, ""), (63, " \n\t"), (64, "é ß the THE"), (65, "x" * 5000 + " long " * 4000),
         (7, "again the word1"), (7, "again the word1")]


def test_base_scores_equal_counting(spark, docs_of):
    docs = docs_of(DOCS)
    for c in ("block", "at", "held", "word", "n", "c", "known", "score", "ids"):
        docs = docs.withColumn(c, F.lit("x"))
    rows = L.score(docs, vocabulary_path(), END_OF_TEXT, every=2, block_bytes=700, head=5).collect()
    assert base_of(rows) == brute(DOCS)
    assert all(r.score < 0 for r in rows)
    same = [r.score for r in rows if r.doc_id == 7]
    assert len(same) == 3 and len({round(s, 4) for s in same}) == 2  # its own text and two repeats


def test_no_training_documents_and_no_documents(spark, docs_of):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    rows = [(i, "some text") for i in held]
    assert base_of(L.score(docs_of(rows), vocabulary_path(), END_OF_TEXT).collect()) == brute(rows)
    assert L.score(docs_of([]), vocabulary_path(), END_OF_TEXT).collect() == []


def test_training_helps_held_out_texts(spark, docs_of):
    rng = np.random.default_rng(4)
    words = ["alpha", "beta", "gamma", "delta", "epsilon"]
    rows = [(i, " ".join(words[(s + j) % 5] for j in range(60))) for i, s in enumerate(rng.integers(0, 5, 200))]
    docs = docs_of(rows)

    def total(rounds):
        out = L.score(docs, vocabulary_path(), END_OF_TEXT, rounds=rounds, every=2)
        return out.where("held_out").agg(F.sum("score")).first()[0]
    before, after = total(0), total(2)
    assert after > 0.6 * before  # both negative: at least two fifths of the surprise is gone


def test_every_training_window_is_learnt(spark, docs_of):
    # A word of its own in each window: the rows of all their ids must move.
    words = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    rows = [(i, " ".join(f"{w} the {w}" for w in words[i % 10 * 10:i % 10 * 10 + 10])) for i in range(40)]
    relation = L._relation(docs_of(rows), vocabulary_path(), END_OF_TEXT, L.BLOCK_BYTES)
    tree, params = L.train(relation, END_OF_TEXT)
    moved = (params["embed"] != A.fresh(tree)["embed"]).any(axis=1)
    counts = L._id_counts(relation, END_OF_TEXT)
    assert (counts > 0).sum() > 50
    assert moved[counts > 0].all() and not moved[counts == 0].any()
    sizes = np.array([1, 30, 500, 77])
    held = np.array([False, True, False, False])
    taken = np.concatenate([L._chosen(3, sizes, held, turn, L.TRAIN_EVERY) for turn in range(L.ROUNDS)])
    assert sorted(taken) == np.flatnonzero(~held[A.windows(sizes)[0]]).tolist()


def test_scoring_takes_equal_targets_in_few_products(monkeypatch):
    model, rng = small_model(9, n=600)
    states = np.concatenate([rng.standard_normal((6000, 5)), np.ones((6000, 1))], axis=1)
    targets = rng.integers(0, 600, 6000)
    calls, plain = [], A._softplus
    monkeypatch.setattr(A, "_softplus", lambda x: calls.append(len(x)) or plain(x))
    got = model.path_scores(states, targets)
    assert len(calls) < 30  # not one for each distinct target
    first, nodes, sign = model.paths
    for i in range(0, 6000, 97):
        path = slice(first[targets[i]], first[targets[i] + 1])
        choices = model.p["out"][nodes[path]] @ states[i] * sign[path]
        assert got[i] == pytest.approx(-np.log1p(np.exp(choices)).sum(), abs=1e-6)


def test_words_travel_as_one_value_a_block(spark, docs_of, monkeypatch):
    monkeypatch.setattr(L, "COUNTED", 3)
    rows = [(1, "The the a"), (2, None), (3, " \x0b"), (4, "é the"), (None, "a b"), (5, "")]
    relation = L._relation(docs_of(rows), vocabulary_path(), END_OF_TEXT, 4)
    assert dict(relation.dtypes)["words"] == "binary"
    learnt = Counter(w for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 10 for w in (t or "").lower().split())
    assert {r.word: r.c for r in L._word_counts(relation).collect()} == learnt
