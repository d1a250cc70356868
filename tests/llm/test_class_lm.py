import random

import numpy as np
import pyarrow as pa

import maskwright.llm.class_lm as class_lm
from maskwright.llm.class_lm import Model, exchange, own_words, score_documents, word_classes


def rows_of(spark, spell):
    rng = random.Random(5)
    frequent = [f"f{i:03d}" for i in range(600)]
    rows = []
    for d in range(500):
        words = [w for i in range(12) for w in (frequent[(d * 12 + i) % 600], frequent[(d * 12 + i + 7 * (d % 3)) % 600])]
        words.insert(rng.randrange(len(words)), spell(d % 250))
        rows.append((d, " ".join(words)))
    return spark.createDataFrame(rows, "doc_id long, text string")


def scores(spark, spell, **kw):
    return {r["doc_id"]: (r["n_known"], r["base_score"], r["score"]) for r in score_documents(rows_of(spark, spell), **kw).collect()}


def test_classes_do_not_depend_on_spelling(spark):
    """Words beyond the exchanged ones get their class from their neighbours, whatever they end in."""
    want = scores(spark, lambda i: f"r{i}")
    got = scores(spark, lambda i: f"{i}" + "qwertzuiop"[i % 7] + "asdfghjkl"[i % 9])
    assert want.keys() == got.keys()
    assert all(np.allclose(want[d], got[d]) for d in want)


def test_words_that_are_not_broadcast(spark):
    """Counts and classes that come by shuffle: all tokens of training documents are known, base scores as before."""
    want, got = scores(spark, lambda i: f"r{i}"), scores(spark, lambda i: f"r{i}", broadcast_words=610)
    assert all(np.allclose(want[d][:2], got[d][:2]) and got[d][2] < 0 for d in want)


def test_sizes_grow_and_sweeps_end():
    assert own_words(10**8) > own_words(10**6) > own_words(1000) and word_classes(10**8) > word_classes(10**5)
    items = 42
    pairs = np.random.default_rng(1).integers(0, 30, (items, items))
    of, m = exchange(np.arange(items * items), pairs.ravel(), items, 4)
    onto = np.eye(6)[of]
    assert np.array_equal(m, onto.T @ pairs @ onto) and of[40] == 4 and of[41] == 5 and set(of[:40]) <= {0, 1, 2, 3}


    def likelihood(of):
        m = np.eye(6)[of].T @ pairs @ np.eye(6)[of]
        h = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return h(m) - h(m.sum(0)) - h(m.sum(1))

    for i in range(40):
        for b in range(4):
            moved = of.copy()
            moved[i] = b
            assert likelihood(moved) <= likelihood(of) + 1e-6


def test_probabilities_sum_to_one():
    """Transitions from each class, and emissions of each class with its one unseen word."""
    rng = np.random.default_rng(2)
    counts = [rng.integers(1, 9, k) for k in (5, 3, 1)]
    m = rng.integers(0, 4, (3, 3)).astype(float)
    m *= 1.0
    for c, own in enumerate(counts):  # a class is entered as often as its words stand
        m[:, c] *= own.sum() / max(m[:, c].sum(), 1)
        m[0, c] += own.sum() - m[:, c].sum()
    model = Model(m, np.array([len(own) for own in counts]), 0, 0, 0)
    assert np.allclose((10**model.transition).sum(1), 1)
    for c, own in enumerate(counts):
        assert np.isclose((own + 0.5).sum() / model.emission[c] + 0.5 / model.emission[c], 1)


def test_held_out_texts_gain_from_classes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = score_documents(docs).filter("held_out").selectExpr("sum(score) as s", "sum(base_score) as b", "sum(n_tokens) as n").first()
    assert (r["s"] - r["b"]) / r["n"] > 0.1


def test_words_are_assigned_from_sorted_rows(spark):
    """Each word's best class, whatever batches its rows are dealt to; no lists are collected for it."""
    rng = np.random.default_rng(4)
    m = rng.integers(0, 50, (6, 6)).astype(float)
    near = [(int(h), int(k), int(n)) for h, k, n in zip(rng.integers(-40, 40, 900), rng.integers(0, 12, 900), rng.integers(1, 9, 900))]
    out = class_lm.assigned(spark.createDataFrame(near, "h long, key int, n long"), m)
    assert "collect_list" not in out._jdf.queryExecution().toString()
    own, want = class_lm.context_weights(m), {}
    for h, k, n in near:
        want.setdefault(h, np.zeros(12))[k] += n
    want = {h: (int(x[:6].sum()), int(np.argmax(x @ own))) for h, x in want.items()}
    assert {r["h"]: (r["n"], r["class"]) for r in out.collect()} == want

    class Shared:
        value = own

    rows = pa.table({"h": [r[0] for r in sorted(near)], "key": [r[1] for r in sorted(near)], "n": [r[2] for r in sorted(near)]})
    parts = pa.Table.from_batches(class_lm._assign(Shared)(rows.to_batches(max_chunksize=7))).to_pylist()
    assert {r["h"]: (r["n"], r["class"]) for r in parts} == want and len(parts) == len(want)


def test_words_are_found_by_their_first_bits():
    rng = np.random.default_rng(6)
    for size in (0, 1, 2, 3, 700):
        hashes = np.unique(np.concatenate([rng.integers(0, 2**64, size, np.uint64), np.arange(min(size, 5), dtype=np.uint64), np.array([2**64 - 1] * (size > 1), np.uint64)]))
        words = class_lm.Vocabulary(hashes, np.arange(len(hashes)) + 1, 2)

        class Block:
            pass

        Block.hashes = np.concatenate([hashes, rng.integers(0, 2**64, 50, np.uint64), np.array([0, 9, 2**64 - 1], np.uint64)])
        known = {int(h): k + 1 for k, h in enumerate(hashes)}
        assert words.look(Block)[0].tolist() == [known.get(int(h), -1) for h in Block.hashes]
