"""Steps that the findings of round 3 asked to make lighter: the same results in less time or memory."""

import random

import numpy as np
from pyspark.sql import functions as F

from scriptorium.llm import maxent_lm as lm
from scriptorium.llm import suffix_dedup as sd


def plain_update(weights, squares, met, rows, cls, prior):
    z = weights[rows[:, 0]] + prior
    for i in range(1, rows.shape[1]):
        z += weights[rows[:, i]]
    z -= z.max(1, keepdims=True)
    z -= np.log(np.exp(z).sum(1, keepdims=True))
    grad = np.exp(z)
    grad[np.arange(len(cls)), cls] -= 1
    for i in range(rows.shape[1]):
        order = np.argsort(rows[:, i], kind="stable")
        r = rows[order, i]
        first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        g = np.add.reduceat(grad[order], first, axis=0)
        r = r[first]
        met[r] += np.diff(np.append(first, len(order)))
        squares[r] += g * g
        weights[r] -= lm.RATE * g / np.sqrt(squares[r] + 1.0)


def test_op6_update_equals_the_plain_step_bit_by_bit():
    rng = np.random.default_rng(7)
    n, n_rows = 9000, 1 << lm.FEATURE_BITS
    rows = rng.integers(0, n_rows, (n, lm.N_FEATURES))
    rows[:, 1] = (rng.pareto(0.7, n) * 40).astype(np.int64) % n_rows  # groups of every length
    rows[:, 2] = n_rows - 1
    cls = rng.integers(0, lm.CLASSES, n)
    prior = np.log(rng.random(lm.CLASSES) + 0.1).astype(np.float32)
    kinds = [[np.zeros((n_rows, lm.CLASSES), np.float32), np.zeros((n_rows, lm.CLASSES), np.float32), np.zeros(n_rows, np.int64)] for _ in range(2)]
    for _ in range(2):
        lm.update(*kinds[0], rows, cls, prior)
        plain_update(*kinds[1], rows, cls, prior)
    for now, before in zip(*kinds):
        assert np.array_equal(now, before)


def test_op6_groups_of_rows_are_reduced_singly_only_when_long(monkeypatch):
    reduced = []

    class Counted:
        def __getattr__(self, name):
            return getattr(np, name)

        class add:
            def __new__(cls, *a, **b):
                return np.add(*a, **b)

            @staticmethod
            def reduceat(x, at, axis=0):
                reduced.append(len(at))
                return np.add.reduceat(x, at, axis=axis)

    monkeypatch.setattr(lm, "np", Counted())
    n_rows = 1 << lm.FEATURE_BITS
    rows = np.repeat(np.arange(1000)[:, None], lm.N_FEATURES, axis=1)
    rows[:20] = 5
    weights, squares = (np.zeros((n_rows, lm.CLASSES), np.float32) for _ in range(2))
    lm.update(weights, squares, np.zeros(n_rows, np.int64), rows, np.zeros(1000, np.int64), np.zeros(lm.CLASSES, np.float32))
    assert sum(reduced) <= lm.N_FEATURES


def test_op10_shards_hold_whole_anchors_and_stay_below_the_limit():
    sizes = [(1, 40), (1, 40), (2, 90), (3, 5), (3, 5), (4, 300), (5, 30), (6, 80)]
    rows = [(a, i, i == 3, bytes(n)) for i, (a, n) in enumerate(sizes)]
    shards = list(sd._shards(iter(rows), 100))
    assert [r for held in shards for r in held] == rows
    assert [[r[0] for r in held] for held in shards] == [[1, 1], [2], [3, 3], [4], [5], [6]]
    assert list(sd._shards(iter([]), 100)) == []


def test_op10_a_segment_that_many_texts_share_is_one_row_of_a_run_and_not_split(spark, monkeypatch):
    rng = random.Random(3)
    passage = "".join(rng.choices("abcdefgh ", k=700))
    docs = [(k, "".join(rng.choices("ijklmnop ", k=500)) + passage + "".join(rng.choices("qrstuvwx ", k=500))) for k in range(120)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    listed = sd._list_segments(frame.select(sd.text_key().alias("text"), F.col("text").cast("binary").alias("t"), F.lit(1).alias("copies")), 400, 64)
    keys = listed.select("anchor", "seg", F.size("texts").alias("n"), F.size("pos").alias("m")).collect()
    assert len(keys) == len({(r.anchor, r.seg) for r in keys}) and max(r.n for r in keys) == 120
    assert all(r.n == r.m for r in keys)

    split, whole = [], sd._split_repeats
    monkeypatch.setattr(sd, "_split_repeats", lambda segs, length: split.append(segs) or whole(segs, length))
    monkeypatch.setattr(sd, "MAX_SHARD", 150_000)  # the occurrences have more bytes, the different segments fewer
    rows = {r.text: r for r in sd.remove_repeats(frame).collect()}
    assert len(rows) == 120 and all(r.n_bytes == 1700 and r.n_removed >= 700 and r.n_spans == 1 for r in rows.values())
    assert split[0].count() == 0
