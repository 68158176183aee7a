"""Digests of heads followed by all numbers (K4), and how many Python workers a task of the masking queries has."""

import hashlib

import numpy as np
import pyarrow as pa

import __spark_entry__ as entry
from scriptorium.functions import random as rnd
from scriptorium.operators import masking


def test_digests_of_all_numbers_equal_hashlib():
    """what the messages of a head share is made once."""
    heads = [b"41:annual:%d:%d:" % (i * 7919 % 10**(i % 6 + 1), i % 40) for i in range(60)]
    heads += [b"", b"x" * 52, b"y" * 54, b"z" * 55, b"u" * 56, b"v" * 62, b"w" * 63, b"s" * 64, b"t" * 130]
    for counts in (np.full(len(heads), 32), np.full(len(heads), 1001), np.arange(len(heads)) % 23, np.zeros(len(heads), int)):
        got = rnd.md5_counted(heads, counts, 2)
        want = [hashlib.md5(h + b"%d" % i).hexdigest()[:16] for h, n in zip(heads, counts.tolist()) for i in range(n)]
        assert [f"{a:08x}{b:08x}" for a, b in got.T.tolist()] == want
    last = rnd.md5_counted([b"k:"], np.array([70_000]))[:, -1]
    assert "".join(f"{w:08x}" for w in last.tolist()) == hashlib.md5(b"k:69999").hexdigest()


def test_the_steps_before_a_number_are_made_once_for_a_head(monkeypatch):
    sizes, run = [], rnd._md5_block
    monkeypatch.setattr(rnd, "_md5_block", lambda state, words, shape: sizes.append([0 if w is None else w.size for w in words]) or run(state, words, shape))
    rnd.md5_counted([b"41:annual:%d:" % i for i in range(100, 200)], np.full(100, 30), 2)
    assert sizes and all(sum(x > 100 for x in block) <= 2 and sum(x == 0 for x in block) >= 9 for block in sizes)


def test_heads_are_made_once_for_a_key():
    keys = pa.array(["a", "a", None, "b", "a"])
    heads, which = rnd.heads_of(keys, 5, "r")
    assert len(heads) == 3 and [heads[i] for i in which] == rnd.keys_as_bytes(keys, 5, "r") == [b"5:r:a:", b"5:r:a:", b"5:r:", b"5:r:b:", b"5:r:a:"]
    assert rnd.keys_as_bytes(pa.array([], pa.string()), 5) == []


def workers_of_a_task(df):
    """The most Python steps that stand in one stage's chain of the plan, and so run at once in a task."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    path, most = [], 0
    for line in lines:
        depth = len(line) - len(line.lstrip(" :+-*()0123456789"))
        path = [(d, n) for d, n in path if d < depth]
        above = path[-1][1] if path else 0
        path.append((depth, 0 if "Exchange" in line else above + ("EvalPython" in line)))
        most = max(most, path[-1][1])
    return most


def some_documents(spark, path):
    text = " ".join(f"Sentence number {'abcdefghij'[i % 10]} has some plain words in it." for i in range(60))
    rows = [(i, text[i:], f"src{i}", "en", len(text) - i) for i in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_a_task_of_the_draws_has_two_python_workers_at_most(spark, tmp_path):
    """masking, vectors and draws ran in one stage, with five workers a task."""
    data = some_documents(spark, tmp_path)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        for query in (entry.q_replace_sampled, entry.q_replace_sampled_multinomial, entry.q_replace_sampled_gumbel):
            assert 0 < workers_of_a_task(query(spark, data)) <= 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_positions_without_a_python_worker(spark):
    df = spark.createDataFrame([(1, [4, 5, None, 4]), (2, []), (3, None), (4, [5])], "k int, ids array<int>")
    got = df.select("k", masking.positions_of(4)("ids").alias("p"))
    assert "EvalPython" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r.k: r.p for r in got.collect()} == {1: [0, 3], 2: [], 3: None, 4: []}
