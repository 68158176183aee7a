"""A3 exact mode vs brute force, X12/X14, streaming = batch, and the driver entry."""

import collections
import os
import tempfile

from pyspark.sql import functions as F

from scriptorium.operators import runs, vocab
from scriptorium.streaming.early_stop_stream import stream_early_stopping


def brute_vocab(fr, size, minf):
    words = {w: [c if i == 0 else "##" + c for i, c in enumerate(w)] for w in fr}
    toks = list(vocab.SPECIAL_TOKENS)
    for c in sorted({w[0] for w in fr}) + ["##" + c for c in sorted({c for w in fr for c in w[1:]})]:
        if c not in toks:
            toks.append(c)
    while len(toks) < size:
        cnt = collections.Counter()
        for w, sy in words.items():
            for a, b in zip(sy, sy[1:]):
                cnt[(a, b)] += fr[w]
        cands = [(c, pr) for pr, c in cnt.items() if c >= minf]
        if not cands:
            break
        _, (a, b) = min(cands, key=lambda x: (-x[0], x[1]))
        m = a + (b[2:] if b.startswith("##") else b)
        if m not in toks:
            toks.append(m)
        for w, sy in words.items():
            out, fresh = [], False
            for x in sy:
                if out and not fresh and out[-1] == a and x == b:
                    out[-1], fresh = m, True
                else:
                    out.append(x)
                    fresh = False
            words[w] = out
    return toks


def test_learn_vocabulary_exact(spark):
    fr = {"lower": 5, "lowest": 3, "newer": 6, "wider": 3, "new": 2, "low": 7}
    df = spark.createDataFrame(list(fr.items()), "word string, freq long")
    size = 5 + 13 + 12
    got = [r.token for r in vocab.learn_vocabulary(df, size, min_frequency=2).orderBy("token_id").collect()]
    assert got == brute_vocab(fr, size, 2)


def test_wordpiece_and_encode(spark):
    v = {t: i for i, t in enumerate(["[pad]", "[seq]", "[/seq]", "[unk]", "[mask]", "un", "##aff", "##able", "a"])}
    assert vocab.wordpiece_ids("unaffable", v) == [5, 6, 7]
    assert vocab.wordpiece_ids("unknown", v) == [3]
    voc = spark.createDataFrame(list(v.items()), "token string, token_id int")
    df = spark.createDataFrame([("Unaffable a",), ("a",)], "sequence string")
    rows = vocab.encode_sequences(df, voc, 6).select("input_ids", "attention_mask", "token_type_ids").collect()
    assert rows[0].input_ids == [1, 5, 6, 7, 8, 2] and rows[0].attention_mask == [1] * 6
    assert rows[1].input_ids == [1, 8, 2, 0, 0, 0] and rows[1].attention_mask == [1, 1, 1, 0, 0, 0]
    assert rows[1].token_type_ids == [0] * 6


def test_stream_early_stopping_equals_batch(spark):
    rows = [(f"r{r}", s, float(abs((s * 7 + r * 3) % 11 - 5))) for r in range(6) for s in range(1, 31)]
    df = spark.createDataFrame(rows, "run_id string, step long, loss double")
    d = tempfile.mkdtemp(prefix="st2-")
    for lo in range(1, 31, 10):
        df.where((F.col("step") >= lo) & (F.col("step") < lo + 10)).coalesce(1).write.mode("append").parquet(d + "/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(d + "/in")
    q = (stream_early_stopping(stream, "loss", patience=4).writeStream.format("parquet")
         .option("path", d + "/out").option("checkpointLocation", d + "/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    res = spark.read.parquet(d + "/out")
    got = {r.run_id: (r.best_step, r.stop_step) for r in
           res.groupBy("run_id").agg(F.max_by(F.struct("best_step", "stop_step"), "last_step").alias("x"))
           .select("run_id", "x.*").collect()}
    exp = {r.run_id: (r.best_step, r.stop_step) for r in runs.early_stopping(df, "loss", 4).collect()}
    assert got == exp and len(res.select("last_step").distinct().collect()) >= 2


def test_entry_smoke(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() >= 0 and df.columns == ["source", "doc_id", "chunk_id", "sequence"]
    qs, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(qs)


def test_words_are_cut_alike_for_learning_and_encoding(spark):
    from pyspark.sql import functions as F

    text = "x\u00b2 हिन्दी ok"
    df = spark.createDataFrame([(1, text)], "doc_id long, sequence string")
    freqs = vocab.word_frequencies(df, "sequence")
    words = sorted(r.word for r in freqs.collect())
    voc = spark.createDataFrame([(t, i) for i, t in enumerate([*vocab.SPECIAL_TOKENS, *words])], "token string, token_id int")
    ids = vocab.encode_sequences(df, voc, 16).select("input_ids").first().input_ids
    assert vocab.UNK_ID not in ids and len([i for i in ids if i >= 5]) == freqs.agg(F.sum("freq")).first()[0]
