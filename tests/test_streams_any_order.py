"""ST1 with the bounded distinct scan, ST2 with rows in any order."""

import random
import uuid

from pyspark.sql import functions as F

from scriptorium.operators import chunking as ch
from scriptorium.operators import runs
from scriptorium.streaming.chunk_stream import Distinct, first_texts, start_chunk_stream
from scriptorium.streaming.early_stop_stream import latest_status, start_early_stopping


def metrics(n_runs=4, steps=25):
    r = random.Random(3)
    return [(f"r{k}", s, round(r.random() * (3 if k % 2 else 1) + (10 / s), 3), 1_700_000_000 + 60 * s) for k in range(n_runs) for s in range(1, steps + 1)]


def run_stream(spark, tmp_path, batches, **rule):
    schema = "run_id string, step long, loss double, ts timestamp"
    name = uuid.uuid4().hex
    for b in batches:
        rows = spark.createDataFrame([(k, s, v) for k, s, v, _ in b], "run_id string, step long, loss double")
        times = spark.createDataFrame([(k, s, t) for k, s, _, t in b], "run_id string, step long, t long")
        rows.join(times, ["run_id", "step"]).select("run_id", "step", "loss", F.timestamp_seconds("t").alias("ts")).coalesce(1) \
            .write.mode("append").parquet(str(tmp_path / f"in{name}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / f"in{name}"))
    q = start_early_stopping(stream, str(tmp_path / f"out{name}"), str(tmp_path / f"ck{name}"), **rule)
    q.awaitTermination()
    dropped = sum(s["numRowsDroppedByWatermark"] for p in q.recentProgress for s in p["stateOperators"])
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress]
    rows = latest_status(spark.read.parquet(str(tmp_path / f"out{name}"))).collect()
    return {r.run_id: r for r in rows}, dropped, kept


def test_any_arrival_order_gives_the_batch_answer(spark, tmp_path):
    rows = metrics()
    table = spark.createDataFrame([r[:3] for r in rows], "run_id string, step long, loss double")
    for seed, (mode, delta) in enumerate([("min", 0.0), ("max", 0.05)]):
        want = {r.run_id: r for r in runs.early_stopping(table, "loss", 3, delta, mode).collect()}
        mixed = list(rows)
        random.Random(seed).shuffle(mixed)
        got, dropped, _ = run_stream(spark, tmp_path, [mixed[i::4] for i in range(4)], metric="loss", patience=3, delta=delta, mode=mode, delay="2 hours")
        assert {k: (r.best_step, r.best_value, r.stop_step) for k, r in got.items()} == {k: (r.best_step, r.best_value, r.stop_step) for k, r in want.items()}
        assert dropped == 0 and all(r.n_rows == 25 and r.n_dropped == 0 for r in got.values())


def test_steps_behind_the_watermark_are_folded_and_late_rows_counted(spark, tmp_path):
    rows = metrics(2, 40)
    early, late = [r for r in rows if r[1] != 2], [r for r in rows if r[1] == 2]
    batches = [[r for r in early if lo <= r[1] < lo + 10] for lo in range(1, 41, 10)] + [late]
    got, dropped, kept = run_stream(spark, tmp_path, batches, metric="loss", patience=3, delta=0.0, mode="min", delay="1 minute")
    table = spark.createDataFrame([r[:3] for r in early], "run_id string, step long, loss double")
    want = {r.run_id: r for r in runs.early_stopping(table, "loss", 3, 0.0, "min").collect()}
    assert {k: (r.best_step, r.stop_step, r.n_rows) for k, r in got.items()} == {k: (r.best_step, r.stop_step, 39) for k, r in want.items()}
    assert dropped + sum(r.n_dropped for r in got.values()) == len(late)
    assert max(kept) < 39 * 2  # the map holds the steps of the delay, not the history


def documents(spark):
    texts = ["\n".join(f"speaker {i % 6}: line {j} of the call number {i % 6}." for j in range(7)) for i in range(24)]
    rows = [(i, "calls" if i % 2 else "news", None, None if i in (9, 11) else texts[i], 1_700_000_000 + 600 * i) for i in range(24)]
    return spark.createDataFrame(rows, "doc_id long, source string, doc_type string, text string, t long").withColumn("seen", F.timestamp_seconds("t")).drop("t")


def test_chunk_stream_with_distinct_scan_equals_the_batch_job(spark, tmp_path):
    docs = documents(spark)
    profiles = {"calls": ch.ChunkProfile(None, None, None), "news": ch.ChunkProfile(None, None, None)}
    for lo in range(0, 24, 6):
        docs.where((F.col("doc_id") >= lo) & (F.col("doc_id") < lo + 6)).write.mode("append").parquet(str(tmp_path / "in"))
    q = start_chunk_stream(spark, str(tmp_path / "in"), docs.schema, str(tmp_path / "out"), str(tmp_path / "ck"), profiles=profiles, chunk_words=200,
                           max_files_per_trigger=1, distinct=Distinct("seen", "1 second", 10**6))
    q.awaitTermination()
    want = ch.chunk_corpus(docs, profiles, 200)
    got = spark.read.parquet(str(tmp_path / "out")).select(*want.columns)
    assert sorted(got.collect()) == sorted(want.collect()) and want.where("source = 'calls'").count() > 0


def test_a_text_is_forgotten_after_its_time(spark, tmp_path):
    docs = documents(spark).where("source = 'calls'")
    # One file per document, ten minutes apart; call i comes again an hour later.
    for i in range(1, 24, 2):
        docs.where(F.col("doc_id") == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = {}
    for seconds in (600, 10**6):
        stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = (first_texts(stream, Distinct("seen", "0 seconds", seconds)).writeStream.format("parquet").option("path", str(tmp_path / f"o{seconds}"))
             .option("checkpointLocation", str(tmp_path / f"c{seconds}")).trigger(availableNow=True).start())
        q.awaitTermination()
        out[seconds] = sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / f"o{seconds}")).collect())
    assert out[10**6] == sorted(r.doc_id for r in docs.groupBy("text").agg(F.min("doc_id").alias("doc_id")).collect())
    assert set(out[10**6]) < set(out[600])


def test_state_is_written_once_per_run_and_trigger():
    """a state call and a timer per row is a round trip to the JVM per row."""
    import pandas as pd

    from scriptorium.streaming.early_stop_stream import StopProcessor

    class State:
        def __init__(self):
            self.held, self.calls = [], 0

        def exists(self):
            return bool(self.held)

        def get(self):
            return self.held if not self.held or isinstance(self.held, tuple) else iter(self.held)

        def update(self, row):
            self.calls, self.held = self.calls + 1, row

        def appendList(self, rows):
            self.calls, self.held = self.calls + 1, self.held + rows

        def put(self, rows):
            self.calls, self.held = self.calls + 1, list(rows)

        def clear(self):
            self.calls, self.held = self.calls + 1, []

    class Handle:
        def __init__(self):
            self.timers, self.states = [], {}

        def getValueState(self, name, schema):
            return self.states.setdefault(name, State())

        getListState = getValueState

        def registerTimer(self, at):
            self.timers.append(at)

    class Timer:
        def getExpiryTimeInMs(self):
            return 499

    handle, one = Handle(), StopProcessor(3, 0.0, "min")
    one.init(handle)
    rows = pd.DataFrame({"step": range(1, 1001), "value": [float(2000 - i) for i in range(1000)], "at": range(1000)})
    (status,) = one.handleInputRows(("r",), iter([rows]), None)
    assert status["best_step"][0] == 1000 and status["n_rows"][0] == 1000
    assert len(handle.timers) == 1 and sum(s.calls for s in handle.states.values()) == 2
    assert list(one.handleExpiredTimer(("r",), None, Timer())) == []
    assert len(handle.states["pending"].held) == 500 and handle.states["folded"].held[5] == 500
