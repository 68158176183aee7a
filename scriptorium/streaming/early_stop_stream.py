"""ST2: early stopping over a live metrics stream, keyed by run.

``start_early_stopping`` takes rows in any order. Its state per run (``transformWithState``) is the fold over
all steps that the watermark has passed, a few numbers, and a list of the steps that may still get a
predecessor. An event-time timer per run and trigger folds the trigger's rows once the watermark is past them, so the
list holds no more than the watermark's delay and a trigger's span; state and timers are written once per run and
trigger, not once per row. Every trigger gives one status row per run with new rows: the fold carried on over the map in step order, so
the last status of a run (largest ``n_rows``) equals the batch operator W7 over the rows that arrived. Rows behind the
watermark are dropped and counted by Spark (``numRowsDroppedByWatermark`` of the query's progress); a step
that comes when a later one has been folded is counted in ``n_dropped``.

``stream_early_stopping`` is the form for streams without event time whose steps arrive in order:
``applyInPandasWithState`` with the fold alone; a row whose step is not after the last step seen is ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT_SCHEMA = ("run_id string, best_step long, best_value double, stop_step long, last_step long")
STATE_SCHEMA = ("best double, best_step long, best_value double, counter int, stop_step long, last_step long")


def _fold(rows: pd.DataFrame, st: dict, metric: str, patience: int, delta: float, mode: str) -> dict:
    sign = -1.0 if mode == "min" else 1.0
    d = delta if mode == "min" else -delta
    for step, v in zip(rows["step"].tolist(), rows[metric].tolist()):
        if st["last_step"] is not None and step <= st["last_step"]:
            continue
        st["last_step"] = int(step)
        if st["stop_step"] is not None:
            continue
        score = sign * float(v)
        if st["best"] is None:
            st.update(best=score, best_step=int(step), best_value=float(v), counter=0)
        elif score < st["best"] + d:
            st["counter"] += 1
            if st["counter"] >= patience:
                st["stop_step"] = int(step)
        else:
            st.update(best=score, best_step=int(step), best_value=float(v), counter=0)
    return st


def stream_early_stopping(stream: DataFrame, metric: str = "loss", patience: int = 5, delta: float = 0.0,
                          mode: str = "min", run: str = "run_id") -> DataFrame:
    """ST2 on a streaming frame of ``run_id, step, <metric>``; output mode append."""

    def update(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            b, bs, bv, c, ss, ls = state.get
            st = dict(best=b, best_step=bs, best_value=bv, counter=c, stop_step=ss, last_step=ls)
        else:
            st = dict(best=None, best_step=None, best_value=None, counter=0, stop_step=None, last_step=None)
        parts = [p for p in pdfs if len(p)]
        rows = pd.concat(parts).sort_values("step") if parts else pd.DataFrame({"step": [], metric: []})
        st = _fold(rows, st, metric, patience, delta, mode)
        state.update((st["best"], st["best_step"], st["best_value"], st["counter"], st["stop_step"], st["last_step"]))
        yield pd.DataFrame({"run_id": pd.array([key[0]], dtype="string"),
                            "best_step": pd.array([st["best_step"]], dtype="Int64"),
                            "best_value": pd.array([st["best_value"]], dtype="Float64"),
                            "stop_step": pd.array([st["stop_step"]], dtype="Int64"),
                            "last_step": pd.array([st["last_step"]], dtype="Int64")})

    return (stream.select(run, "step", metric).groupBy(run)
            .applyInPandasWithState(update, OUTPUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout))


# ---------------------------------------------------------------------------
# Rows in any order
# ---------------------------------------------------------------------------
STATUS_SCHEMA = "run_id string, best_step long, best_value double, stop_step long, last_step long, n_rows long, n_dropped long"
FOLD_SCHEMA = STATE_SCHEMA + ", n_rows long, n_dropped long"
FOLD_FIELDS = ("best", "best_step", "best_value", "counter", "stop_step", "last_step", "n_rows", "n_dropped")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class StopProcessor(StatefulProcessor):
    """A run's fold over its final steps, and a list of (step, value, event time in ms) of the others; of a step's rows the last one counts."""

    def __init__(self, patience: int, delta: float, mode: str):
        self.rule = (patience, delta, mode)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.folded = handle.getValueState("folded", FOLD_SCHEMA)
        self.pending = handle.getListState("pending", "step long, value double, at long")

    def _fold_of(self) -> dict:
        if self.folded.exists():
            return dict(zip(FOLD_FIELDS, self.folded.get()))
        return dict.fromkeys(FOLD_FIELDS) | {"counter": 0, "n_rows": 0, "n_dropped": 0}

    def _over(self, st: dict, rows: list[tuple[int, float]]) -> dict:
        frame = pd.DataFrame(sorted(rows), columns=["step", "value"])
        return _fold(frame, dict(st), "value", *self.rule)

    def _pending(self) -> dict[int, tuple[float, int]]:
        return {step: (value, at) for step, value, at in self.pending.get()} if self.pending.exists() else {}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        st, new = self._fold_of(), []
        for part in rows:
            for step, value, at in zip(part["step"].tolist(), part["value"].tolist(), part["at"].tolist()):
                if st["last_step"] is not None and step <= st["last_step"]:
                    st["n_dropped"] += 1
                    continue
                st["n_rows"] += 1
                new.append((int(step), float(value), int(at)))
        held = self._pending()
        if new:
            held.update((step, (value, at)) for step, value, at in new)
            self.pending.appendList(new)
            self.handle.registerTimer(max(at for _, _, at in new))
        self.folded.update(tuple(st[f] for f in FOLD_FIELDS))
        now = self._over(st, [(step, value) for step, (value, _) in held.items()])
        yield pd.DataFrame({"run_id": pd.array([key[0]], dtype="string"), "best_value": pd.array([now["best_value"]], dtype="Float64"),
                            **{c: pd.array([now[c]], dtype="Int64") for c in ("best_step", "stop_step", "last_step", "n_rows", "n_dropped")}})[
            ["run_id", "best_step", "best_value", "stop_step", "last_step", "n_rows", "n_dropped"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The watermark has passed a row: it and all rows before it are final."""
        until = expiredTimerInfo.getExpiryTimeInMs()
        held = self._pending()
        final = [(step, value) for step, (value, at) in held.items() if at <= until]
        if final:
            st = self._over(self._fold_of(), final)
            self.folded.update(tuple(st[f] for f in FOLD_FIELDS))
            rest = [(step, value, at) for step, (value, at) in held.items() if at > until]
            if rest:
                self.pending.put(rest)
            else:
                self.pending.clear()
        return iter(())

    def close(self) -> None:
        pass


def early_stopping_statuses(stream: DataFrame, metric: str = "loss", patience: int = 5, delta: float = 0.0, mode: str = "min",
                            run: str = "run_id", event_time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """ST2 for rows in any order (``run_id, step, <metric>, <event time>``; time must not fall while steps
    rise); output mode append. The session needs the RocksDB state store (``start_early_stopping`` sets it)."""
    timed = stream.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, delay)
    rows = timed.select(
        F.col(run).cast("string").alias("run_id"), F.col("step").cast("long").alias("step"), F.col(metric).cast("double").alias("value"),
        (F.unix_micros(F.col(event_time)) / 1000).cast("long").alias("at"), F.col(event_time).alias("_time"))
    return rows.groupBy("run_id").transformWithStateInPandas(
        StopProcessor(patience, delta, mode), outputStructType=STATUS_SCHEMA, outputMode="append", timeMode="eventTime")


def start_early_stopping(stream: DataFrame, output_dir: str, checkpoint_dir: str, **rule) -> StreamingQuery:
    """Start ``early_stopping_statuses`` into Parquet files, with the state store that it needs (set for this query only)."""
    spark, name = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        return (early_stopping_statuses(stream, **rule).writeStream.format("parquet").outputMode("append").option("path", output_dir)
                .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
    finally:
        spark.conf.set(name, before)


def latest_status(statuses: DataFrame) -> DataFrame:
    """The last status of every run."""
    newest = F.struct("n_rows", "n_dropped", "last_step")
    return statuses.groupBy("run_id").agg(F.max_by(F.struct(*[c for c in statuses.columns if c != "run_id"]), newest).alias("s")).select("run_id", "s.*")
