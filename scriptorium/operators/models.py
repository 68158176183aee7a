"""Model selection and probes on Spark ML (M1-M5) plus attention pooling and
sentence ranking (M6, W6, J3).

The reference fine-tunes a transformer; the user-level question -- "how well
does a classifier do on this labelled text under cross-validated random
search, and how separable are these embeddings" -- is answered with
``pyspark.ml`` estimators, which train distributed over the partitions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest
from pyspark.ml.evaluation import Evaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.random import hash_uniform
from .scores import binary_scores, multiclass_scores, regression_scores


# ---------------------------------------------------------------------------
# M5: trial table
# ---------------------------------------------------------------------------
# Search space of the classifier: (name, kind, low, high, default). Kinds:
# "float" uniform, "log" log-uniform, "int" uniform inclusive, "bool".
DEFAULT_SPACE = (
    ("regParam", "log", 1e-4, 1.0, 0.01),
    ("elasticNetParam", "float", 0.0, 1.0, 0.0),
    ("maxIter", "int", 10, 60, 30),
    ("fitIntercept", "bool", 0, 1, True),
)


def trial_table(spark: SparkSession, space=DEFAULT_SPACE, n_trials: int = 4, seed: int = 0) -> DataFrame:
    """M5: one row per trial; trial 0 holds the defaults, trial t > 0 draws each
    parameter from a seeded hash uniform: float uniform, log-uniform, integer
    uniform on [low, high] inclusive, or a fair boolean."""
    base = spark.range(n_trials).withColumnRenamed("id", "trial_id")
    cols = [F.col("trial_id")]
    for name, kind, lo, hi, default in space:
        u = hash_uniform(seed, F.lit(name), F.col("trial_id"))
        if kind == "float":
            draw = F.lit(float(lo)) + u * float(hi - lo)
        elif kind == "log":
            draw = F.exp(F.lit(math.log(lo)) + u * (math.log(hi) - math.log(lo)))
        elif kind == "int":
            draw = (F.lit(int(lo)) + F.floor(u * (int(hi) - int(lo) + 1))).cast("int")
        else:
            draw = u < 0.5
        cols.append(F.when(F.col("trial_id") == 0, F.lit(default)).otherwise(draw).alias(name))
    return base.select(*cols)


# ---------------------------------------------------------------------------
# M1 / M2: cross-validated random search and final evaluation
# ---------------------------------------------------------------------------
def term_frequencies(df: DataFrame, num_features: int = 1 << 18) -> DataFrame:
    """Stateless featurisation (tokenise + hashed term counts) -> ``_tf``; applied
    once before cross-validation since it learns nothing from the data."""
    tok = RegexTokenizer(inputCol="text", outputCol="_tok", pattern=r"(?U)\W+").transform(df)
    return HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features).transform(tok).drop("_tok")


def _few_partitions(df: DataFrame) -> DataFrame:
    """At most two partitions per core: every step of a fit sends a gradient per partition."""
    return df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism)


def _without_summary(model, spark: SparkSession):
    """The model without its training summary. The summary of a binary model holds the session, and a model travels with
    every task that predicts; a session cannot be serialized once it has observed metrics (``DataFrame.observe``)."""
    if getattr(model, "hasSummary", False):
        model._java_obj.setSummary(spark._jvm.scala.Option.empty())
    return model


class WithoutSummary(Estimator):
    """An estimator whose models carry no training summary."""

    def __init__(self, estimator: Estimator):
        super().__init__()
        self.estimator = estimator

    def copy(self, extra=None) -> "WithoutSummary":
        return WithoutSummary(self.estimator.copy(extra))

    def _fit(self, dataset: DataFrame):
        return _without_summary(self.estimator.fit(dataset), dataset.sparkSession)


class MacroF1(Evaluator):
    """Unweighted mean of the classes' F1 (A6), for Spark ML's model selection."""

    def __init__(self, label: str = "label_d", prediction: str = "prediction"):
        super().__init__()
        self.label, self.prediction = label, prediction

    def _evaluate(self, dataset: DataFrame) -> float:
        pairs = dataset.select(F.col(self.label).alias("label"), F.col(self.prediction).alias("prediction"))
        return float(multiclass_scores(pairs).first()["macro_f1"] or 0.0)

    def isLargerBetter(self) -> bool:
        return True


def _evaluator(num_classes: int):
    """Binary: F1 of the positive class; multiclass: macro F1; 0 classes (regression): R^2."""
    if num_classes == 0:
        return RegressionEvaluator(labelCol="label_d", metricName="r2")
    if num_classes == 2:
        return MulticlassClassificationEvaluator(labelCol="label_d", metricName="fMeasureByLabel", metricLabel=1.0)
    return MacroF1()


def cv_search(train: DataFrame, trials: DataFrame, k: int = 5, num_classes: int = 2, order: str = "row_no",
              parallelism: int = 4, seed: int = 0, estimator=None, num_features: int = 1 << 18,
              index: str | None = None) -> DataFrame:
    """M1: every trial's parameters are scored by k-fold cross-validation with
    contiguous folds in ``order`` (W4) -> ``trial_id, cv_score`` plus the
    parameters. Folds and trials train in parallel (``parallelism``). The trial
    list (bounded by ``n_trials``) is the only thing collected. ``num_classes`` picks
    the score (2: F1 of class 1, more: macro F1, 0: R^2 of a regressor); ``estimator``
    is any Spark ML one on ``features`` and ``label_d`` whose parameters the trials name; ``index``
    a dense row number from 0, where the rows have one (see ``kfold``)."""
    from .ordering import kfold

    folded = kfold(train, k, [order], index=index).withColumn("label_d", F.col("label").cast("double"))
    # The k x trials fits all read this frame: persist it (spills to disk) so the
    # folds, shuffles and tokenisation run once; IDF stays inside the fitted
    # pipeline so every fold learns it from its own training rows only.
    folded = _few_partitions(term_frequencies(folded, num_features).select("fold", "label_d", "_tf")).persist()
    rows = trials.orderBy("trial_id").collect()
    names = [c for c in trials.columns if c != "trial_id"]
    lr = estimator if estimator is not None else LogisticRegression(featuresCol="features", labelCol="label_d")
    maps = []
    for r in rows:
        pm = {}
        for n in names:
            v = r[n]
            pm[lr.getParam(n)] = int(v) if n == "maxIter" else (bool(v) if n == "fitIntercept" else float(v))
        maps.append(pm)
    pipe = Pipeline(stages=[IDF(inputCol="_tf", outputCol="features"), WithoutSummary(lr)])
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=maps, evaluator=_evaluator(num_classes),
                        foldCol="fold", parallelism=parallelism, seed=seed)
    try:
        model = cv.fit(folded)
    finally:
        folded.unpersist()
    spark = train.sparkSession
    scores = spark.createDataFrame([(int(r["trial_id"]), float(m)) for r, m in zip(rows, model.avgMetrics)],
                                   "trial_id long, cv_score double")
    return trials.join(scores, "trial_id")


def final_evaluation(train: DataFrame, test: DataFrame, best: dict, num_classes: int = 2, estimator=None,
                     num_features: int = 1 << 18) -> DataFrame:
    """M2: refit on the whole train part with the best parameters, score the train
    and test parts (A5; A6 for more classes, A7 for 0 = regression) -> one row per part.
    The featurised parts are persisted for the fit and the scoring and released before
    returning the two rows."""
    lr = estimator if estimator is not None else LogisticRegression(featuresCol="features", labelCol="label_d")
    for n, v in best.items():
        if n == "trial_id" or not lr.hasParam(n):
            continue
        lr = lr.setParams(**{n: int(v) if n == "maxIter" else (bool(v) if n == "fitIntercept" else float(v))})
    pipe = Pipeline(stages=[IDF(inputCol="_tf", outputCol="features"), WithoutSummary(lr)])
    tr = train.withColumn("label_d", F.col("label").cast("double")).withColumn("split", F.lit("train"))
    te = test.withColumn("label_d", F.col("label").cast("double")).withColumn("split", F.lit("test"))
    both = term_frequencies(tr.unionByName(te), num_features).select("split", "label_d", "label", "_tf").persist()
    try:
        model = pipe.fit(both.where(F.col("split") == "train"))
        pred = model.transform(both)
        if num_classes == 0:
            scores = regression_scores(pred, by=["split"])
        else:
            pred = pred.withColumn("prediction", F.col("prediction").cast("int"))
            scores = binary_scores(pred, by=["split"]) if num_classes == 2 else multiclass_scores(pred, by=["split"])
        rows = scores.collect()  # one row per part
    finally:
        both.unpersist()
    return train.sparkSession.createDataFrame(rows, scores.schema)


# ---------------------------------------------------------------------------
# M1 with a score per epoch and early stopping
# ---------------------------------------------------------------------------
METRIC_SCHEMA = "trial_id long, fold int, run_id string, step long, loss double, score double"


# Rows whose gradients are averaged before the blocks are, as Spark ML's perceptron does (its ``blockSize``).
BLOCK_ROWS = 128


class _Terms:
    """Rows of an Arrow batch (``indices``, ``values``, ``label``) as flat arrays; the features stay sparse."""

    def __init__(self, batch: pa.Table):
        indices, values = (batch.column(c).combine_chunks() for c in ("indices", "values"))
        self.n = batch.num_rows
        self.rows = np.repeat(np.arange(self.n), np.diff(indices.offsets.to_numpy()))
        self.at = indices.flatten().to_numpy(zero_copy_only=False)
        self.x = values.flatten().to_numpy(zero_copy_only=False)
        if batch.column("label").null_count:
            raise ValueError("a label is null")
        self.label = batch.column("label").to_numpy().astype(np.int64)

    def probabilities(self, weights: np.ndarray, num_features: int, n_classes: int) -> np.ndarray:
        w, bias = weights[: num_features * n_classes].reshape(num_features, n_classes), weights[num_features * n_classes :]
        z = np.stack([np.bincount(self.rows, self.x * w[self.at, c], self.n) for c in range(n_classes)], axis=1) + bias
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def gradient(self, weights: np.ndarray, num_features: int, n_classes: int, share: float) -> np.ndarray:
        """Of the cross entropy, ``share`` of it for every row."""
        delta = self.probabilities(weights, num_features, n_classes)
        delta[np.arange(self.n), self.label] -= 1.0
        delta *= share
        slope = np.stack([np.bincount(self.at, self.x * delta[self.rows, c], num_features) for c in range(n_classes)], axis=1)
        return np.concatenate([slope.ravel(), delta.sum(axis=0)])


def _gradients(weights: np.ndarray, num_features: int, n_classes: int):
    """Rows of a partition -> one row: the sum of its blocks' mean gradients, and the number of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, blocks, held = np.zeros(len(weights)), 0, None
        for b in batches:
            rows = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            full = rows.num_rows - rows.num_rows % BLOCK_ROWS
            for a in range(0, full, 8 * BLOCK_ROWS):
                part = rows.slice(a, min(8 * BLOCK_ROWS, full - a))
                total += _Terms(part).gradient(weights, num_features, n_classes, 1.0 / BLOCK_ROWS)
            blocks, held = blocks + full // BLOCK_ROWS, rows.slice(full)
        if held is not None and held.num_rows:
            total += _Terms(held).gradient(weights, num_features, n_classes, 1.0 / held.num_rows)
            blocks += 1
        if blocks:
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([total], kind), pa.array([blocks], pa.int64())], ["total", "blocks"])

    return run


def _scored(weights: np.ndarray, num_features: int, n_classes: int):
    """Rows -> probability of the label, label, prediction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = _Terms(pa.Table.from_batches([b]))
            p = rows.probabilities(weights, num_features, n_classes)
            columns = [p[np.arange(rows.n), rows.label], rows.label.astype(np.int32), p.argmax(axis=1).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["p", "label", "prediction"])

    return run


def _first_weights(spark: SparkSession, num_features: int, n_classes: int, seed: int) -> np.ndarray:
    """The weights that Spark ML's perceptron of one layer starts from: a fit of no steps."""
    one = spark.createDataFrame([(Vectors.sparse(num_features, []), float(c)) for c in range(n_classes)], ["features", "label_d"])
    net = MultilayerPerceptronClassifier(layers=[num_features, n_classes], featuresCol="features", labelCol="label_d",
                                         solver="gd", maxIter=0, seed=seed)
    return net.fit(one).weights.toArray()


def _epochs_of_fold(folded: DataFrame, fold: int, trial: int, n_classes: int, num_features: int, n_epochs: int, patience: int,
                    steps_per_epoch: int, step_size: float, first: np.ndarray) -> list[tuple]:
    """Train on the other folds epoch by epoch, each from the weights of the one before; (.., epoch, validation loss, score) rows.

    A layer from the features to the classes with a softmax on top is multinomial logistic regression, by gradient
    descent as Spark ML's perceptron does it, which however holds every row as a dense vector. Here the features stay
    sparse; a step brings one gradient per partition to the driver. Training ends where the early-stopping rule does
    (W7, no delta), so the rows are those of the epochs that were trained."""
    columns = ["indices", "values", F.col("label_d").cast("int").alias("label")]
    train, valid = (folded.where(c).select(*columns) for c in (F.col("fold") != fold, F.col("fold") == fold))
    weights, rows, best, waited = first, [], None, 0
    for epoch in range(1, n_epochs + 1):
        for _ in range(steps_per_epoch):
            parts = train.mapInArrow(_gradients(weights, num_features, n_classes), "total array<double>, blocks long").collect()
            if parts:
                weights = weights - step_size * np.sum([p["total"] for p in parts], axis=0) / sum(p["blocks"] for p in parts)
        pred = valid.mapInArrow(_scored(weights, num_features, n_classes), "p double, label int, prediction int")
        one = (binary_scores(pred) if n_classes == 2 else multiclass_scores(pred)).select(
            F.col("f1" if n_classes == 2 else "macro_f1").alias("score"))
        loss = pred.agg(F.avg(-F.log(F.greatest("p", F.lit(1e-15))))).first()[0]
        rows.append((trial, fold, f"{trial}:{fold}", epoch, float(loss), float(one.first()["score"])))
        if best is None or -loss >= best:
            best, waited = -loss, 0
        else:
            waited += 1
            if waited >= patience:
                break
    return rows


def cv_epochs(train: DataFrame, trials: DataFrame, k: int = 5, num_classes: int = 2, n_epochs: int = 10, patience: int = 3,
              order: str = "row_no", num_features: int = 1 << 12, steps_per_epoch: int = 5, parallelism: int = 4, seed: int = 0,
              index: str | None = None) -> DataFrame:
    """M1 as the reference trains: for every trial (``trial_id, step_size``) and contiguous fold a warm-started run of at most
    ``n_epochs`` epochs -> the metric table ``trial_id, fold, run_id, step, loss, score`` with a row per epoch.

    ``loss`` is the mean negative log probability of the validation fold, ``score`` its F1 (macro F1 for more classes).
    Feed it to ``early_stopping`` and ``selected_epoch_score`` (``selected_cv_scores`` does). Only the rows of the
    table, at most trials x folds x epochs, reach the driver; the fits run on Spark, folds side by side. A fold without
    rows has no run. ``index``: a dense row number from 0, where the rows have one (see ``kfold``)."""
    from .ordering import kfold

    folded = kfold(train, k, [order], index=index).withColumn("label_d", F.col("label").cast("double"))
    terms = F.unwrap_udt("_tf")
    folded = _few_partitions(term_frequencies(folded, num_features).select("fold", "label_d", terms["indices"].alias("indices"),
                                                                           terms["values"].alias("values"))).persist()
    first = _first_weights(train.sparkSession, num_features, num_classes, seed)
    try:
        folds = [r["fold"] for r in folded.select("fold").distinct().orderBy("fold").collect()]
        jobs = [(t["trial_id"], f, float(t["step_size"])) for t in trials.orderBy("trial_id").collect() for f in folds]
        with ThreadPool(parallelism) as pool:
            done = pool.map(lambda j: _epochs_of_fold(folded, j[1], j[0], num_classes, num_features, n_epochs, patience, steps_per_epoch, j[2], first), jobs)
    finally:
        folded.unpersist()
    return train.sparkSession.createDataFrame([row for rows in done for row in rows], METRIC_SCHEMA)


def selected_cv_scores(metrics: DataFrame, patience: int = 3) -> DataFrame:
    """W7 + W8 over a metric table of ``cv_epochs``: ``trial_id, fold, stop_step, selected_step, score`` of every run."""
    from .runs import early_stopping, selected_epoch_score

    stops = early_stopping(metrics, "loss", patience, 0.0, "min")
    chosen = selected_epoch_score(metrics, stops)
    runs = metrics.select("run_id", "trial_id", "fold").distinct()
    return runs.join(chosen, "run_id").join(stops.select("run_id", "stop_step"), "run_id").select(
        "trial_id", "fold", "stop_step", "selected_step", "score")


# ---------------------------------------------------------------------------
# M3 / M4: separability probes on frozen embeddings
# ---------------------------------------------------------------------------
def _vectors(emb: DataFrame, col: str = "embedding") -> DataFrame:
    return emb.select(array_to_vector(F.col(col)).alias("features"), F.col("label").cast("double").alias("label_d"))


def linear_separability(emb: DataFrame, max_iter: int = 100) -> DataFrame:
    """M3: multinomial logistic regression trained and scored on the same data
    -> ``n, accuracy``."""
    data = _vectors(emb)
    model = LogisticRegression(featuresCol="features", labelCol="label_d", maxIter=max_iter, family="multinomial").fit(data)
    pred = model.transform(data)
    return pred.agg(F.count(F.lit(1)).alias("n"),
                    F.avg((F.col("prediction") == F.col("label_d")).cast("double")).alias("accuracy"))


def svm_separability(emb: DataFrame, max_iter: int = 50) -> DataFrame:
    """M4: one-vs-rest linear SVM trained and scored on the same data."""
    data = _vectors(emb)
    model = OneVsRest(classifier=LinearSVC(maxIter=max_iter), featuresCol="features", labelCol="label_d").fit(data)
    for one in model.models:
        _without_summary(one, emb.sparkSession)
    pred = model.transform(data)
    return pred.agg(F.count(F.lit(1)).alias("n"),
                    F.avg((F.col("prediction") == F.col("label_d")).cast("double")).alias("accuracy"))


# ---------------------------------------------------------------------------
# Attention pooling and sentence ranking
# ---------------------------------------------------------------------------
def attention_pool(seq_vectors: DataFrame, max_sequences: int, dim: int, doc: str = "doc_id",
                   idx: str = "seq_idx", vec: str = "embedding") -> DataFrame:
    """M6 with identity projections: per document take the first ``max_sequences``
    sequence vectors; every one of the ``max_sequences`` query slots (padded
    slots are zero vectors) attends over the *real* keys with softmax of
    ``q.k / sqrt(dim)``; the document vector is the mean over *all* slots.

    Per document the group holds at most ``max_sequences`` vectors, so the attention is one small
    matrix product per row, made in numpy a batch of documents at a time (no pair rows; nested array
    functions would evaluate the softmax sums anew for every element). Returns
    ``doc_id, n_sequences, key_weights`` (column sums of the attention matrix,
    used by W6) and ``doc_vector``."""
    kept = seq_vectors.where(F.col(idx) < max_sequences) \
        .select(doc, idx, F.transform(vec, lambda x: x.cast("double")).alias("_x"))
    g = kept.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(idx).alias("i"), F.col("_x").alias("x"))))
                              .alias("_s"))
    g = g.select(doc, F.size("_s").alias("n_sequences"), F.flatten(F.transform("_s", lambda e: e["x"])).alias("_v"))
    pooled = g.withColumn("_p", _attention(max_sequences, dim)(F.col("_v")))
    return pooled.select(doc, "n_sequences", F.col("_p.key_weights").alias("key_weights"), F.col("_p.doc_vector").alias("doc_vector"))


def _attention(max_sequences: int, dim: int):
    """UDF: the joined key vectors of a document -> struct(key_weights, doc_vector)."""

    @F.arrow_udf("struct<key_weights: array<double>, doc_vector: array<double>>")
    def attend(vectors: pa.Array) -> pa.Array:
        out = []
        for v in vectors:
            keys = v.values.to_numpy(zero_copy_only=False).reshape(-1, dim)
            queries = np.zeros((max_sequences, dim))
            queries[: len(keys)] = keys  # padded slots are zero vectors
            scores = queries @ keys.T / math.sqrt(dim)
            e = np.exp(scores - scores.max(axis=1, keepdims=True))
            weights = (e / e.sum(axis=1, keepdims=True)).sum(axis=0)
            out.append({"key_weights": weights, "doc_vector": weights @ keys / max_sequences})
        kind = pa.list_(pa.float64())
        return pa.array(out, pa.struct([("key_weights", kind), ("doc_vector", kind)]))

    return attend


def rank_sentences(pooled: DataFrame, sentences: DataFrame, doc: str = "doc_id", idx: str = "seq_idx") -> DataFrame:
    """W6 + J3: rank a document's real sentences by the attention they receive
    (sum over queries, descending; padded slots are not ranked) and attach the
    sentence text by an equi-join on ``(doc_id, seq_idx)``. The rank window is
    per document, whose size is bounded by ``max_sequences``."""
    keys = pooled.select(doc, F.posexplode("key_weights").alias(idx, "weight"))
    w = Window.partitionBy(doc).orderBy(F.desc("weight"), idx)
    ranked = keys.withColumn("rank", F.row_number().over(w).cast("long"))
    return ranked.join(sentences.select(doc, F.col(idx).cast("int").alias(idx), "sentence"), [doc, idx])
