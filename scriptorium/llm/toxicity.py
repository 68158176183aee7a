"""Operator 4: toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary wording of
labelled rows. A window (``window_words`` words with the spaces around them) is
compressed with each; the bytes that the toxic dictionary saves over the ordinary
one are its compression distance. A document's distances, counted by calibrated
thresholds, go through a logistic curve fitted on labelled rows.

The toxic dictionary is trained on windows that tell the classes apart (windows of toxic
rows with a stem, the first letters of a word, that toxic rows hold far more often than
ordinary ones) and ends with the ordinary dictionary's content, as toxic text holds
ordinary wording too; so wording that both classes share costs the same with either and
only what is special to toxic rows makes a distance. Every window is compressed behind a
fixed head that both dictionaries hold: zstandard stores a short input raw when it cannot
shorten it, and the head keeps it from doing so; a tail that neither dictionary holds
follows, as no match is looked for in an input's last eight bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.common import crc_fold, keep, table, whole_text

# Bounds of what is fitted on: labelled rows per class, stems and windows sent to the driver.
SAMPLE_ROWS = 10_000
MAX_STEMS = 20_000
MAX_WINDOWS = 40_000
STEM_CHARS = 5
LEAST_RATIO = 8.0
TOXIC_BYTES, ORDINARY_BYTES = 32_768, 65_536
THRESHOLDS = (1, 2, 3, 4)
NO_EVIDENCE = 0.49
FEATURES = 2 * len(THRESHOLDS) + 1
HEAD = b"|0123456789-compression-distance-9876543210|"
TAIL = b"\x01\x02\x03\x04\x05\x06\x07\x08\x0e\x0f"
WORD = re.compile(r"\w+")
NO_WORD = r"[^\p{L}\p{N}_]+"


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(
        window_log=18, chain_log=17, hash_log=17, search_log=5, min_match=5, target_length=32,
        strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=0, write_checksum=0, write_dict_id=0)
    trained = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    trained.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=trained, compression_params=params)


@dataclass(frozen=True)
class ToxicityModel:
    """Two dictionaries and the weights of the logistic curve."""

    toxic: bytes
    ordinary: bytes
    window_words: int = 1
    weights: tuple[float, ...] = (0.0,) * (FEATURES + 1)


class _Distances:
    """Compression distance of windows; distinct windows are compressed once (the memory is bounded)."""

    def __init__(self, model: ToxicityModel, remembered: int = 400_000):
        self.toxic, self.ordinary = _compressor(model.toxic), _compressor(model.ordinary)
        self.words, self.known, self.remembered = model.window_words, {}, remembered

    def of_text(self, text: str) -> list[int]:
        words = WORD.findall(text.lower())
        n = self.words
        if n > 1:
            words = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
        known, out = self.known, []
        for w in words:
            d = known.get(w)
            if d is None:
                raw = HEAD + f" {w} ".encode("utf-8", "surrogatepass") + TAIL
                d = len(self.ordinary.compress(raw)) - len(self.toxic.compress(raw))
                if len(known) >= self.remembered:
                    known.clear()
                known[w] = d
            out.append(d)
        return out

    def features(self, text: str) -> list[float]:
        """Largest distance, and per threshold log(1 + number) and share of the windows that reach it."""
        d = np.asarray(self.of_text(text), dtype=np.int64)
        if not len(d):
            return [0.0] * FEATURES
        hits = [float((d >= t).sum()) for t in THRESHOLDS]
        return [float(max(d.max(), 0)) / 8.0, *(float(np.log1p(h)) for h in hits), *(10.0 * h / len(d) for h in hits)]


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Newton steps on the ridge-penalised log loss (the intercept is not penalised)."""
    a = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(a.shape[1]), np.full(a.shape[1], ridge * len(x) / 100)
    penalty[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + penalty * w
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def _content(windows: list[tuple[str, int]], size: int) -> bytes:
    """What zstandard's trainer keeps of the windows; all of them when there are too few to train on."""
    samples = [f" {w} ".encode("utf-8", "surrogatepass") for w, n in windows for _ in range(min(n, 8))]
    alone = b"".join(dict.fromkeys(reversed(samples)))
    if len(alone) <= size:
        return alone
    try:
        return zstandard.train_dictionary(size, samples, k=24, d=6, level=19).as_bytes()
    except zstandard.ZstdError:
        return alone[-size:]


def train_toxicity(labelled: DataFrame, text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS,
                   window_words: int = 1) -> ToxicityModel:
    """Fit the model on ``labelled`` (text, label 0/1; rows with another or no label are left out).

    At most about ``sample_rows`` rows of each class are used (a fold of the text's hash; equal texts go
    together). Without rows of both classes every score is the share of toxic rows (0.5 without any).
    """
    rows = keep(labelled.select(whole_text(text).alias("t"), F.col(label).cast("int").alias("y")).where("y in (0, 1)"))
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        share = min(max((n1 + 0.5) / (n0 + n1 + 1), 1e-6), NO_EVIDENCE)
        return ToxicityModel(HEAD, HEAD, window_words, (float(np.log(share / (1 - share))), *[0.0] * FEATURES))
    folds = F.pmod(F.xxhash64("t"), F.lit(1 << 20))
    part = F.when(F.col("y") == 1, min(1.0, sample_rows / n1)).otherwise(min(1.0, sample_rows / n0))
    sample = rows.where(folds < part * (1 << 20))

    words = sample.select(F.xxhash64("t").alias("id"), "y", F.explode(F.array_distinct(F.split(F.lower("t"), NO_WORD))).alias("w")).where("w <> ''")
    stems = words.select("id", "y", F.substring("w", 1, STEM_CHARS).alias("stem")).distinct()
    seen = stems.groupBy("stem").agg(F.sum("y").alias("tox"), F.sum(1 - F.col("y")).alias("ord"))
    ratio = (F.col("tox") / F.lit(float(n1))) / ((F.col("ord") + 1) / F.lit(float(n0)))
    least = F.lit(LEAST_RATIO)
    telling = [r["stem"] for r in seen.where((F.col("tox") >= 4) & (ratio >= least))
               .orderBy(F.desc("tox"), "stem").limit(MAX_STEMS).select("stem").collect()]
    wanted = F.substring("w", 1, STEM_CHARS).isin(telling) if telling else F.lit(False)
    toxic = words.where((F.col("y") == 1) & wanted).groupBy("w").count().orderBy(F.desc("count"), "w").limit(MAX_WINDOWS)
    plain = words.where("y = 0").groupBy("w").count().orderBy(F.desc("count"), "w").limit(MAX_WINDOWS)
    ordinary = _content([tuple(r) for r in plain.collect()], ORDINARY_BYTES) + HEAD
    model = ToxicityModel(_content([tuple(r) for r in toxic.collect()], TOXIC_BYTES) + ordinary, ordinary, window_words)

    kind = T.StructType([T.StructField("y", T.IntegerType()), T.StructField("f", T.ArrayType(T.DoubleType()))])

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = _Distances(model)
        for b in batches:
            yield pd.DataFrame({"y": b["y"], "f": [d.features(t) for t in b["t"]]})

    got = sample.select("t", "y").mapInPandas(measure, kind).toPandas()
    x = np.array(got["f"].tolist(), dtype=float)
    order = np.lexsort(x.T)  # one order, however the rows arrive
    return ToxicityModel(model.toxic, model.ordinary, window_words, _fit_logistic(x[order], got["y"].to_numpy(float)[order]))


def score_toxicity(df: DataFrame, model: ToxicityModel, text: str = "text", score: str = "toxicity") -> DataFrame:
    """``df`` with the double column ``score`` in 0..1 (replaced if there): higher, likelier toxic.

    Whole texts; a null text is scored as an empty one. Equal texts get equal scores. No shuffle.
    """
    w = np.array(model.weights)

    @F.pandas_udf(T.DoubleType())
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        d = _Distances(model)
        for texts in batches:
            x = np.array([d.features(t) for t in texts], dtype=float).reshape(len(texts), FEATURES)
            yield pd.Series(1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30))))

    return df.withColumn(score, scored(whole_text(text)))


def labelled_rows(spark: SparkSession, docs: DataFrame, sf_dir: str, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic) of labelled documents that may be learned from (crc32 fold of five, not 0).

    At most ``sample_rows`` ids of each class, by a hash of the id, go to the texts as a broadcast of
    that bound, so no text is shuffled.
    """
    labels = (table(spark, sf_dir, "labels", "doc_id", "toxic").where(F.col("toxic").isin(0, 1) & (crc_fold("doc_id", 5) != 0))
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    order = [F.xxhash64("doc_id"), "doc_id"]
    some = [labels.where(F.col("toxic") == y).orderBy(*order).limit(sample_rows) for y in (0, 1)]
    return docs.select("doc_id", "text").join(F.broadcast(some[0].union(some[1])), "doc_id").select("text", "toxic")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; learned from the labelled rows outside the held-out fold."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = train_toxicity(labelled_rows(spark, docs, sf_dir))
    return score_toxicity(docs, model, score="score").select(
        "doc_id", (crc_fold("doc_id", 5) == 0).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
