"""

``entry(spark)`` runs the flagship corpus chunk job on sf0.001. ``queries()``
``(spark, sf_dir) -> DataFrame``; ``oracle_sql()`` gives the same answer as
DuckDB SQL over the driver's parquet views. Float columns are rounded to 6
decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import chunking as ch
from scriptorium.operators import filters as flt
from scriptorium.operators import labelled
from scriptorium.operators import ordering as od
from scriptorium.operators import masking
from scriptorium.operators import models
from scriptorium.operators import vocab
from scriptorium.operators import runs as runs_ops
from scriptorium.operators import scores
from scriptorium.functions.random import hash_uniform, hash_uniforms
from scriptorium.functions import text as tx
from scriptorium.functions.arrays import posexplode_rows
from scriptorium.session import cut_lineage
from scriptorium.sources import documents as srcdocs
from scriptorium.sources import standins as si

try:  # the training-data operators and their pipeline are an optional part
    import scriptorium.llm.registry as training_data
except ModuleNotFoundError as missing:
    if missing.name != "corpus_pipeline" and not (missing.name or "").startswith("scriptorium.llm"):
        raise
    training_data = None

SF_SMOKE = "/root/testdata/sf0.001"

# Settings used by the registered queries (reference defaults unless noted).
CHUNK_WORDS = ch.DEFAULT_CHUNK_WORDS
# Small trims and a short chunk so that the packer is exercised on every source
# of the test tables (median 19 sentences per document); see FIXTURES.md.
SMALL_PROFILES = {
    "annual": ch.ChunkProfile(1, 1, None),
    "current": ch.ChunkProfile(None, None, 0.0),
    "calls": ch.ChunkProfile(1, 1, None),
    "news": ch.ChunkProfile(2, 3, None),
    "reports": ch.ChunkProfile(1, None, None),
}
SMALL_WORDS = 60


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the corpus chunk job over all five sources on sf0.001."""
    return ch.chunk_corpus(si.documents_in(spark, SF_SMOKE))


# ---------------------------------------------------------------------------
# Spark queries
# ---------------------------------------------------------------------------
def _docs(spark, sf):
    return si.documents_in(spark, sf)


def _r6(c):
    return F.round(c, 6)


def q_chunk_corpus(spark, sf):
    return ch.chunk_corpus(_docs(spark, sf))


def q_chunk_corpus_small(spark, sf):
    return ch.chunk_corpus(_docs(spark, sf), SMALL_PROFILES, chunk_words=SMALL_WORDS)


def q_scan_source(spark, sf):
    return srcdocs.scan_source(_docs(spark, sf)).select("doc_id", "source", "text")


def q_scan_distinct(spark, sf):
    return srcdocs.scan_distinct(_docs(spark, sf).where(F.col("source") == "calls")).select("doc_id", "text")


def q_count_documents(spark, sf):
    return srcdocs.count_documents(_docs(spark, sf))



def _calls(spark, sf):
    return _docs(spark, sf).where(F.col("source") == "calls")


def q_scan_page(spark, sf):
    return srcdocs.scan_page(_docs(spark, sf), limit=300, offset=100, order_by="doc_id")


def q_corpus_union(spark, sf):
    return srcdocs.corpus_union_by_source(_docs(spark, sf))


def q_preview_sources(spark, sf):
    return srcdocs.preview_sources(_docs(spark, sf), n=5).select("source", "doc_id", "row_no")


def q_count_sequences(spark, sf):
    return srcdocs.count_sequences(q_chunk_corpus_small(spark, sf))


def q_filter_doc_type(spark, sf):
    return flt.filter_doc_type(_docs(spark, sf).where(F.col("source") == "current")).select("doc_id", "doc_type")


def q_filter_noisy_docs(spark, sf):
    cur = flt.filter_doc_type(_docs(spark, sf).where(F.col("source") == "current"))
    return flt.filter_noisy_docs(cur).select("doc_id")


def q_filter_short_transcripts(spark, sf):
    return flt.filter_short_transcripts(_calls(spark, sf)).select("doc_id")


def q_clean_transcripts(spark, sf):
    return flt.clean_transcripts(_calls(spark, sf)).select("doc_id", "text")


def q_clean_transcripts_conversations(spark, sf):
    return flt.clean_transcripts(si.transcripts_from_conversations(spark, sf)).select("doc_id", "text")


def q_clean_reports(spark, sf):
    return flt.clean_reports(_docs(spark, sf).where(F.col("source") == "reports")).select("doc_id", "text")


def q_filter_numeric_sentences(spark, sf):
    rep = _docs(spark, sf).where(F.col("source") == "reports") \
        .select("doc_id", tx.split_sentences(tx.flatten_newlines(F.col("text"))).alias("sentences"))
    kept = flt.filter_numeric_sentences(rep, "sentences")
    return kept.select("doc_id", posexplode_rows("sentences").alias("idx", "sentence"))


def q_filter_noisy_chunks(spark, sf):
    raw = ch.pack_chunks(_docs(spark, sf), SMALL_WORDS, 2, 3)
    return flt.filter_noisy_chunks(raw).select("doc_id", "chunk_id")


def q_trim_sentences(spark, sf):
    d = _docs(spark, sf).select("doc_id", tx.split_sentences(F.col("text")).alias("s"))
    return d.select("doc_id", F.size("s").alias("n_sentences"),
                    F.size(flt.trim_sentences(F.col("s"), 2, 3)).alias("n_kept"))


def q_exclude_nulls(spark, sf):
    return srcdocs.count_documents(flt.exclude_nulls(_docs(spark, sf)))


def q_split_sentences(spark, sf):
    return _docs(spark, sf).select("doc_id", F.posexplode(tx.split_sentences(F.col("text"))).alias("idx", "sentence"))


def q_split_sentences_simple(spark, sf):
    return _docs(spark, sf).select("doc_id",
                                   F.posexplode(tx.split_sentences_simple(F.col("text"))).alias("idx", "sentence"))


def q_word_count(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.word_count(F.col("text")).alias("n_words"))


def q_digit_punct_fraction(spark, sf):
    return _docs(spark, sf).select("doc_id", _r6(tx.digit_punct_fraction(F.col("text"))).alias("share"))


def q_numeric_percentage(spark, sf):
    return _docs(spark, sf).select("doc_id", _r6(tx.numeric_percentage(F.col("text"))).alias("pct"))


def q_flatten_newlines(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.flatten_newlines(F.col("text")).alias("text"))


def q_pack_chunks(spark, sf):
    return ch.pack_chunks(_docs(spark, sf), SMALL_WORDS, 2, 3)


# A page of every source's table.
PAGE_LIMIT, PAGE_OFFSET = 40, 7


def _rounded_report(r):
    return r.withColumn("excluded_fraction", _r6(F.col("excluded_fraction"))) \
        .withColumn("mean_share", _r6(F.col("mean_share")))


def q_chunk_report(spark, sf):
    return _rounded_report(ch.chunk_report(_docs(spark, sf), SMALL_PROFILES, SMALL_WORDS))


def q_chunk_report_page(spark, sf):
    return _rounded_report(ch.chunk_report(_docs(spark, sf), SMALL_PROFILES, SMALL_WORDS, limit=PAGE_LIMIT, offset=PAGE_OFFSET))


def q_chunk_report_written(spark, sf):
    return _rounded_report(ch.write_corpus(_docs(spark, sf), _scratch(spark, "chunks"), SMALL_PROFILES, SMALL_WORDS))


def q_write_corpus_page(spark, sf):
    path = _scratch(spark, "chunks")
    ch.write_corpus(_docs(spark, sf), path, SMALL_PROFILES, SMALL_WORDS, limit=PAGE_LIMIT, offset=PAGE_OFFSET)
    return spark.read.parquet(path).select("source", "doc_id", "chunk_id", "sequence")


def q_corpus_union_sources(spark, sf):
    docs = _docs(spark, sf)
    return srcdocs.corpus_union({name: docs.where(F.col("source") == name) for name in si.SOURCE_NAMES})


def q_scan_page_deep(spark, sf):
    return srcdocs.scan_page(_docs(spark, sf), None, 250).select("doc_id", "source", "doc_type")


def q_document_sequences(spark, sf):
    return ch.document_sequences(si.labelled_in(spark, sf))


# ---- ordering, windows, batches, splits
SHUFFLE_SEED = 7
EPOCH_LIMIT = 300
BATCH_SIZE = 128


def _shuffled(spark, sf):
    # The shuffle reads its rows twice (places and offsets); dealt first, the texts are chunked once for both.
    seqs = q_chunk_corpus_small(spark, sf).select("source", "doc_id", "chunk_id")
    return od.shuffle_sequences(seqs.repartition(_shuffle_partitions(spark), "source", "doc_id", "chunk_id"), SHUFFLE_SEED)


def _shuffled_kept(spark, sf):
    """The shuffled keys as a stored table, for queries whose limits, totals and window read them one after another."""
    return cut_lineage(_shuffled(spark, sf))


def _retrieval(seqs):
    return seqs.select("source").distinct().withColumn("limit", F.lit(EPOCH_LIMIT))


def q_shuffle_sequences(spark, sf):
    return _shuffled(spark, sf).select("source", "doc_id", "chunk_id", "row_no")


def q_epoch_window(spark, sf):
    seqs = _shuffled_kept(spark, sf)
    return od.epoch_window(seqs, _retrieval(seqs), epoch=2).select("source", "doc_id", "chunk_id", "row_no")


def q_epoch_window_wrap(spark, sf):
    seqs = _shuffled_kept(spark, sf)
    return od.epoch_window(seqs, _retrieval(seqs), epoch=3).select("source", "doc_id", "chunk_id", "row_no")


def q_planned_steps(spark, sf):
    return od.planned_steps(_retrieval(q_chunk_corpus_small(spark, sf)), BATCH_SIZE, 3)


def q_batch_plan(spark, sf):
    seqs = _shuffled_kept(spark, sf)
    ret = _retrieval(seqs)
    win = od.epoch_window(seqs, ret, epoch=2)
    spe = od.planned_steps(ret, BATCH_SIZE, 3).select("steps_per_epoch").scalar()
    return od.batch_plan(win, BATCH_SIZE, seed=11, epoch=2, steps_per_epoch=spe) \
        .select("source", "doc_id", "chunk_id", "position", "batch_id", "global_step")


def _labelled(spark, sf):
    return si.labelled_in(spark, sf, "quality")


def q_labelled_documents(spark, sf):
    return labelled.labelled_documents(_docs(spark, sf), si.table(spark, sf, "labels"), "quality") \
        .select("doc_id", "label")


def q_shuffle_labelled(spark, sf):
    return od.shuffle_labelled(_labelled(spark, sf), 42).select("doc_id", "label", "row_no")


def q_train_test_split(spark, sf):
    sh = od.shuffle_labelled(_labelled(spark, sf), 42)
    return od.train_test_split(sh, 0.8, ["row_no"], index="row_no").select("doc_id", "split")


def q_kfold(spark, sf):
    sh = od.shuffle_labelled(_labelled(spark, sf), 42)
    return od.kfold(sh, 5, ["row_no"], index="row_no").select("doc_id", "row_no", "fold")


def q_sample_with_replacement(spark, sf):
    return od.sample_with_replacement(_labelled(spark, sf), 50, 5, ["doc_id"]).select("draw", "doc_id", "label")


def q_select_rows(spark, sf):
    sh = od.shuffle_labelled(_labelled(spark, sf), 42)
    folds = od.kfold(sh, 5, ["row_no"], index="row_no")
    return od.select_rows(sh, folds.where(F.col("fold") == 2)).select("doc_id", "row_no")


def q_labelled_union(spark, sf):
    lab = _labelled(spark, sf)
    parts = si.standin_parts(lab)
    return labelled.labelled_union(parts, seed=42).select("part", "row_no", "doc_id", "label")


def q_label_counts(spark, sf):
    sh = od.shuffle_labelled(_labelled(spark, sf), 42)
    return labelled.label_counts(od.train_test_split(sh, 0.8, ["row_no"], index="row_no"), by=["split"])


def q_label_counts_folds(spark, sf):
    sh = od.shuffle_labelled(_labelled(spark, sf), 42)
    return labelled.label_counts(od.kfold(sh, 5, ["row_no"], index="row_no"), by=["fold"])


def q_next_run_id(spark, sf):
    ev = si.table(spark, sf, "events")
    runs = ev.select(F.concat_ws("_", "event_type", F.col("user_id").cast("string")).alias("run_name")).distinct()
    types = ev.select(F.col("event_type").alias("model_type")).distinct()
    return runs_ops.next_run_id(runs, types)


# ---- masking and token-level metrics (character-level stand-in ids, see standins.char_ids)
# pad_truncate cuts and pads to this length; masking and its scores work on whole sequences.
PAD_LEN = 256
MASK_SEED = 13


def _char_encoded(spark, sf, dealt=False):
    """``dealt`` shuffles the sequences evenly first: for queries that read them twice (the chunking then runs once) and do much per position."""
    seqs = q_chunk_corpus_small(spark, sf)
    if dealt:
        seqs = seqs.repartition(_shuffle_partitions(spark), "source", "doc_id", "chunk_id")
    return seqs.select("source", "doc_id", "chunk_id", si.row_key("source", "doc_id", "chunk_id").alias("row_key"),
                       si.char_ids(F.col("sequence")).alias("input_ids"))


def _joined(c):
    return F.array_join(F.col(c), ",")


def _shuffle_partitions(spark):
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _masked(spark, sf, dealt=False, **kw):
    return masking.mask_tokens(_char_encoded(spark, sf, dealt), seed=MASK_SEED, n_tokens=si.CHAR_VOCAB, **kw)


def q_mask_tokens(spark, sf):
    return _masked(spark, sf).select("source", "doc_id", "chunk_id", _joined("masked_ids").alias("masked"),
                                     _joined("labels").alias("labels"))


def q_mask_tokens_arrow(spark, sf):
    m = masking.mask_tokens_arrow(_char_encoded(spark, sf), seed=MASK_SEED, n_tokens=si.CHAR_VOCAB)
    return m.select("source", "doc_id", "chunk_id", _joined("masked_ids").alias("masked"), _joined("labels").alias("labels"))


def q_mask_tokens_hard(spark, sf):
    return _masked(spark, sf, hard=True, ignore_index=None).select(
        "source", "doc_id", "chunk_id", _joined("masked_ids").alias("masked"), _joined("labels").alias("labels"))


def _replaced(encoded):
    return masking.replace_random(encoded, seed=MASK_SEED, n_tokens=si.CHAR_VOCAB)


def q_replace_random(spark, sf):
    return _replaced(_char_encoded(spark, sf)).select("source", "doc_id", "chunk_id", _joined("corrupted_ids").alias("corrupted"),
                                       _joined("replaced").alias("replaced"))


def q_masking_audit(spark, sf):
    return masking.masking_audit(_masked(spark, sf, with_decision=True))


def q_mlm_accuracy(spark, sf):
    m = _masked(spark, sf)
    u = hash_uniforms(23, F.col("row_key"), F.size("labels"))
    preds = F.zip_with("labels", u, lambda l, v: F.when(v < 0.3, l + 1).otherwise(l))
    return scores.mlm_accuracy(m.withColumn("predictions", preds), by=["source"]) \
        .withColumn("mlm_accuracy", _r6(F.col("mlm_accuracy")))


def q_replaced_token_scores(spark, sf):
    # Made beside the replacement, of the ids as it is: one Python worker then makes both.
    r = _replaced(_char_encoded(spark, sf).withColumn("_u", hash_uniforms(29, F.col("row_key"), F.size("input_ids"))))
    logits = F.transform("_u", lambda u: F.round((u - 0.5) * 4.0))
    mask = F.transform("input_ids", lambda x: F.when(x != 0, F.lit(1)).otherwise(F.lit(0)))
    out = scores.replaced_token_scores(r.withColumn("logits", logits).withColumn("attention_mask", mask),
                                       by=["source"])
    return out.select("source", *[_r6(F.col(c)).alias(c) for c in ("accuracy", "precision", "recall")])


def _generator_scores(masked):
    """Stand-in generator output: a vector of logits per masked position.

    A row's positions are dealt before their vectors are made: a task then has the Python workers of the masking or those
    of the vectors and draws, not both, and the draws of a row stay together."""
    pos = masked.select("row_key", masking.positions_of(masking.MASK_ID)("masked_ids").alias("pos"))
    pos = pos.repartition(_shuffle_partitions(masked.sparkSession), "row_key")
    # Of a bare column Spark would infer that it is not empty and mask all sequences once more to see it.
    pos = pos.select("row_key", F.explode(F.coalesce("pos", F.array().cast("array<int>"))).alias("pos"))
    return pos.withColumn("logits", si.generator_logits(41, F.col("row_key"), F.col("pos"), si.CHAR_VOCAB))


def _sampled(spark, sf, mode):
    m = _masked(spark, sf, dealt=True)
    r = masking.replace_sampled(m, _generator_scores(m), mode=mode, seed=43)
    return r.select("source", "doc_id", "chunk_id", _joined("disc_ids").alias("disc"), _joined("disc_labels").alias("labels"))


def q_replace_sampled(spark, sf):
    return _sampled(spark, sf, "aggressive")


def q_replace_sampled_gumbel(spark, sf):
    return _sampled(spark, sf, "gumbel_softmax")


def q_replace_sampled_multinomial(spark, sf):
    return _sampled(spark, sf, "multinomial")


# ---- classification / regression scores (stand-in predictions flip labels by a seeded hash)
def _predicted(spark, sf):
    sh = od.shuffle_labelled(_labelled(spark, sf), 42)
    sp = od.train_test_split(sh, 0.8, ["row_no"], index="row_no")
    flip = hash_uniform(17, F.col("doc_id")) < 0.2
    return sp.withColumn("prediction", F.when(flip, 1 - F.col("label")).otherwise(F.col("label")))


def _r6_all(df, keep):
    return df.select(*keep, *[_r6(F.col(c)).alias(c) for c in df.columns if c not in keep])


def q_binary_scores(spark, sf):
    return _r6_all(scores.binary_scores(_predicted(spark, sf), by=["split"]), ["split", "n"])


def _emb_predicted(spark, sf):
    e = si.table(spark, sf, "embeddings").select("vec_id", "label")
    flip = hash_uniform(31, F.col("vec_id")) < 0.3
    return e.withColumn("prediction", F.when(flip, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def q_class_scores(spark, sf):
    cs = scores.class_scores(_emb_predicted(spark, sf)).drop("tp", "actual")
    return _r6_all(cs, ["label"])


def q_multiclass_scores(spark, sf):
    return _r6_all(scores.multiclass_scores(_emb_predicted(spark, sf)), [])


def q_regression_scores(spark, sf):
    d = si.table(spark, sf, "documents").select("doc_id", (F.col("n_chars") / 1000.0).alias("label"))
    d = d.withColumn("prediction", F.col("label") + hash_uniform(37, F.col("doc_id")) - 0.5)
    return _r6_all(scores.regression_scores(d), [])


# ---- run analytics (events stand in for run metrics)
def _metrics(spark, sf):
    return si.run_metrics_in(spark, sf)


def _batches(spark, sf):
    m = _metrics(spark, sf)
    return m.withColumn("batch_id", ((F.col("step") - 1) / 10).cast("long"))


def q_eval_summary(spark, sf):
    return _r6_all(scores.eval_summary(_batches(spark, sf)), ["run_id", "n_batches"])


def q_run_summary(spark, sf):
    return _r6_all(runs_ops.run_summary(_metrics(spark, sf)), ["run_id", "n_steps"])


def _objectives(spark, sf):
    return runs_ops.run_objective(runs_ops.run_summary(_metrics(spark, sf)), scores.eval_summary(_batches(spark, sf)))


def q_run_objective(spark, sf):
    return _r6_all(_objectives(spark, sf), ["run_id"])


def q_best_trial(spark, sf):
    t = _objectives(spark, sf).select(F.col("run_id").cast("long").alias("trial_id"), F.col("objective").alias("value"))
    return _r6_all(runs_ops.best_trial(t, direction="minimize"), ["trial_id"])


def q_early_stopping(spark, sf):
    r = runs_ops.early_stopping(_metrics(spark, sf), "loss", patience=3, delta=0.0, mode="min")
    return _r6_all(r, ["run_id", "best_step", "stop_step"])


def q_early_stopping_max(spark, sf):
    r = runs_ops.early_stopping(_metrics(spark, sf), "accuracy", patience=4, delta=0.02, mode="max")
    return _r6_all(r, ["run_id", "best_step", "stop_step"])


def q_selected_epoch_score(spark, sf):
    m = _metrics(spark, sf).withColumn("score", F.col("accuracy"))
    stops = runs_ops.early_stopping(m, "loss", patience=3, delta=0.0, mode="min")
    return _r6_all(runs_ops.selected_epoch_score(m, stops), ["run_id", "selected_step"])


def q_cv_mean(spark, sf):
    p = _predicted(spark, sf).where(F.col("split") == "train").drop("split")
    folds = od.kfold(p, 5, ["row_no"])
    fs = scores.binary_scores(folds, by=["fold"]).select(F.lit(0).alias("trial_id"), "fold", F.col("f1").alias("score"))
    return _r6_all(runs_ops.cv_mean(fs), ["trial_id", "n_folds"])


# ---- vocabulary, encoding
# The reference's vocabulary, and one that the SQL side can learn step by step.
VOCAB_SIZE = 50_000
SMALL_VOCAB = 300
ENCODE_LEN = 256
# The reference's number of sequences per document.
DOC_SEQS = 32
DOC_SEQ_LEN = 256


def q_normalize_text(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.normalize_text(F.col("text")).alias("text"))


def q_pretokenize(spark, sf):
    return _docs(spark, sf).select(
        "doc_id", posexplode_rows(tx.pretokenize(tx.normalize_text(F.col("text")))).alias("idx", "token"))


def q_word_frequencies(spark, sf):
    return vocab.word_frequencies(_docs(spark, sf))


def _vocab(spark, sf, size=VOCAB_SIZE):
    return vocab.learn_vocabulary(vocab.word_frequencies(_docs(spark, sf)), size, min_frequency=5)


def q_learn_vocabulary(spark, sf):
    return _vocab(spark, sf)


def q_learn_vocabulary_small(spark, sf):
    return _vocab(spark, sf, SMALL_VOCAB)


def q_encode_words(spark, sf, **how):
    words = vocab.word_frequencies(_docs(spark, sf))
    return vocab.encode_words(words, _vocab(spark, sf, SMALL_VOCAB), **how).select("word", "freq", _joined("ids").alias("ids"))


def q_encode_words_join(spark, sf):
    return q_encode_words(spark, sf, broadcast_limit=0)


def q_vocab_lookup(spark, sf):
    return vocab.vocab_lookup(vocab.word_frequencies(_docs(spark, sf)), _vocab(spark, sf, SMALL_VOCAB))


def _encoded(spark, sf, size, **how):
    enc = vocab.encode_sequences(q_chunk_corpus_small(spark, sf), _vocab(spark, sf, size), ENCODE_LEN, **how)
    return enc.select("source", "doc_id", "chunk_id", _joined("input_ids").alias("input_ids"),
                      F.aggregate("attention_mask", F.lit(0), lambda a, b: a + b).alias("n_tokens"))


def q_encode_sequences(spark, sf):
    return _encoded(spark, sf, SMALL_VOCAB)


def q_encode_sequences_join(spark, sf):
    return _encoded(spark, sf, SMALL_VOCAB, broadcast_limit=0)


def q_encode_sequences_full(spark, sf):
    return _encoded(spark, sf, VOCAB_SIZE)


def q_pad_truncate(spark, sf):
    seqs = q_chunk_corpus_small(spark, sf)
    return seqs.select("source", "doc_id", "chunk_id", F.array_join(si.char_ids(F.col("sequence"), PAD_LEN), ",").alias("ids"))


def q_pad_documents(spark, sf):
    sents = ch.document_sequences(si.labelled_in(spark, sf))
    enc = sents.select("doc_id", "seq_idx", si.char_ids(F.col("sentence"), DOC_SEQ_LEN).alias("input_ids"))
    enc = enc.withColumn("attention_mask", F.transform("input_ids", lambda x: F.when(x != 0, 1).otherwise(0)))
    padded = labelled.pad_documents(enc, DOC_SEQS, DOC_SEQ_LEN)
    rows = lambda c: F.array_join(F.transform(c, lambda a: F.array_join(a, ",")), "|")
    return padded.select("doc_id", rows(F.col("input_ids")).alias("input_ids"),
                         _joined("sequence_mask").alias("sequence_mask"))


# ---- Spark ML probes and attention
POOL_SEQS = 32
EMB_DIM = 64


def _seq_vectors(spark, sf):
    e = si.table(spark, sf, "embeddings")
    return e.select((F.col("vec_id") / 8).cast("long").alias("doc_id"), (F.col("vec_id") % 8).cast("int").alias("seq_idx"),
                    "embedding")


def q_attention_pool(spark, sf):
    p = models.attention_pool(_seq_vectors(spark, sf), POOL_SEQS, EMB_DIM)
    return p.select("doc_id", F.col("n_sequences").cast("long").alias("n_sequences"),
                    F.round(F.aggregate("doc_vector", F.lit(0.0), lambda a, b: a + b), 5).alias("vec_sum"),
                    F.round(F.sqrt(F.aggregate("doc_vector", F.lit(0.0), lambda a, b: a + b * b)), 5).alias("vec_norm"))


def q_rank_sentences(spark, sf):
    sents = ch.document_sequences(si.table(spark, sf, "documents"))
    # Every document's first POOL_SEQS sentences get a vector of the table, by position modulo its size.
    vecs = si.table(spark, sf, "embeddings")
    spot = sents.where(F.col("seq_idx") < POOL_SEQS).select(
        "doc_id", "seq_idx", ((F.col("doc_id") * POOL_SEQS + F.col("seq_idx")) % vecs.agg(F.count(F.lit(1))).scalar()).alias("vec_id"))
    p = models.attention_pool(spot.join(vecs, "vec_id").select("doc_id", "seq_idx", "embedding"), POOL_SEQS, EMB_DIM)
    r = models.rank_sentences(p, sents)
    return r.select("doc_id", "rank", "seq_idx", "sentence", F.round("weight", 5).alias("weight"))


def q_linear_separability(spark, sf):
    return models.linear_separability(si.table(spark, sf, "embeddings"))


def q_svm_separability(spark, sf):
    return models.svm_separability(si.table(spark, sf, "embeddings"))


def _cv_parts(spark, sf):
    sh = od.shuffle_labelled(_labelled(spark, sf), 42)
    sp = od.train_test_split(sh, 0.8, ["row_no"], index="row_no")
    return sp.where(F.col("split") == "train"), sp.where(F.col("split") == "test")


def q_cv_search(spark, sf):
    train, _ = _cv_parts(spark, sf)
    return models.cv_search(train, models.trial_table(spark, n_trials=3, seed=3), k=3, index="row_no")


def q_cv_epochs(spark, sf):
    """Cross-validated training epoch by epoch with early stopping, over a stored metric table."""
    sh = od.shuffle_labelled(_labelled(spark, sf), 42)
    trials = spark.createDataFrame([(0, 0.03)], "trial_id long, step_size double")
    path = _scratch(spark, "cv-metrics")
    models.cv_epochs(sh, trials, k=3, n_epochs=4, patience=2, steps_per_epoch=3, index="row_no").write.parquet(path)
    return models.selected_cv_scores(spark.read.parquet(path), patience=2)


def q_final_evaluation(spark, sf):
    train, test = _cv_parts(spark, sf)
    res = models.cv_search(train, models.trial_table(spark, n_trials=3, seed=3), k=3, index="row_no")
    best = runs_ops.best_trial(res, value="cv_score", direction="maximize").first().asDict()
    return models.final_evaluation(train.drop("split"), test.drop("split"), best)


# ---- Structured Streaming (ST1, ST2) and the chunk sink
def _scratch(spark, name):
    import uuid

    from scriptorium.session import ensure_checkpoint_dir

    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


FILE_BYTES, ROW_GROUP_BYTES = 512 << 20, 8 << 20


def _document_files(spark, sf, columns="*"):
    """Documents as successive files (doc-id ranges covering the whole table): (folder, schema).

    A trigger takes one file, so a range is written as one file for each FILE_BYTES of text and not as one for each
    task that read the table. Its row groups are small, so all cores share the file.
    """
    raw = si.table(spark, sf, "documents").selectExpr(columns, "timestamp_seconds(doc_id) AS seen_at")
    inbox = _scratch(spark, "inbox")
    last = raw.agg(F.max("doc_id")).first()[0] or 0
    width = max(1, -(-(last + 1) // 4))
    ids = raw.where((F.col("doc_id") >= 0) & (F.col("doc_id") <= last))
    held = {r["lo"]: r["size"] or 0 for r in ids.groupBy(F.floor(F.col("doc_id") / width).alias("lo")).agg(F.sum(F.octet_length("text")).alias("size")).collect()}
    for k, lo in enumerate(range(0, last + 1, width)):
        part = raw.where((F.col("doc_id") >= lo) & (F.col("doc_id") < lo + width))
        files = max(1, -(-held.get(k, 0) // FILE_BYTES))
        part.repartitionByRange(files, "doc_id").write.mode("append").option("parquet.block.size", ROW_GROUP_BYTES).parquet(inbox)
    return inbox, raw.schema


def _prepared(raw):
    return si.documents_in_from(raw)


def _prepared_with_time(raw):
    src = si.source_of()
    return raw.select("doc_id", src.alias("source"), F.when(src == "current", si.exhibit_of()).alias("doc_type"), "text", "seen_at")


def _streamed_chunks(spark, sf, prepare, distinct=None):
    from scriptorium.streaming.chunk_stream import start_chunk_stream

    inbox, schema = _document_files(spark, sf)
    out, ck = _scratch(spark, "stream-chunks"), _scratch(spark, "stream-chunks-ckpt")
    q = start_chunk_stream(spark, inbox, schema, out, ck, prepare=prepare, profiles=SMALL_PROFILES,
                           chunk_words=SMALL_WORDS, max_files_per_trigger=1, distinct=distinct)
    q.awaitTermination()
    return spark.read.parquet(out).select("source", "doc_id", "chunk_id", "sequence")


def q_stream_chunk(spark, sf):
    return _streamed_chunks(spark, sf, _prepared)


def q_stream_chunk_distinct(spark, sf):
    from scriptorium.streaming.chunk_stream import Distinct

    # Copies lie anywhere in the table, so texts are remembered over all of it.
    return _streamed_chunks(spark, sf, _prepared_with_time, Distinct("seen_at", "1 second", 10**9))


def q_stream_early_stopping(spark, sf):
    from scriptorium.streaming.early_stop_stream import latest_status, start_early_stopping

    src, out, ck = _scratch(spark, "metrics"), _scratch(spark, "stops"), _scratch(spark, "stops-ckpt")
    m = _metrics(spark, sf).select("run_id", "step", "loss", "ts")
    # Metrics arrive in no order: every run's steps are dealt to four writes by a hash.
    for k in range(4):
        m.where(F.pmod(F.xxhash64("run_id", "step"), F.lit(4)) == k).write.mode("append").parquet(src)
    stream = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 4).parquet(src)
    q = start_early_stopping(stream, out, ck, metric="loss", patience=3, delta=0.0, mode="min", delay="3650 days")
    q.awaitTermination()
    return latest_status(spark.read.parquet(out)).select(
        "run_id", "best_step", F.round("best_value", 6).alias("best_value"), "stop_step")


def q_write_chunks(spark, sf):
    from scriptorium.sources.sinks import write_chunks

    path = _scratch(spark, "chunks")
    write_chunks(q_chunk_corpus_small(spark, sf), path)
    return spark.read.parquet(path).select("source", "doc_id", "chunk_id", "sequence")


# ---- composed plans (corpus build, one epoch of the pretraining feed)
def q_build_corpus(spark, sf):
    from scriptorium.plans.corpus import build_corpus
    from scriptorium.sources.sinks import open_shuffled

    paths = build_corpus(spark, _docs(spark, sf), _scratch(spark, "corpus"), SMALL_PROFILES, SMALL_WORDS, seed=SHUFFLE_SEED)
    return open_shuffled(spark, paths.shuffled)[0].select("source", "doc_id", "chunk_id", "row_no")


def q_epoch_feed(spark, sf):
    from scriptorium.plans.corpus import build_corpus
    from scriptorium.plans.pretraining import epoch_feed
    from scriptorium.sources.sinks import open_shuffled

    paths = build_corpus(spark, _docs(spark, sf), _scratch(spark, "corpus"), SMALL_PROFILES, SMALL_WORDS, seed=SHUFFLE_SEED)
    seqs, totals = open_shuffled(spark, paths.shuffled)
    feed = epoch_feed(seqs, _retrieval(totals), _vocab(spark, sf), epoch=1, batch_size=BATCH_SIZE,
                      max_length=ENCODE_LEN, seed=5, n_epochs=3, totals=totals)
    return feed.select("source", "doc_id", "chunk_id", "epoch", "batch_id", "global_step",
                       _joined("masked_ids").alias("masked_ids"), _joined("labels").alias("labels"))

def _own_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "chunk_corpus": q_chunk_corpus,
        "chunk_corpus_small": q_chunk_corpus_small,
        "scan_source": q_scan_source,
        "scan_distinct": q_scan_distinct,
        "count_documents": q_count_documents,
        "scan_page": q_scan_page,
        "corpus_union": q_corpus_union,
        "corpus_union_sources": q_corpus_union_sources,
        "preview_sources": q_preview_sources,
        "count_sequences": q_count_sequences,
        "filter_doc_type": q_filter_doc_type,
        "filter_noisy_docs": q_filter_noisy_docs,
        "filter_short_transcripts": q_filter_short_transcripts,
        "clean_transcripts": q_clean_transcripts,
        "clean_transcripts_conversations": q_clean_transcripts_conversations,
        "clean_reports": q_clean_reports,
        "filter_numeric_sentences": q_filter_numeric_sentences,
        "filter_noisy_chunks": q_filter_noisy_chunks,
        "trim_sentences": q_trim_sentences,
        "exclude_nulls": q_exclude_nulls,
        "split_sentences": q_split_sentences,
        "split_sentences_simple": q_split_sentences_simple,
        "word_count": q_word_count,
        "digit_punct_fraction": q_digit_punct_fraction,
        "numeric_percentage": q_numeric_percentage,
        "flatten_newlines": q_flatten_newlines,
        "pack_chunks": q_pack_chunks,
        "chunk_report": q_chunk_report,
        "chunk_report_page": q_chunk_report_page,
        "chunk_report_written": q_chunk_report_written,
        "write_corpus_page": q_write_corpus_page,
        "scan_page_deep": q_scan_page_deep,
        "document_sequences": q_document_sequences,
        "shuffle_sequences": q_shuffle_sequences,
        "epoch_window": q_epoch_window,
        "epoch_window_wrap": q_epoch_window_wrap,
        "planned_steps": q_planned_steps,
        "batch_plan": q_batch_plan,
        "labelled_documents": q_labelled_documents,
        "shuffle_labelled": q_shuffle_labelled,
        "train_test_split": q_train_test_split,
        "kfold": q_kfold,
        "sample_with_replacement": q_sample_with_replacement,
        "select_rows": q_select_rows,
        "labelled_union": q_labelled_union,
        "label_counts": q_label_counts,
        "label_counts_folds": q_label_counts_folds,
        "next_run_id": q_next_run_id,
        "mask_tokens": q_mask_tokens,
        "mask_tokens_arrow": q_mask_tokens_arrow,
        "mask_tokens_hard": q_mask_tokens_hard,
        "replace_random": q_replace_random,
        "masking_audit": q_masking_audit,
        "replace_sampled": q_replace_sampled,
        "replace_sampled_gumbel": q_replace_sampled_gumbel,
        "replace_sampled_multinomial": q_replace_sampled_multinomial,
        "mlm_accuracy": q_mlm_accuracy,
        "replaced_token_scores": q_replaced_token_scores,
        "binary_scores": q_binary_scores,
        "class_scores": q_class_scores,
        "multiclass_scores": q_multiclass_scores,
        "regression_scores": q_regression_scores,
        "eval_summary": q_eval_summary,
        "run_summary": q_run_summary,
        "run_objective": q_run_objective,
        "best_trial": q_best_trial,
        "early_stopping": q_early_stopping,
        "early_stopping_max": q_early_stopping_max,
        "selected_epoch_score": q_selected_epoch_score,
        "cv_mean": q_cv_mean,
        "normalize_text": q_normalize_text,
        "pretokenize": q_pretokenize,
        "word_frequencies": q_word_frequencies,
        "learn_vocabulary": q_learn_vocabulary,
        "learn_vocabulary_small": q_learn_vocabulary_small,
        "encode_words": q_encode_words,
        "encode_words_join": q_encode_words_join,
        "vocab_lookup": q_vocab_lookup,
        "encode_sequences": q_encode_sequences,
        "encode_sequences_join": q_encode_sequences_join,
        "encode_sequences_full": q_encode_sequences_full,
        "pad_truncate": q_pad_truncate,
        "pad_documents": q_pad_documents,
        "attention_pool": q_attention_pool,
        "rank_sentences": q_rank_sentences,
        "linear_separability": q_linear_separability,
        "svm_separability": q_svm_separability,
        "cv_search": q_cv_search,
        "cv_epochs": q_cv_epochs,
        "final_evaluation": q_final_evaluation,
        "stream_chunk": q_stream_chunk,
        "stream_chunk_distinct": q_stream_chunk_distinct,
        "stream_early_stopping": q_stream_early_stopping,
        "write_chunks": q_write_chunks,
        "build_corpus": q_build_corpus,
        "epoch_feed": q_epoch_feed,
    }


# ---------------------------------------------------------------------------
# DuckDB oracle SQL, built from small fragments
# ---------------------------------------------------------------------------
DOCS_IN = """docs_in AS (
  SELECT doc_id,
         ['annual','current','calls','news','reports'][(CAST(substr(source, 4) AS INTEGER) % 5) + 1] AS source,
         CASE WHEN CAST(substr(source, 4) AS INTEGER) % 5 = 1
              THEN ['EX-99.1','EX-99.5','EX-10.1','EX-99'][(doc_id % 4) + 1] END AS doc_type,
         text
  FROM documents)"""

DP_CLASS = r"[^0-9\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _own_queries() | (training_data.queries() if training_data else {})


def s_share(x: str, empty: str | None = None) -> str:
    tail = f" ELSE {empty}" if empty is not None else ""
    return (f"(CASE WHEN length({x}) > 0 THEN length(regexp_replace({x}, '{DP_CLASS}', '', 'g'))::DOUBLE"
            f" / length({x}){tail} END)")


def s_numpct(x: str) -> str:
    return f"((length(regexp_replace({x}, '[^0-9]', '', 'g'))::DOUBLE / length({x})) * 100)"


def s_split(t: str) -> str:
    m1 = f"regexp_replace({t}, '([.?]) ', '\\1' || chr(1), 'g')"
    m2 = f"regexp_replace({m1}, '([.?])' || chr(10), '\\1' || chr(2), 'g')"
    u1 = f"regexp_replace({m2}, '([A-Z][a-z]\\.|[0-9]\\.)' || chr(1), '\\1 ', 'g')"
    u2 = f"regexp_replace({u1}, '([A-Z][a-z]\\.|[0-9]\\.)' || chr(2), '\\1' || chr(10), 'g')"
    return f"string_split(replace({u2}, chr(2), chr(1)), chr(1))"


def s_words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '\\S+'))"


def s_report_clean(t: str) -> str:
    sents = f"list_transform({s_split(f'replace({t}, chr(10), chr(32))')}, lambda y: trim(y))"
    keep = (f"list_filter({sents}, lambda x: length(x) > 0 AND (length(x) - length(replace(x, '%', ''))) <= 5"
            f" AND {s_numpct('x')} <= 15)")
    return f"array_to_string({keep}, ' ')"


def s_calls_clean(t: str) -> str:
    lines = f"list_filter(string_split({t}, chr(10)), lambda x: length(x) > 10)"
    strip = (f"list_transform({lines}, lambda x: CASE WHEN strpos(substr(x, 1, 20), ':') > 0 "
             f"THEN substr(x, strpos(x, ':') + 1) ELSE x END)")
    return f"array_to_string({strip}, ' ')"


def s_profile(profiles, attr, default="0") -> str:
    arms = " ".join(f"WHEN '{k}' THEN {getattr(v, attr) or 0}" for k, v in profiles.items())
    return f"CASE source {arms} ELSE {default} END"


def s_cleaned(profiles) -> str:
    """CTE list: docs_in -> cleaned(doc_id, source, text) per source profile."""
    names = ", ".join(f"'{k}'" for k in profiles if k not in ("current", "calls"))
    exhibits = ", ".join(f"'{e}'" for e in tx.CURRENT_FILING_EXHIBITS)
    return f"""{DOCS_IN},
cur AS (
  SELECT doc_id, source, text FROM docs_in
  WHERE source = 'current' AND doc_type IN ({exhibits}) AND {s_share('text', '0.0')} <= 0.30),
plain AS (
  SELECT doc_id, source,
         CASE WHEN source = 'news' THEN replace(text, chr(10), ' ')
              WHEN source = 'reports' THEN {s_report_clean('text')} ELSE text END AS text
  FROM docs_in WHERE source IN ({names})),
calls_d AS (SELECT min(doc_id) AS doc_id, source, text FROM docs_in WHERE source = 'calls' GROUP BY source, text),
calls AS (
  SELECT doc_id, source, {s_calls_clean('text')} AS text
  FROM calls_d WHERE len(string_split(text, chr(10))) >= 5),
cleaned AS (SELECT * FROM cur UNION ALL SELECT * FROM plain UNION ALL SELECT * FROM calls)"""


def s_packed(input_cte: str, words: int, profiles=None, a: str = "0", b: str = "0") -> str:
    """CTE list over ``input_cte(doc_id, source, text)`` -> ``chunks(source, doc_id,
    chunk_id, sequence)`` plus ``trimmed(ok)``; greedy packing by recursive CTE."""
    if profiles:
        a, b = s_profile(profiles, "trim_first"), s_profile(profiles, "trim_last")
    return f"""split AS (
  SELECT doc_id, source, {s_split('text')} AS s, {a} AS a, {b} AS b FROM {input_cte}),
trimmed AS (
  SELECT doc_id, source,
         CASE WHEN a > 0 AND b > 0 THEN 2 * b < len(s) WHEN a > 0 THEN a < len(s)
              WHEN b > 0 THEN b < len(s) ELSE true END AS ok,
         list_slice(s, a + 1, len(s) - b) AS kept
  FROM split),
sents AS (
  SELECT doc_id, source, unnest(kept) AS sent, unnest(range(1, len(kept) + 1)) AS n FROM trimmed WHERE ok),
sw AS (SELECT doc_id, source, sent, n, {s_words('sent')} AS w FROM sents),
r(source, doc_id, n, cnt, chunk) AS (
  SELECT source, doc_id, n, w, CASE WHEN w > {words} THEN 1 ELSE 0 END FROM sw WHERE n = 1
  UNION ALL
  SELECT s.source, s.doc_id, s.n,
         CASE WHEN r.cnt + s.w > {words} THEN s.w ELSE r.cnt + s.w END,
         CASE WHEN r.cnt + s.w > {words} THEN r.chunk + 1 ELSE r.chunk END
  FROM r JOIN sw s ON s.source = r.source AND s.doc_id = r.doc_id AND s.n = r.n + 1),
chunks AS (
  SELECT r.source, r.doc_id, r.chunk AS chunk_id, string_agg(s.sent, ' ' ORDER BY s.n) AS sequence
  FROM r JOIN sw s ON s.source = r.source AND s.doc_id = r.doc_id AND s.n = r.n
  GROUP BY r.source, r.doc_id, r.chunk
  UNION ALL
  SELECT source, doc_id, 0 AS chunk_id, '' AS sequence FROM sw WHERE n = 1 AND w > {words})"""


def s_chunk_corpus(profiles, words, max_share=0.15) -> str:
    return f"""WITH RECURSIVE {s_cleaned(profiles)},
{s_packed('cleaned', words, profiles)},
scored AS (
  SELECT *, CASE WHEN length(sequence) > 0 THEN {s_share('sequence')}
                 WHEN source = 'current' THEN 0.0 END AS share FROM chunks),
bad AS (SELECT DISTINCT source, doc_id FROM scored WHERE share IS NULL)
SELECT source, doc_id, CAST(chunk_id AS INTEGER) AS chunk_id, sequence FROM scored
WHERE share <= {max_share}
  AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source = scored.source AND bad.doc_id = scored.doc_id)"""



def s_u(seed, *exprs) -> str:
    """Hash uniform, identical to ``scriptorium.functions.random.hash_uniform``."""
    parts = ", ".join([f"'{seed}'", *exprs])
    return f"(('0x' || substr(md5(concat_ws(':', {parts})), 1, 13))::UBIGINT / 4503599627370496.0)"


def s_small_corpus() -> str:
    return s_chunk_corpus(SMALL_PROFILES, SMALL_WORDS)


def s_shuffled() -> str:
    return f"""seqs AS ({s_small_corpus()}),
sh AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY {s_u(SHUFFLE_SEED, 'doc_id', 'chunk_id')},
                                doc_id, chunk_id) - 1 AS row_no
  FROM seqs)"""


def s_window(epoch: int) -> str:
    off = epoch * EPOCH_LIMIT
    return f"""{s_shuffled()},
tot AS (SELECT source, count(*) AS n_total FROM sh GROUP BY source),
st AS (SELECT source, CASE WHEN {off} + {off} > n_total THEN 0 ELSE {off} END AS lo FROM tot),
win AS (SELECT sh.* FROM sh JOIN st USING (source) WHERE row_no >= lo AND row_no < lo + {EPOCH_LIMIT})"""


LAB = "lab AS (SELECT d.doc_id, d.text, CAST(l.quality AS INTEGER) AS label FROM documents d JOIN labels l USING (doc_id))"
LAB_SH = f"""{LAB},
lsh AS (SELECT *, row_number() OVER (ORDER BY {s_u(42, 'doc_id')}, doc_id) - 1 AS row_no FROM lab)"""


def s_explode(list_expr: str, src: str, key: str = "doc_id", idx: str = "idx", val: str = "sentence") -> str:
    return (f"SELECT {key}, CAST({idx} AS INTEGER) AS {idx}, {val} FROM (SELECT {key}, unnest(_l) AS {val}, "
            f"unnest(range(0, len(_l))) AS {idx} FROM (SELECT {key}, {list_expr} AS _l FROM {src}))")


def s_simple_split(t: str) -> str:
    return f"string_split(regexp_replace({t}, '([.!?]) +', '\\1' || chr(1), 'g'), chr(1))"


def s_paged(sql: str) -> str:
    """The same SQL over a page of every source's scan (transcripts: of their distinct texts)."""
    page = f"QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 BETWEEN {PAGE_OFFSET} AND {PAGE_OFFSET + PAGE_LIMIT - 1}"
    parts = {"FROM docs_in\n  WHERE source = 'current'": f"FROM (SELECT * FROM docs_in {page})\n  WHERE source = 'current'",
             "FROM docs_in WHERE source IN (": f"FROM (SELECT * FROM docs_in {page}) WHERE source IN (",
             "WHERE source = 'calls' GROUP BY source, text)": f"WHERE source = 'calls' GROUP BY source, text {page.replace('ORDER BY doc_id', 'ORDER BY min(docs_in.doc_id)')})"}
    for a, b in parts.items():
        assert a in sql or a.replace("\n  ", " ") in sql, a
        sql = sql.replace(a, b).replace(a.replace("\n  ", " "), b)
    return sql


def s_report() -> str:
    return f"""WITH RECURSIVE {s_cleaned(SMALL_PROFILES)},
{s_packed('cleaned', SMALL_WORDS, SMALL_PROFILES)},
scored AS (
  SELECT *, CASE WHEN length(sequence) > 0 THEN {s_share('sequence')}
                 WHEN source = 'current' THEN 0.0 END AS share FROM chunks),
excl AS (
  SELECT source, doc_id FROM trimmed WHERE NOT ok
  UNION
  SELECT DISTINCT source, doc_id FROM scored WHERE share IS NULL),
agg AS (
  SELECT s.source, count(*) AS n_raw_chunks,
         sum(CASE WHEN e.doc_id IS NULL THEN s.share ELSE 0 END) AS share_sum,
         sum(CASE WHEN e.doc_id IS NULL AND s.share <= 0.15 THEN 1 ELSE 0 END) AS n_kept
  FROM scored s LEFT JOIN excl e ON e.source = s.source AND e.doc_id = s.doc_id GROUP BY s.source),
ex AS (SELECT source, count(*) AS n_excluded FROM excl GROUP BY source),
tot AS (SELECT source, count(*) AS n_documents FROM docs_in GROUP BY source)
SELECT tot.source, n_documents, coalesce(n_excluded, 0) AS n_excluded,
       round(coalesce(n_excluded, 0) / n_documents, 6) AS excluded_fraction,
       CAST(coalesce(n_raw_chunks, 0) AS BIGINT) AS n_raw_chunks,
       round(share_sum / n_raw_chunks, 6) AS mean_share,
       CAST(coalesce(n_kept, 0) AS BIGINT) AS n_kept_chunks
FROM tot LEFT JOIN agg USING (source) LEFT JOIN ex USING (source)"""


def _oracle_batch2() -> dict[str, str]:
    d = f"WITH {DOCS_IN} "
    exhibits = ", ".join(f"'{e}'" for e in tx.CURRENT_FILING_EXHIBITS)
    rep_kept = (f"list_filter(list_transform({s_split('replace(text, chr(10), chr(32))')}, lambda y: trim(y)), "
                f"lambda x: length(x) > 0 AND (length(x) - length(replace(x, '%', ''))) <= 5 "
                f"AND {s_numpct('x')} <= 15)")
    packed_23 = f"""WITH RECURSIVE {DOCS_IN}, {s_packed('docs_in', SMALL_WORDS, a='2', b='3')}"""
    return {
        "scan_page": d + "SELECT doc_id, source, doc_type, text FROM docs_in ORDER BY doc_id LIMIT 300 OFFSET 100",
        "corpus_union_sources": d + "SELECT doc_id, source, CASE WHEN source IN ('news', 'reports') "
                                    "THEN replace(text, chr(10), ' ') ELSE text END AS text FROM docs_in WHERE text IS NOT NULL",
        "corpus_union": d + "SELECT doc_id, source, CASE WHEN source IN ('news', 'reports') "
                            "THEN replace(text, chr(10), ' ') ELSE text END AS text FROM docs_in WHERE text IS NOT NULL",
        "preview_sources": d + "SELECT source, doc_id, row_no FROM (SELECT source, doc_id, row_number() OVER "
                               "(PARTITION BY source ORDER BY doc_id) AS row_no FROM docs_in) WHERE row_no <= 5",
        "count_sequences": f"SELECT source, count(*) AS n_sequences FROM ({s_small_corpus()}) GROUP BY source",
        "filter_doc_type": d + f"SELECT doc_id, doc_type FROM docs_in WHERE source = 'current' AND doc_type IN ({exhibits})",
        "filter_noisy_docs": d + f"SELECT doc_id FROM docs_in WHERE source = 'current' AND doc_type IN ({exhibits}) "
                                 f"AND {s_share('text', '0.0')} <= 0.30",
        "filter_short_transcripts": d + "SELECT doc_id FROM docs_in WHERE source = 'calls' "
                                        "AND len(string_split(text, chr(10))) >= 5",
        "clean_transcripts": d + f"SELECT doc_id, {s_calls_clean('text')} AS text FROM docs_in "
                                 "WHERE source = 'calls' AND len(string_split(text, chr(10))) >= 5",
        "clean_reports": d + f"SELECT doc_id, {s_report_clean('text')} AS text FROM docs_in WHERE source = 'reports'",
        "clean_transcripts_conversations": f"""WITH t AS (
  SELECT conv_id AS doc_id, string_agg(concat_ws(': ', role, text), chr(10) ORDER BY turn) AS text
  FROM conversations GROUP BY conv_id)
SELECT doc_id, {s_calls_clean('text')} AS text FROM t WHERE len(string_split(text, chr(10))) >= 5""",
        "filter_numeric_sentences": d + ", rep AS (SELECT * FROM docs_in WHERE source = 'reports') "
                                    + s_explode(rep_kept, "rep"),
        "filter_noisy_chunks": packed_23 + f" SELECT doc_id, CAST(chunk_id AS INTEGER) AS chunk_id FROM chunks "
                                           f"WHERE {s_share('sequence')} <= 0.15",
        "trim_sentences": d + "SELECT doc_id, CAST(len(s) AS INTEGER) AS n_sentences, "
                              "CAST(CASE WHEN 2 * 3 < len(s) THEN len(list_slice(s, 3, len(s) - 3)) END AS INTEGER) AS n_kept "
                              f"FROM (SELECT doc_id, {s_split('text')} AS s FROM docs_in)",
        "exclude_nulls": d + "SELECT source, count(*) AS n_documents FROM docs_in WHERE text IS NOT NULL GROUP BY source",
        "split_sentences": d + s_explode(s_split("text"), "docs_in"),
        "split_sentences_simple": d + s_explode(s_simple_split("text"), "docs_in"),
        "word_count": d + f"SELECT doc_id, CAST({s_words('text')} AS INTEGER) AS n_words FROM docs_in",
        "digit_punct_fraction": d + f"SELECT doc_id, round({s_share('text')}, 6) AS share FROM docs_in",
        "numeric_percentage": d + f"SELECT doc_id, round(CASE WHEN length(text) > 0 THEN {s_numpct('text')} END, 6) "
                                  "AS pct FROM docs_in",
        "flatten_newlines": d + "SELECT doc_id, replace(text, chr(10), ' ') AS text FROM docs_in",
        "pack_chunks": packed_23 + " SELECT doc_id, CAST(chunk_id AS INTEGER) AS chunk_id, sequence FROM chunks",
        "chunk_report": s_report(),
        "chunk_report_written": s_report(),
        "chunk_report_page": s_paged(s_report()),
        "write_corpus_page": s_paged(s_small_corpus()),
        "scan_page_deep": d + "SELECT doc_id, source, doc_type FROM docs_in ORDER BY doc_id OFFSET 250",
        "document_sequences": f"WITH {LAB} " + s_explode(s_simple_split("text"), "lab", idx="seq_idx"),
        "shuffle_sequences": f"WITH {s_shuffled()} SELECT source, doc_id, chunk_id, row_no FROM sh",
        "epoch_window": f"WITH {s_window(2)} SELECT source, doc_id, chunk_id, row_no FROM win",
        "epoch_window_wrap": f"WITH {s_window(3)} SELECT source, doc_id, chunk_id, row_no FROM win",
        "planned_steps": f"""WITH seqs AS ({s_small_corpus()}),
ret AS (SELECT DISTINCT source, {EPOCH_LIMIT} AS lim FROM seqs)
SELECT CAST(ceil(sum(lim) / {BATCH_SIZE}) AS BIGINT) AS steps_per_epoch,
       CAST(ceil(sum(lim) / {BATCH_SIZE}) AS BIGINT) * 3 AS total_steps FROM ret""",
        "batch_plan": f"""WITH {s_window(2)},
spe AS (SELECT CAST(ceil(count(DISTINCT source) * {EPOCH_LIMIT} / {BATCH_SIZE}) AS BIGINT) AS spe FROM seqs),
pos AS (SELECT source, doc_id, chunk_id,
               row_number() OVER (ORDER BY {s_u(11, "'2'", 'source', 'doc_id', 'chunk_id')}, source, doc_id, chunk_id) - 1
               AS position FROM win)
SELECT source, doc_id, chunk_id, position, CAST(position // {BATCH_SIZE} AS INTEGER) AS batch_id,
       CAST(2 * (SELECT spe FROM spe) + position // {BATCH_SIZE} + 1 AS BIGINT) AS global_step FROM pos""",
        "labelled_documents": f"WITH {LAB} SELECT doc_id, label FROM lab",
        "shuffle_labelled": f"WITH {LAB_SH} SELECT doc_id, label, row_no FROM lsh",
        "train_test_split": f"""WITH {LAB_SH}
SELECT doc_id, CASE WHEN row_no < floor((SELECT count(*) FROM lab) * 0.8) THEN 'train' ELSE 'test' END AS split
FROM lsh""",
        "kfold": f"WITH {LAB_SH} SELECT doc_id, row_no, CAST(ntile(5) OVER (ORDER BY row_no) - 1 AS INTEGER) AS fold FROM lsh",
        "sample_with_replacement": f"""WITH {LAB},
idx AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS _i FROM lab),
draws AS (SELECT range AS draw, CAST(floor({s_u(5, 'range')} * (SELECT count(*) FROM lab)) AS BIGINT) AS _i
          FROM range(50))
SELECT draw, doc_id, label FROM draws JOIN idx USING (_i)""",
        "select_rows": f"""WITH {LAB_SH},
f AS (SELECT row_no, ntile(5) OVER (ORDER BY row_no) - 1 AS fold FROM lsh)
SELECT doc_id, row_no FROM lsh WHERE row_no IN (SELECT row_no FROM f WHERE fold = 2)""",
        "labelled_union": f"""WITH {LAB},
p AS (SELECT *, CASE WHEN {s_u(3, 'doc_id')} < 0.8 THEN 'train' ELSE 'test' END AS part FROM lab)
SELECT part, row_number() OVER (PARTITION BY part ORDER BY {s_u(42, 'doc_id')}, doc_id) - 1 AS row_no, doc_id, label
FROM p""",
        "label_counts": f"""WITH {LAB_SH},
s AS (SELECT label, CASE WHEN row_no < floor((SELECT count(*) FROM lab) * 0.8) THEN 'train' ELSE 'test' END AS split
      FROM lsh)
SELECT split, label, count(*) AS n FROM s GROUP BY split, label""",
        "label_counts_folds": f"""WITH {LAB_SH},
s AS (SELECT label, CAST(ntile(5) OVER (ORDER BY row_no) - 1 AS INTEGER) AS fold FROM lsh)
SELECT fold, label, count(*) AS n FROM s GROUP BY fold, label""",
        "next_run_id": """WITH runs AS (SELECT DISTINCT concat_ws('_', event_type, user_id) AS run_name FROM events),
per AS (SELECT split_part(run_name, '_', 1) AS model_type,
               max(TRY_CAST(split_part(run_name, '_', 2) AS INTEGER)) AS mx FROM runs GROUP BY 1),
types AS (SELECT DISTINCT event_type AS model_type FROM events),
x AS (SELECT t.model_type, CAST(CASE WHEN mx IS NULL THEN 0 ELSE mx + 1 END AS VARCHAR) AS v
      FROM types t LEFT JOIN per USING (model_type))
SELECT model_type, model_type || '_' || CASE WHEN length(v) < 2 THEN lpad(v, 2, '0') ELSE v END AS next_run FROM x""",
    }


def s_uh(h: str, word: int = 0) -> str:
    return f"(('0x' || substr({h}, {1 + 8 * word}, 8))::UBIGINT / 4294967296.0)"


def s_enc() -> str:
    chars = "list_filter(string_split(sequence, ''), lambda c: c <> '')"
    ids = f"list_transform({chars}, lambda c: (unicode(c) % 27) + 5)"
    return f"""seqs AS ({s_small_corpus()}),
enc AS (
  SELECT source, doc_id, chunk_id, concat_ws(':', source, doc_id, chunk_id) AS k,
         list_concat([1], {ids}, [2]) AS ids
  FROM seqs),
pos AS (SELECT source, doc_id, chunk_id, k, unnest(ids) AS x, unnest(range(0, len(ids))) AS i FROM enc),
hp AS (SELECT *, CASE WHEN x NOT IN (0, 1, 2, 3) THEN md5(concat_ws(':', '{MASK_SEED}', k, i)) END AS h FROM pos)"""


def s_soft() -> str:
    return f"""{s_enc()},
d1 AS (SELECT *, (h IS NOT NULL AND {s_uh('h', 0)} < 0.15) AS sel FROM hp),
d2 AS (SELECT *, (sel AND {s_uh('h', 1)} < 0.8) AS rep FROM d1),
d3 AS (SELECT *, (sel AND NOT rep AND {s_uh('h', 2)} < 0.5) AS rnd,
              CAST(floor({s_uh('h', 3)} * 32) AS INTEGER) AS rid FROM d2),
d4 AS (SELECT *, CASE WHEN rep THEN 4 WHEN rnd THEN rid ELSE x END AS m,
              CASE WHEN sel THEN x ELSE -100 END AS l,
              CASE WHEN rep THEN 1 WHEN rnd THEN 2 WHEN sel THEN 3 WHEN h IS NOT NULL THEN 0 ELSE -1 END AS d
       FROM d3)"""


def s_hard() -> str:
    return f"""{s_enc()},
d1 AS (SELECT *, (h IS NOT NULL AND {s_uh('h', 0)} < 0.15) AS sel FROM hp),
d4 AS (SELECT *, CASE WHEN sel THEN 4 ELSE x END AS m, x AS l FROM d1)"""


def s_replaced() -> str:
    return f"""{s_hard()},
r1 AS (SELECT *, CASE WHEN m = 4 THEN md5(concat_ws(':', '{MASK_SEED}', 'r', k, i)) END AS h2 FROM d4),
r2 AS (SELECT *, CAST(floor({s_uh('h2', 0)} * 32) AS INTEGER) AS rid2 FROM r1),
r3 AS (SELECT *, CASE WHEN h2 IS NOT NULL THEN rid2 ELSE x END AS c,
              CASE WHEN h2 IS NOT NULL AND rid2 <> x THEN 1 ELSE 0 END AS y FROM r2)"""


def s_agg_lists(src: str, cols: dict) -> str:
    aggs = ", ".join(f"string_agg(CAST({e} AS VARCHAR), ',' ORDER BY i) AS {n}" for n, e in cols.items())
    return f"SELECT source, doc_id, chunk_id, {aggs} FROM {src} GROUP BY source, doc_id, chunk_id"


def s_bin_scores(src: str, by: str) -> str:
    grp = f"{by}, " if by else ""
    gb = f"GROUP BY {by}" if by else ""
    return f"""sc AS (SELECT {grp}count(*) AS n, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS accuracy,
       sum(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS tp,
       sum(CASE WHEN prediction = 1 THEN 1 ELSE 0 END) AS pp, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS ap
  FROM {src} {gb}),
sc2 AS (SELECT *, CASE WHEN pp <> 0 THEN tp / pp ELSE 0.0 END AS precision,
               CASE WHEN ap <> 0 THEN tp / ap ELSE 0.0 END AS recall FROM sc),
sc3 AS (SELECT *, CASE WHEN precision + recall <> 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END
               AS f1 FROM sc2)"""


PREDICTED = f"""{LAB_SH},
sp AS (SELECT *, CASE WHEN row_no < floor((SELECT count(*) FROM lab) * 0.8) THEN 'train' ELSE 'test' END AS split
       FROM lsh),
pr AS (SELECT *, CASE WHEN {s_u(17, 'doc_id')} < 0.2 THEN 1 - label ELSE label END AS prediction FROM sp)"""

EMB = f"""e AS (SELECT vec_id, label, CASE WHEN {s_u(31, 'vec_id')} < 0.3 THEN (label + 1) % 10 ELSE label END
                 AS prediction FROM embeddings),
cls AS (SELECT label AS c FROM e UNION SELECT prediction FROM e),
per AS (SELECT c, sum(CASE WHEN label = c THEN 1 ELSE 0 END) AS actual,
               sum(CASE WHEN prediction = c THEN 1 ELSE 0 END) AS predicted,
               sum(CASE WHEN label = c AND prediction = c THEN 1 ELSE 0 END) AS tp
        FROM cls, e GROUP BY c),
per2 AS (SELECT *, CASE WHEN predicted <> 0 THEN tp / predicted ELSE 0.0 END AS precision,
                CASE WHEN actual <> 0 THEN tp / actual ELSE 0.0 END AS recall FROM per),
per3 AS (SELECT *, CASE WHEN precision + recall <> 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END
                AS f1 FROM per2)"""

METRICS = """metrics AS (
  SELECT CAST(user_id AS VARCHAR) AS run_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step,
         value AS loss, 1.0 / (1.0 + value) AS accuracy FROM events)"""

SUMMARY = f"""{METRICS},
mm AS (SELECT *, loss - lag(loss) OVER (PARTITION BY run_id ORDER BY step) AS delta,
              CAST(row_number() OVER (PARTITION BY run_id ORDER BY step) - 1 AS DOUBLE) AS x FROM metrics),
summ AS (
  SELECT run_id, arg_max(loss, step) AS final_loss, arg_max(accuracy, step) AS final_accuracy,
         avg(loss) AS mean_loss, stddev_pop(loss) AS std_loss, avg(accuracy) AS mean_accuracy,
         stddev_pop(accuracy) AS std_accuracy, avg(delta) AS mean_loss_delta, stddev_pop(delta) AS std_loss_delta,
         regr_slope(loss, x) AS loss_trend_slope, count(*) AS n_steps
  FROM mm GROUP BY run_id),
bt AS (SELECT run_id, (step - 1) // 10 AS batch_id, avg(loss) AS l, avg(accuracy) AS a FROM metrics
       GROUP BY run_id, batch_id),
ev AS (SELECT run_id, avg(l) AS eval_loss, avg(a) AS eval_accuracy, count(*) AS n_batches FROM bt GROUP BY run_id),
obj AS (
  SELECT s.run_id,
         1.0 * coalesce(final_loss, 0) + 0.0 * coalesce(final_accuracy, 0) + 0.5 * coalesce(std_loss, 0)
         + 0.0 * coalesce(std_accuracy, 0) + 10.0 * coalesce(mean_loss_delta, 0) + 10.0 * coalesce(std_loss_delta, 0)
         + 1.0 * coalesce(eval_loss, 0) + 10.0 * coalesce(eval_accuracy, 0) AS objective
  FROM summ s JOIN ev USING (run_id))"""


def s_early(metric: str, patience: int, delta: float, mode: str) -> str:
    sign = "-" if mode == "min" else ""
    d = delta if mode == "min" else -delta
    return f"""es_m AS (SELECT run_id, step, CAST({metric} AS DOUBLE) AS v FROM metrics),
es(run_id, step, best, best_step, best_value, counter, stop_step) AS (
  SELECT run_id, step, {sign}v, CAST(step AS BIGINT), v, 0, CAST(NULL AS BIGINT) FROM es_m WHERE step = 1
  UNION ALL
  SELECT m.run_id, m.step,
         CASE WHEN r.stop_step IS NOT NULL OR {sign}m.v < r.best + ({d}) THEN r.best ELSE {sign}m.v END,
         CASE WHEN r.stop_step IS NOT NULL OR {sign}m.v < r.best + ({d}) THEN r.best_step ELSE m.step END,
         CASE WHEN r.stop_step IS NOT NULL OR {sign}m.v < r.best + ({d}) THEN r.best_value ELSE m.v END,
         CASE WHEN r.stop_step IS NOT NULL THEN r.counter
              WHEN {sign}m.v < r.best + ({d}) THEN r.counter + 1 ELSE 0 END,
         CASE WHEN r.stop_step IS NOT NULL THEN r.stop_step
              WHEN {sign}m.v < r.best + ({d}) AND r.counter + 1 >= {patience} THEN m.step END
  FROM es r JOIN es_m m ON m.run_id = r.run_id AND m.step = r.step + 1),
stops AS (SELECT run_id, arg_max(best_step, step) AS best_step, arg_max(best_value, step) AS best_value,
                 arg_max(stop_step, step) AS stop_step FROM es GROUP BY run_id)"""


def _oracle_batch3() -> dict[str, str]:
    r = "round"
    return {
        "mask_tokens": f"WITH {s_soft()} " + s_agg_lists("d4", {"masked": "m", "labels": "l"}),
        "mask_tokens_hard": f"WITH {s_hard()} " + s_agg_lists("d4", {"masked": "m", "labels": "l"}),
        "replace_random": f"WITH {s_replaced()} " + s_agg_lists("r3", {"corrupted": "c", "replaced": "y"}),
        "masking_audit": f"""WITH {s_soft()}
SELECT source, count(*) AS n_maskable, CAST(sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_selected,
       round(sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) / count(*), 6) AS share_selected,
       round(sum(CASE WHEN d = 1 THEN 1 ELSE 0 END) / sum(CASE WHEN d > 0 THEN 1 ELSE 0 END), 6) AS share_masked,
       round(sum(CASE WHEN d = 2 THEN 1 ELSE 0 END) / sum(CASE WHEN d > 0 THEN 1 ELSE 0 END), 6) AS share_random,
       round(sum(CASE WHEN d = 3 THEN 1 ELSE 0 END) / sum(CASE WHEN d > 0 THEN 1 ELSE 0 END), 6) AS share_kept
FROM d4 WHERE d >= 0 GROUP BY source""",
        "mlm_accuracy": f"""WITH {s_soft()},
pp AS (SELECT *, CASE WHEN {s_uh("md5(concat_ws(':', '23', k, i))")} < 0.3 THEN l + 1 ELSE l END AS p FROM d4)
SELECT source, round(avg(CASE WHEN p = l THEN 1.0 ELSE 0.0 END), 6) AS mlm_accuracy, count(*) AS n_masked
FROM pp WHERE m = 4 GROUP BY source""",
        "replaced_token_scores": f"""WITH {s_replaced()},
g AS (SELECT *, round(({s_uh("md5(concat_ws(':', '29', k, i))")} - 0.5) * 4.0) AS lg FROM r3 WHERE x <> 0),
g2 AS (SELECT *, (sign(lg) + 1.0) * 0.5 AS prd FROM g),
g3 AS (SELECT *, CAST(trunc(prd) AS INTEGER) AS pl FROM g2),
agg AS (SELECT source, avg(CASE WHEN prd = y THEN 1.0 ELSE 0.0 END) AS accuracy,
               sum(CASE WHEN pl = 1 AND y = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN pl = 1 THEN 1 ELSE 0 END) AS pp,
               sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS ap FROM g3 GROUP BY source)
SELECT source, round(accuracy, 6) AS accuracy, round(CASE WHEN pp <> 0 THEN tp / pp ELSE 0.0 END, 6) AS precision,
       round(CASE WHEN ap <> 0 THEN tp / ap ELSE 0.0 END, 6) AS recall FROM agg""",
        "binary_scores": f"""WITH {PREDICTED}, {s_bin_scores('pr', 'split')}
SELECT split, n, {r}(accuracy, 6) AS accuracy, {r}(precision, 6) AS precision, {r}(recall, 6) AS recall,
       {r}(f1, 6) AS f1 FROM sc3""",
        "class_scores": f"""WITH {EMB}
SELECT c AS label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM per3""",
        "multiclass_scores": f"""WITH {EMB}
SELECT round(sum(tp) / sum(actual), 6) AS accuracy, round(avg(f1), 6) AS macro_f1 FROM per3""",
        "regression_scores": f"""WITH d AS (SELECT doc_id, n_chars / 1000.0 AS label FROM documents),
p AS (SELECT *, label + {s_u(37, 'doc_id')} - 0.5 AS prediction FROM d)
SELECT round(avg(abs(prediction - label)), 6) AS mae, round(avg((prediction - label) * (prediction - label)), 6) AS mse,
       round(CASE WHEN var_pop(label) > 0 THEN 1 - avg((prediction - label) * (prediction - label)) / var_pop(label)
             ELSE 0.0 END, 6) AS r2 FROM p""",
        "eval_summary": f"""WITH {SUMMARY}
SELECT run_id, n_batches, round(eval_loss, 6) AS eval_loss, round(eval_accuracy, 6) AS eval_accuracy FROM ev""",
        "run_summary": f"""WITH {SUMMARY}
SELECT run_id, n_steps, round(final_loss, 6) AS final_loss, round(final_accuracy, 6) AS final_accuracy,
       round(mean_loss, 6) AS mean_loss, round(std_loss, 6) AS std_loss, round(mean_accuracy, 6) AS mean_accuracy,
       round(std_accuracy, 6) AS std_accuracy, round(mean_loss_delta, 6) AS mean_loss_delta,
       round(std_loss_delta, 6) AS std_loss_delta, round(loss_trend_slope, 6) AS loss_trend_slope FROM summ""",
        "run_objective": f"WITH {SUMMARY} SELECT run_id, round(objective, 6) AS objective FROM obj",
        "best_trial": f"""WITH {SUMMARY}
SELECT CAST(run_id AS BIGINT) AS trial_id, round(objective, 6) AS value FROM obj
ORDER BY objective, CAST(run_id AS BIGINT) LIMIT 1""",
        "early_stopping": f"""WITH RECURSIVE {METRICS}, {s_early('loss', 3, 0.0, 'min')}
SELECT run_id, best_step, round(best_value, 6) AS best_value, stop_step FROM stops""",
        "early_stopping_max": f"""WITH RECURSIVE {METRICS}, {s_early('accuracy', 4, 0.02, 'max')}
SELECT run_id, best_step, round(best_value, 6) AS best_value, stop_step FROM stops""",
        "selected_epoch_score": f"""WITH RECURSIVE {METRICS}, {s_early('loss', 3, 0.0, 'min')},
last AS (SELECT run_id, max(step) AS last_step, arg_max(loss, step) AS last_loss FROM metrics GROUP BY run_id),
pick AS (SELECT s.run_id, CASE WHEN stop_step IS NOT NULL OR best_value < last_loss THEN best_step ELSE last_step END
                AS selected_step FROM stops s JOIN last USING (run_id))
SELECT p.run_id, p.selected_step, round(m.accuracy, 6) AS score
FROM pick p JOIN metrics m ON m.run_id = p.run_id AND m.step = p.selected_step""",
        "cv_mean": f"""WITH {PREDICTED},
tr AS (SELECT *, ntile(5) OVER (ORDER BY row_no) - 1 AS fold FROM pr WHERE split = 'train'),
{s_bin_scores('tr', 'fold')}
SELECT 0 AS trial_id, round(avg(f1), 6) AS cv_score, count(*) AS n_folds FROM sc3""",
    }


PRETOKEN_RE2 = r"\p{Nd}|[\pL\p{Pc}]+|[^\pL\p{Nd}\p{Pc}\s]+"


def s_norm(t: str) -> str:
    return f"strip_accents(lower(trim({t}, chr(32) || chr(10))))"


def s_word_freq() -> str:
    return f"""SELECT word, count(*) AS freq FROM (
  SELECT unnest(regexp_extract_all({s_norm('text')}, '{PRETOKEN_RE2}')) AS word FROM documents) GROUP BY word"""


def s_vocab(size: int, min_frequency: int = 5) -> str:
    """CTE list ending in ``voc(token, token_id)``: greedy merges, one a step; every symbol stands between chr(1) and chr(2)."""
    both = "chr(1) || b.l || chr(2) || chr(1) || b.r || chr(2)"
    merged = "{0}.l || CASE WHEN {0}.r LIKE '##%' THEN {0}.r[3:] ELSE {0}.r END"
    # Some merges give a text that is a token already, so there are a few steps more than tokens.
    more = f"n + 1 <= {size} + 50 - {len(vocab.SPECIAL_TOKENS)} - (SELECT count(*) FROM al)"
    specials = ", ".join(f"'{t}'" for t in vocab.SPECIAL_TOKENS)
    return f"""wf AS MATERIALIZED ({s_word_freq()}),
ch AS MATERIALIZED (SELECT row_number() OVER () AS k, freq, list_transform(list_filter(string_split(word, ''), lambda c: c <> ''),
                           lambda c, i: CASE WHEN i = 1 THEN c ELSE '##' || c END) AS cs FROM wf),
al AS MATERIALIZED (SELECT t, {len(vocab.SPECIAL_TOKENS)} + row_number() OVER (ORDER BY length(t) > 1, t) - 1 AS id
                    FROM (SELECT DISTINCT unnest(cs) AS t FROM ch)),
st(k, n, s, freq, l, r) USING KEY (k) AS (
  SELECT k, 0, chr(1) || array_to_string(cs, chr(2) || chr(1)) || chr(2), freq, '', '' FROM ch
  UNION
  (WITH b AS (SELECT l, r FROM (SELECT freq, unnest(x[:-2]) AS l, unnest(x[2:]) AS r FROM
        (SELECT freq, string_split(s[2:-2], chr(2) || chr(1)) AS x FROM st WHERE k > 0))
      GROUP BY l, r HAVING sum(freq) >= {min_frequency} ORDER BY sum(freq) DESC, l, r LIMIT 1)
   SELECT k, n + 1, replace(s, {both}, chr(1) || {merged.format('b')} || chr(2)), freq, b.l, b.r FROM st, b WHERE k > 0 AND {more}
   UNION ALL SELECT DISTINCT -(n + 1), n + 1, '', 0, b.l, b.r FROM st, b WHERE k > 0 AND {more})),
made AS (
  SELECT unnest([{specials}]) AS token, unnest(range({len(vocab.SPECIAL_TOKENS)})) AS id
  UNION ALL SELECT t, id FROM al
  UNION ALL SELECT {merged.format('st')}, {len(vocab.SPECIAL_TOKENS) - 1} + (SELECT count(*) FROM al) + n FROM st WHERE k < 0),
voc AS MATERIALIZED (SELECT token, row_number() OVER (ORDER BY min(id)) - 1 AS token_id FROM made GROUP BY token ORDER BY 2 LIMIT {size})"""


def s_word_ids() -> str:
    """CTE list ending in ``wi(word, ids)``: the longest token at every start, walked from the first character."""
    return f"""{s_vocab(SMALL_VOCAB)},
fits AS (SELECT word, a.i AS a, max(e.i) AS e FROM (SELECT word FROM wf WHERE length(word) <= {vocab.MAX_WORD_CHARS}), LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i) a,
         LATERAL (SELECT unnest(range(a.i, length(word) + 1)) AS i) e
         JOIN voc ON token = CASE WHEN a.i = 1 THEN '' ELSE '##' END || substr(word, a.i, e.i - a.i + 1) GROUP BY word, a.i),
best AS MATERIALIZED (SELECT word, a, e, token_id FROM fits JOIN voc ON token = CASE WHEN a = 1 THEN '' ELSE '##' END || substr(word, a, e - a + 1)),
walk(word, a, ids) AS (
  SELECT word, 1::BIGINT, []::BIGINT[] FROM wf
  UNION ALL SELECT w.word, b.e + 1, list_append(w.ids, b.token_id) FROM walk w JOIN best b ON b.word = w.word AND b.a = w.a),
wi AS MATERIALIZED (SELECT wf.word, wf.freq, coalesce(w.ids, [{vocab.UNK_ID}]) AS ids FROM wf LEFT JOIN walk w ON w.word = wf.word AND w.a = length(wf.word) + 1)"""


def s_encoded() -> str:
    return f"""WITH RECURSIVE {s_word_ids()},
seqs AS ({s_small_corpus()}),
tk AS (SELECT source, doc_id, chunk_id, regexp_extract_all({s_norm('sequence')}, '{PRETOKEN_RE2}') AS ws FROM seqs),
tp AS (SELECT source, doc_id, chunk_id, unnest(ws) AS word, unnest(range(len(ws))) AS p FROM tk),
ti AS (SELECT source, doc_id, chunk_id, flatten(list(ids ORDER BY p)) AS ids FROM tp JOIN wi USING (word) GROUP BY source, doc_id, chunk_id),
al2 AS (SELECT source, doc_id, chunk_id, list_concat([1], list_slice(coalesce(ids, []), 1, {ENCODE_LEN - 2}), [2]) AS ids
        FROM tk LEFT JOIN ti USING (source, doc_id, chunk_id))
SELECT source, doc_id, chunk_id, array_to_string(list_resize(ids, {ENCODE_LEN}, 0), ',') AS input_ids, len(ids)::INTEGER AS n_tokens FROM al2"""


def s_charids(x: str, length: int) -> str:
    chars = f"list_filter(string_split({x}, ''), lambda c: c <> '')"
    ids = f"list_transform({chars}, lambda c: (unicode(c) % 27) + 5)"
    return f"list_resize(list_concat([1], list_slice({ids}, 1, {length - 2}), [2]), {length}, 0)"


def _oracle_batch4() -> dict[str, str]:
    zeros = ",".join(["0"] * DOC_SEQ_LEN)
    vectors = f"""SELECT vec_id // 8 AS doc_id, vec_id % 8 AS k, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
       WHERE vec_id % 8 < {POOL_SEQS}"""
    ranked = f"""SELECT st.doc_id, st.seq_idx AS k, CAST(e.embedding AS DOUBLE[]) AS x FROM st
       JOIN embeddings e ON e.vec_id = (st.doc_id * {POOL_SEQS} + st.seq_idx) % (SELECT count(*) FROM embeddings)
       WHERE st.seq_idx < {POOL_SEQS}"""
    pool = f"""v AS ({vectors}),
n AS (SELECT doc_id, count(*) AS n FROM v GROUP BY doc_id),
q AS (SELECT n.doc_id, t.q FROM n CROSS JOIN range({POOL_SEQS}) t(q)),
qv AS (SELECT q.doc_id, q.q, v.x AS qx FROM q LEFT JOIN v ON v.doc_id = q.doc_id AND v.k = q.q),
sc AS (SELECT qv.doc_id, qv.q, v.k, v.x, coalesce(list_inner_product(qv.qx, v.x), 0.0) / sqrt({EMB_DIM}) AS s
       FROM qv JOIN v ON v.doc_id = qv.doc_id),
w AS (SELECT *, exp(s - max(s) OVER (PARTITION BY doc_id, q)) AS e FROM sc),
w2 AS (SELECT *, e / sum(e) OVER (PARTITION BY doc_id, q) AS a FROM w),
kw AS (SELECT doc_id, k, sum(a) AS weight, any_value(x) AS x FROM w2 GROUP BY doc_id, k)"""
    return {
        "normalize_text": f"SELECT doc_id, {s_norm('text')} AS text FROM documents",
        "pretokenize": "WITH d AS (SELECT doc_id, " + s_norm("text") + " AS t FROM documents) "
                       + s_explode(f"regexp_extract_all(t, '{PRETOKEN_RE2}')", "d", val="token"),
        "word_frequencies": s_word_freq(),
        "learn_vocabulary_small": f"WITH RECURSIVE {s_vocab(SMALL_VOCAB)} SELECT token, token_id::INTEGER AS token_id FROM voc",
        **dict.fromkeys(("encode_words", "encode_words_join"),
                        f"WITH RECURSIVE {s_word_ids()} SELECT word, freq, array_to_string(ids, ',') AS ids FROM wi"),
        "vocab_lookup": f"""WITH RECURSIVE {s_vocab(SMALL_VOCAB)}
SELECT word, freq, coalesce(token_id, {vocab.UNK_ID})::INTEGER AS token_id FROM wf LEFT JOIN voc ON token = word""",
        **dict.fromkeys(("encode_sequences", "encode_sequences_join"), s_encoded()),
        "pad_truncate": f"""WITH seqs AS ({s_small_corpus()})
SELECT source, doc_id, chunk_id, array_to_string({s_charids('sequence', PAD_LEN)}, ',') AS ids FROM seqs""",
        "pad_documents": f"""WITH {LAB},
s AS ({s_explode(s_simple_split('text'), 'lab', idx='seq_idx')}),
e AS (SELECT doc_id, seq_idx, {s_charids('sentence', DOC_SEQ_LEN)} AS ids FROM s WHERE seq_idx < {DOC_SEQS}),
g AS (SELECT doc_id, list(array_to_string(ids, ',') ORDER BY seq_idx) AS l, count(*) AS n FROM e GROUP BY doc_id)
SELECT doc_id, array_to_string(list_concat(l, list_resize([]::VARCHAR[], {DOC_SEQS} - n, '{zeros}')), '|')
       AS input_ids,
       array_to_string(list_concat(list_resize([]::INTEGER[], n, 1), list_resize([]::INTEGER[], {DOC_SEQS} - n, 0)),
                       ',') AS sequence_mask FROM g""",
        "attention_pool": f"""WITH {pool},
kd AS (SELECT doc_id, k, weight, unnest(x) AS xv, unnest(range(0, len(x))) AS d FROM kw),
dv AS (SELECT doc_id, d, sum(weight * xv) / {POOL_SEQS} AS val FROM kd GROUP BY doc_id, d)
SELECT dv.doc_id, n.n AS n_sequences, round(sum(val), 5) AS vec_sum, round(sqrt(sum(val * val)), 5) AS vec_norm
FROM dv JOIN n USING (doc_id) GROUP BY dv.doc_id, n.n""",
        "rank_sentences": f"""WITH st AS ({s_explode(s_simple_split('text'), 'documents', idx='seq_idx')}),
{pool.replace(vectors, ranked)},
rk AS (SELECT doc_id, CAST(k AS INTEGER) AS seq_idx, weight,
              row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, k) AS rank FROM kw)
SELECT rk.doc_id, rk.rank, rk.seq_idx, st.sentence, round(rk.weight, 5) AS weight
FROM rk JOIN st ON st.doc_id = rk.doc_id AND st.seq_idx = rk.seq_idx""",
    }

def s_sampled(mode: str) -> str:
    u_gen = s_u(41, "k", "i", "t.tok")
    cand = f"""{s_soft()},
mp AS (SELECT source, doc_id, chunk_id, k, i FROM d4 WHERE m = 4),
cand AS (SELECT mp.*, t.tok, {u_gen} * 4.0 - 2.0 AS logit FROM mp CROSS JOIN range({si.CHAR_VOCAB}) t(tok))"""
    grp = "source, doc_id, chunk_id, i"
    if mode == "multinomial":
        u_pos = s_u(43, "k", "i")
        draw = f"""e AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY {grp})) AS e FROM cand),
c AS (SELECT *, sum(e) OVER (PARTITION BY {grp} ORDER BY tok ROWS UNBOUNDED PRECEDING) AS c,
             sum(e) OVER (PARTITION BY {grp}) AS tt, {u_pos} AS u FROM e),
dr AS (SELECT {grp}, coalesce(min(CASE WHEN c >= u * tt THEN tok END), max(tok)) AS s FROM c GROUP BY {grp})"""
    else:
        u_g = s_u(43, "k", "i", "tok")
        score = "logit" if mode == "aggressive" else f"logit - ln(-ln({u_g} + {0.5 / 4503599627370496.0}))"
        draw = f"dr AS (SELECT {grp}, first(tok ORDER BY {score} DESC, tok) AS s FROM cand GROUP BY {grp})"
    return f"""WITH {cand},
{draw},
z AS (SELECT d4.*, dr.s FROM d4 LEFT JOIN dr USING (source, doc_id, chunk_id, i))
{s_agg_lists('z', {'disc': 'coalesce(s, m)', 'labels': 'CASE WHEN s IS NOT NULL AND s <> x THEN 1 ELSE 0 END'})}"""

def s_chunk_corpus_stream() -> str:
    """ST1 oracle: the small-profile chunk job without the transcript dedupe."""
    sql = s_chunk_corpus(SMALL_PROFILES, SMALL_WORDS)
    return sql.replace("calls_d AS (SELECT min(doc_id) AS doc_id, source, text FROM docs_in WHERE source = 'calls' "
                       "GROUP BY source, text)",
                       "calls_d AS (SELECT doc_id, source, text FROM docs_in WHERE source = 'calls')")


def _own_oracle_sql() -> dict[str, str]:
    return {
        "chunk_corpus": s_chunk_corpus(ch.DEFAULT_PROFILES, CHUNK_WORDS),
        "chunk_corpus_small": s_chunk_corpus(SMALL_PROFILES, SMALL_WORDS),
        "scan_source": f"WITH {DOCS_IN} SELECT doc_id, source, text FROM docs_in",
        "scan_distinct": f"WITH {DOCS_IN} SELECT min(doc_id) AS doc_id, text FROM docs_in "
                         "WHERE source = 'calls' GROUP BY text",
        "count_documents": f"WITH {DOCS_IN} SELECT source, count(*) AS n_documents FROM docs_in GROUP BY source",
        **_oracle_batch2(),
        **_oracle_batch3(),
        **_oracle_batch4(),
        # The streams and the sink give the batch answers, so they share the batch oracles.
        "stream_chunk": s_chunk_corpus_stream(),
        "stream_chunk_distinct": s_small_corpus(),
        "stream_early_stopping": f"""WITH RECURSIVE {METRICS}, {s_early('loss', 3, 0.0, 'min')}
SELECT run_id, best_step, round(best_value, 6) AS best_value, stop_step FROM stops""",
        "write_chunks": s_small_corpus(),
        "build_corpus": f"WITH {s_shuffled()} SELECT source, doc_id, chunk_id, row_no FROM sh",
        "replace_sampled": s_sampled("aggressive"),
        "replace_sampled_gumbel": s_sampled("gumbel_softmax"),
        "replace_sampled_multinomial": s_sampled("multinomial"),
    }


def oracle_sql() -> dict[str, str]:
    return _own_oracle_sql() | (training_data.oracle_sql() if training_data else {})
