"""Pretraining feed plan: epoch window -> encode -> batches -> masking, ending
where a trainer would read (one parquet table per epoch)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.masking import mask_tokens_arrow
from ..operators.ordering import batch_plan, epoch_window, planned_steps
from ..operators.vocab import encode_sequences


def epoch_feed(seqs: DataFrame, retrieval: DataFrame, vocab: DataFrame, epoch: int, batch_size: int,
               max_length: int, seed: int = 0, p: float = 0.15, n_tokens: int | None = None,
               n_epochs: int = 1, totals: DataFrame | None = None) -> DataFrame:
    """One epoch of training rows: ``source, doc_id, chunk_id, epoch, batch_id,
    global_step, input_ids, token_type_ids, attention_mask, masked_ids, labels``. ``totals``: those of the
    table's manifest, so that nothing is counted."""
    win = epoch_window(seqs, retrieval, epoch, totals=totals)
    spe = planned_steps(retrieval, batch_size, n_epochs).select("steps_per_epoch").scalar()
    batches = batch_plan(win, batch_size, seed, epoch, spe)
    enc = encode_sequences(batches, vocab, max_length)
    key = F.concat_ws(":", F.lit(epoch), "source", "doc_id", "chunk_id")
    n = n_tokens if n_tokens is not None else vocab.count()
    return mask_tokens_arrow(enc.withColumn("row_key", key), seed=seed, p=p, n_tokens=n).drop("row_key")
