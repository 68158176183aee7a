"""Array helpers: safe explode, template/pad/truncate (X13, X14), per-document
padding (X15) and the maskable-id set (X16)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def posexplode_rows(arr: Column | str) -> Column:
    """``posexplode`` over an array column that was computed upstream.

    For a bare column Spark infers ``size(arr) > 0`` and pushes that predicate
    below the projections that build the array, inlining (and re-running) the
    whole array pipeline inside a Filter. Exploding an expression (here a
    ``coalesce`` with the empty array, which yields the same rows) keeps the
    plan to one evaluation per row (the identity ``filter`` is that expression;
    NULL arrays still give no rows)."""
    c = F.col(arr) if isinstance(arr, str) else arr
    return F.posexplode(F.filter(c, lambda x: F.lit(True)))


def with_template(ids: Column, first_id: int = 1, last_id: int = 2) -> Column:
    """``[seq] ids [/seq]``."""
    return F.concat(F.array(F.lit(first_id)), ids, F.array(F.lit(last_id)))


def pad_truncate(ids: Column, max_length: int, first_id: int = 1, last_id: int = 2, pad_id: int = 0) -> Column:
    """X13 + X14: keep at most ``max_length - 2`` content ids, wrap in the two
    specials, right-pad with ``pad_id`` to exactly ``max_length``."""
    body = F.slice(ids, 1, max_length - 2)
    seq = with_template(body, first_id, last_id)
    return F.concat(seq, F.array_repeat(F.lit(pad_id), F.lit(max_length) - F.size(seq)))


def never_masked(special_ids=(0, 1, 2, 3, 4), mask_id: int = 4) -> Column:
    """The ids never selected for masking = specials minus the mask id."""
    return F.array_except(F.array(*[F.lit(i) for i in special_ids]), F.array(F.lit(mask_id)))
