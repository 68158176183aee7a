"""Ordered operators: row numbering, shuffles, epoch windows, batches, splits, folds,
sampling and row selection (R1-R4, W1-W4, J2, J5).

Row numbering at scale
----------------------
``row_number()`` over a window partitioned by ``source`` sends each source to a
single task; with one source holding a third of 74 M chunks that task sorts
tens of GB alone. ``index_rows`` numbers rows in two levels computed from data
values only: a *block* number that does not fall along the order splits every
group into about B balanced blocks; ``row_number()`` runs per (group, block);
each block's offset comes from a count table of #groups x B rows (AQE
broadcasts it by measured size). For hash-uniform orders the block is
``floor(u * B)``; for others it is the row's place among B bounds sampled over the
whole order tuple, so a constant or hot leading column is split by the columns after
it. The bounds are a scalar subquery: nothing runs while a plan is built.
Nothing depends on physical partition ids, so recomputation after an
executor loss -- or two plan branches that read the input separately -- give
identical numbers. The order must be a total order (callers append unique ids).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.random import hash_uniform

# Offset rows (sources x blocks) that are sent to all tasks.
MAX_OFFSETS = 1_000_000
STRIPE_ROWS = 250_000


def _num_blocks(df: DataFrame, num_blocks: int | None) -> int:
    if num_blocks:
        return int(num_blocks)
    return max(64, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def uniform_block(u: Column, num_blocks: int) -> Column:
    """Block key for orders led by a uniform in [0, 1)."""
    return F.least(F.floor(u * num_blocks), F.lit(num_blocks - 1)).cast("int")


def index_rows(df: DataFrame, order: list, by: list[str] | tuple = (), out: str = "row_no",
               start: int = 0, block: Column | None = None, num_blocks: int | None = None) -> DataFrame:
    """Add ``out`` = 0-based (or ``start``-based) position of each row in ``order``
    within its ``by`` group. ``order`` (names or Columns, ``.desc()`` and null placement
    included) must make rows unique within a group; ``block`` (optional) must be
    non-decreasing along ``order``; without it the blocks are cut at bounds sampled over the whole order."""
    by = list(by)
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    if block is None:
        b = with_sampled_block(df, order_cols, _num_blocks(df, num_blocks))
    else:
        b = df.withColumn("_blk", block)
    b = b.withColumn("_grp", _group_key(by))
    ranked = b.withColumn("_r", F.row_number().over(Window.partitionBy("_grp", "_blk").orderBy(*order_cols)) - 1)
    return (ranked.join(_block_offsets(b), ["_grp", "_blk"])
            .withColumn(out, (F.col("_off") + F.col("_r") + F.lit(start)).cast("long"))
            .drop("_grp", "_blk", "_r", "_off"))


def _group_key(by: list[str]) -> Column:
    """The group columns as one struct, in which nulls are equal (a join on the bare columns would lose them)."""
    return F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0))


def _block_offsets(blocked: DataFrame) -> DataFrame:
    """(``_grp``, ``_blk``, ``_off``): rows of the group before each block."""
    counts = blocked.groupBy("_grp", "_blk").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("_grp").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")


def _sort_part(c: Column) -> tuple[Column, bool, bool]:
    """(key, descending, nulls first) of an order column."""
    node = c._jc.node()
    if node.getClass().getSimpleName() != "SortOrder":
        return c, False, True
    key = type(c)(SparkSession.active()._jvm.org.apache.spark.sql.Column(node.child()))
    return key, node.sortDirection().toString().startswith("org.apache.spark.sql.internal.SortOrder$Descending"), \
        "NullsFirst" in node.nullOrdering().toString()


def _at_or_before(b: Column, r: Column, parts: list) -> Column:
    """Whether the key struct ``b`` does not come after ``r``, field by field."""
    res = F.lit(True)
    for i, (_, descending, nulls_first) in reversed(list(enumerate(parts))):
        x, y = b[f"k{i}"], r[f"k{i}"]
        res = F.when(x.eqNullSafe(y), res).when(x.isNull(), F.lit(nulls_first)).when(y.isNull(), F.lit(not nulls_first)) \
            .otherwise(x > y if descending else x < y)
    return res


def _count_before(bounds: Column, r: Column, most: int, at_or_before) -> Column:
    """How many of the ordered ``bounds`` (at most ``most``) do not come after ``r``: a binary search."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, most).bit_length()))])

    def step(n, width):
        fits = (n + width <= F.size(bounds)) & at_or_before(F.get(bounds, n + width - 1), r)
        return n + F.when(fits, width).otherwise(0)

    return F.aggregate(steps, F.lit(0), step)


def with_sampled_block(df: DataFrame, order: list[Column], num_blocks: int, out: str = "_blk") -> DataFrame:
    """Add the block number of a row: how many of the sampled bounds lie at or before it in ``order``.

    About 20 rows' keys per block, picked by their hash, are sorted in a scalar subquery, and every
    twentieth is a bound. Equal keys are one key."""
    parts = [_sort_part(c) for c in order]
    row = F.struct(*[c.alias(f"k{i}") for i, (c, _, _) in enumerate(parts)])
    keys = df.select(row.alias("k"))
    share = F.least(F.lit(1.0), F.lit(20.0 * num_blocks) / F.greatest(keys.agg(F.count(F.lit(1))).scalar(), F.lit(1)))
    picked = keys.where(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < share * (1 << 30))

    def compare(a, b):
        return F.when(_at_or_before(a, b, parts), F.when(_at_or_before(b, a, parts), 0).otherwise(-1)).otherwise(1)

    sample = picked.agg(F.array_sort(F.collect_set("k"), compare).alias("s"))
    places = F.transform(F.sequence(F.lit(1), F.lit(num_blocks)), lambda i: F.floor(i * F.size("s") / num_blocks).cast("int"))
    bounds = sample.select(F.transform(places, lambda i: F.get("s", i)).alias("b")).select(F.filter("b", lambda x: x.isNotNull()))
    staged = df.withColumn("_bounds", bounds.scalar()).withColumn("_key", row)
    at = _count_before(F.col("_bounds"), F.col("_key"), num_blocks, lambda b, r: _at_or_before(b, r, parts))
    return staged.withColumn(out, at).drop("_bounds", "_key")


def shuffle_sequences(seqs: DataFrame, seed: int = 0, key: tuple = ("doc_id", "chunk_id"),
                      by: str = "source") -> DataFrame:
    """Seeded shuffle of each chunk table; ``row_no`` is the new 0-based row
    position within its source (the reference's ``ORDER BY RANDOM()`` into a new
    table). Write the result sorted by (source, row_no) so later epoch windows
    are range predicates that skip row groups."""
    u = hash_uniform(seed, *[F.col(k) for k in key])
    nb = _num_blocks(seqs, None)
    return index_rows(seqs.withColumn("_u", u), ["_u", *key], by=[by],
                      block=uniform_block(F.col("_u"), nb), num_blocks=nb).drop("_u")


def shuffle_into_stripes(seqs: DataFrame, seed: int = 0, key: tuple = ("doc_id", "chunk_id"), by: str = "source",
                         stripes: int | None = None) -> DataFrame:
    """R1 for writing: ``shuffle_sequences`` with the same ``row_no``, dealt once and sorted.

    A stripe is a run of blocks, so it holds consecutive row numbers. Texts are exchanged once, by (source, stripe); the
    numbering window and the write find the rows where they lie, in order. The blocks' offsets come from a pass
    over the keys alone."""
    nb = _num_blocks(seqs, None)
    # Files of some STRIPE_ROWS rows, and work for half of the cores at least.
    n = min(nb, stripes or max(seqs.sparkSession.sparkContext.defaultParallelism // 2, -(-seqs.count() // STRIPE_ROWS), 1))
    u = hash_uniform(seed, *[F.col(k) for k in key])

    def blocked(df: DataFrame) -> DataFrame:
        return df.withColumn("_u", u).withColumn("_blk", uniform_block(F.col("_u"), nb)).withColumn("_grp", _group_key([by]))

    offsets = _block_offsets(blocked(seqs.select(by, *key)))
    dealt = blocked(seqs).withColumn("stripe", F.floor(F.col("_blk") * n / nb).cast("int")).repartition("_grp", "stripe")
    place = F.row_number().over(Window.partitionBy("_grp", "stripe", "_blk").orderBy("_u", *key)) - 1
    ranked = dealt.withColumn("_r", place)
    # One row per source and block: at most MAX_OFFSETS of them are broadcast, so the texts stay where they are.
    small = offsets.limit(MAX_OFFSETS + 1).count() <= MAX_OFFSETS
    return (ranked.join(F.broadcast(offsets) if small else offsets, ["_grp", "_blk"])
            .withColumn("row_no", (F.col("_off") + F.col("_r")).cast("long"))
            .drop("_u", "_grp", "_blk", "_r", "_off"))


def shuffle_labelled(df: DataFrame, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """Seeded shuffle of a labelled set; ``row_no`` = new position."""
    nb = _num_blocks(df, None)
    return index_rows(df.withColumn("_u", hash_uniform(seed, F.col(key))), ["_u", key],
                      block=uniform_block(F.col("_u"), nb), num_blocks=nb).drop("_u")


def source_totals(seqs: DataFrame, by: str = "source") -> DataFrame:
    """S6 as a lookup: rows per source (one row per source)."""
    return seqs.groupBy(by).agg(F.count(F.lit(1)).alias("n_total"))


def epoch_window(seqs: DataFrame, retrieval: DataFrame, epoch: int, wrap: str = "reference",
                 by: str = "source", totals: DataFrame | None = None) -> DataFrame:
    """W1 + J5: rows ``[offset, offset + limit)`` of each source for ``epoch``.

    ``retrieval`` has ``source, limit``. offset = epoch * limit; with
    ``wrap="reference"`` the offset falls back to 0 once ``2 * offset > n_total``
    (quirk Q4); ``wrap="full"`` goes through all rows and then on from the start, so
    a window may hold the last rows and the first ones.

    Limits and totals (one row per source; ``totals`` is ``source_totals`` kept from
    the write, else it is counted here) come to the driver, and the window becomes
    literal ranges: on a stored table the source reaches the partition filters and the
    row numbers the row-group statistics, so an epoch reads its own rows only."""
    rows = retrieval.join(source_totals(seqs, by) if totals is None else totals, by).select(by, "limit", "n_total").collect()
    wanted = F.lit(False)
    for r in sorted(rows, key=lambda r: str(r[by])):
        limit, n = int(r["limit"]), int(r["n_total"])
        lo = epoch * limit
        if wrap == "reference":
            ranges = [(0 if 2 * lo > n else lo, (0 if 2 * lo > n else lo) + limit)]
        elif limit >= n:
            ranges = [(0, n)]
        else:
            lo %= n
            ranges = [(lo, min(n, lo + limit)), (0, max(0, lo + limit - n))]
        for a, b in ranges:
            if a < b:
                wanted = wanted | ((F.col(by) == r[by]) & (F.col("row_no") >= F.lit(a)) & (F.col("row_no") < F.lit(b)))
    return seqs.where(wanted)


def planned_steps(retrieval: DataFrame, batch_size: int, n_epochs: int) -> DataFrame:
    """Steps per epoch = ceil(sum(limit) / batch_size) (requested limits, not
    rows found) and the total over ``n_epochs``."""
    per_epoch = F.ceil(F.sum("limit") / F.lit(batch_size)).cast("long")
    return retrieval.agg(per_epoch.alias("steps_per_epoch")) \
        .withColumn("total_steps", F.col("steps_per_epoch") * F.lit(n_epochs))


def batch_plan(window: DataFrame, batch_size: int, seed: int, epoch: int,
               steps_per_epoch: int | Column, key: tuple = ("source", "doc_id", "chunk_id")) -> DataFrame:
    """W2 + R2: mix an epoch's rows across sources (seeded), number them, and cut
    consecutive batches of ``batch_size`` (the last may be partial).
    ``global_step`` = epoch * steps_per_epoch + batch_id + 1."""
    u = hash_uniform(seed, epoch, *[F.col(k) for k in key])
    nb = _num_blocks(window, None)
    pos = index_rows(window.withColumn("_u", u), ["_u", *key], out="_pos",
                     block=uniform_block(F.col("_u"), nb), num_blocks=nb).drop("_u")
    out = pos.withColumn("epoch", F.lit(epoch)).withColumn("batch_id", (F.col("_pos") / batch_size).cast("int"))
    spe = steps_per_epoch if isinstance(steps_per_epoch, Column) else F.lit(int(steps_per_epoch))
    step = (F.lit(epoch) * spe + F.col("batch_id") + 1).cast("long")
    return out.withColumn("global_step", step).withColumnRenamed("_pos", "position")


def _positions(df: DataFrame, order: list, index: str | None) -> DataFrame:
    """``_i``: the dense 0-based column ``index`` where the rows have one, else their place in ``order``."""
    return index_rows(df, order, out="_i") if index is None else df.withColumn("_i", F.col(index))


def train_test_split(df: DataFrame, fraction: float, order: list, index: str | None = None) -> DataFrame:
    """Contiguous split -- the first ``int(n * fraction)`` rows (in ``order``)
    are train, the rest test. ``n`` is a scalar subquery (one value, no join). A stored dense row
    number (from 0, in ``order``) can be named as ``index``; then nothing is numbered or shuffled."""
    idx = _positions(df, order, index)
    n = df.agg(F.count(F.lit(1))).scalar()  # scalar subquery: one value, no join
    cut = F.floor(n * F.lit(fraction))
    return idx.withColumn("split", F.when(F.col("_i") < cut, "train").otherwise("test")).drop("_i")


def kfold(df: DataFrame, k: int, order: list, index: str | None = None) -> DataFrame:
    """Contiguous, unshuffled k-fold; the first ``n mod k`` folds get one extra
    row (the ``ntile`` rule). ``fold`` = 0-based validation fold of the row; ``index`` as in the split."""
    idx = _positions(df, order, index)
    n = df.agg(F.count(F.lit(1))).scalar()
    q = (n / k).cast("long")
    r = n % k
    big = r * (q + 1)
    fold = F.when(F.col("_i") < big, (F.col("_i") / (q + 1)).cast("long")) \
        .otherwise(r + ((F.col("_i") - big) / F.greatest(q, F.lit(1))).cast("long"))
    return idx.withColumn("fold", fold.cast("int")).drop("_i")


def sample_with_replacement(df: DataFrame, n: int, seed: int, order: list, index: str | None = None,
                            num_blocks: int | None = None) -> DataFrame:
    """``n`` draws with replacement; draw i takes row ``floor(u_i * N)`` in
    ``order`` (exclusive upper bound -- quirk Q7 fixed). Draws are generated by
    ``spark.range``, so nothing passes the driver.

    Two stages: the draws are allotted to blocks of the order by the blocks' counts, then picked inside the blocks
    that got some; rows of other blocks are counted, never numbered. With a dense ``index`` it is one join."""
    total = df.agg(F.count(F.lit(1))).scalar()
    draws = (df.sparkSession.range(n).withColumnRenamed("id", "draw")
             .withColumn("_i", F.floor(hash_uniform(seed, F.col("draw")) * total).cast("long")))
    if index is not None:
        return draws.join(df.withColumn("_i", F.col(index)), "_i").drop("_i")
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    blocks = _num_blocks(df, num_blocks)
    b = with_sampled_block(df, order_cols, blocks)
    # The blocks' offsets: one sorted array of at most as many entries as there are blocks.
    offsets = _block_offsets(b.withColumn("_grp", _group_key([]))).agg(F.sort_array(F.collect_list(F.struct(F.col("_off").alias("o"), F.col("_blk").alias("b"))))).scalar()
    at = _count_before(F.col("_o"), F.col("_i"), blocks + 1, lambda x, i: x["o"] <= i)
    allotted = draws.withColumn("_o", offsets).withColumn("_n", at).withColumn("_at", F.get("_o", F.col("_n") - 1)).select(
        "draw", F.col("_at.b").alias("_blk"), (F.col("_i") - F.col("_at.o")).alias("_r"))
    hit = b.join(allotted.select("_blk").distinct(), "_blk", "left_semi")
    ranked = hit.withColumn("_r", (F.row_number().over(Window.partitionBy("_blk").orderBy(*order_cols)) - 1).cast("long"))
    return allotted.join(ranked, ["_blk", "_r"]).drop("_blk", "_r")


def select_rows(df: DataFrame, indices: DataFrame, index_col: str = "row_no") -> DataFrame:
    """Rows whose index appears in ``indices`` (left-semi join: duplicates in
    ``indices`` do not multiply rows)."""
    return df.join(indices.select(index_col), index_col, "left_semi")
