"""Operator 8: secret scan (DataFrame functions only).

Three fixed patterns give the base spans; a sliding window of Shannon entropy
over long unbroken strings adds the ones that no pattern knows.

Positions come from two linear passes of one pattern: ``split`` gives the gaps
and ``regexp_extract_all`` the matches between them, so a running sum of their
lengths gives every start and end in code points without a marker character
that a text could hold itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import table, whole_text

# The three base patterns, their least lengths and their order.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "entropy")
MIN_ASSIGN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24

# Symbols that a key may be made of; the first sixteen are the hexadecimal ones.
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
# Strings that look random and are not secret: identifiers, dates, letters only, digits only,
# one symbol repeated, placeholders.
ALLOWED = (
    r"^(?:[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
    r"|[A-Za-z/_=-]+|[0-9/_=+-]+|(.)\1+)$"
    r"|(?i:example|placeholder|changeme|dummy|xxxxxx|lorem)"
)


def _spans(text: Column, pattern: str, least: int, kind: int, value_group: bool = False) -> Column:
    """array<struct<start,kind,end>> of the matches of ``pattern`` that are long enough."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2 if value_group else 0))
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")

    def step(acc, x):
        start = acc["pos"] + F.char_length(x["gap"])
        end = start + F.char_length(x["hit"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.when(x["hit"].isNull(), acc).otherwise(F.struct(
            end.cast("bigint").alias("pos"),
            F.when(F.char_length(x["val"]) >= least, F.concat(acc["out"], F.array(span)))
            .otherwise(acc["out"]).alias("out"),
        ))

    parts = F.arrays_zip(gaps.alias("gap"), found.alias("hit"), values.alias("val"))
    walked = F.aggregate(parts, F.struct(F.lit(0).cast("bigint").alias("pos"), empty.alias("out")), step)
    return F.when(F.regexp_like(text, F.lit(pattern)), walked["out"]).otherwise(empty)


def _hot_range(candidate: Column, window: int, hex_bits: float, mixed_bits: float) -> Column:
    """struct<lo,hi>: first start and last end of the windows with high entropy; null without one.

    One pass over the symbols. The state keeps the count of every symbol in the
    window and the sum of c*log2(c); a step adds the new symbol and takes away the
    one that leaves, so a window costs the same whatever its width.
    """
    idx = F.transform(F.regexp_extract_all(candidate, F.lit("."), F.lit(0)), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    pairs = F.arrays_zip(idx.alias("add"), F.concat(F.array_repeat(F.lit(-1), window), idx).alias("drop"))
    term = lambda c: F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))
    inside = lambda v, lo, hi: F.when((v >= lo) & (v < hi), 1).otherwise(0)
    start = F.struct(
        F.lit(0).alias("n"), F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("sum"),
        F.lit(0).alias("hexes"), F.lit(0).alias("digits"), F.lit(0).alias("letters"),
        F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"),
    )

    def step(acc, x):
        add, drop = x["add"], x["drop"]
        leaves = drop >= 0
        c_drop = F.when(leaves, F.get(acc["counts"], drop)).otherwise(F.lit(0))
        s1 = acc["sum"] - F.when(leaves, term(c_drop) - term(c_drop - 1)).otherwise(F.lit(0.0))
        c_add = F.get(acc["counts"], add) - F.when(add == drop, 1).otherwise(0)
        total = s1 - term(c_add) + term(c_add + 1)
        counts = F.transform(
            acc["counts"],
            lambda v, j: v + F.when(j == add, 1).otherwise(0) - F.when(j == drop, 1).otherwise(0),
        )
        n = acc["n"] + 1
        hexes = acc["hexes"] + inside(add, 0, 16) - inside(drop, 0, 16)
        digits = acc["digits"] + inside(add, 0, 10) - inside(drop, 0, 10)
        letters = acc["letters"] + inside(add, 10, 62) - inside(drop, 10, 62)
        bits = F.log2(F.lit(float(window))) - total / F.lit(float(window))
        hot = (n >= window) & (digits >= 2) & (letters >= 2) & F.when(
            hexes == window, bits >= hex_bits).otherwise(bits >= mixed_bits)
        return F.struct(
            n.alias("n"), counts.alias("counts"), total.alias("sum"), hexes.alias("hexes"),
            digits.alias("digits"), letters.alias("letters"),
            F.when(hot & acc["lo"].isNull(), n - window).otherwise(acc["lo"]).alias("lo"),
            F.when(hot, n).otherwise(acc["hi"]).alias("hi"),
        )

    real = F.filter(pairs, lambda x: x["add"].isNotNull())
    out = F.aggregate(real, start, step)
    return F.struct(out["lo"].alias("lo"), out["hi"].alias("hi"))


def _entropy_spans(text: Column, window: int, hex_bits: float, mixed_bits: float) -> Column:
    """array<struct<start,kind,end>> of high-entropy stretches of long unbroken strings."""
    cls = r"[A-Za-z0-9+/_=-]"
    pattern = rf"(?<!{cls}){cls}{{{window},}}"
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")

    def step(acc, x):
        start = acc["pos"] + F.char_length(x["gap"])
        span = F.struct((start + x["hot"]["lo"]).alias("start"), F.lit(3).alias("kind"), (start + x["hot"]["hi"]).alias("end"))
        return F.when(x["hit"].isNull(), acc).otherwise(F.struct(
            (start + F.char_length(x["hit"])).cast("bigint").alias("pos"),
            F.when(x["hot"]["lo"].isNotNull(), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"),
        ))

    parts = F.transform(F.arrays_zip(gaps.alias("gap"), found.alias("hit")), lambda x: F.struct(
        x["gap"].alias("gap"), x["hit"].alias("hit"),
        F.when(x["hit"].isNotNull() & ~F.regexp_like(x["hit"], F.lit(ALLOWED)),
               _hot_range(x["hit"], window, hex_bits, mixed_bits)).alias("hot")))
    walked = F.aggregate(parts, F.struct(F.lit(0).cast("bigint").alias("pos"), empty.alias("out")), step)
    return F.when(F.regexp_like(text, F.lit(pattern)), walked["out"]).otherwise(empty)


def scan_secrets(df: DataFrame, text: str = "text", window: int = 20, hex_bits: float = 3.0,
                 mixed_bits: float = 3.6) -> DataFrame:
    """Add ``base_spans`` and ``secret_spans`` to every row of ``df``.

    Both are array<struct<start bigint, kind int, end bigint>> (``KINDS[kind]``),
    ordered by start, then kind; positions are code points, the end exclusive.
    ``base_spans``: matches of the three patterns, leftmost and non-overlapping per
    kind, the too short ones dropped. ``secret_spans``: those, and the stretches of
    at least ``window`` symbols without a break whose entropy reaches ``hex_bits``
    (only hexadecimal symbols in the window) or ``mixed_bits`` (others), unless the
    string is allowed (see ``ALLOWED``) or the stretch lies inside a base span.

    A null or empty text has no spans. Equal rows get equal spans. Columns of ``df``
    stay; ones that already bear the two names are replaced. No shuffle.
    """
    t = whole_text(text)
    base = F.array_sort(F.concat(
        _spans(t, ASSIGN, MIN_ASSIGN_VALUE, 0, value_group=True),
        _spans(t, ACCESS, MIN_ACCESS, 1), _spans(t, rf"{HEX[:-1]}{{{MIN_HEX},}}", MIN_HEX, 2)))
    out = df.withColumn("base_spans", base)
    more = F.filter(
        _entropy_spans(t, window, hex_bits, mixed_bits),
        lambda x: ~F.exists(F.col("base_spans"), lambda b: (b["start"] <= x["start"]) & (b["end"] >= x["end"])))
    return out.withColumn("secret_spans", F.array_sort(F.concat(F.col("base_spans"), more)))


def redact_secrets(df: DataFrame, text: str = "text", mark: str = "[secret]", **settings) -> DataFrame:
    """``df`` with every found span of ``text`` replaced by ``mark`` (overlapping spans by one mark).

    Rows without a span are returned unchanged, null texts too; so are all other columns, whatever their names (the
    scan sees the text alone, under a name of its own, beside the row as a struct).
    """
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(text).alias("scanned"))
    spans = scan_secrets(packed, "scanned", **settings)
    t = F.col("scanned")

    def step(acc, s):
        fresh = s["start"] >= acc["pos"]
        return F.struct(
            F.greatest(acc["pos"], s["end"]).alias("pos"),
            F.when(fresh, F.concat(acc["out"], F.substring(t, (acc["pos"] + 1).cast("int"), (s["start"] - acc["pos"]).cast("int")), F.lit(mark)))
            .otherwise(acc["out"]).alias("out"))

    walked = F.aggregate("secret_spans", F.struct(F.lit(0).cast("bigint").alias("pos"), F.lit("").alias("out")), step)
    done = F.when(F.size("secret_spans") > 0, F.concat(
        walked["out"], F.substring(t, (walked["pos"] + 1).cast("int"), F.lit(2**31 - 1)))).otherwise(t)
    return spans.withColumn("done", done).select(*[F.col("done").alias(c) if c == text else F.col(f"row.`{c}`") for c in df.columns])


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text of ``documents``: counts, digest and spans per document."""
    found = scan_secrets(table(spark, sf_dir, "documents", "doc_id", "text"))
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("secret_spans")).alias("spans"))
