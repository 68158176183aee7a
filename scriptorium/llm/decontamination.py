"""Operator 13: benchmark passages in documents, by one Aho-Corasick automaton over words.

Every window of WINDOW consecutive words of a benchmark item (the whole item where it is shorter) is a pattern of
word numbers; words that no item has are number 0, which no pattern holds. A document is read
once: its words run through the automaton, which reports every pattern that ends at a word, and the words inside any
occurrence are hit. Runs of hit words are mapped back to the characters of the original text.

The automaton travels with the tasks, so its size is bounded: items are cut into segments (which overlap by
a window less one word, so that each window is in one of them) and dealt into blocks of about BLOCK_WORDS words.
One block is the usual case; each further block is a further scan, and a document's runs are joined at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import keep, table, whole_text
from scriptorium.llm.words import word_lists, word_places

WINDOW = 10
SEGMENT_WORDS, BLOCK_WORDS = 1 << 10, 1 << 16

_FOUND = "struct<n_words: long, starts: array<long>, ends: array<long>, items: array<string>>"


def segments(items: DataFrame, item_id: str, texts: list[str], window: int = WINDOW, size: int = SEGMENT_WORDS) -> DataFrame:
    """(item, words, n): the normalised words of every text column, in segments of at most ``size`` words.

    Segments overlap by ``window`` - 1 words. The columns of an item are texts of their own: no window spans two.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                words: list[bytes] = []
                for more in word_lists(data.as_py()):
                    words += more
                    while len(words) >= size + window - 1:
                        rows.append((item, words[:size]))
                        words = words[size - window + 1:]
                if words:
                    rows.append((item, words))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([b" ".join(r[1]) for r in rows], pa.binary()).cast(pa.string()),
                 pa.array([len(r[1]) for r in rows], pa.int64())], ["item", "words", "n"])

    parts = None
    for name in texts:
        # An item without an id still hits; it is listed under the empty string.
        part = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), whole_text(name).cast("binary").alias("data"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.mapInArrow(cut, "item string, words string, n long")


def build_automaton(rows: list[tuple[str, str]], window: int = WINDOW):
    """(number of each word, automaton over word numbers or None, items of each pattern) of (item, words) segments."""
    import ahocorasick

    numbers: dict[bytes, int] = {}
    patterns: dict[tuple[int, ...], set[str]] = {}
    for item, words in rows:
        ids = [numbers.setdefault(w, len(numbers) + 1) for w in words.encode().split()]
        width = min(window, len(ids))
        for i in range(len(ids) - width + 1):
            patterns.setdefault(tuple(ids[i : i + width]), set()).add(item)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for i, pattern in enumerate(patterns):
        automaton.add_word(pattern, (len(pattern), i))
    if patterns:
        automaton.make_automaton()
    return numbers, automaton if patterns else None, [sorted(x) for x in patterns.values()]


def _find(data: bytes, numbers: dict, automaton, window: int) -> tuple[int, list[tuple[int, int]], set[int]]:
    """(number of words, (first, end) of every occurrence in words, patterns that occur) of a text."""
    n, last, spans, seen = 0, [], [], set()
    for words in word_lists(data):
        ids = [numbers.get(w, 0) for w in words]
        if automaton is not None and any(ids):
            # Occurrences that began in the slice before are found with its last words.
            first = n - len(last)
            for at, (length, pattern) in automaton.iter(tuple(last + ids)):
                spans.append((first + at + 1 - length, first + at + 1))
                seen.add(pattern)
        n += len(ids)
        last = (last + ids)[-(window - 1):] if window > 1 else []
    return n, spans, seen


def _union(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the runs that cover the spans (touching ones are one run)."""
    starts, ends = [], []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _scan(data: Column, rows: list[tuple[str, str]], window: int) -> Column:
    """What the patterns of one block of segments find in a binary column."""
    kind = pa.struct([("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])

    @F.arrow_udf(_FOUND)
    def scan(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        numbers, automaton, items = build_automaton(rows, window)
        for batch in texts:
            out = []
            for data in batch:
                n, spans, seen = _find(data.as_py(), numbers, automaton, window)
                starts, ends = _union(spans)
                out.append({"n_words": n, "starts": starts, "ends": ends, "items": sorted({x for p in seen for x in items[p]})})
            yield pa.array(out, kind)

    return scan(data)


def find_passages(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_texts: tuple[str, ...] = ("text",),
                  window: int = WINDOW, out: str = "found", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Add ``out``: struct(n_words, starts, ends, items) of every row of ``docs``.

    ``starts`` and ``ends`` bound the runs of hit words (as word numbers, ends exclusive), ``items`` are the ids, as
    strings in their order, of the items with a window that occurs. A null or empty text has no words; an item without
    words has no window; repeated items count once per id; without items nothing is hit. Rows and their other columns stay as
    they are (``out`` replaces a column of that name).
    """
    parts = keep(segments(items, item_id, list(item_texts), window).distinct())
    total = parts.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    data = whole_text(text).cast("binary")
    if blocks == 1:
        return docs.withColumn(out, _scan(data, [(r.item, r.words) for r in parts.collect()], window))
    numbered = keep(docs.select(F.struct(*docs.columns).alias("row"), data.alias("data")).withColumn("no", F.monotonically_increasing_id()))
    found = None
    for b in range(blocks):
        rows = [(r.item, r.words) for r in parts.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == b).collect()]
        one = numbered.select("no", _scan(F.col("data"), rows, window).alias("f"))
        found = one if found is None else found.unionByName(one)

    @F.arrow_udf(_FOUND)
    def join(parts: pa.Array) -> pa.Array:
        out = []
        for fs in parts.to_pylist():
            starts, ends = _union([x for f in fs for x in zip(f["starts"], f["ends"])])
            out.append({"n_words": fs[0]["n_words"], "starts": starts, "ends": ends, "items": sorted({x for f in fs for x in f["items"]})})
        return pa.array(out, parts.type.value_type)

    # One row per block and document, so the lists are as many as the blocks.
    merged = found.groupBy("no").agg(F.collect_list("f").alias("fs")).select("no", join("fs").alias(out))
    return numbered.join(merged, "no").select(*[f"row.{c}" for c in docs.columns if c != out], out)


def passage_spans(text: Column, found: Column) -> Column:
    """array of struct(start, end): the hit runs in code points of the original text, ends exclusive."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    @F.arrow_udf("array<struct<start: long, end: long>>")
    def place(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        out = []
        for t, a, b in zip(texts, starts, ends):
            a, b = a.as_py() or [], b.as_py() or []
            words = word_places(t.as_py()) if a else []
            out.append([{"start": words[i][0], "end": words[j - 1][1]} for i, j in zip(a, b)])
        return pa.array(out, kind)

    return place(F.coalesce(text, F.lit("")), found["starts"], found["ends"])


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every document that lie in a window of ten words of a ``benchmark`` item, and those items."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = find_passages(docs, table(spark, sf_dir, "benchmark", "item_id", "text")).select("doc_id", "found")
    hit = F.aggregate(F.zip_with("found.ends", "found.starts", lambda b, a: b - a), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("doc_id", "found.n_words", hit.alias("n_hit"), F.size("found.items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"), (F.size("found.starts") > 0).alias("contaminated"))
