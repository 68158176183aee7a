"""Operator 9: main text of web pages by the maximum-scoring subsequence.

A page is read as a sequence of text runs and tags. A run scores its number of words times
the weight of the place it stands in, a tag scores below zero; the contiguous stretch with
the largest sum, found by one linear scan, is the content region. The weights are log odds
learned from the pages that mark their article themselves (``article``, ``main``): how often
words and tags of a place lie inside of it. A place that those pages do not show has a weight
by its kind of element. What is no article text by its element or class (menus, forms,
adverts, comments, ...) is left out of the region again.
"""

from __future__ import annotations

import html
import re
from collections import ChainMap, Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import keep, table

# So many of the most frequent entries travel with the tasks; the others are joined.
MAX_PLACES = 5_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_RAW = {n: re.compile(rf"</{n}\s*>|\Z", re.I) for n in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "select")}
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q s samp small "
                    "span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset("nav header footer aside form menu dialog button fieldset object audio video canvas head".split())
_WORDS_OF_OTHER = frozenset(
    "nav navbar navigation menu sidebar side aside footer foot masthead banner ad ads advert adverts advertisement advertising "
    "sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended comment comments disqus respond reply replies breadcrumb "
    "breadcrumbs pagination pager widget toolbar search copyright legal skip header".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_MARKED = ("article", "main")
_PLACES = frozenset("article main section nav header footer aside form div body".split())
_PARTS = frozenset("ul ol li table td blockquote figure dl".split())
# Scores of tags whose place no labelled page shows.
_TAG_PRIOR = {"p": -0.1, "br": -0.05, "h1": -0.2, "h2": -0.2, "h3": -0.2, "b": -0.05, "i": -0.05, "em": -0.05, "strong": -0.05,
              "span": -0.1, "a": -1.0, "li": -0.4, "ul": -0.4, "ol": -0.4, "td": -0.7, "tr": -0.5, "div": -0.7, "input": -3.0, "option": -2.0}


def _other(name: str, attrs: str, inside_article: bool) -> tuple[bool, str]:
    """(whether the element holds no article text, its first class or id word)."""
    tag_says = name in _DROPPED
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return tag_says, ""
    first = ""
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key in ("class", "id"):
            words = re.findall(r"[a-z]+", value)
            first = first or (words[0] if words else "")
            if name not in ("html", "body", "article", "main") or "comment" in words or "comments" in words:
                hit = _WORDS_OF_OTHER.intersection(words)
                tag_says = tag_says or bool(hit - {"header"}) or ("header" in hit and not inside_article)
        elif key == "role":
            tag_says = tag_says or value in _ROLES
        elif key == "hidden":
            tag_says = True
        elif key == "aria-hidden":
            tag_says = tag_says or value == "true"
        elif "display:none" in value.replace(" ", ""):
            tag_says = True
    return tag_says, first


def page_tokens(page: str) -> list[tuple]:
    """(is a tag, place, text or tag name, breaks the block, no article text, inside a marked article) in page order."""
    out, stack, at = [], [], 0
    dropped = marked = 0
    place = "body"

    def state(entry):
        nonlocal dropped, marked, place
        dropped, marked, place = entry

    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else n
        if stop > at:
            out.append((False, place, page[at:stop], False, dropped > 0, marked > 0))
        if not m:
            break
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if m["close"]:
            inside = dropped > 0
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    state(stack[k][1])
                    del stack[k:]
                    break
            out.append((True, place, "/" + name, name not in _INLINE, inside, marked > 0))
            continue
        other, word = _other(name, m["attrs"], marked > 0)
        if name == "header" and marked:
            other = False
        out.append((True, place, name, name not in _INLINE, dropped > 0 or other, marked > 0))
        if name in _RAW:
            at = _RAW[name].search(page, at).end()
            continue
        if name in _VOID or m["attrs"].endswith("/") and name not in _PLACES:
            continue
        stack.append((name, (dropped, marked, place)))
        dropped += other
        if name in _MARKED and not other:
            marked += 1
        if name in _PLACES:
            place = f"{name}.{word}" if word else name
            if other:
                place = "other:" + place
        elif name in _PARTS:
            place = f"{place.split('>')[0]}>{name}"
    return out


def _content(token: tuple) -> bool:
    return token[5] and not token[4]


def place_counts(pages: Iterator[str]) -> Counter:
    """(place or place and tag, inside or not) -> words or tags, over the pages that mark one article."""
    counts: Counter = Counter()
    for page in pages:
        tokens = page_tokens(page)
        if not any(t[5] for t in tokens):
            continue
        for t in tokens:
            if t[0]:
                counts[f"<{t[2]}@{t[1]}", _content(t)] += 1
            else:
                words = len(t[2].split())
                if words:
                    counts[t[1], _content(t)] += words
    return counts


@dataclass(frozen=True)
class PlaceWeights:
    """Weights of all counted entries: the most frequent ones, and (place, weight) of the others if there are any."""

    top: dict[str, float]
    rest: DataFrame | None = None


def learn_weights(pages: DataFrame, column: str = "html", max_places: int = MAX_PLACES) -> PlaceWeights:
    """Weight of each place's words and of each tag in a place: log odds of lying inside a marked article.

    Counted over all pages. The ``max_places`` most frequent entries come to the driver, the others stay a table.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for b in batches:
            total.update(place_counts(b["h"]))
            if len(total) > 50_000:
                yield _rows(total)
                total = Counter()
        yield _rows(total)

    def _rows(total: Counter) -> pd.DataFrame:
        return pd.DataFrame({"place": [k[0] for k in total], "inside": [k[1] for k in total], "n": list(total.values())}).astype(
            {"place": "object", "inside": "bool", "n": "int64"})

    read = pages.select(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("h"))
    seen = keep(read.mapInPandas(run, "place string, inside boolean, n bigint").groupBy("place").agg(
        F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("bad")))
    top = seen.orderBy(F.desc(F.col("good") + F.col("bad")), "place").limit(max_places).collect()
    weights = {r["place"]: float(np.log((r["good"] + 0.5) / (r["bad"] + 0.5))) for r in top}
    if seen.count() <= len(weights):
        return PlaceWeights(weights)
    known = F.broadcast(seen.sparkSession.createDataFrame([(p,) for p in weights], "place string"))
    return PlaceWeights(weights, seen.join(known, "place", "left_anti").select(
        "place", F.log((F.col("good") + 0.5) / (F.col("bad") + 0.5)).alias("weight")))


def _score(token: tuple, weights: Mapping[str, float]) -> float:
    if token[4]:  # left out in any case: a small price for going on past it
        return -0.2 if token[0] else -0.25 * len(token[2].split())
    if token[0]:
        name = token[2]
        known = weights.get(f"<{name}@{token[1]}")
        if known is None:
            return _TAG_PRIOR.get(name.strip("/"), -1.5)
        return min(known, -0.01)
    words = len(token[2].split())
    if not words:
        return 0.0
    known = weights.get(token[1])
    return words * (1.0 if known is None else max(min(known, 3.0), -3.0))


def main_text(page: str, weights: Mapping[str, float]) -> str:
    """The text of the best contiguous region: blocks in page order, white space as one space."""
    tokens = page_tokens(page)
    best, best_at, total, begin = 0.0, (0, 0), 0.0, 0
    for i, t in enumerate(tokens):
        total += _score(t, weights)
        if total <= 0:
            total, begin = 0.0, i + 1
        elif total > best:
            best, best_at = total, (begin, i + 1)
    parts = []
    for t in tokens[best_at[0] : best_at[1]]:
        if t[0]:
            if t[3]:
                parts.append(" ")
        elif not t[4]:
            parts.append(html.unescape(t[2]) if "&" in t[2] else t[2])
    return " ".join("".join(parts).split())


def _own_weights(keyed: DataFrame, weights: PlaceWeights) -> DataFrame:
    """(__a, __b, __own): for each different page with entries of ``weights.rest`` these entries' weights."""
    top = weights.top

    @F.pandas_udf("array<string>")
    def others(pages_in: pd.Series) -> pd.Series:
        return pages_in.map(lambda p: sorted({e for t in page_tokens(p) if (e := f"<{t[2]}@{t[1]}" if t[0] else t[1]) not in top}))

    listed = keyed.select("__a", "__b", F.explode(others("__page")).alias("place")).distinct()
    found = listed.join(weights.rest, "place")
    return found.groupBy("__a", "__b").agg(F.map_from_entries(F.collect_list(F.struct("place", "weight"))).alias("__own"))  # at most those of one page


def extract_text(pages: DataFrame, weights: PlaceWeights, column: str = "html", to: str = "main_text") -> DataFrame:
    """``pages`` with the main text of every whole page in column ``to`` (replaced if there; empty if none).

    A null page reads as empty; equal pages get equal texts. No shuffle as long as all weights travel with the
    tasks; otherwise each page is joined with the weights of its own rarer entries.
    """
    top = weights.top
    page = F.coalesce(F.col(column).cast("string"), F.lit(""))

    if weights.rest is None:
        @F.pandas_udf("string")
        def run(pages_in: pd.Series) -> pd.Series:
            return pages_in.map(lambda p: main_text(p, top))

        return pages.withColumn(to, run(page))

    @F.pandas_udf("string")
    def run_own(pages_in: pd.Series, own: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, ChainMap(dict(o), top) if o else top) for p, o in zip(pages_in, own)], dtype="object")

    keyed = pages.withColumn("__page", page).withColumn("__a", F.xxhash64("__page")).withColumn("__b", F.xxhash64(F.lit(1), "__page"))
    joined = keyed.drop("__page").join(_own_weights(keyed, weights), ["__a", "__b"], "left")
    names = pages.columns if to in pages.columns else [*pages.columns, to]
    return joined.withColumn(to, run_own(page, "__own")).select(*names)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page of ``pages``."""
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    out = extract_text(pages, learn_weights(pages), to="text")
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
