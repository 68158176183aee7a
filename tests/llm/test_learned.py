import collections
import math
import re
import zlib

import numpy as np
import pytest

from scriptorium.llm import ann
from scriptorium.llm import html_text as hx
from scriptorium.llm import maxent_lm as lm
from scriptorium.llm import toxicity as tx

from .conftest import prose, write_tables


def test_neighbours_have_ranks_scores_and_recall(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x[700:1000] = x[700]  # copies: ties
    rows = [(i, v.tolist(), i) for i, v in enumerate(x)]
    rows += [(2000, None, 1), (2100, [0.0] * 24, 1), (2200, [float("nan")] * 24, 1), (2300, [1.0, None] * 12, 1), (2400, [1.0], 1), (None, x[0].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score bigint")
    got = collections.defaultdict(list)
    for r in ann.op1_ann(spark, write_tables(tmp_path, embeddings=df)).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, 1500, 100))
    hit = 0
    x = x.astype(float)
    for q, found in got.items():
        found.sort()
        far = np.sqrt(((x - x[q]) ** 2).sum(1))
        assert [f[0] for f in found] == list(range(1, 11))
        assert all(f[2] == far[f[1]] and f[1] != q for f in found)
        assert [(f[2], f[1]) for f in found] == sorted((f[2], f[1]) for f in found)
        far[q] = np.inf
        hit += len({f[1] for f in found} & set(np.lexsort((np.arange(1500), far))[:10].tolist()))
    assert hit >= 0.9 * 10 * len(got)


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.5]), (100, [3.0, 3.0])], "vec_id bigint, embedding array<double>")
    rows = ann.nearest_neighbours(df, df.where("vec_id % 100 = 0")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in rows) == [(0, 1, 1), (0, 2, 100), (100, 1, 1), (100, 2, 0)]
    assert ann.nearest_neighbours(df.limit(0), df).count() == 0


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 2**63, 800, dtype=np.uint64)
    codes[:400] = codes[0] ^ np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 30), replace=False)) for _ in range(400)], np.uint64)
    index = ann.MultiIndex(codes)
    for radius in (0, 1, 3, 4, 7, 10, 18, 27, 64):
        assert index.within(codes[0], radius).tolist() == np.flatnonzero(np.bitwise_count(codes ^ codes[0]) <= radius).tolist()


@pytest.fixture(scope="module")
def labelled_tables(spark, tmp_path_factory):
    import random

    r = random.Random(0)
    docs, labels = [], []
    for i in range(900):
        words = prose(i, r.randrange(30, 120)).split()
        toxic = i % 6 == 0
        if toxic:
            for _ in range(4):
                words.insert(r.randrange(len(words)), r.choice(["grumbletwit", "snarkwart", "vileoaf"]))
        docs.append((i, " ".join(words)))
        if i % 5:
            labels.append((i, 1, int(toxic)))
    docs += [(2000, None), (2001, ""), (2002, "snarkwart vileoaf grumbletwit"), (2002, "snarkwart vileoaf grumbletwit")]
    labels += [(5000, 1, 1), (3, 1, None)]
    base = tmp_path_factory.mktemp("labelled")
    return write_tables(base, documents=spark.createDataFrame(docs, "doc_id bigint, text string"),
                        labels=spark.createDataFrame(labels, "doc_id bigint, quality bigint, toxic bigint"))


def test_toxicity_separates_held_out_documents(spark, labelled_tables):
    rows = tx.op4_toxicity(spark, labelled_tables).collect()
    assert len(rows) == 904
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in rows if r.held_out and r.doc_id < 900]
    assert sum(r.predicted == int(r.doc_id % 6 == 0) for r in held) >= 0.95 * len(held)
    scores = collections.defaultdict(set)
    for r in rows:
        scores[r.doc_id].add(r.score)
    assert len(scores[2002]) == 1 and min(scores[2002]) > 0.5 and scores[2000] == scores[2001]


def test_toxicity_without_labels(spark, odd_docs, no_docs):
    model = tx.train_toxicity(spark.createDataFrame([("x", None)], "text string, toxic int"))
    rows = tx.score_toxicity(odd_docs, model, score="score").collect()
    assert len(rows) == odd_docs.count() and {round(r.score, 6) for r in rows} == {tx.NO_EVIDENCE}
    assert tx.score_toxicity(no_docs, model).count() == 0


def test_model_beats_the_base_and_counts_exactly(spark, tmp_path):
    texts = {i: (" ".join(f"la{w}" for w in prose(i, 60).split()) if i % 2 else prose(i, 60)).replace("pi", "PI") for i in range(400)}
    texts |= {1000: None, 1001: "", 1002: "unseenword another"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    rows = {r.doc_id: r for r in lm.op6_maxent_lm(spark, write_tables(tmp_path, documents=docs)).collect()}
    tokens = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) + [None] for i, t in texts.items()}
    fold = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    c = collections.Counter(w for i, ws in tokens.items() if not fold(i) for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(c[w] > 0 for w in ws), n, fold(i))
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel_tol=1e-9)
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_rare_words_are_joined_exactly(spark, monkeypatch):
    docs = spark.createDataFrame([(i, prose(i, 80)) for i in range(30)] + [(3, prose(3, 80))], "doc_id bigint, text string")
    key = lambda r: (r.doc_id, r.base_score)
    want = sorted((r.doc_id, r.n_known, round(r.base_score, 6), round(r.score, 4)) for r in lm.score_texts(docs, docs).collect())
    monkeypatch.setattr(lm, "TOP_WORDS", 20)
    assert sorted((r.doc_id, r.n_known, round(r.base_score, 6), round(r.score, 4)) for r in lm.score_texts(docs, docs).collect()) == want


def test_class_and_word_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    weights = rng.normal(size=(1 << lm.FEATURE_BITS, lm.CLASSES)).astype(np.float32)
    rows = rng.integers(0, 1 << lm.FEATURE_BITS, (50, lm.N_FEATURES))
    assert np.allclose(np.exp(lm.log_softmax(weights, rows, np.zeros(lm.CLASSES, np.float32))).sum(1), 1, atol=1e-4)


def test_gradient_updates_lower_the_loss():
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 200, (4000, lm.N_FEATURES))
    cls = rows[:, 0] % lm.CLASSES
    weights = np.zeros((1 << lm.FEATURE_BITS, lm.CLASSES), np.float32)
    squares, met = np.zeros_like(weights), np.zeros(len(weights), np.int64)
    flat = np.zeros(lm.CLASSES, np.float32)
    loss = lambda: -lm.log_softmax(weights, rows, flat)[np.arange(len(cls)), cls].mean()
    before = loss()
    for _ in range(20):
        lm.update(weights, squares, met, rows, cls, flat)
    assert loss() < 0.5 * before and met.sum() == 20 * rows.size


def test_model_on_odd_and_empty_input(spark, odd_docs, no_docs):
    assert lm.score_texts(odd_docs, odd_docs).count() == odd_docs.count()
    rows = lm.score_texts(odd_docs, no_docs).collect()
    assert {r.train_tokens for r in rows} == {0} and {r.n_known for r in rows} == {0}
    assert lm.score_texts(no_docs, odd_docs).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><article>";</script></head><body>
<nav><ul><li><a href="/a">Home page</a></li><li><a>About us</a></li></ul></nav><div class="ad">Buy this now, it is cheap and good.</div>
{open}<h1>Title &amp; more</h1><!-- note --><p>First  <b>bo</b>ld words\n here &lt;x&gt; &eacute;.<br>Second line<p>Unclosed paragraph with enough words to count.
<div class="cookie-notice">We use cookies on this site</div><ul><li>one item</li><li>two items</li></ul><form><input value="x">Your mail</form>
<p>Last words of it all.</p><div id="comments"><p>Reader says something long about it, very long indeed.</p></div>{close}
<aside>Related things to read next today</aside><footer>&copy; site, all rights reserved here</footer></body></html>"""
WANT = "Title & more First bold words here <x> é. Second line Unclosed paragraph with enough words to count. one item two items Last words of it all."


def test_main_text_of_marked_and_unmarked_pages(spark, tmp_path):
    marked = PAGE.format(open="<article>", close="</article>")
    pages = {1: marked, 2: PAGE.format(open='<div class="content">', close="</div>"), 3: None, 4: "", 5: "just words, no tags", 6: "<p", 7: "<nav>menu</nav>",
             8: marked.replace("</footer></body></html>", "&am"), 9: marked}
    df = spark.createDataFrame([(i, f"u{i}", p) for i, p in pages.items()], "page_id bigint, url string, html string")
    got = {r.page_id: r for r in hx.op9_html_extraction(spark, write_tables(tmp_path, pages=df)).collect()}
    assert got[1].text == got[2].text == got[8].text == got[9].text == WANT
    assert [got[i].text for i in (3, 4, 5, 6, 7)] == ["", "", "just words, no tags", "", ""]
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_region_is_the_best_of_all_regions():
    weights = {"body": 1.0}
    tokens = hx.page_tokens("<div><p>a b c</p><td>x</td><td>y</td><td>z</td><p>d e f g</p></div>")
    scores = [hx._score(t, weights) for t in tokens]
    best = max(((sum(scores[i:j]), -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)))
    text = hx.main_text("<div><p>a b c</p><td>x</td><td>y</td><td>z</td><p>d e f g</p></div>", weights)
    assert best[0] > 0 and text.endswith("d e f g")
    assert hx.main_text("", weights) == "" and hx.main_text("<" * 5000, weights) is not None


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert hx.extract_text(pages, hx.learn_weights(pages)).count() == 0


def test_weights_of_rare_templates_are_used_too(spark):
    def page(k, marked):
        name = "z" + "".join(chr(97 + int(d)) for d in str(k))
        a, b = ("<article>", "</article>") if marked else ('<div class="c' + name + '">', "</div>")
        return f'<body><div class="{name}">{"sold here " * 20}</div>{a}<p>{"story words " * 30}</p>{b}</body>'

    rows = [(2 * k + m, page(k, bool(m)), 7) for k in range(40) for m in (0, 1)] + [(100, page(3, True), 7), (101, None, 7)]
    pages = spark.createDataFrame(rows, "page_id bigint, html string, main_text bigint")
    few = hx.extract_text(pages, hx.learn_weights(pages, max_places=10))
    got = {r.page_id: r.main_text for r in few.collect()}
    assert got == {r.page_id: r.main_text for r in hx.extract_text(pages, hx.learn_weights(pages)).collect()}
    assert few.columns == pages.columns and few.count() == len(rows) and got[101] == ""
    assert all(t == ("story words " * 30).strip() for i, t in got.items() if i != 101)


def test_groups_are_voted_by_all_texts_and_seeds_seen_in_all(spark):
    a, b, word = "left", "right", "wanted"
    rows = [(f"{b} {b} " + f"{word} " * 50,)] + [(f"{a} {a} {word}",)] * 80
    train = spark.createDataFrame(rows, "t string").repartition(40)  # the longest run alone holds the word most
    seeds = np.sort(np.concatenate([lm.token_hashes(np.frombuffer(w.encode(), np.uint8), np.array([len(w)]))[0][:1] for w in (a, b)]))
    of = {w: lm.token_hashes(np.frombuffer(w.encode(), np.uint8), np.array([len(w)]))[0][0] for w in (a, b, word)}
    group = np.array([3 if h == of[a] else 5 for h in seeds])
    got = {r.h: (r.c, r.k) for r in lm._count_words(train, seeds, group).collect()}
    assert got[int(of[word].view(np.int64))] == (130, 3)
    many = spark.range(1000).selectExpr("concat('same ', id % 7) as t").union(spark.createDataFrame(rows, "t string"))
    assert set(of.values()) <= set(lm._group_seeds(many)[0])


def test_classes_do_not_depend_on_the_split(spark):
    rows = [(f"{prose(i, 40)} w{i % 90}",) for i in range(400)]
    one, many = (spark.createDataFrame(rows, "t string").repartition(n) for n in (1, 30))
    seeds = lm._group_seeds(one)
    assert all((x == y).all() for x, y in zip(seeds, lm._group_seeds(many)))
    key = lambda df: sorted((r.h, r.c, r.k) for r in lm._count_words(df, *seeds).collect())
    assert key(one) == key(many)


def test_toxicity_without_both_classes_predicts_nothing(spark):
    texts = spark.createDataFrame([("you moron",), ("a fine day",), (None,)], "text string")
    for y in ([], [0, 0], [1, 1, 1]):
        rows = spark.createDataFrame([("word salad", v) for v in y], "text string, toxic int")
        scores = {r.toxicity for r in tx.score_toxicity(texts, tx.train_toxicity(rows)).collect()}
        assert len(scores) == 1 and 0 <= scores.pop() < 0.5
