import corpus_pipeline as cp

from .conftest import prose, write_tables
from .test_dedup import brute_components, brute_removal, shingle_set


def test_stages_take_effect_in_order(spark, tmp_path):
    passage = prose(77, 90)
    docs = {i: prose(i, 150) for i in range(60)}
    docs |= {i: prose(i, 150) + " grumbletwit snarkwart" * 4 for i in range(100, 160)}
    docs |= {200: docs[1], 201: docs[2] + " tail", 202: prose(300, 50) + " " + passage, 203: passage + " " + prose(301, 60), 204: None, 205: "",
             206: prose(302, 50) + " password=hunter22 end"}
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in docs.items()]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(i, 1, int(100 <= i < 160)) for i in docs], "doc_id bigint, quality bigint, toxic bigint")
    base = write_tables(tmp_path / "in", documents=table, labels=labels)
    current, seen = spark.read.parquet(f"{base}/documents.parquet"), []
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, current, base).write.parquet(str(tmp_path / f"out{k}"))
        current = spark.read.parquet(str(tmp_path / f"out{k}"))
        seen.append({r.doc_id: r for r in current.collect()} if k < 4 else current.collect())
        if k < 4:
            assert current.columns == table.columns
    assert set(docs) - set(seen[0]) == set(range(100, 160))
    want = brute_components({i: shingle_set(r.text) for i, r in seen[0].items()})
    assert set(seen[1]) == {i for i, c in want.items() if i == c}
    texts = {i: (r.text or "").encode() for i, r in seen[1].items()}
    for (i, t), (n, gone, _, _) in zip(texts.items(), brute_removal(list(texts.values()), cp.PASSAGE_BYTES)):
        assert len((seen[2][i].text or "").encode()) == n - gone and seen[2][i].n_chars == len(seen[2][i].text or "")
    assert passage not in (seen[2][202].text + seen[2][203].text) and seen[2][204].text is None
    assert seen[3][206].text.endswith("[secret] end") and set(seen[3]) == set(seen[2])
    assert {r.doc_id for r in seen[4]} == set(seen[3])


def test_run_writes_each_stage_to_the_shared_folder(spark, tmp_path):
    from scriptorium.session import ensure_checkpoint_dir

    table = spark.createDataFrame([(i, prose(i, 30), "en", "s", 1) for i in range(8)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([], "doc_id bigint, quality bigint, toxic bigint")  # no evidence: nothing is rejected
    out = cp.run(spark, write_tables(tmp_path, documents=table, labels=labels))
    shared = ensure_checkpoint_dir(spark).split(":")[-1].strip("/")
    assert all(shared in f for f in out.inputFiles())
    assert {r.doc_id for r in out.select("doc_id").collect()} == set(range(8))


def test_repeated_rows_and_rows_without_an_id_keep_their_text_once(spark, tmp_path):
    a, b, c, d, e = (prose(400 + i, 150) for i in range(5))
    rows = [(1, a), (1, a), (1, a), (2, a), (3, b), (4, b + " tail"), (4, b + " tail"), (None, c), (None, c), (None, a), (None, b + " tail"),
            (5, d), (6, e), (6, e), (None, None), (None, None), (7, ""), (7, ""), (8, ""), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    want = sorted([(1, a), (3, b), (None, c), (5, d), (6, e), (None, None), (7, ""), (8, ""), (None, "")], key=str)
    for k, stage in ((1, cp.near_dedup_stage), (2, cp.suffix_dedup_stage)):
        stage(spark, docs, "").write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=str) == want
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
