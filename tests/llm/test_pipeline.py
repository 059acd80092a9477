"""The pipeline on a small folder, stage by stage against brute force."""

import hashlib
import random

import corpus_pipeline
from tests.llm.test_small import brute_components, brute_hits, brute_secrets, prose


def test_pipeline(spark, tmp_path):
    pick, rows = random.Random(1), []
    for i in range(40):
        rows.append((i, " ".join(prose(i, 60)).capitalize() + "."))
    for i in range(40, 60):
        rows.append((i, "### ".join(prose(i, 60)) + "$$$"))
    passage = " ".join(prose(500, 12))
    rows += [(70, rows[3][1]), (71, rows[4][1] + " more."), (72, rows[5][1] + " " + passage + "."), (73, rows[6][1][:-1] + ' token = "' + "0123456789abcdef" * 2 + '".')]
    rows += [(80, None), (81, "")]
    pick.shuffle(rows)
    documents = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 40), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "BPE encoding and decoding"]
    stages = [stage for _, stage in corpus_pipeline.STAGES]
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    good = stages[0](spark, docs, str(tmp_path))
    kept = texts(good)
    assert set(range(40)) <= set(kept) and not set(range(40, 60)) & set(kept) and good.columns == docs.columns
    single = stages[1](spark, good, str(tmp_path))
    expected = {i for i, _, root in brute_components(list(kept.items()), corpus_pipeline.NEAR) if i == root}
    assert set(texts(single)) == expected and 70 not in expected and single.columns == docs.columns
    clean = stages[2](spark, single, str(tmp_path))
    assert set(texts(clean)) == {i for i in expected if not brute_hits(kept[i], [(1, passage)])[-1]} and 72 not in texts(clean)
    safe = stages[3](spark, clean, str(tmp_path))
    assert safe.columns == docs.columns and not any(brute_secrets(t or "") for t in texts(safe).values())
    assert all(t == kept[i] for i, t in texts(safe).items() if not brute_secrets(kept[i] or ""))
    last = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {i: r.decoded_sha256 for i, r in last.items()} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in texts(safe).items()}
    assert all(r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() for r in last.values())


def test_contaminated_rows_do_not_take_others_of_their_id(spark, tmp_path):
    passage = " ".join(prose(500, 12))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"one {passage}"), (None, "a clean text"), (None, None), (7, f"two {passage}"), (7, "another clean text"), (8, f"one {passage}"), (9, "a clean text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()
    key = lambda row: tuple(map(str, row))
    assert sorted(map(tuple, left), key=key) == sorted([r for r in rows if passage not in (r[1] or "")], key=key)
