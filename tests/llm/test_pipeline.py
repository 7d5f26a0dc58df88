"""The pipeline's stages on a small corpus: each works on what its predecessor kept, and its decisions take effect."""

import random

from bramble.llm.common import new_path


def test_stages(spark):
    import corpus_pipeline

    rng = random.Random(1)
    text = lambda n, seed: " ".join(f"w{random.Random(seed * 1000 + i).randrange(5000)}" for i in range(n))
    rows, labels = [], []
    for i in range(300):
        bad = i % 6 == 0
        rows.append((i, text(60, i) + (" zwkrump" if bad else ""), "en", f"s{i % 4}", 0))
        labels.append((i, 1, int(bad)))
    rows += [(1000 + i, text(60, 1), "en", "s1", 0) for i in range(4)]
    rows += [(2000 + i, text(60, 5) + f" tail{i}", "en", "s2", 0) for i in range(3)]
    sf = new_path(spark, "tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, sf)
        path = new_path(spark, "stage")
        out.write.parquet(path)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs = spark.read.parquet(path)
        seen[name] = sorted(r["doc_id"] for r in docs.collect())
    assert seen["toxicity"] == sorted(i for i, *_ in rows if i >= 1000 or i % 6)
    assert seen["exact dedup"] == [i for i in seen["toxicity"] if not 1000 <= i < 2000]
    assert seen["near dedup"] == [i for i in seen["exact dedup"] if i < 2000]
    assert set(seen["mixing"]) <= set(seen["near dedup"]) and len(seen["mixing"]) > 100
    assert set(seen["packing"]) == set(seen["mixing"])
    assert {len(s) for s in (corpus_pipeline.STAGES,)} == {5} and rng
