"""The pipeline's stages on a small corpus, held against what they must keep and drop."""

import random

import pytest


@pytest.fixture()
def corpus(spark, tmp_path):
    r = random.Random(9)
    stems = {"xx": ["ka", "lo", "mi", "ne"], "yy": ["thr", "ing", "est", "ou"]}
    rows, labels = [], []
    for i in range(240):
        lang = "xx" if i % 2 else "yy"
        w = [r.choice(stems[lang]) + r.choice(stems[lang]) for _ in range(40)]
        if i % 4 == 0:
            for _ in range(6):
                w.insert(r.randrange(len(w)), r.choice(["blorgish", "blorgy", "blorgs"]))
        rows.append((i, " ".join(w), lang, "s", 1))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(300 + i, rows[i][1] + " tail", rows[i][2], "s", 1) for i in range(1, 40, 2)] + [(400, None, "xx", "s", 1), (401, "12 34", "yy", "s", 1), (402, "漢字 かな 交じり 文", None, "s", 1), (1, rows[1][1], "xx", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages(spark, corpus):
    import corpus_pipeline

    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    names, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, corpus)
        assert docs.columns == names
        docs.write.parquet(f"{corpus}/{name}")
        docs = spark.read.parquet(f"{corpus}/{name}")
        seen[name] = sorted(r.doc_id for r in docs.collect())
    clean = {i for i in range(240) if i % 4}
    assert clean <= set(seen["toxicity"]) and sum(i % 4 == 0 and i < 240 for i in seen["toxicity"]) <= 3
    assert not {400, 401, 402} & set(seen["language_id"]) and clean <= set(seen["language_id"])
    kept = seen["ngram_jaccard"]
    assert len(kept) == len(set(kept)) and clean <= set(kept) and not any(300 <= i < 400 for i in kept)
    packed = corpus_pipeline.run(spark, corpus).collect()
    assert {p.doc_id for p in packed} == set(kept)


def test_toxicity_stage_drops_what_the_operator_predicts(spark, corpus, monkeypatch):
    import numpy as np

    from maskline.llm import stages, toxicity

    model = toxicity.Model(np.zeros(1 << toxicity.BUCKET_BITS), float(np.log(0.4 / 0.6)))  # every score is 0.4
    monkeypatch.setattr(toxicity, "learn", lambda docs, labels: model)
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    assert toxicity.score(docs, model).where("predicted = 1").count() == docs.count()
    assert stages.drop_toxic(spark, docs, corpus).count() == 0


def test_near_duplicates_without_doc_id(spark):
    from maskline.llm import stages

    w = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, w, "x"), (None, w + " end", "x"), (None, "other " * 3, "x"), (None, "other " * 3, "x"), (None, None, "x")], "doc_id long, text string, lang string")
    got = stages.drop_near_duplicates(spark, docs, "").select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, w), (None, "other " * 3), (None, None)], key=str)
