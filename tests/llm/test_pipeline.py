"""The stages on a small corpus with planted copies, boilerplate, personal data, poor and toxic texts, nulls and repeats."""

import numpy as np
import pytest

import corpus_pipeline

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    words = [f"w{k}" for k in range(500)]
    rows, labels = [], []
    for i in range(240):
        text = "\n".join(" ".join(rng.choice(words, 12)) for _ in range(6)) + "\nthis footer line is on every single page"
        if i % 10 == 0:
            text = " ".join(w + "###" for w in text.split())
            labels.append((i, 0, 0))
        else:
            labels.append((i, 1, 0))
        rows.append((i, text, "en", f"s{i % 12}", len(text)))
    rows[31] = (31, rows[30 + 1][1] + " write to a.b@example.org", "en", "s1", 0)
    rows += [(300, rows[1][1], "en", "s5", 0), (301, rows[1][1].replace("w1 ", "w2 "), "en", "s6", 0), (302, None, None, None, None), (303, "", "fr", "s1", 0), (304, " \n ", None, "s2", 3)]
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
    return str(at)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.dtypes == spark.read.parquet(f"{folder}/documents.parquet").dtypes
        docs = corpus_pipeline.written(out)
        held[name] = docs.toPandas()
    kept = held["quality classifier"]
    assert not set(kept.doc_id) & set(range(0, 240, 10)) and len(set(range(240)) - set(range(0, 240, 10)) - set(kept.doc_id)) <= 2
    lines = held["line dedup"]
    assert set(lines.doc_id) == set(kept.doc_id) and not lines[lines.doc_id != 31].text.fillna("").str.contains("footer").any()
    ids = set(held["MinHash near-dedup"].doc_id)
    assert 1 in ids and not ids & {300, 301} and set(lines.doc_id) - ids == {300, 301}
    private = held["PII"]
    assert private.text.fillna("").str.contains("EMAIL").sum() == 1 and not private.text.fillna("").str.contains("@").any()
    packed = held["best-fit packing"]
    assert set(packed.doc_id) == set(private.doc_id) and packed.groupby("sequence_id").length.sum().max() <= 2048
    assert packed.length.sum() / 2048 / packed.sequence_id.nunique() > 0.9


def test_run_is_the_stages(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(got.columns) and got.count() > 200
