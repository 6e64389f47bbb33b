"""The stages of the pipeline in turn, each on what the one before kept, and run()."""

import re

from tests.llm.test_operators import BASE, TEXTS, brute_lines, shingle_set

import corpus_pipeline

W = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, tmp_path):
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(docs.toPandas())
    told = {i: t for i, t in enumerate(TEXTS) if any(c.isalpha() for c in t or "")}
    assert dict(zip(kept[0].doc_id, kept[0].text, strict=True)) == told
    lines = brute_lines(sorted(told.items()))
    assert dict(zip(kept[1].doc_id, kept[1].text, strict=True)) == lines
    gone = {j for i in lines for j in lines if i < j and (a := shingle_set(lines[i])) and (b := shingle_set(lines[j])) and 100 * len(a & b) >= 75 * len(a | b)}
    assert set(kept[2].doc_id) == set(lines) - gone and TEXTS.index(BASE) in set(kept[2].doc_id)
    n = lambda df: sum(len(W.findall(t or "")) for t in df.text)
    assert abs(n(kept[3]) - n(kept[2])) <= 2 and list(kept[3].columns) == list(kept[0].columns)
    assert set(kept[4].doc_id) == set(kept[3].doc_id)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept[4])
