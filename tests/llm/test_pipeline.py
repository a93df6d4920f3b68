"""The corpus pipeline on small tables: every stage's decisions take effect."""

import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from masswright.llm import quality, secrets

from .test_operators import corpus, shingles, table, word_ids

pytest.importorskip("public_tokenizers")


def test_stages_decide(spark, tmp_path):
    rows = [*corpus(), [400, "my password = hunter2hunter2 and " + " ".join(f"w{i}" for i in range(70)), "en", "web", 1]]
    docs = table(spark, rows, extra=False)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(50)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    good = {(r["doc_id"], r["text"]) for r in quality.judge_quality(docs, labels, keep=("text",)).where("kept").collect()}
    # One row of each class: smallest id (a real one first); the fixture's classes have unique ids but for null and 5.
    left: list = []
    texts = sorted({t for _, t in good})
    sets = {t: shingles(t) for t in texts}
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for a in texts:
        for b in texts:
            if a < b and 5 * (both := len(sets[a] & sets[b])) >= 4 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    for k in {find(t) for t in texts}:
        left.append(min(((d, t) for d, t in good if find(t) == k), key=lambda x: (x[0] is None, x[0] or 0)))
    clean = [(d, secrets.redact(t, secrets.base_spans(t) + secrets.confirmed_spans(t))) for d, t in left]
    want = []
    for (d, _), ids in zip(clean, word_ids([t for _, t in clean], 0), strict=True):
        want += [(d, k // 2048, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in got), key=repr) == sorted(want, key=repr)
    assert 400 in {r["doc_id"] for r in got} and not any(re.search("hunter2", t) for _, t in clean)


def test_middle_stages_return_the_columns_of_documents(spark, tmp_path):
    docs = table(spark, corpus()[:20], extra=False)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, str(tmp_path))
        assert found.dtypes == docs.dtypes and found.count() > 0
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
