"""The audit of filters against a brute-force run of every order."""

import re
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from masswright.llm import filteraudit

from .test_operators import bag, corpus, table

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def failing(doc_id, text, everything):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = set()
    if len(words) < 50:
        out.add("A")
    if 100 * len(set(words)) < 65 * len(words):
        out.add("B")
    if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text):
        out.add("C")
    if re.search(r"[#$%&*|]", text):
        out.add("D")
    if doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t in everything):
        out.add("E")
    return out


def brute(docs, labels):
    everything = [(d, t) for d, t, _ in docs]
    good, toxic = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, x in labels if x == 1} - {None}
    rows = [(d, s or "", failing(d, t or "", everything)) for d, t, s in docs]
    out = []
    for part in {s for _, s, _ in rows}:
        own = [(d, f) for d, s, f in rows if s == part]
        found, total = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                removed = [x for x in left if name in x[1]]
                left = [x for x in left if name not in x[1]]
                total[name] += len(removed)
                gone = len([x for x in own if name in x[1]]) - len(removed)
                found.append((name, part, "".join(order), step, len(left), len(removed), gone, sum(f == {name} for _, f in own), sum(d in good for d, _ in removed), sum(d in toxic for d, _ in removed)))
        out += [(*x[1:], total[x[0]]) for x in found]
    return sorted(out, key=repr)


def test_the_audit_equals_a_run_of_every_order(spark):
    rows = corpus()
    long = " ".join(f"w{i}" for i in range(60))
    rows += [[300, "A B C " * 30, "en", "caps", 1], [301, "A B C " * 30, "en", "web", 1], [299, "A B C " * 30, "en", "", 1], [302, long + " #", "en", "one", 1], [302, long + " #", "en", "one", 1], [302, long, "en", "one", 1], [None, long, "en", "one", 1], [250, long, "en", "one", 1]]
    labels = [(i, i % 2, (i // 2) % 2) for i in range(0, 310, 3)] + [(300, 0, 0), (300, 1, None), (299, None, 1), (None, 1, 1), (9999, 1, 1)]
    docs, known = table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit(1)).withColumn("id", F.lit(2))
    found = filteraudit.audit_filters(docs, known)
    assert found.columns == COLUMNS
    assert bag(found) == brute([(r[0], r[1], r[3]) for r in rows], labels)


def test_an_empty_table_has_no_parts(spark):
    docs = table(spark, corpus()).limit(0)
    assert filteraudit.audit_filters(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    assert filteraudit.audit_filters(table(spark, corpus()), spark.createDataFrame([], "doc_id long, quality int, toxic int")).agg(F.sum("good_lost")).first()[0] == 0


def test_matrices_share_out_every_mask():
    m = filteraudit.outcome_matrices()
    assert all(m[k].shape == (32, 600) for k in ("kept", "removed", "redundant", "unique"))
    # After an order's last step a document is kept or was removed at exactly one step.
    kept, removed = m["kept"].reshape(32, 120, 5), m["removed"].reshape(32, 120, 5)
    assert (kept[:, :, -1] + removed.sum(axis=2) == 1).all()
    assert (m["removed"] @ m["filter_at"]).sum(axis=1).tolist() == [0, *[120] * 31]
    assert np.array_equal(m["removed"] + m["redundant"], (np.arange(32)[:, None] & (m["filter_at"] @ (1 << np.arange(5)))[None, :] != 0).astype(int))
