"""The mixture against a simulated run of the queues."""

import hashlib
import re
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from masswright.llm import mixing

from .test_operators import CLASHES, bag, corpus, table


def shares(sizes, max_repeats):
    """Targets by sharing the excess again and again, in fractions."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, free, left = {}, set(order), Fraction(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level >= max_repeats * sizes[s]}
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: Fraction(max_repeats * sizes[s]) for s in over}
        left -= sum(max_repeats * sizes[s] for s in over)
        free -= over
    return order, target


def simulate(docs, max_repeats=3):
    rows = []
    for k, (doc_id, text, source) in enumerate(docs):
        digest = hashlib.md5((text or "").encode()).hexdigest()
        key = int(hashlib.md5(f"mixture-1:{'null' if doc_id is None else doc_id}:{digest}".encode()).hexdigest()[:15], 16)
        rows.append((source, key, doc_id is not None, doc_id or 0, digest, len(re.findall(r"[^\x20\x09-\x0D]+", text or "")), k))
    sizes, upto, ends = defaultdict(int), defaultdict(int), []
    for r in rows:
        sizes[r[0]] += r[5]
    order, target = shares(sizes, max_repeats)
    for turn in range(max_repeats):
        for r in sorted(rows, key=lambda r: r[1:]):
            if r[5]:
                upto[r[0]] += r[5]
                ends.append((upto[r[0]] / target[r[0]], order.index(r[0]), upto[r[0]], r[5], r[6]))
    left, taken = sum(sizes.values()), [0] * len(rows)
    for _, _, _, size, k in sorted(ends):
        taken[k] += min(size, left)
        left -= min(size, left)
    return [(docs[r[6]][0], r[5], sizes[r[0]], float(target[r[0]]), taken[r[6]]) for r in rows]


def near(rows):
    return sorted(((*r[:3], round(r[3], 6), r[4]) for r in rows), key=repr)


@pytest.mark.parametrize("per_bucket", [20_000, 3])
def test_the_mix_is_the_served_queue(spark, per_bucket, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 2)
    rows = corpus()
    rows += [[None, "the same row", "en", "web", 1]] * 7 + [[400 + i, "tiny source", "en", "a", 1] for i in range(5)] + [[500, "", "en", "blank", 1], [501, None, "en", "blank", 1]]
    rows += [[600 + i, "w " * (i % 9), "fr", "b", 1] for i in range(80)]
    found = mixing.mix_documents(table(spark, rows), rows_per_bucket=per_bucket)
    assert found.columns == ["doc_id", "size", "source_size", "target", "taken"]
    got = bag(found)
    assert near(got) == near(simulate([(r[0], r[1], r[3]) for r in rows]))
    assert sum(r[4] for r in got) == sum(r[1] for r in got) and all(0 <= r[4] <= 3 * r[1] for r in got)
    again = mixing.mix_documents(table(spark, rows).repartition(7), rows_per_bucket=per_bucket)
    assert bag(again) == got


def test_capped_sources_share_their_excess(spark):
    rows = [[i, "x y z", "en", "abc"[i % 3] if i < 6 else "d", 1] for i in range(40)] + [[99, "one two", "en", None, 1]]
    got = bag(mixing.mix_documents(table(spark, rows, extra=False)))
    assert near(got) == near(simulate([(r[0], r[1], r[3]) for r in rows]))
    targets = {(r[2], round(r[3], 6)) for r in got}
    assert (6, 18.0) in targets or (2, 6.0) in targets


def test_tables_without_words_or_rows(spark):
    docs = table(spark, [[1, "", "en", "a", 0], [2, None, "en", None, 0], [3, " \n", "en", "a", 0]])
    assert bag(mixing.mix_documents(docs)) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0), (3, 0, 0, 0.0, 0)]
    assert mixing.mix_documents(docs.limit(0)).count() == 0
    one = table(spark, [[1, "a b c d", "en", "a", 0]]).select("doc_id", "text", "source", *CLASHES, F.lit("z").alias("target"))
    assert bag(mixing.mix_documents(one)) == [(1, 4, 4, 4.0, 4)]
