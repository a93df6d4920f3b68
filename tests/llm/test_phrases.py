"""Phrase mining against counts of every phrase."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from masswright.llm import phrases

from .test_operators import CLASHES, WORDS, bag


def brute(docs, min_count=10, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in (1, 2, 3):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {g for g, a in f.items() if len(g) > 1 and a >= min_count}
        rows = []
        for g in found:
            a = f[g]
            if any(len(h) > len(g) and 100 * f[h] >= 50 * a and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1)) for h in found):
                continue
            score, _, l, r = min((10**6 * a * a // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            rows.append((-score, -a, " ".join(g).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out, key=repr)


def texts():
    rng = random.Random(11)
    rows = []
    for i in range(150):
        words = [rng.choice(WORDS[: 12 if i % 3 else 40]) for _ in range(rng.randint(0, 60))]
        words = [w.upper() if rng.random() < 0.1 else w + rng.choice([".", ", ", "!", "\n", "\t"]) if rng.random() < 0.1 else w for w in words]
        rows.append((rng.choice(["  ", " "]).join(words), rng.choice(["en", "en", "en", "fr", None])))
    rows += [("a a a a a a a a a a a a", "en"), ("x x y x x y " * 8, "en"), (None, "en"), ("", None), (" \t.,;", "de"), ("Été É Été É " * 12, "fr"), ("東京 \U0001f600 東京 \U0001f600, " * 9 + "東京 \U0001f600", "ja"), ("lone", "zz"), ("und too " * 11, "und"), ("one two three four", "en")]
    return rows + [("the very same passage of words in a copy", "en")] * 25


@pytest.mark.parametrize("small", [False, True])
def test_phrases_equal_counts_of_all(spark, monkeypatch, small):
    if small:  # many blocks, hot pivots and ranking rounds
        monkeypatch.setattr(phrases, "BLOCK_BYTES", 500)
        monkeypatch.setattr(phrases, "PIVOT_ROWS", 20)
        monkeypatch.setattr(phrases, "RANK_ROWS", 30)
    top = 12 if small else 2000
    rows = texts()
    df = spark.createDataFrame(rows, "text string, lang string").select(F.lit(1).alias("doc_id"), "*", *[F.lit(3).alias(c) for c in (*CLASHES, "w1", "phrase", "counts", "a", "f")])
    found = phrases.mine_phrases(df, top=top)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = bag(found)
    assert got == brute(rows, top=top) and len({r[0] for r in got}) == 4


def test_lower_bounds_and_empty_tables(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "text string, lang string")
    assert bag(phrases.mine_phrases(df, min_count=2)) == brute(rows, min_count=2)
    assert phrases.mine_phrases(df.limit(0)).count() == 0
    assert phrases.mine_phrases(df, min_count=10_000).count() == 0


def test_scores_pass_64_bits(spark):
    row = spark.range(1).selectExpr("4000000000000L a", "5000000000000L l", "6000000000001L r").select(phrases._score("a", "l", "r")).first()
    assert row[0] == 10**6 * 4000000000000**2 // (5000000000000 * 6000000000001)
