"""Phrase collocations by pivot partitioning.

An n-gram belongs to its rarest word, its pivot.  Around every occurrence of a frequent
word, the stretch of more frequent words is cut out as a fragment and routed to that word:
rarer words, and words too rare for any phrase, end it.  The task that holds a word mines
its fragments and emits only n-grams whose pivot the word is, so every n-gram is counted in
one place and nothing is counted twice.

Texts are read once, as blocks of bounded size: a block holds places into the list of its
distinct words.  Words are counted from these lists, and the ids of frequent words, given
by falling count, go back to the blocks by a join.  Equal fragments of a block are counted
before they are routed; pivots with very many occurrences are dealt to several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from masswright.session import ship_package

from .common import stage_table, text_or_empty

#: Bytes of text in a block; a longer document is a block of its own.
BLOCK_BYTES = 8 << 20
#: Occurrences of a pivot a task.
PIVOT_ROWS = 1 << 22
#: Candidates of a language that are ranked in one task.
RANK_ROWS = 100_000
_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_BLANKS = b" \t"


def split_words(data: np.ndarray):
    """Words of UTF-8 bytes, lower-cased in A to Z, and the piece that each is in."""
    import pyarrow as pa

    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    kind = np.zeros(256, np.uint8)
    kind[list(_BLANKS)], kind[list(_SEPARATORS)] = 1, 2
    kinds = kind[data]
    inside = kinds == 0
    edges = np.diff(inside.view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(lower[data[inside]]))
    return words, np.searchsorted(np.flatnonzero(kinds == 2), starts)


def _slices(batch) -> Iterator:
    """(lang, bytes of its texts) in runs of at most BLOCK_BYTES, or one row."""
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
    cuts = [0]
    while cuts[-1] < batch.num_rows:
        done = sizes[cuts[-1] - 1] if cuts[-1] else 0
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(sizes, done + BLOCK_BYTES, side="right"))))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        run = batch.slice(a, b - a)
        for lang in pc.unique(run.column(0)).to_pylist():
            texts = run.column(1).filter(pc.equal(run.column(0), lang))
            if sum(x.nbytes for x in [texts]):
                yield lang, np.frombuffer(b"".join(texts.to_pylist()), np.uint8)


def word_blocks(docs: DataFrame) -> DataFrame:
    """Staged rows (block, lang, words, counts, coded): coded holds a block's words as places into words, -1 between pieces."""

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lang, data in _slices(batch):
                words, piece = split_words(data)
                if not len(words):
                    continue
                coded = words.dictionary_encode()
                places = coded.indices.to_numpy()
                at = np.arange(len(places)) + np.cumsum(np.diff(piece, prepend=piece[:1]) > 0)
                row = np.full(at[-1] + 1, -1, "<i4")
                row[at] = places
                counts = np.bincount(places, minlength=len(coded.dictionary))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block], pa.int64()),
                        pa.array([lang], pa.string()),
                        pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), coded.dictionary),
                        pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), pa.array(counts, pa.int64())),
                        pa.array([len(row)], pa.int64()),
                        pa.array([pa.compress(row.tobytes(), codec="zstd", asbytes=True)], pa.binary()),
                    ],
                    names=["block", "lang", "words", "counts", "n_coded", "coded"],
                )
                block += 1

    # The line feed ends the last piece of a text.
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.concat(text_or_empty(), F.lit("\n")).cast("binary").alias("text"))
    return stage_table(rows.mapInArrow(encode, "block long, lang string, words array<string>, counts array<long>, n_coded long, coded binary"), "phrase-blocks")


def frequent_words(counts: DataFrame, min_count: int) -> DataFrame:
    """Staged rows (id, lang, word, f) of the words of ``counts`` with at least ``min_count``; ids are dense, and a larger id is no more frequent."""
    rows = counts.where(F.col("f") >= min_count).orderBy(F.desc("f"), "lang", "word").withColumn("at", F.monotonically_increasing_id())
    rows = stage_table(rows, "phrase-order").withColumn("part", F.shiftright("at", 33))
    parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return stage_table(rows.join(parts, "part").select((F.col("before") + place).alias("id"), "lang", "word", "f"), "phrase-words")


def pivot_fragments(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """Fragments (key, left, right, n): key holds the pivot's id and, above it, the share of a hot pivot (from 1, else 0); left and right hold two ids each, raised by 1, 0 for none."""
    placed = blocks.select(F.col("block").alias("of"), "lang", F.posexplode("words").alias("place", "word")).join(words, ["lang", "word"]).select("of", "place", "id", "f")
    most = PIVOT_ROWS

    def cut(texts, known):
        import pyarrow as pa

        names = ["key", "left", "right", "n"]
        empty = pa.table({c: pa.array([], pa.int64()) for c in names})
        if not texts.num_rows or not known.num_rows:
            return empty
        coded = np.frombuffer(pa.decompress(texts.column("coded")[0].as_buffer(), decompressed_size=4 * texts.column("n_coded")[0].as_py(), codec="zstd", asbytes=True), "<i4")
        place = known.column("place").to_numpy()
        ids, shares = np.zeros((2, max(int(coded.max()), int(place.max())) + 2), np.int64)
        ids[place] = known.column("id").to_numpy() + 1
        shares[place] = known.column("f").to_numpy() // most
        ids = np.concatenate([[0, 0], ids[coded], [0, 0]])  # 0: a rare word or the end of a piece
        at = np.flatnonzero(ids)
        pivot = ids[at]

        def taken(near: np.ndarray, beside, limit: np.ndarray) -> np.ndarray:
            return np.where((near > 0) & (near <= limit) & beside, near, 0)

        # Equal words belong to the first of them.
        l1 = taken(ids[at - 1], True, pivot - 1)
        l2 = taken(ids[at - 2], l1 > 0, pivot - 1)
        r1 = taken(ids[at + 1], True, pivot)
        r2 = taken(ids[at + 2], r1 > 0, pivot)
        left, right = l2 << 32 | l1, r1 << 32 | r2
        most_shares = shares[coded[at - 2]] + 1
        share = np.where(most_shares > 1, (left * 31 + right) % most_shares + 1, 0)
        some = (l1 > 0) | (r1 > 0)
        table = pa.table({"key": (share << 32 | pivot - 1)[some], "left": left[some], "right": right[some]})
        return table.group_by(names[:3]).aggregate([([], "count_all")]).rename_columns(names).select(names)

    return blocks.select("block", "n_coded", "coded").groupBy("block").cogroup(placed.groupBy("of")).applyInArrow(cut, "key long, left long, right long, n long")


def mine_fragments(fragments: DataFrame, min_count: int) -> DataFrame:
    """Candidates (w1, w2, w3, a) of at least ``min_count``, as ids; w3 is -1 in phrases of two words."""

    def low(c: str) -> Column:
        return F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)) - 1

    def high(c: str) -> Column:
        return F.shiftright(c, 32) - 1

    def phrase(*ids: Column, where: Column) -> Column:
        return F.when(where, F.struct(*[x.alias(f"w{k}") for k, x in enumerate((*ids, F.lit(-1).cast("long"))[:3], 1)]))

    rows = fragments.repartition("key")
    rows = rows.select("key", "n", F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).alias("p"), high("left").alias("l2"), low("left").alias("l1"), high("right").alias("r1"), low("right").alias("r2"))
    l2, l1, p, r1, r2 = (F.col(c) for c in ("l2", "l1", "p", "r1", "r2"))
    owned = [phrase(l1, p, where=l1 >= 0), phrase(p, r1, where=r1 >= 0), phrase(l2, l1, p, where=l2 >= 0), phrase(l1, p, r1, where=(l1 >= 0) & (r1 >= 0)), phrase(p, r1, r2, where=r2 >= 0)]
    rows = rows.select("key", "n", F.explode(F.array(*owned)).alias("phrase")).where("phrase is not null")
    # Fragments of a key are in one task, so this counts without another shuffle.
    mined = rows.groupBy("key", "phrase.w1", "phrase.w2", "phrase.w3").agg(F.sum("n").alias("a"))
    # Only phrases of a hot pivot may still be spread over its shares.
    mined = mined.where((F.col("a") >= min_count) | (F.shiftright("key", 32) > 0))
    return mined.groupBy("w1", "w2", "w3").agg(F.sum("a").alias("a")).where(F.col("a") >= min_count)


def _score(a: str, l: str, r: str) -> Column:  # noqa: E741
    """floor(10**6 * a * a / (l * r)), in decimals of 38 digits."""
    return F.expr(f"cast(1000000 as decimal(38, 0)) * cast({a} as decimal(18, 0)) * cast({a} as decimal(18, 0)) div (cast({l} as decimal(18, 0)) * cast({r} as decimal(18, 0)))")


def score_phrases(candidates: DataFrame, words: DataFrame, cover_percent: int = 50) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates that no longer one covers.

    Parts of a candidate occur at least as often as it, so their counts are all at hand.
    """
    named = candidates
    for k in (1, 2, 3):
        named = named.join(words.select(F.col("id").alias(f"w{k}"), F.col("word").alias(f"word{k}"), F.col("f").alias(f"f{k}"), *(["lang"] if k == 1 else [])), f"w{k}", "left" if k == 3 else "inner")
    named = stage_table(named, "phrase-candidates")
    two, three = named.where("w3 < 0"), named.where("w3 >= 0")
    parts = three.select("w1", "w2", "a").unionByName(three.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
    longer = parts.groupBy("w1", "w2").agg(F.max("a").alias("longer"))
    free = two.join(longer, ["w1", "w2"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * cover_percent))
    free = free.select("lang", F.concat_ws(" ", "word1", "word2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), _score("a", "f1", "f2").alias("score"))
    pairs = two.select("w1", "w2", F.col("a").alias("pair"))
    three = three.join(pairs.withColumnRenamed("pair", "f12"), ["w1", "w2"]).join(pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("pair").alias("f23")), ["w2", "w3"])
    cuts = three.withColumn("first", _score("a", "f1", "f23")).withColumn("second", _score("a", "f12", "f3"))
    early = F.col("first") <= F.col("second")
    cuts = cuts.select(
        "lang",
        F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"),
        "a",
        F.when(early, F.col("f1")).otherwise(F.col("f12")).alias("l"),
        F.when(early, F.col("f23")).otherwise(F.col("f3")).alias("r"),
        F.least("first", "second").alias("score"),
    )
    return free.unionByName(cuts)


def top_phrases(scored: DataFrame, top: int) -> DataFrame:
    """Adds rank and keeps each language's first ``top``: the best of every bounded bucket first, until a language's rest fits a task."""
    best = [F.desc("score"), F.desc("a"), "phrase"]
    rows = stage_table(scored, "phrase-scores")
    while True:
        most = rows.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
        buckets = -(-most // RANK_ROWS)
        if buckets <= 1 or buckets * top >= most:
            break
        first = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(buckets))).orderBy(*best))
        rows = stage_table(rows.withColumn("rank", first).where(F.col("rank") <= top).drop("rank"), "phrase-best")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)


def mine_phrases(docs: DataFrame, min_count: int = 10, top: int = 2000) -> DataFrame:
    """The strongest phrases of two or three words of every language of ``docs`` (text, lang).

    Texts are lower-cased in A to Z, split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and at
    blanks and tabs into words.  A phrase that occurs a >= ``min_count`` times is a
    candidate; cut in two parts of l and r occurrences its score is
    floor(10**6 * a * a / (l * r)), the lowest of its cuts, the first of equal ones.
    Candidates inside a longer one with at least half their occurrences go.  Returns lang,
    rank, phrase, a, l, r, n (the language's words) and score, ranked by score, a (both
    falling) and the phrase's bytes.

    A null text counts as empty, a null language as ``und``.  Every row counts, repeated
    rows too, and doc_id is not looked at.  Languages without candidates and empty tables
    give no rows.  Other columns are ignored.
    """
    ship_package(docs.sparkSession)
    blocks = word_blocks(docs)
    words = F.explode(F.arrays_zip("words", "counts"))
    counts = blocks.select("lang", words.alias("x")).groupBy("lang", F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("f"))
    totals = blocks.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = frequent_words(counts, min_count)
    candidates = mine_fragments(pivot_fragments(blocks, frequent), min_count)
    ranked = top_phrases(score_phrases(candidates, frequent), top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
